"""Session settings, and shipping this package to executors."""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings the plans here are written for. Adaptive execution sizes shuffles and splits skewed joins at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_shipped: set[str] = set()


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").config(map=SETTINGS | {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | settings)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: the sources go to the cluster as one archive, once."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix=f"{root.name}-", suffix=".zip", delete=False) as f:
        with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as archive:
            for p in sorted(root.rglob("*.py")):
                archive.write(p, p.relative_to(root.parent))
    atexit.register(Path(f.name).unlink, missing_ok=True)  # the driver serves it to executors as long as it runs
    spark.sparkContext.addPyFile(f.name)
    _shipped.add(application)
