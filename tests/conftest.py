import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from fennelmill.session import local_session

    folder = tempfile.mkdtemp(prefix="fennelmill-test-")
    session = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.driver.memory": "4g", "spark.default.parallelism": "4"})
    yield session
    session.stop()
