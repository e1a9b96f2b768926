"""Arrivals and rank jumps over streams (extensions; the batch operators define what is right)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fennelmill.operators import signals
from fennelmill.sources.files import Snapshots


def first_seen(items: DataFrame, key: str, event_time: str, late: str = "1 day") -> DataFrame:
    """Each key's first event in a stream; state for a key goes when the watermark has passed it."""
    return items.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def counts_by_window(items: DataFrame, event_time: str, key: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events of each key in tumbling or sliding windows, with late events up to the watermark."""
    window = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    return items.withWatermark(event_time, late).groupBy(window, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def jump_batches(spark: SparkSession, ranks: Snapshots, emit: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each micro-batch is one ranking, compared with the snapshot of the one before.

    The snapshot is named by the batch, so a batch that is repeated after a failure compares with the same ranks again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        current = ranks.current()
        last = ranks.read() if current != f"batch-{batch_id}" else spark.read.schema(ranks.schema).parquet(f"{ranks.root}/run_id=batch-{batch_id - 1}") if batch_id else ranks.read().limit(0)
        emit(signals.rank_jumps(batch, last), batch_id)
        ranks.write(signals.next_ranks(batch, last), f"batch-{batch_id}", datetime.fromtimestamp(batch_id))

    return run
