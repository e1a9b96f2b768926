"""Arrivals and rank jumps over streams whose state never expires: what the batch operators give, batch by batch.

State is kept of each item code, for good, in buckets of codes. It begins with the snapshot of the last batch run, so a deployment can go over from runs
to a stream, and a query that goes on from its checkpoint knows every code it has met.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fennelmill.functions import scalars as S
from fennelmill.operators import signals


def use_state(spark: SparkSession) -> None:
    """State of any size needs a store on disk; a session that names one keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Parts into which item codes are dealt: a part is one group of a stream, so that its rows and state go to Python at once.
#: The number is fixed for the life of a checkpoint.
BUCKETS = 2048
_BUCKET = "__bucket"


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn(_BUCKET, F.pmod(F.xxhash64("item_code"), F.lit(BUCKETS)).cast("int"))


def _some(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames that have rows: where a bucket has more initial state than rows, frames come without any row or column."""
    return (part.drop(columns=_BUCKET, errors="ignore") for part in rows if len(part))


class FirstSeen(StatefulProcessor):
    """Marks the first row of each code, by ``pos``, unless the code has been met before.

    A group is a bucket of codes. Its state is the list of codes met, to which only new ones are added; of a batch it holds one
    row for each new code. Rows without a ``pos`` come last. Of a code's rows at one ``pos`` the least by the other columns,
    in order of their names, is first: the shuffle brings them in any order.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.met = handle.getListState("met", "codes ARRAY<STRING>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        met = pd.Index([c for (codes,) in self.met.get() for c in codes] if self.met.exists() else [], dtype=object)
        first = None
        for part in _some(rows):
            known = met.get_indexer(part["item_code"]) >= 0
            fresh = part[~known] if first is None else pd.concat([first, part[~known]], ignore_index=True)
            tied = fresh.duplicated(["item_code", "pos"]).any()
            fresh = fresh.sort_values(["pos", *sorted(fresh.columns.drop("pos"))] if tied else "pos", kind="stable")
            again = fresh.duplicated("item_code")
            first = fresh[~again]
            for others in (part[known], fresh[again]):
                if len(others):
                    yield others.assign(is_new=False)
        if first is not None and len(first):
            self.met.appendValue((first["item_code"].tolist(),))
            yield first.assign(is_new=True)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        if len(initialState):
            self.met.appendValue((initialState["item_code"].tolist(),))

    def close(self) -> None:
        pass


class LastRank(StatefulProcessor):
    """Says of each ranked row what rank its code had in the run before; rows of one run don't count for each other.

    A group is a bucket of codes; its state is the rank of each code in the last two runs that it was in.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ranks = handle.getValueState("ranks", "codes ARRAY<STRING>, runs ARRAY<BIGINT>, ranks ARRAY<INT>")

    def _held(self) -> pd.DataFrame:
        codes, runs, ranks = self.ranks.get() if self.ranks.exists() else ([], [], [])
        return pd.DataFrame({"item_code": pd.Series(codes, dtype=object), "run": pd.Series(runs, dtype="int64"), "rank": pd.Series(ranks, dtype="int64")})

    def _hold(self, held: pd.DataFrame) -> None:
        self.ranks.update((held["item_code"].tolist(), held["run"].tolist(), held["rank"].tolist()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(_some(rows))
        if not parts:
            return
        batch = pd.concat(parts, ignore_index=True).sort_values(["item_code", "run", "pos"], ignore_index=True)
        code_run = ["item_code", "run"]
        now = batch[[*code_run, "rank"]].drop_duplicates(code_run, keep="last").astype({"run": "int64", "rank": "int64"})
        runs = pd.concat([self._held(), now], ignore_index=True).drop_duplicates(code_run, keep="last").sort_values(code_run, ignore_index=True)
        before = runs.shift(1)
        follows = (before["item_code"] == runs["item_code"]) & (before["run"] == runs["run"] - 1)
        was = runs.assign(was=before["rank"].where(follows, signals.UNRANKED).astype("int64"))
        yield batch.merge(was[[*code_run, "was"]], on=code_run, how="left")
        self._hold(runs.groupby("item_code", sort=False).tail(2))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        if len(initialState):
            self._hold(pd.concat([self._held(), initialState[["item_code", "run", "rank"]]], ignore_index=True))

    def close(self) -> None:
        pass


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def stream_arrivals(feed: DataFrame, history: DataFrame, announced: str = signals.ANNOUNCED, collaboration: str = signals.COLLABORATION) -> DataFrame:
    """Over a stream of a feed the signals that :func:`signals.arrivals` gives over all of it, each micro-batch's rows by ``pos``.

    Of a code's rows at one ``pos`` only one is new here. Rows of earlier micro-batches count as earlier. Rows without a code are
    always new and need no state. ``history`` is read once, when a query begins without a checkpoint.
    """
    use_state(feed.sparkSession)
    code = S.truthy("item_code")
    start = _bucketed(history.where("item_code is not null").select("item_code").distinct()).groupBy(_BUCKET)
    coded = _bucketed(feed.where(code.isNotNull())).groupBy(_BUCKET).transformWithStateInPandas(FirstSeen(), _with(feed.schema, "is_new", T.BooleanType()), "Append", "None", start)
    return signals.arrival_signals(coded.unionByName(feed.where(code.isNull()).withColumn("is_new", F.lit(True))), announced, collaboration)


def stream_jumps(ranking: DataFrame, last: DataFrame, last_run: int) -> DataFrame:
    """Over a stream of rankings, numbered by ``run`` without gaps, the signals that :func:`signals.rank_jumps` gives run by run.

    ``last`` are the ranks that held after ``last_run``. A run may come in several micro-batches, but not after a later one.
    Rows without a code were never ranked; rows without a rank are dropped.
    """
    use_state(ranking.sparkSession)
    rows = ranking.where("rank is not null")
    ranked = last.where("item_code is not null and rank is not null").groupBy("item_code").agg(F.max("rank").alias("rank"))
    start = _bucketed(ranked.select("item_code", F.lit(last_run).cast("long").alias("run"), F.col("rank").cast("int").alias("rank"))).groupBy(_BUCKET)
    coded = _bucketed(rows.where("item_code is not null")).groupBy(_BUCKET).transformWithStateInPandas(LastRank(), _with(ranking.schema, "was", T.IntegerType()), "Append", "None", start)
    return signals.jump_signals(coded.unionByName(rows.where("item_code is null").withColumn("was", F.lit(signals.UNRANKED))))
