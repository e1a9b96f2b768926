"""Streams with state against the batch operators, over several micro-batches and restarts."""

import random

import duckdb
import pandas as pd
import pytest

from fennelmill import schemas
from fennelmill.operators import signals
from fennelmill.plans.queries import QUERIES
from fennelmill.streaming import state

FEED = "pos long, item_code string, title string, url string, image string, price long"
RANKED = "run long, pos long, rank int, item_code string, title string, url string, image string, price long"


class Polled:
    """A stream over a folder, begun anew from its checkpoint for each slice of rows."""

    def __init__(self, spark, folder, schema, make):
        self.spark, self.folder, self.schema, self.make, self.turn = spark, folder, schema, make, 0

    def run(self, rows):
        self.spark.createDataFrame(rows, self.schema).repartition(2).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.make(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"))
        query = stream.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None

    def rows(self):
        return sorted(map(tuple, self.spark.read.parquet(f"{self.folder}/out").collect()), key=repr)


def test_arrivals_over_restarts_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", *(f"c{k}" for k in range(60))]), rng.choice(["新発売 x", "a×b", "plain", None]), "u", None, i) for i in range(400)]
    history = spark.createDataFrame([(f"c{k}", None, None) for k in range(0, 60, 4)] + [(None, None, None)], schemas.HISTORY)
    polled = Polled(spark, tmp_path, FEED, lambda s: state.stream_arrivals(s, history))
    for at in range(0, 400, 150):
        some = rows[at : at + 150]
        polled.run(rng.sample(some, len(some)))
    assert polled.rows() == sorted(map(tuple, signals.arrivals(spark.createDataFrame(rows, FEED), history).collect()), key=repr)


def test_jumps_over_restarts_are_those_of_each_run(spark, tmp_path):
    rng = random.Random(4)
    runs = {r: [(r, i, rng.choice([None, *range(1, 100)]), rng.choice([None, *(f"c{k}" for k in range(40))]), "t", None, None, 1) for i in range(50)] for r in (8, 9, 10)}
    last = spark.createDataFrame([(f"c{k}", k + 40) for k in range(0, 40, 3)] + [(None, 5)], schemas.RANKS)
    polled = Polled(spark, tmp_path, RANKED, lambda s: state.stream_jumps(s, last, 7))
    polled.run(runs[8])
    polled.run(runs[9][:20])
    polled.run(runs[9][20:] + runs[10])
    want, before = [], last
    for r in (8, 9, 10):
        now = spark.createDataFrame(runs[r], RANKED)
        want += map(tuple, signals.rank_jumps(now, before).collect())
        before = signals.next_ranks(now.where("rank is not null"), before)
    assert polled.rows() == sorted(want, key=repr)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, None)]])
def test_streams_of_few_rows(spark, tmp_path, rows):
    polled = Polled(spark, tmp_path, FEED, lambda s: state.stream_arrivals(s, spark.createDataFrame([], schemas.HISTORY)))
    polled.run(rows)
    assert len(polled.rows()) == len(rows)


class Held:
    """State of one group, kept in the process."""

    def __init__(self):
        self.values = []

    getListState = getValueState = lambda self, name, schema: self
    exists = lambda self: bool(self.values)
    get = lambda self: iter(self.values) if len(self.values[0]) == 1 else self.values[-1]
    appendValue = update = lambda self, value: self.values.append(value)


def test_codes_go_to_the_state_in_buckets():
    """One call takes rows of many codes, in several frames and batches."""
    met = state.FirstSeen()
    met.init(Held())
    frame = lambda rows: pd.DataFrame(rows, columns=["pos", "item_code"])
    out = lambda *frames: sorted((int(p), c, bool(n)) for f in met.handleInputRows((1,), iter(frames), None) for p, c, n in f.itertuples(index=False))
    met.handleInitialState((1,), frame([(0, "z")]), None)
    assert out(frame([(5, "a"), (4, "b"), (3, "z")]), frame([(2, "a"), (6, "b"), (7, "c")])) == [(2, "a", True), (3, "z", False), (4, "b", True), (5, "a", False), (6, "b", False), (7, "c", True)]
    assert out(frame([(8, "c"), (9, "d")])) == [(8, "c", False), (9, "d", True)]


def test_ranks_go_to_the_state_in_buckets():
    last = state.LastRank()
    last.init(Held())
    frame = lambda rows: pd.DataFrame(rows, columns=["run", "pos", "item_code", "rank"])
    out = lambda *frames: sorted((r, p, int(was)) for f in last.handleInputRows((1,), iter(frames), None) for r, p, _, _, was in f.itertuples(index=False))
    assert out(frame([(1, 0, "a", 50), (1, 1, "b", 60)]), frame([(1, 2, "a", 40), (2, 3, "a", 30)])) == [(1, 0, 101), (1, 1, 101), (1, 2, 101), (2, 3, 40)]
    assert out(frame([(2, 4, "a", 20), (3, 5, "a", 10), (3, 6, "b", 5)])) == [(2, 4, 40), (3, 5, 20), (3, 6, 101)]


def test_first_of_rows_at_one_position_does_not_hang_on_their_order():
    rows = [(4, "a", "t", None, 9), (4, "a", "t", None, 7), (4, "a", None, "u", 8), (5, "a", "s", None, 1), (None, "b", "t", None, 3), (6, "b", "t", None, 4)]
    for turn in range(40):
        mixed = random.Random(turn).sample(rows, len(rows))
        met = state.FirstSeen()
        met.init(Held())
        frames = [pd.DataFrame(part, columns=["pos", "item_code", "title", "url", "price"]) for part in (mixed[: turn % 6], mixed[turn % 6 :])]
        out = pd.concat(met.handleInputRows((1,), iter(frames), None))
        assert len(out) == len(rows) and sorted(out[out["is_new"]]["price"]) == [4, 7]


def test_arrivals_of_odd_lines_are_those_of_the_sql(spark, tmp_path):
    """Lines whose part the table lacks, and lines without a part, an order or a price."""
    con, rng = duckdb.connect(), random.Random(5)
    lines = [(i, rng.choice([None, *range(-4, 160)]), i % 7 + 1, rng.choice([None, 10.5, 99.0])) for i in range(1, 500)]
    lines += [(None, k, 1, 5.0) for k in (None, None, 50, 4, 5, 6, 300, 301, 303)]
    con.execute("create table lineitem (l_orderkey bigint, l_partkey bigint, l_linenumber int, l_extendedprice double)")
    con.execute("create table part as select i as p_partkey, if(i % 7 = 0, null, 'ring ' || i) as p_name, if(i % 5 = 0, 'PROMO', null) as p_type from range(100) t(i)")
    con.executemany("insert into lineitem values (?, ?, ?, ?)", lines)
    for t in ("lineitem", "part"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    q = QUERIES["d1_stream_arrivals"]
    want = con.sql(q.sql)
    got = [tuple(r) for r in q.run(spark, str(tmp_path)).select(*want.columns).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)
