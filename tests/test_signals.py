from datetime import datetime

from fennelmill.operators import signals

FEED = "pos int, item_code string, title string, url string, image string, price long"


def feed(spark, *rows):
    return spark.createDataFrame([(i, c, t, None, None, 1) for i, (c, t) in enumerate(rows)], FEED)


def history(spark, *codes):
    return spark.createDataFrame([(c, datetime(2024, 1, 1), "old") for c in codes], "item_code string, seen_at timestamp_ntz, title string")


def kinds(df):
    return [(r.pos, r.type, r.score) for r in df.orderBy("pos").collect()]


def test_arrivals_scores_and_repeats(spark):
    rows = feed(spark, ("a", "x"), ("a", "x"), (None, "x"), (None, "x"), ("", "x"), ("", "x"), ("k", "予約 x"), ("k2", "コラボ x"), ("n", "予約 コラボ"), ("k", "限定 予約"), ("m", "２０２５年１０月発売"), ("z", "9×17 cm"), ("q", None))
    got = kinds(signals.arrivals(rows, history(spark, "k", "k2")))
    assert got == [(0, "new_arrival", 3.0), (2, "new_arrival", 3.0), (3, "new_arrival", 3.0), (4, "new_arrival", 3.0), (5, "new_arrival", 3.0), (6, "preorder", 5.0), (8, "new_arrival", 12.0), (9, "preorder", 9.0), (10, "new_arrival", 8.0), (11, "new_arrival", 7.0), (12, "new_arrival", 3.0)]


def test_rank_jumps_thresholds(spark):
    ranking = spark.createDataFrame([(i, r, c, "t", None, None, 1) for i, (c, r) in enumerate([("new80", 80), ("new81", 81), ("to20", 20), ("to19", 19), (None, 5), ("norank", None)])], "pos int, rank int, item_code string, title string, url string, image string, price long")
    last = spark.createDataFrame([("to20", 40), ("to19", 40)], "item_code string, rank int")
    got = [(r.item_code, r.jump, r.score) for r in signals.rank_jumps(ranking, last).orderBy("pos").collect()]
    assert got == [("new80", 21, 15.5), ("to19", 21, 15.5), (None, 96, 53.0)]


def test_top_signal_ties_and_fallback(spark):
    rows = spark.createDataFrame([("sudden_jump", "b", 7.0, 1, 0), ("new_arrival", "c", 7.0, 0, 5), ("new_arrival", "a", 7.0, 0, 2)], "type string, item_code string, score double, branch int, pos long").selectExpr("*", "'t' title")
    assert signals.top_signal(rows).first().item_code == "a"
    none = signals.top_signal(rows.where("false"), "nothing").collect()
    assert [(r.type, r.title, r.score) for r in none] == [("standard", "nothing", 0.0)]


def test_state_moves_on_and_is_idempotent(spark):
    rows = feed(spark, ("a", "one"), ("a", "two"), (None, "x"), ("", "y"))
    now = datetime(2024, 2, 1)
    once = signals.next_history(history(spark, "old"), rows, now)
    twice = signals.next_history(once, rows, now)
    want = [("a", now, "two"), ("old", datetime(2024, 1, 1), "old")]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want
    assert signals.arrivals(rows.where("item_code = 'a'"), once).count() == 0


def test_ranks_last_row_wins_and_missing_feed(spark):
    ranking = spark.createDataFrame([(0, 3, "a"), (1, 9, "a"), (2, 1, None)], "pos int, rank int, item_code string")
    last = spark.createDataFrame([("z", 1)], "item_code string, rank int")
    assert [tuple(r) for r in signals.next_ranks(ranking, last).collect()] == [("a", 9)]
    assert signals.next_ranks(None, last).count() == 0
    assert signals.next_ranks(None, last, keep_when_missing=True).count() == 1
