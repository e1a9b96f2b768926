"""The best matches of each row against a plain loop, with ties and frequent tokens."""

import random
import re

import pytest

from fennelmill.operators import matching, tasks


def tokens(text):
    return set(re.findall("[一-龥ぁ-んァ-ンa-zA-Z0-9]+", text or ""))


def plain(left, pool, least, most):
    out = {}
    for k, text in left:
        found = sorted((-len(tokens(text) & tokens(t)), p) for p, t in pool)
        out |= {(k, i): (p, -s) for i, (s, p) in enumerate([f for f in found if -f[0] >= least][:most], 1)}
    return out


@pytest.mark.parametrize("least, most", [(2, 3), (1, 5), (2, 1), (3, 2)])
def test_equal_to_a_plain_loop(spark, least, most):
    rng = random.Random(least * 10 + most)
    words = [f"w{i}" for i in range(30)]
    line = lambda n: " ".join(rng.choices(words, weights=[30 - i for i in range(30)], k=n))
    left = [(i, line(rng.randint(0, 8))) for i in range(40)] + [(90, None), (91, ""), (92, "unheard of words"), (93, "w1")]
    pool = [(i, line(rng.randint(0, 12))) for i in range(120)] + [(500, None), (501, "w0 w1 w2 w3 w4 w5"), (502, "w0 w1 w2 w3 w4 w5")]
    a, b = spark.createDataFrame(left, "k int, t string").repartition(3), spark.createDataFrame(pool, "p int, t string").repartition(4)
    got = {(r.k, r.place): (r.match, r.score) for r in matching.best_matches(a, b, "k", "t", "p", "t", least=least, most=most).collect()}
    assert got == plain(left, pool, least, most)
    assert matching.best_matches(a.where("false"), b, "k", "t", "p", "t").count() == matching.best_matches(a, b.where("false"), "k", "t", "p", "t").count() == 0


def test_tasks_hold_the_best_products_in_order(spark):
    trends = spark.createDataFrame([(0, "red toy car"), (1, "nothing like it"), (2, "blue")], "pos int, query string")
    products = spark.createDataFrame([("a", "toy car"), ("b", "red toy car set"), ("c", "red car"), ("d", "toy")], "item_id string, title string")
    [task] = tasks.tasks_for_trends(trends, products, "2024-02-01").collect()
    assert (task.pos, task.task_id, task.item_ids, task.theme) == (0, "2024-02-01-red-toy-car", ["b", "a", "c"], "red toy car: compared")


def test_pool_rows_are_scored_where_they_are_read(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randint(0, 40)}" for _ in range(n))
    a, b = spark.createDataFrame([(i, text(6)) for i in range(20)], "k int, t string"), spark.createDataFrame([(i, text(9)) for i in range(200)], "p int, t string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = matching.best_matches(a, b, "k", "t", "p", "t")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(at" not in plan and not re.search(r"hashpartitioning\(l#\w+, at", plan)


def test_large_left_sides_are_shuffled_with_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(matching, "MOST_BROADCAST", 0)
    test_equal_to_a_plain_loop(spark, 2, 3)
    test_equal_to_a_plain_loop(spark, 2, 1)


def test_repeated_keys_give_a_match_once(spark):
    a = spark.createDataFrame([(1, "red toy"), (1, "toy car")], "k int, t string")
    b = spark.createDataFrame([(7, "red toy car"), (7, "toy red"), (8, "toy car")], "p int, t string")
    assert sorted((r.place, r.match, r.score) for r in matching.best_matches(a, b, "k", "t", "p", "t").collect()) == [(1, 7, 3), (2, 8, 2)]
