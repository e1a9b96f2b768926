"""The indexed search against a plain loop over all pairs."""

import math
import random

import pytest

from fennelmill.operators import matching


def least_errors(pattern, text):
    """The fewest errors of a match that starts where the text does."""
    row = [0] + list(range(1, len(text) + 1))
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def chunk_score(pattern, text, at, threshold, distance):
    scores = [least_errors(pattern, text[x : x + 2 * len(pattern)]) / len(pattern) + abs(x - at) / distance for x in range(len(text))]
    best = min(scores, default=math.inf)
    return max(matching.LEAST_SCORE, best) if best <= threshold + 1e-12 else None


def plain(rows, queries, weights, threshold=0.4, location=0, distance=1000):
    out = {}
    for q in {x.lower() for x in queries if x}:
        starts = [i * 32 if i < -(-len(q) // 32) - 1 else max(0, len(q) - 32) for i in range(-(-len(q) // 32))]
        for key, *columns in rows:
            total, any_column = 0.0, False
            for text, w in zip(columns, weights):
                text = (text or "").lower()
                found = [chunk_score(q[s : s + 32], text, location + s, threshold, distance) for s in starts] if text else [None]
                if all(f is None for f in found):
                    continue
                any_column = True
                score = matching.EQUAL_SCORE if text == q else sum(1 if f is None else f for f in found) / len(starts)
                total += math.log(score) * w / sum(weights) * round(1 / math.sqrt(max(1, len(text.split(" ")) - text.split(" ").count(""))), 3)
            if any_column:
                out[key, q] = round(math.exp(total), 8)
    return out


@pytest.mark.parametrize("options", [{}, {"threshold": 0.25, "location": 5, "distance": 20}, {"threshold": 0.0}, {"threshold": 0.6, "distance": 100}])
def test_equal_to_a_plain_loop(spark, options):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    rows = [(i, " ".join(word(rng.randint(1, 7)) for _ in range(rng.randint(1, 8))), rng.choice([None, "", word(3), word(12).upper()])) for i in range(40)]
    rows += [(90, "𝒳y z " + "x" * 600 + " abcab", "abcab"), (91, "abcde " * 14, None), (92, None, None)]
    queries = [word(n) for n in (1, 2, 3, 3, 4, 5, 5, 6, 8, 11)] + ["", None, "ABCAB", "abcab", "𝒳y", "abcde " * 9, "abcde abxde abcde abcde abcde abcde abcd", "a" * 33]
    df = spark.createDataFrame(rows, "id int, title string, body string").repartition(3)
    asked = spark.createDataFrame([(q,) for q in queries], "q string")
    got = {(r.id, r.q): round(r.score, 8) for r in matching.search(df, asked, "id", "q", {"title": 3.0, "body": 1.0}, **options).collect()}
    assert got == pytest.approx(plain(rows, queries, (3.0, 1.0), **options), abs=1e-7)


def test_no_pair_is_made_without_a_shared_piece(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "id int, title string")
    found = matching.search(df, spark.createDataFrame([("alhpa",), ("zzz",)], "q string"), "id", "q", {"title": 1.0})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert [(r.id, r.q) for r in found.collect()] == [(1, "alhpa")]
    none = matching.search(df.where("false"), spark.createDataFrame([], "q string"), "id", "q", {"title": 1.0})
    assert none.count() == 0


def test_rows_of_equal_texts_are_scored_once(spark):
    """Rows meet their scores in a join alone: nothing is grouped by rows, however many share their texts."""
    df = spark.createDataFrame([(i, "alpha beta", "Gamma" if i % 2 else None) for i in range(6)], "id int, title string, body string")
    found = matching.search(df, spark.createDataFrame([("alpha",), ("gamma",)], "q string"), "id", "q", {"title": 1.0, "body": 1.0})
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.q) for r in found.collect()) == sorted([(i, "alpha") for i in range(6)] + [(i, "gamma") for i in (1, 3, 5)])
