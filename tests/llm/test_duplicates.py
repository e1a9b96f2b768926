"""Near-duplicates of texts and of vectors against all pairs."""

import random
import re

import numpy as np

from fennelmill.llm import rpforest, sketch_dedup
from fennelmill.llm.components import components

DOC = "doc_id long, text string, n int, bands string"


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, i) for i in range(201, 240)] + [(5, 5)]
    want = {i: r for i, r in roots({x for e in links for x in e}, links).items() if any(i in e and e[0] != e[1] for e in links)}
    got = components(spark.createDataFrame([*links, (None, 3), (3, None)], "a long, b long")).collect()
    assert {r.id: r.component for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, roots(ids, links)


def near_texts():
    """Groups of edited copies around the threshold, boilerplate shared by many, and short texts."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, passage = [], [word() for _ in range(45)]
    for g in range(12):
        base = [word() for _ in range(60)]
        for k in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(60)] = word()
            rows.append(" ".join(copy).upper() if k % 5 == 0 else " ".join(copy))
    rows += [" ".join(passage + [word() for _ in range(rng.randint(8, 25))]) for _ in range(60)]
    rows += ["", None, "  \n ", "one two", "ONE\ttwo", "one two three four five", "é É", "é é", "x " * 3000, "x " * 2999]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def test_documents_against_all_pairs(spark):
    rows = near_texts()
    sets, want = brute(rows)
    rows += [rows[0], (None, rows[1][1]), (None, None)]
    df = spark.createDataFrame([(i, t, 1, "own") for i, t in rows], DOC).repartition(5)
    got = sketch_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    left = sketch_dedup.drop_duplicates(df).collect()
    assert {r.doc_id for r in left} == {None, *want.values()} and left[0].bands == "own"
    assert sketch_dedup.near_duplicates(df.where("false")).count() == 0 and sketch_dedup.drop_duplicates(df.where("false")).count() == 0


def test_an_id_with_several_texts_under_any_order(spark):
    """Links of any text of an id join its component, however rows are ordered and dealt."""
    one, two = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(100)]
    near = lambda words, k: " ".join([*words[:k], "x", *words[k + 1 :]])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (3, near(two, 99)), (2, near(one, 99)), (5, "c d e f g h"), (5, None), (7, "c d e f g h"), (8, ""), (8, " ".join(one)), (None, "n"), (None, " ".join(two))]
    want = {1: 1, 2: 1, 3: 1, 5: 5, 7: 5, 8: 1, None: None}
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        for parts in (1, 4):
            got = sketch_dedup.near_duplicates(spark.createDataFrame([(i, t, 1, "own") for i, t in order], DOC).repartition(parts)).collect()
            assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == set(want.items())
            assert all(r.kept == (r.doc_id in (None, 1, 5)) for r in got)
            assert sorted(str((r.doc_id, r.n_shingles)) for r in got) == sorted(str((i, len(shingles(t)))) for i, t in rows)


def test_rest_is_exact_without_pivots(spark):
    """The exact search alone finds what all pairs find, whatever components it starts from."""
    rows = [(i, t) for i, t in near_texts() if t and t.strip()]
    _, want = brute(rows)
    docs = spark.createDataFrame(rows, "id long, text string")
    found = sketch_dedup._rest_links(docs.selectExpr("id", "id component"), docs, 75)
    links = [(r.a, r.b) for r in found.collect()]
    assert roots([i for i, _ in rows], links) == want


def test_rest_meets_large_components_group_by_group(spark, monkeypatch):
    """Components of some members each, met in groups of four; who links with none of the first group meets the others."""
    monkeypatch.setattr(sketch_dedup, "_SMALL", 2)
    monkeypatch.setattr(sketch_dedup, "_GROUP", 4)
    rows = [(i, t) for i, t in near_texts() if t and t.strip()]
    base = [f"b{k}" for k in range(60)]
    rows += [(1000 + k, " ".join([*base[:k], f"e{k}", *base[k + 1 :]])) for k in range(40)] + [(1040, " ".join(base))]
    _, want = brute(rows)
    some = {}
    for i, _ in rows:
        if i % 3:
            some.setdefault(want[i], []).append(i)
    start = {i: min(ids) for ids in some.values() for i in ids}
    docs = spark.createDataFrame(rows, "id long, text string")
    rest = spark.createDataFrame([(i, start.get(i, i)) for i, _ in rows], "id long, component long")
    links = [(r.a, r.b) for r in sketch_dedup._rest_links(rest, docs, 75).collect()]
    assert max(map(len, some.values())) > 8
    assert roots([i for i, _ in rows], links + list(start.items())) == want


def test_slices_of_few_words(spark):
    """A slice may hold any number of words in all: one short text, or a short one that slices() yields alone."""
    shingler, words = sketch_dedup.Shingler(), "one two three four five six".split()
    for n in range(7):
        text = " ".join(words[:n])
        alone, among = shingler([text]), shingler([text, "a much longer text that follows the short one"])
        assert len(alone[0]) == len(shingles(text)) and alone[0].tolist() == among[0].tolist()
    long = " ".join(f"w{i}" for i in range(40000))
    assert len(long) > 1 << 18
    for texts in (["one two"], ["one two three"], [f"{long} a", "one two", f"{long} b"], [f"{long} a", "One two three", "", f"{long} b"]):
        df = spark.createDataFrame([(i, t, 1, "own") for i, t in enumerate(texts)], DOC).coalesce(1)
        sets, want = brute(list(enumerate(texts)))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in sketch_dedup.near_duplicates(df).collect()}
        assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_sketch_similarity_is_that_of_the_sets():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    errors = []
    for n in (1, 5, 40, 400):
        for shared in (0.3, 0.75, 0.95):
            k = max(1, round(n * shared))
            a, b = pool[:n], np.concatenate([pool[:k], pool[1500 : 1500 + n - k]])
            s = sketch_dedup.sketches([a, b])
            assert (s != np.uint64((1 << 64) - 1)).all()
            errors.append(abs((s[0] == s[1]).mean() - len(set(a) & set(b)) / len(set(a) | set(b))))
    assert max(errors) < 0.2 and np.mean(errors) < 0.06


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = []
    for i in range(400):
        v = base[rng.integers(60)] + rng.standard_normal(16) * rng.choice([0.02, 0.05, 0.2])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(3))))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(30)] + [(2000, (np.array(rows[0][1], np.float32) * 2).tolist(), rows[0][2]), (2001, rows[0][1], None), (2002, None, 1), (2003, [], 1), (2004, [0.0] * 16, 1), (2005, [None] + [1.0] * 15, 1), (2006, [float("nan")] + [1.0] * 15, 1), (2007, [float("inf")] + [1.0] * 15, 1), (2008, [1.0] * 8, 1), (2009, [3.0] * 8, 1), (2010, [1e-30] * 16, 2), (2011, [3e30] * 16, 2)]
    fit = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    n, links = dict.fromkeys((r[0] for r in rows), 0), []
    for k, (i, v, lab) in enumerate(fit):
        for j, w, other in fit[:k]:
            if lab == other and len(v) == len(w) and (v / abs(v).max()) @ (w / abs(w).max()) / np.linalg.norm(v / abs(v).max()) / np.linalg.norm(w / abs(w).max()) >= 0.98:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    want = roots([r[0] for r in rows], links)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n int")
    rules = rpforest.Forest(leaf=32, least=4, block=16)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rpforest.near_duplicates(df, rules=rules).collect()}
    assert got == {i: (n[i], want[i], want[i] == i) for i in n}
    assert rpforest.near_duplicates(df.where("false")).count() == 0


def test_double_vectors_keep_their_precision(spark):
    """Cosines that lie on both sides of the threshold only beyond single precision, and values beyond its range."""
    a = np.array([1.0, 0.0])
    turn = lambda c: [c, float(np.sqrt(1 - c * c))]
    rows = [(0, a.tolist()), (1, turn(0.98 + 1e-10)), (2, [-x for x in turn(0.98 - 1e-10)]), (3, (-a).tolist()), (4, [1e200, 0.0, 0.0]), (5, [2e200, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "l") for i, v in rows], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in rpforest.near_duplicates(df).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4)}


def test_leaves_stay_small_and_links_are_counted_not_listed(spark):
    """A table much larger than the sample the first splits are fitted on, and one dense group that no split makes smaller."""
    rng = np.random.default_rng(4)
    spread = rng.standard_normal((3000, 8))
    dense = np.ones(8) + rng.standard_normal((300, 8)) * 0.01
    v = np.concatenate([spread, dense]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    rules = rpforest.Forest(sample=64, leaf=64, least=8, block=128, refit=128, trees=3)
    got = {r.vec_id: r.n_links for r in rpforest.near_duplicates(df, rules=rules).collect()}
    wanted = near.sum(1) - 1
    assert all(got[i] <= wanted[i] for i in got) and sum(got.values()) >= 0.9 * wanted.sum() and all(got[i] >= 299 for i in range(3000, 3300))
    from pyspark.sql import functions as F

    classes = df.select("label", "embedding", F.col("vec_id").alias("head"), F.lit(1).cast("long").alias("n"), F.lit(8).alias("d"), F.col("vec_id").alias("cid"))
    placed = rpforest.assigned(classes, 0.98, rules)
    sizes = [r["count"] for r in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().where("leaf % 2 = 0").collect()]
    assert max(sizes) <= 128
    found = rpforest.linked_in_leaves(placed, 0.98, rules)
    assert found.count() <= 4 * placed.select(F.explode("leaves")).count() and set(found.columns) == {"cid", "head", "others", "root"}
