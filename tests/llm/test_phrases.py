"""Phrases against plain counting, and the automata on their own."""

import random
import re
from collections import Counter

import numpy as np

from fennelmill.llm import phrases

SCHEMA = "lang string, text string, a int, w1 string"


def plain(rows, most=2000, least=10):
    """The contract as loops over whole texts."""
    out = []
    for lang in {x or "und" if x is None else x for x, _ in rows}:
        f, n = Counter(), 0
        for x, text in rows:
            if ("und" if x is None else x) != lang:
                continue
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                f.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in candidates.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def got(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(x, t, 1, "clash") for x, t in rows], SCHEMA).repartition(parts)
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[c] for c in columns) for r in phrases.collocations(df, **options).collect())


def _corpus(rng, n, vocabulary):
    words = [w for i, w in enumerate(vocabulary) for _ in range(1 + 40 // (i + 1))]
    marks = [" "] * 9 + [", ", ".\n", "\t", "  ", "!?"]
    return ["".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_equal_to_plain_counting_over_many_ranges(spark):
    rng = random.Random(6)
    vocabulary = ["The", "the", "of", "é", "Éa", "日本", "\x00", "\x01b", "a-b", "un a", *(f"w{i}" for i in range(30))]
    rows = [(rng.choice(["en", "de", None, "und"]), t) for t in _corpus(rng, 500, vocabulary)] + [("en", None), (None, ""), ("fr", "..."), ("en", "the of the of the of " * 300)]
    want = plain(rows)
    assert len(want) > 200
    assert got(spark, rows) == want
    assert got(spark, rows, parts=7, range_bytes=900, shard_bytes=2000) == want
    assert got(spark, rows[::-1], most=5, least=20, range_bytes=3000) == plain(rows, 5, 20)


def test_one_hot_word_phrase_and_long_text(spark):
    rows = [("en", "hot hot hot ghost. " * 4000 + "x" * 100_000), *[("en", f"hot word{i % 50} tail")for i in range(1000)], *[("en", "hot hot")] * 1000]
    assert got(spark, rows, range_bytes=2000, shard_bytes=5000) == plain(rows)


def test_no_rows_no_words_no_candidates(spark):
    assert got(spark, []) == [] and got(spark, [(None, None), ("en", " .,\t")]) == [] and got(spark, [("en", "a b c")] * 9) == []
    assert got(spark, [("en", "a b")] * 10) == [("en", 1, "a b", 10, 10, 10, 20, 1_000_000)]


def test_automata_share_suffixes_and_keep_weights():
    rng = random.Random(1)
    words = [w.encode() for w in sorted(f"w{i}" for i in range(9))]
    triples = Counter((rng.randrange(1, 10), rng.randrange(0, 4), rng.randrange(0, 3)) for _ in range(300))
    a, b, c, weights = (np.array(x, np.int64) for x in zip(*(k + (1 + v % 2,) for k, v in sorted(triples.items()))))
    one = phrases.Automaton.of(words, a, b, c, weights)
    assert len(one.layers[2][0]) - 1 < len(set(zip(a, b)))  # fewer states than prefixes
    for x in (one, phrases.Automaton.from_bytes(one.to_bytes())):
        assert all((p == q).all() for p, q in zip(x.paths(), (a, b, c, weights))) and x.words == words
        assert (x.weights_of(a, b, c) == weights).all()
        assert x.weights_of(np.array([1, -1, 9]), np.array([9, 0, 9]), np.array([9, 0, 0])).tolist() == [0, 0, 0]


def test_triples_of_many_words_are_summed_exactly():
    a, b, c = (np.array(x, np.int64) for x in ([5, 3_000_000, 5], [2_999_999, 1, 2_999_999], [7, 0, 7]))
    assert [x.tolist() for x in phrases._summed((a, b, c), np.array([1, 2, 4]), 3_000_001)] == [[5, 3_000_000], [2_999_999, 1], [7, 0], [5, 2]]
