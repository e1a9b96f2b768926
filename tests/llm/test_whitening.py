"""Whitening against exact integers, and its edge cases."""

import math
import random
from decimal import Decimal

import numpy as np
import pytest

from fennelmill.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n int, z string"


def plain(rows, d):
    """``{id: deviation}``, covariance and centred rows, in whole numbers as long as they last."""
    ok = [(i, [math.floor(64 * c) + 1_000_000 for c in v + [0.0] * (d - len(v))]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n = len(ok)
    sums = [sum(x[j] for _, x in ok) for j in range(d)]
    deviations = {i: sum((n * x[j] - sums[j]) ** 2 for j in range(d)) for i, x in ok}
    centred = [[n * x[j] - sums[j] for j in range(d)] for _, x in ok]
    covariance = [[sum(r[i] * r[j] for r in centred) / n**3 for j in range(d)] for i in range(d)]
    return deviations, np.array(covariance), np.array([[c / n for c in r] for r in centred])


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 5, "clash") for i, v in rows], SCHEMA).repartition(3)
    return whitening.whiten(df, **options).collect()


def test_equal_to_exact_arithmetic(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) * (j + 1) + (5000 if j == 2 else 0) for j in range(7)]) for i in range(300)] + [(900, None), (901, [1.0] * 6 + [None]), (902, [math.nan] * 7), (903, [math.inf] + [0.0] * 6)]
    deviations, covariance, centred = plain(rows, 7)
    found = run(spark, rows, components=5)
    assert {r.vec_id: r.deviation for r in found} == {i: Decimal(v) for i, v in deviations.items()} and {r.n for r in found} == {300}
    values, vectors = np.linalg.eigh(covariance)
    want = centred @ vectors[:, ::-1][:, :5] / np.sqrt(values[::-1][:5])
    z = np.array([r.z for r in sorted(found, key=lambda r: r.vec_id)])
    for k in range(5):
        assert min(np.abs(z[:, k] - s * want[:, k]).max() for s in (1, -1)) < 1e-9
    assert np.allclose(found[0].explained, values[::-1][:5] / values.sum(), rtol=1e-10)
    assert found[0].identity_error < 1e-9 and np.abs(np.cov(z.T, bias=True) - np.eye(5)).max() < 1e-9


def test_scatter_of_wide_entries_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-(1 << 40), 1 << 40, (200, 3))
    x[:, 2] = 7  # a constant dimension has no planes
    df = spark.createDataFrame([([c / 64 for c in map(float, row)],) for row in x], "v array<double>").repartition(4)
    sums, products = whitening.cross_products(df, x.min(0), x.max(0))
    shifted = [[int(c) - int(m) for c, m in zip(row, x.min(0))] for row in x]
    assert sums == [sum(r[j] for r in shifted) for j in range(3)]
    assert products == [[sum(r[i] * r[j] for r in shifted) for j in range(3)] for i in range(3)]


def test_planes_count_rows_beyond_whole_words():
    x = np.array([[5, 1], [3, 0], [7, 1]] * 43, np.int64)
    planes = whitening.Planes(x.min(0), x.max(0))
    planes.add(x[:100])
    planes.add(x[100:])
    got = {(i, j): v for i, j, band, v in planes.sums() if band == 0}
    y = x - x.min(0)
    assert got == {(0, -1): y[:, 0].sum(), (1, -1): y[:, 1].sum(), (0, 0): (y[:, 0] ** 2).sum(), (0, 1): (y[:, 0] * y[:, 1]).sum(), (1, 1): (y[:, 1] ** 2).sum()}


def test_few_equal_and_uneven_vectors(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
    [one] = run(spark, [(1, [1.0, 2.0])])
    assert (one.n, one.deviation, one.z, one.explained, one.identity_error) == (1, 0, [0.0, 0.0], [0.0, 0.0], 0.0)
    assert all(r.z == [0.0, 0.0] for r in run(spark, [(1, [1.0, 2.0])] * 4))
    rows = [(i, [float(i)] * (i % 3)) for i in range(9)] + [(None, [2.0])]
    deviations, covariance, _ = plain(rows, 2)
    found = run(spark, rows)
    assert {r.vec_id: r.deviation for r in found} == {i: Decimal(v) for i, v in deviations.items()} and found[0].identity_error < 1e-9
    dependent = run(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(20)])
    assert all(r.z[1:] == [0.0, 0.0] for r in dependent) and dependent[0].identity_error < 1e-9 and dependent[0].explained[0] == pytest.approx(1.0)


def test_huge_entries_and_rows_of_components(spark):
    found = run(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.5, 3.0])])
    assert all(math.isfinite(x) for r in found for x in r.z) and found[0].identity_error < 1e-4
    df = spark.createDataFrame([(i, [float(i % 5), float(i % 7)], 1, "") for i in range(70)], SCHEMA)
    rows = whitening.components_of(whitening.whiten(df)).collect()
    assert len(rows) == 140 and {r.component for r in rows} == {1, 2} and all(isinstance(r.deviation, int) for r in rows)
