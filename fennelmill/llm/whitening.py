"""Whitening of embeddings by a bit-sliced scatter matrix.

Entries become integers, shifted by each dimension's minimum. A task packs the bit planes of its rows into 64-bit words, one
run of words for each plane, and the number of rows that have a bit in both of two planes is a popcount of their AND. Weighted
by the planes' powers of two these counts are exact cross-products; Spark adds them over all tasks, and they are centred
as integers of any size. Only then does floating point begin, with the eigenvectors of the covariance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fennelmill.llm.common import materialise, small_batches

#: Entries are scaled by SCALE and rounded down; the constant added to them, which no covariance depends on, is left out.
SCALE = 64
#: Entries beyond it count as it; bits of one limb of a weighted sum; rows whose planes are packed together.
_MOST, _LIMB, _BLOCK = float(1 << 62), 15, 8192


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """The integers of a batch of vectors, shorter ones padded with zeros."""
    flat = np.asarray(column.flatten(), np.float64)
    if len(flat) == d * len(column):
        c = flat.reshape(len(column), d)
    else:
        sizes = np.asarray(column.value_lengths())
        c = np.zeros((len(column), d))
        c[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * SCALE), -_MOST, _MOST).astype(np.int64)


def _ranges(vectors: DataFrame, d: int) -> np.ndarray:
    """``(low, high)`` of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), d)
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(low), pa.array(high)], ["i", "low", "high"])

    rows = vectors.select("v").mapInArrow(run, "i int, low long, high long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    out = np.zeros((d, 2), np.int64)
    for r in rows:
        out[r.i] = r.low, r.high
    return out


class Planes:
    """The bit planes of all dimensions, and the counts of rows that have a bit in both of two of them."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        bits = [(int(h) - int(lo)).bit_length() for lo, h in zip(low, high)]
        self.low = low
        self.dims = np.repeat(np.arange(len(bits)), bits)
        self.place = np.concatenate([np.arange(b) for b in bits] + [np.zeros(0, np.int64)]).astype(np.int64)
        self.counts = np.zeros((len(self.dims), len(self.dims)), np.int64)

    def add(self, x: np.ndarray) -> None:
        """Count rows of integers."""
        shifted = x.view(np.uint64) - self.low.view(np.uint64)
        rows = np.zeros((-(-len(x) // 64) * 8, len(self.dims)), np.uint8)
        packed = np.packbits(((shifted[:, self.dims] >> self.place.astype(np.uint64)) & np.uint64(1)).astype(np.bool_), axis=0)
        rows[: len(packed)] = packed
        words = np.ascontiguousarray(rows.T).view(np.uint64)
        for a in range(len(words)):
            self.counts[a, a:] += np.bitwise_count(words[a] & words[a:]).sum(1, dtype=np.int64)

    def sums(self) -> Iterator[tuple[int, int, int, int]]:
        """``(i, j, band, value)`` with ``i <= j``: the cross-products are the sum of ``value << (15 * band)``; ``j`` is -1 for plain sums."""
        if not len(self.dims):
            return
        full = self.counts + np.triu(self.counts, 1).T
        have, starts = np.unique(self.dims, return_index=True)
        limb = self.place // _LIMB
        weight = np.int64(1) << (self.place - limb * _LIMB)
        most = int(limb.max())
        products: dict[int, np.ndarray] = {}
        for u in range(most + 1):
            of_u = np.where(limb == u, weight, 0)
            plain = np.add.reduceat(np.diag(self.counts) * of_u, starts)
            yield from ((int(i), -1, u, int(v)) for i, v in zip(have, plain))
            for w in range(most + 1):
                of_w = np.where(limb == w, weight, 0)
                part = np.add.reduceat(np.add.reduceat(full * of_u[:, None] * of_w, starts, axis=0), starts, axis=1)
                products[u + w] = products.get(u + w, 0) + part
        for band, m in products.items():
            yield from ((int(have[a]), int(have[b]), band, int(m[a, b])) for a in range(len(have)) for b in range(a, len(have)))


def cross_products(vectors: DataFrame, low: np.ndarray, high: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums and cross-products of the shifted integers of ``(v)``, as Python integers."""
    d = len(low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, held, n = Planes(low, high), [], 0
        for b in batches:
            held.append(_matrix(b.column("v"), d))
            n += b.num_rows
            if n >= _BLOCK:
                planes.add(np.concatenate(held))
                held, n = [], 0
        if n:
            planes.add(np.concatenate(held))
        rows = list(planes.sums())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["i", "j", "band", "value"])

    added = vectors.select("v").mapInArrow(run, "i int, j int, band int, value long").groupBy("i", "j", "band").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    sums, products = [0] * d, [[0] * d for _ in range(d)]
    for r in added.collect():
        value = int(r.value) << (_LIMB * r.band)
        if r.j < 0:
            sums[r.i] += value
        else:
            products[r.i][r.j] += value
    for i in range(d):
        for j in range(i):
            products[i][j] = products[j][i]
    return sums, products


@dataclass
class Whitener:
    """A fitted transformation: sums, eigenvalues and eigenvectors (columns), the greatest first."""

    n: int
    low: np.ndarray
    high: np.ndarray
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def rank(self, components: int) -> int:
        """How many of the first components have variance beyond rounding."""
        least = self.values[0] * len(self.values) * 4 * np.finfo(np.float64).eps if len(self.values) else 0.0
        return int((self.values[:components] > least).sum())

    def __call__(self, x: np.ndarray, components: int) -> tuple[list[Decimal | None], np.ndarray]:
        """Deviations and whitened rows of integers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        off = x - self.low - whole
        spread = max(1, max((abs(int(v)) for v in (off.min(initial=0), off.max(initial=0)))))
        if len(rest) * (self.n * (spread + 1)) ** 2 < 1 << 63:
            far = off * self.n - np.array(rest, np.int64)
            deviation = list(map(Decimal, (far * far).sum(1).tolist()))
        else:
            exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, rest)) for row in off.tolist()]
            deviation = [Decimal(v) if v < 10**38 else None for v in exact]
        centred = off.astype(np.float64) - np.array([r / self.n for r in rest])
        k = self.rank(components)
        out = np.zeros((len(x), min(components, len(self.values))))
        out[:, :k] = centred @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))
        return deviation, out


def fit(vectors: DataFrame) -> Whitener | None:
    """The transformation that whitens ``(v)``, or None without any vector."""
    n, d = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return None
    limits = _ranges(vectors, d)
    low, high = np.ascontiguousarray(limits[:, 0]), np.ascontiguousarray(limits[:, 1])
    sums, products = cross_products(vectors, low, high)
    centred = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    covariance = np.array([[v / (n * n) for v in row] for row in centred]).reshape(d, d)
    values, columns = np.linalg.eigh(covariance)
    trace = sum(centred[i][i] for i in range(d)) / (n * n)
    return Whitener(n, low, high, sums, np.maximum(values[::-1], 0.0), np.ascontiguousarray(columns[:, ::-1]), trace)


def _identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of the first ``k`` entries of ``z`` minus the identity, measured over all rows."""
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            if b.num_rows:
                z = np.asarray(b.column("z").flatten()).reshape(b.num_rows, -1)[:, :k]
                total += np.concatenate([z.T @ z, z.sum(0, keepdims=True)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "value"])

    total = np.zeros((k + 1, k))
    for r in whitened.select("z").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        total[r.i, r.j] = r.value
    mean = total[k] / n
    return float(np.abs(total[:k] / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, components: int = 32, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(id, n, deviation, z, explained, identity_error)`` for each vector without NULL or non-finite entries.

    An entry ``c`` becomes ``x = floor(64 c)`` plus a constant. ``deviation`` is the exact sum over dimensions of
    ``(n x - S)^2`` as a decimal, ``z`` the array of the first components of ``x - S / n``, each over the root of its
    eigenvalue; ``explained`` the array of eigenvalues over their sum; ``identity_error`` one number, measured on ``z``.
    The driver holds one matrix of the dimensions; the vectors stay in their partitions, nothing of theirs is shuffled.

    Edge cases: a NULL vector, or one with NULL or non-finite entries, gives no row; vectors shorter than the longest
    are padded with zeros, empty ones too; entries beyond 2^56 count as that; components without variance (constant
    or dependent dimensions, a single row) are 0 and left out of the error, and explain 0 if nothing varies; a deviation
    of more than 38 digits is NULL; NULL and repeated ids are rows like others; other columns are not read, whatever
    their names; an empty table gives no rows.
    """
    kind = df.schema[id_column].dataType.simpleString()
    finite = F.forall(F.col("v"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    vectors = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v")).where(F.col("v").isNotNull()).where(finite)
    small_batches(df.sparkSession)
    schema = f"id {kind}, deviation decimal(38,0), z array<double>"
    found = fit(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                deviation, z = found(_matrix(b.column("v"), len(found.low)), components)
                ends = np.arange(b.num_rows + 1, dtype=np.int32) * z.shape[1]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(deviation, pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel()))], ["id", "deviation", "z"])

    if found is None:
        out, n, explained, error = df.sparkSession.createDataFrame([], schema), 0, [], 0.0
    else:
        out = materialise(vectors.mapInArrow(run, schema), "whitened")
        n, error = found.n, _identity_error(out, found.n, found.rank(components))
        explained = [float(v / found.trace) if found.trace else 0.0 for v in found.values[:components]]
    return out.select(F.col("id").alias(id_column), F.lit(n).cast("long").alias("n"), "deviation", "z", F.array(*map(F.lit, explained)).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))


def components_of(whitened: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """One row for each vector and component of a :func:`whiten` result; a deviation beyond 64 bits is NULL, an empty table gives no rows."""
    each = whitened.select(F.col(id_column), "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "explained", "identity_error", F.posexplode("z").alias("place", "whitened"))
    return each.select(id_column, (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("place")).alias("explained"), "identity_error")
