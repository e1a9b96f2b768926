"""Near-duplicate vectors by a forest of random-projection trees with spill.

A tree splits the vectors of a node at the median of their projections on a random direction; vectors close to the
split go to both sides. The first splits are fitted on a bounded sample; leaves that are still overfull are split again
by samples of their own rows, so leaves stay small at any size of the table. Within a leaf all pairs of one label are
compared, by their cosine in double precision, so a link is never reported below the threshold; that several trees miss
the same pair is unlikely. A pair counts in the first leaf that its rows share, so a leaf returns a number of links for
each row and a spanning forest of them, and no list of pairs.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fennelmill.llm.common import discard, if_small, materialise, small_batches
from fennelmill.llm.components import components


@dataclass(frozen=True)
class Forest:
    """Parameters of the index."""

    trees: int = 4
    #: Vectors the first splits are fitted on, at most; those with the smallest hashes of their ids.
    sample: int = 16_384
    #: Vectors a leaf should hold, and sample vectors a node must hold to be split.
    leaf: int = 512
    least: int = 16
    #: Half the width of the spill, as a multiple of a linked pair's expected projected distance.
    spill: float = 0.5
    #: Rows of a leaf compared with each other by one task at most; a leaf that no split makes smaller is dealt in blocks.
    block: int = 2_048
    #: Vectors that splits of an overfull leaf are fitted on, about, and levels of such splits made at once.
    refit: int = 1_024
    levels: int = 4
    #: Directions tried for a split; a node is dense if most of its rows would go both ways with each.
    draws: int = 3
    seed: int = 7


class Tree:
    """Fitted splits: for each node a direction, a threshold and the children; a node without them is a leaf."""

    def __init__(self, sample: np.ndarray, depth: int, cosine: float, rules: Forest, seed: int) -> None:
        draw = np.random.Generator(np.random.PCG64(seed))
        self.margin = rules.spill * math.sqrt(max(0.0, 2 - 2 * cosine)) / math.sqrt(sample.shape[1])
        self.nodes: list[tuple[np.ndarray, float, int, int] | None] = []
        self.dense: set[int] = set()  # leaves that no split makes smaller
        self._grow(sample, np.arange(len(sample)), depth, draw, rules)

    def _grow(self, sample: np.ndarray, rows: np.ndarray, depth: int, draw: np.random.Generator, rules: Forest) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if depth > 0 and len(rows) >= 2 * rules.least:
            for _ in range(rules.draws):
                way = draw.standard_normal(sample.shape[1])
                way /= np.linalg.norm(way)
                along = sample[rows] @ way
                cut = float(np.median(along))
                left, right = rows[along < cut], rows[along >= cut]
                if len(left) and len(right) and 2 * (np.abs(along - cut) < self.margin).sum() < len(rows):
                    self.nodes[at] = (way, cut, self._grow(sample, left, depth - 1, draw, rules), self._grow(sample, right, depth - 1, draw, rules))
                    return at
            self.dense.add(at)
        return at

    def leaves(self, unit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows) for all leaves that some row falls into."""
        todo = [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if (split := self.nodes[node]) is None:
                yield node, rows
                continue
            way, cut, left, right = split
            along = unit[rows] @ way
            todo.append((left, rows[along < cut + self.margin]))
            todo.append((right, rows[along >= cut - self.margin]))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that neither tiny nor huge components are lost."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def fit(classes: DataFrame, cosine: float, rules: Forest) -> dict[int, list[Tree]]:
    """Trees for each vector length; the driver gets the bounded sample only. Lengths absent from it have one leaf."""
    rows = classes.orderBy(F.xxhash64("head"), "head").select("embedding", "d").limit(rules.sample).collect()
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(r.d, []).append(r.embedding)
    total = classes.count()
    depth = lambda v: max(0, math.ceil(math.log2(max(1, total * len(v) / len(rows)) / rules.leaf)))
    return {d: [Tree(_unit(np.array(v)), depth(v), cosine, rules, rules.seed + t) for t in range(rules.trees)] for d, v in by_length.items()}


_GROUP = ["leaf", "label", "d"]
#: Rows of an overfull leaf that one task splits, about, and how often leaves are split again at most: each time
#: halves them ``levels`` times, so the bound is never reached.
_DEALT, _TURNS = 4_096, 40


def _below(leaf: int, node: int, settled: bool) -> int:
    """The number of a leaf of later splits: a hash, of which the last bit says that no split makes the leaf smaller."""
    digest = hashlib.blake2b(f"{leaf}/{node}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True) & ~1 | settled


def assigned(classes: DataFrame, cosine: float, rules: Forest) -> DataFrame:
    """``classes`` with ``leaves``: the sorted numbers of all leaves of all trees that a row falls into.

    A leaf with more than twice the rows of one label that it should hold is split again, by splits fitted on a sample of
    about ``refit`` of its own rows and some levels at once, until no leaf is overfull or no split makes it smaller.
    """
    forest = fit(classes, cosine, rules)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                held: list[list[int]] = [[] for _ in range(part.num_rows)]
                unit = _unit(_matrix(part.column("embedding"), d))
                for t, tree in enumerate(forest.get(d, ())):
                    for node, rows in tree.leaves(unit):
                        for r in rows.tolist():
                            held[r].append(t << 32 | node << 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([sorted(x) or [0] for x in held], pa.list_(pa.int64()))], [*part.schema.names, "leaves"])

    now = materialise(classes.mapInArrow(first, f"{types}, leaves array<long>"), "assigned")
    for _ in range(_TURNS):
        over = materialise(now.select("label", "d", F.explode("leaves").alias("leaf")).where("leaf % 2 = 0").groupBy(*_GROUP).agg(F.count("*").alias("held")).where(F.col("held") > 2 * rules.leaf), "overfull")
        if over.isEmpty():
            discard(over)
            return now
        moved = materialise(_split_again(now, over, cosine, rules), "moved")
        by_row = moved.groupBy("cid").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "below"))).alias("below"))
        joined = now.join(by_row, "cid", "left")
        fresh = F.when(F.col("below").isNull(), F.col("leaves")).otherwise(F.array_sort(F.flatten(F.transform("leaves", lambda x: F.coalesce(F.try_element_at("below", x), F.array(x))))))
        after = materialise(joined.select(*classes.columns, fresh.alias("leaves")), "assigned")
        discard(now, over, moved)
        now = after
    return now


def _split_again(now: DataFrame, over: DataFrame, cosine: float, rules: Forest) -> DataFrame:
    """``(cid, leaf, below)``: for each row of an overfull leaf the leaves below that it falls into.

    The rows of a leaf are dealt to as many tasks as it needs, each with the leaf's splits.
    """
    label = now.schema["label"].dataType.simpleString()
    rows = now.select("cid", "label", "d", "embedding", F.explode("leaves").alias("leaf")).join(if_small(over), _GROUP)
    rows = rows.withColumn("parts", F.ceil(F.col("held") / _DEALT).cast("int")).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))

    def grow(table: pa.Table) -> pa.Table:
        leaf, d = table.column("leaf")[0].as_py(), table.column("d")[0].as_py()
        held = table.column("held")[0].as_py()
        depth = min(rules.levels, math.ceil(math.log2(held / rules.leaf)))
        tree = Tree(_unit(_matrix(table.column("embedding"), d)), depth, cosine, rules, leaf & (1 << 63) - 1)
        return pa.table({"leaf": [leaf], "label": table.column("label").slice(0, 1), "d": pa.array([d], pa.int32()), "held": [held], "tree": [pickle.dumps(tree)]})

    sample = rows.where(F.pmod(F.xxhash64("cid", F.lit(1)), F.col("held")) < rules.refit).select(*_GROUP, "held", "embedding")
    trees = materialise(sample.groupBy(*_GROUP).applyInArrow(grow, f"leaf long, label {label}, d int, held long, tree binary"), "splits")
    trees = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("held") / _DEALT).cast("int") - 1))).drop("held")

    def split(rows: pa.Table, trees: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"cid": pa.array([], pa.int64()), "leaf": pa.array([], pa.int64()), "below": pa.array([], pa.list_(pa.int64()))})
        leaf, d = rows.column("leaf")[0].as_py(), rows.column("d")[0].as_py()
        below: list[list[int]] = [[] for _ in range(rows.num_rows)]
        tree = pickle.loads(trees.column("tree")[0].as_py()) if trees.num_rows else None
        if tree is None or tree.nodes[0] is None:
            below = [[leaf | 1]] * rows.num_rows
        else:
            for node, which in tree.leaves(_unit(_matrix(rows.column("embedding"), d))):
                number = _below(leaf, node, node in tree.dense)
                for r in which.tolist():
                    below[r].append(number)
        return pa.table({"cid": rows.column("cid"), "leaf": rows.column("leaf"), "below": pa.array(below, pa.list_(pa.int64()))})

    key = [*_GROUP, "part"]
    return rows.select(*key, "cid", "embedding").groupBy(*key).cogroup(trees.groupBy(*key)).applyInArrow(split, "cid long, leaf long, below array<long>")


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` vertices the smallest one that the pairs ``(i, j)`` connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            return root


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    """Leaf numbers, one row each, filled up at the end."""
    rows = column.to_pylist()
    out = np.full((len(rows), max(map(len, rows))), np.iinfo(np.int64).max)
    for r, x in enumerate(rows):
        out[r, : len(x)] = x
    return out


def linked_in_leaves(rows: DataFrame, cosine: float, rules: Forest) -> DataFrame:
    """``(cid, head, others, root)``: for each row of :func:`assigned` and each leaf in which links count, how many rows of other heads it links with there, and the head that a spanning forest ties it to.

    A pair counts in the first leaf that both rows are in. Leaves that no split could make smaller hold rows that mostly
    link with each other; they are compared in blocks, a row going to as many tasks as there are blocks, since the number
    of a row's links asks for all of them.
    """
    kind, most = rows.schema["head"].dataType.simpleString(), rules.block
    each = rows.select(*rows.columns, F.explode("leaves").alias("leaf"))
    sizes = rows.select("label", "d", F.explode("leaves").alias("leaf")).groupBy(*_GROUP).agg(F.count("*").alias("held"))
    large = if_small(materialise(sizes.where(F.col("held") > most).select(*_GROUP, F.ceil(F.col("held") / most).cast("int").alias("blocks")), "large"))
    placed = each.join(large, _GROUP, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")}).drop("blocks", "other")

    def compare(table: pa.Table) -> pa.Table:
        head, n, own = (table.column(c).to_numpy() for c in ("head", "n", "own"))
        one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        leaf = table.column("leaf")[0].as_py()
        unit = _unit(_matrix(table.column("embedding"), table.column("d")[0].as_py()))
        left, right = np.flatnonzero(own == one), np.flatnonzero(own == two)
        lists = None
        others = np.zeros(len(head), np.int64)
        ties: list[tuple[np.ndarray, np.ndarray]] = []
        for s in range(0, len(left), 512):
            i, j = np.nonzero(unit[left[s : s + 512]] @ unit[right].T >= cosine - 1e-12)
            i, j = left[s + i], right[j]
            apart = (head[i] != head[j]) & (i < j) if one == two else head[i] != head[j]
            i, j = i[apart], j[apart]
            sure = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
            i, j = i[sure], j[sure]
            if not len(i):
                continue
            lists = _lists(table.column("leaves")) if lists is None else lists
            for c in range(lists.shape[1]):  # pairs that share an earlier leaf count there
                mine = lists[i, c]
                again = (lists[j] == mine[:, None]).any(1) & (mine < leaf)
                if again.any():
                    i, j = i[~again], j[~again]
            np.add.at(others, i, n[j])
            np.add.at(others, j, n[i])
            ties.append((i, j))
        i, j = (np.concatenate([t[k] for t in ties]) if ties else np.zeros(0, np.int64) for k in (0, 1))
        root = _forest(len(head), i, j)
        some = np.flatnonzero(others)
        return pa.table({"cid": table.column("cid").take(pa.array(some)), "head": table.column("head").take(pa.array(some)), "others": others[some], "root": table.column("head").take(pa.array(root[some]))})

    return placed.groupBy(*_GROUP, "one", "two").applyInArrow(compare, f"cid long, head {kind}, others long, root {kind}")


def near_duplicates(df: DataFrame, cosine: float = 0.98, rules: Forest = Forest(), id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row.

    Rows of equal label and equal vector are one class; classes are compared through their smallest ids, and a link
    between classes counts for all their members. ``n_links`` counts the other rows linked directly, ``component_id`` is
    the smallest id reachable. Vectors stay in their own precision until they are compared in double precision.

    Edge cases: a NULL label, a NULL, empty or zero vector, or one with NULL or non-finite components, links with
    nothing; vectors of different lengths don't link; a NULL id has no component, no links and is kept; rows that repeat
    an id are one vertex, and rows that repeat in full link with each other; other columns are not read, whatever their
    names; an empty table gives no rows.
    """
    small_batches(df.sparkSession)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    given = df.schema[vector_column].dataType
    kind = "array<float>" if given.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").cast(kind).alias("embedding"), F.col(f"`{label_column}`").alias("label"))
    fit_to_link = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    live = F.coalesce(fit_to_link, F.lit(False))
    keys = [F.when(live, F.xxhash64(F.lit(seed), "label", F.size("embedding"), "embedding")).alias(k) for seed, k in ((1, "x"), (2, "y"))]
    light = rows.select("id", *keys)
    merged = rows.select("id", "label", "embedding", *keys).where("x is not null").groupBy("x", "y").agg(F.min("id").alias("head"), F.count("*").alias("n"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
    classes = materialise(merged.withColumn("d", F.size("embedding")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    placed = assigned(classes.drop("x", "y"), cosine, rules)
    found = materialise(linked_in_leaves(placed, cosine, rules), "links")
    discard(placed)
    linked = found.groupBy("cid").agg(F.sum("others").alias("others"))
    reached = components(found.where("head != root").select(F.col("head").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("head"), "component")
    joined = classes.select("cid", "head", "n", "x", "y").join(linked, "cid", "left").join(reached, "head", "left")
    named = materialise(joined.where("n > 1 or others > 0").select("x", "y", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "head").alias("component")), "named")
    discard(classes, found)
    joined = light.join(named, ["x", "y"], "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_column), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
