"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A sketch has ``BINS`` coordinates. In round ``i`` every shingle is thrown into one pseudo-random bin with a
pseudo-random value; a bin keeps the smallest value of the first round that reaches it. After ``BINS`` rounds each
further round throws all shingles into one given bin, so every coordinate is filled whatever the set's size. Rounds end
for a set as soon as its bins are full: large sets need about one. Sketches that agree in all coordinates of some band
make candidates, and the full shingle sets of candidates decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fennelmill.llm.common import discard, fresh_names, if_small, materialise, slices
from fennelmill.llm.components import components

#: Words of a shingle; coordinates of a sketch; bands and coordinates of a band. Two sets of similarity 0.75 meet in no
#: band with a probability of about (1 - 0.75^4)^32 = 5e-6.
WORDS, BINS, BANDS = 5, 128, 32
_ROWS = BINS // BANDS
#: Members of a component that is compared in a join; members and seekers that one group compares.
_SMALL, _GROUP = 8, 256


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit generator, to spread all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of word shingles, for all texts of a slice at once."""

    def __init__(self) -> None:
        draw = np.random.Generator(np.random.PCG64(20))
        self.letter = draw.integers(0, 1 << 64, 256, np.uint64)
        self.letter[ord("A") : ord("Z") + 1] = self.letter[ord("a") : ord("z") + 1]
        self.apart = np.zeros(256, np.bool_)
        self.apart[[32, *range(9, 14)]] = True
        self.step = int(draw.integers(0, 1 << 63)) * 8 + 5 & (1 << 64) - 1
        self.places = draw.integers(0, 1 << 63, (WORDS, WORDS), np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            make = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
            self.up, self.down = make(self.step), make(pow(self.step, -1, 1 << 64))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The distinct shingle hashes of each text, sorted."""
        raw = [t.encode() if t else b"" for t in texts]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        apart = self.apart[data]
        edge = np.flatnonzero(np.diff(apart, prepend=True))
        starts, ends = edge[::2], edge[1::2]
        self._powers(len(data) + 1)
        summed = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letter[data] * self.up[: len(data)], out=summed[1:])
        words = _mix((summed[ends] - summed[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        upto = np.searchsorted(starts, np.cumsum(sizes)).tolist()
        n = len(words)
        full = words * self.places[-1, 0]
        for k in range(1, min(WORDS, n)):
            full[: n - k] += words[k:] * self.places[-1, k]
        full = _mix(full)
        out, at = [], 0
        for to in upto:
            k = to - at
            if k >= WORDS:
                out.append(np.unique(full[at : to - WORDS + 1]))
            else:
                out.append(_mix((words[at:to] * self.places[k - 1, :k]).sum(keepdims=True, dtype=np.uint64)) if k else full[:0])
            at = to
        return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BINS`` coordinates for each non-empty set."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    item = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    empty = np.uint64((1 << 64) - 1)
    held = np.full((len(sets), BINS), empty)
    flat = held.ravel()
    for i in range(2 * BINS):
        thrown = _mix(item + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        bins = (thrown >> np.uint64(57)).astype(np.int64) if i < BINS else i - BINS
        value = (thrown & np.uint64((1 << 48) - 1)) | np.uint64(i << 48)
        np.minimum.at(flat, owner * BINS + bins, value)
        open_still = (held == empty).any(1)
        if not open_still.any():
            break
        stays = open_still[owner]
        item, owner = item[stays], owner[stays]
    return held


def band_keys(held: np.ndarray) -> np.ndarray:
    """``BANDS`` hashes for each sketch; the band is part of the hash."""
    parts = _mix(held).reshape(len(held), BANDS, _ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.zeros((len(held), 1), np.uint64)
    for k in range(_ROWS):
        key = _mix(key + parts[:, :, k])
    return key.view(np.int64)


@lru_cache(maxsize=1)
def _shingler() -> Shingler:
    return Shingler()


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]).view(np.int64)))


def sketch_table(docs: DataFrame) -> DataFrame:
    """``(id, n, digest, bands)`` of ``(id, text)``: set size, digest of the set, band keys; no bands for an empty set."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 18):
            sets = _shingler()(part.column("text").to_pylist())
            some = [i for i, s in enumerate(sets) if len(s)]
            bands = [np.zeros(0, np.int64)] * len(sets)
            for i, row in zip(some, band_keys(sketches([sets[i] for i in some]))):
                bands[i] = row
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), _lists(bands)], ["id", "n", "digest", "bands"])

    return docs.mapInArrow(run, f"id {kind}, n long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``(id, items)`` of ``(id, text)``: all distinct shingle hashes."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 18):
            yield pa.RecordBatch.from_arrays([part.column("id"), _lists(_shingler()(part.column("text").to_pylist()))], ["id", "items"])

    return docs.mapInArrow(run, f"id {kind}, items array<long>")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of the ids; texts of others are not shuffled while the ids are few enough to broadcast."""
    return docs.join(if_small(ids), "id", "left_semi").dropDuplicates(["id"])


def verified(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole shingle sets have ``100 * intersection >= percent * union``.

    Pairs whose sizes alone rule a link out go first; sets are made only for documents that a pair names.
    """
    n_a, n_b = sizes.select(F.col("id").alias("a"), F.col("n").alias("n_a")), sizes.select(F.col("id").alias("b"), F.col("n").alias("n_b"))
    pairs = materialise(pairs.join(n_a, "a").join(n_b, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"), "pairs")
    named = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "named")
    sets = materialise(shingle_sets(_texts_of(docs, named)), "sets")
    of_a, of_b = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    common = F.size(F.array_intersect("items_a", "items_b"))
    alike = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "n_a", "n_b", common.alias("c")).where(f"100 * c >= {percent} * (n_a + n_b - c)")
    links = materialise(alike.select("a", "b"), "links")
    discard(pairs, named, sets)
    return links


def near_duplicates(df: DataFrame, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for each row of documents.

    Sides of joins that are sums over a key are written before they are joined, so that both sides come straight from a
    shuffle and adaptive execution can split a hot key's rows.

    Words are runs of other characters than the space and \\t \\n \\v \\f \\r, with A-Z in lower case; a set holds the
    distinct five-word shingles as 64-bit hashes, or the whole sequence where there are fewer words. Documents link if
    ``100 * intersection >= percent * union`` of their whole sets; a component is named by its smallest id, which is kept.

    Documents of equal sets are one class, and work goes on with a class's smallest id. In a bucket of a band all members
    are compared with a pivot, so a group of mutual copies costs comparisons in proportion to its size. Documents of
    buckets that then still hold several components are joined exactly, by rare shingles, so that no candidate pair of
    different components goes unexamined.

    Edge cases: a NULL or empty text, or one without words, has an empty set and links with nothing; a row with a NULL id
    has a NULL component and is kept; rows that repeat an id belong together and all get its result, and where their
    texts differ each of them is compared, so links of any of them join the component; other columns are not read, whatever their names; an empty table gives no rows; very long texts are taken whole.
    """
    docs = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    made = materialise(sketch_table(docs), "sketches")
    several = made.where("digest is not null and id is not null").groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x < y")
    if several.isEmpty():
        named = _in_components(docs, made, percent)
    else:  # rows are compared under numbers of their own, and those of one id belong together
        discard(made)
        rows = materialise(docs.withColumn("row", F.when(F.col("id").isNotNull(), F.monotonically_increasing_id())), "rows")
        heads = rows.where("id is not null").groupBy("id").agg(F.min("row").alias("a"))
        same = materialise(rows.select("id", F.col("row").alias("b")).join(heads, "id").where("a < b").select("a", "b"), "same")
        numbered = rows.select(F.col("row").alias("id"), "text")
        made = materialise(sketch_table(numbered), "sketches")
        found = materialise(_in_components(numbered, made, percent, same), "named").withColumnRenamed("id", "row")
        own = materialise(rows.select("row", F.col("id").alias("own")).where("row is not null"), "ids")
        smallest = materialise(found.join(own, "row").groupBy("component").agg(F.min("own").alias("smallest")), "smallest")
        named = found.join(own, "row", "left").join(smallest, "component", "left").select(F.col("own").alias("id"), "n", F.col("smallest").alias("component"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return named.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def _in_components(docs: DataFrame, made: DataFrame, percent: int, more_links: DataFrame | None = None) -> DataFrame:
    """``(id, n, component)`` for each row of ``made``, the sketches of ``docs``, in which an id has one set; ``more_links`` are links ``(a, b)`` known besides."""
    copied = made.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last")
    classes = materialise(copied.select("digest", "head"), "classes")
    named = made.join(classes, "digest", "left").withColumn("head", F.when(F.col("id").isNotNull(), F.coalesce("head", "id")))
    member = materialise(named.select("id", "n", "head", F.when(F.col("head") == F.col("id"), F.col("bands")).alias("bands")), "members")
    first = member.where("head = id and n > 0")
    sizes = first.select("id", "n").groupBy("id").agg(F.max("n").alias("n"))
    rows = first.select("id", F.explode("bands").alias("key"))
    crowded = materialise(rows.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("most")).where("pivot < most").select("key", "pivot"), "crowded")
    buckets = materialise(rows.join(crowded, "key"), "buckets")
    sizes = materialise(sizes, "sizes")
    copies = member.where("head < id").select(F.col("head").alias("a"), F.col("id").alias("b"))
    tested = materialise(buckets.select(F.col("pivot").alias("a"), F.col("id").alias("b")).where("a < b").distinct(), "tested")
    links = verified(tested, docs, sizes, percent).union(copies)
    if more_links is not None:
        links = links.union(more_links)
    found = components(links)
    rest = _unsettled(buckets.select("id", "key"), found)
    if not rest.isEmpty():
        more = _rest_links(rest, docs, percent)
        if not more.isEmpty():
            found = components(links.union(more))
    discard(made, classes, crowded, buckets, sizes, tested, rest)
    named = member.join(found.select(F.col("id").alias("head"), "component"), "head", "left")
    return named.select("id", "n", F.coalesce("component", "head").alias("component"))


def drop_duplicates(df: DataFrame, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``df`` whose ids :func:`near_duplicates` keeps, and all rows without an id.

    Edge cases: a NULL or empty text links with nothing and stays; rows that repeat an id stay or go together; all columns
    stay, whatever their names; an empty table gives no rows; very long texts are compared whole.
    """
    [gone] = fresh_names(df, "gone")
    lost = near_duplicates(df, percent, id_column, text_column).where("not kept").select(F.col(id_column).alias(gone)).distinct()
    return df.join(if_small(materialise(lost, "lost")), F.col(f"`{id_column}`") == F.col(gone), "left_anti")


def _unsettled(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """``(id, component)`` of documents that share a bucket with one of another component."""
    named = buckets.join(found, "id", "left").select("id", "key", F.coalesce("component", "id").alias("component"))
    several = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    return materialise(named.join(materialise(several, "crowded"), "key", "left_semi").select("id", "component").distinct(), "rest")


def _prefixes(items: DataFrame, percent: int) -> DataFrame:
    """``(id, n, item, rare)``: of each set the items, rarest first, of which a set that links shares one at least.

    With all sets ordered alike, two sets that link share one of the first ``n - ceil(percent * n / 100) + 1`` items of
    the larger and of the first ``n - ceil(2 * percent * n / (100 + percent)) + 1`` of the smaller; ``rare`` marks the
    latter. Items that no other set holds are counted but not returned. In order of rarity a passage that many documents
    hold comes last, so it brings together only documents that hold little else.
    """
    common = materialise(items.groupBy("item").agg(F.count("*").alias("f")).where("f > 1"), "common")
    by_id = Window.partitionBy("id")
    ranked = items.join(common, "item").select("id", "n", "item", (F.row_number().over(by_id.orderBy("f", "item")) + F.col("n") - F.count("*").over(by_id)).alias("place"))
    upto = lambda over, under: f"n - (n * {over} + {under - 1}) div {under} + 1"
    return ranked.where(f"place <= {upto(percent, 100)}").select("id", "n", "item", F.expr(f"place <= {upto(2 * percent, 100 + percent)}").alias("rare"))


def _rest_links(rest: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between different components of some documents: of each document to each larger component one, if there is any.

    Documents meet components, not their members, through shared prefix items, the smaller component's documents looking
    for the larger ones. What has met is compared in full sets: with small components in a join, with large ones by
    groups of bounded numbers of members and seekers, which return at most one link for a seeker. A seeker meets one group
    of a large component's members first, and all others only if it links with none of those.
    """
    kind = rest.schema["id"].dataType.simpleString()
    large = rest.groupBy("component").agg(F.count("*").alias("size"))
    rest = materialise(rest.join(large, "component").select("id", "component", "size"), "rest")
    sets = materialise(shingle_sets(_texts_of(docs, rest.select("id"))), "sets")
    first = _prefixes(sets.select("id", F.size("items").alias("n"), F.explode("items").alias("item")), percent)
    first = materialise(first.join(rest, "id").select("id", "n", "item", "rare", F.struct("size", "component").alias("own")), "prefixes")
    mixed = first.groupBy("item").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x < y").select("item")
    first = materialise(first.join(materialise(mixed, "mixed"), "item", "left_semi"), "prefixes")
    goals = materialise(first.groupBy("item", F.col("own").alias("goal")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min(F.when(F.col("rare"), F.col("n"))).alias("rare_from")), "goals")
    sizes_fit = f"100 * n >= {percent} * least and {percent} * n <= 100 * most"
    met = materialise(first.join(goals, "item").where(f"own < goal and {sizes_fit} and ((rare and most >= n) or coalesce(rare_from <= n, false))").select("id", "goal").distinct().select("id", F.col("goal.component").alias("component"), F.col("goal.size").alias("size")), "met")
    members = rest.select(F.col("id").alias("b"), "component", "size")
    of_b = sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    n, m, common = F.size("items"), F.size("items_b"), F.size(F.array_intersect("items", "items_b"))
    alike = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (100 * common >= percent * (n + m - common))
    few = met.where(F.col("size") <= _SMALL).select("id", "component").join(members.select("b", "component"), "component").select("id", "b")
    in_small = few.join(sets, "id").join(of_b, "b").where(alike).select(F.col("id").alias("a"), "b")
    many = materialise(met.where(F.col("size") > _SMALL).select("id", "component"), "many")
    parts = lambda c: F.ceil(F.col(c) / _GROUP).cast("int")
    part_of = lambda c, n: F.pmod(F.xxhash64(c), parts(n)).cast("int")
    sized = members.where(F.col("size") > _SMALL).withColumn("chunk", part_of("b", "size"))

    def seek(left: pa.Table, right: pa.Table) -> pa.Table:
        own = [np.array(x.as_py(), np.int64) for x in right.column("items")]
        ids, found = right.column("id").to_pylist(), []
        if own:
            item = np.concatenate(own)
            owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
            order = np.argsort(item, kind="stable")
            item, owner, sizes = item[order], owner[order], np.array([len(x) for x in own])
            for a, x in zip(left.column("id").to_pylist(), left.column("items")):
                x = np.array(x.as_py(), np.int64)
                at, to = np.searchsorted(item, x, "left"), np.searchsorted(item, x, "right")
                run = to - at
                hits = np.arange(run.sum()) + np.repeat(at - np.cumsum(run) + run, run)
                common = np.bincount(owner[hits], minlength=len(own))
                if len(ok := np.flatnonzero(100 * common >= percent * (len(x) + sizes - common))):
                    found.append((a, ids[ok[0]]))
        return pa.table({"a": [a for a, _ in found], "b": [b for _, b in found]}, schema=schema)

    schema = pa.schema([("a", _arrow_type(rest)), ("b", _arrow_type(rest))])
    group = ["component", "part", "chunk"]

    def sought(looking: DataFrame, first: int, last: F.Column) -> DataFrame:
        """Links of ``(id, component)`` into the chunks ``first`` to ``last`` of their components' members."""
        seekers = looking.groupBy("component").agg(F.count("*").alias("seekers"))
        sizes = rest.select("component", "size").distinct()
        chunks = F.explode(F.sequence(F.lit(first), last))
        placed = looking.join(seekers, "component").join(sizes, "component").where(last >= first)
        from_a = placed.select("id", "component", part_of("id", "seekers").alias("part"), chunks.alias("chunk")).join(sets, "id").select(*group, "id", "items")
        asked = sized.join(seekers, "component").where((F.col("chunk") >= first) & (F.col("chunk") <= last))
        to_b = asked.select("b", "component", "chunk", F.explode(F.sequence(F.lit(0), parts("seekers") - 1)).alias("part")).join(of_b, "b").select(*group, F.col("b").alias("id"), F.col("items_b").alias("items"))
        return from_a.groupBy(*group).cogroup(to_b.groupBy(*group)).applyInArrow(seek, f"a {kind}, b {kind}")

    # most seekers that link with a large component link with the first members asked; only others ask all of them
    in_first = materialise(sought(many, 0, F.lit(0)), "links")
    linked = in_first.select(F.col("a").alias("id"), "b").join(members.select("b", "component"), "b").select("id", "component").distinct()
    left = materialise(many.join(linked, ["id", "component"], "left_anti").join(rest.select("component", "size").distinct(), "component").where(F.col("size") > _GROUP).select("id", "component"), "left")
    in_large = in_first if left.isEmpty() else in_first.union(sought(left, 1, parts("size") - 1))
    links = materialise(in_small.union(in_large), "links")
    discard(rest, sets, first, goals, met, many, in_first, left)
    return links


def _arrow_type(df: DataFrame) -> pa.DataType:
    """The Arrow type of the ids."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["id"].dataType)
