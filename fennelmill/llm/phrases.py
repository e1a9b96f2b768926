"""Phrase collocations by weighted acyclic automata.

Every word of a piece of text stands for the path of itself and the two words behind it, with an end mark where the piece
is over, so one path a word counts the phrases of all lengths: the count of a phrase is the sum of the weights below its
prefix. A task sorts the paths of some megabytes of text and builds an automaton for each prefix range of theirs, whose
equal suffixes are one state. Automata of a range are united, their weights summed, and frequent phrases read off.
The parts of a candidate are then looked up by composing them with the automata of the frequent phrases.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fennelmill.llm.common import MOST_BROADCAST, give_back, if_small, materialise, place_in, small_batches

#: Bytes of text that one automaton is made of, and that a prefix range is to hold; samples of a range.
SHARD_BYTES, RANGE_BYTES, SAMPLES = 8 << 20, 8 << 20, 16
#: Parts looked up by one task at a time.
_CHUNK = 1 << 17
#: Parts of a language that are ranked by themselves before the whole.
_BUCKETS = 32
#: What ends a piece, besides letters in lower case and words apart.
_ENDS = ".,;:!?\n\x0b\x0c\r"
_NORMAL = bytes(10 if chr(b) in _ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _summed(words: tuple[np.ndarray, ...], weights: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The distinct triples of word numbers below ``size`` in order, and the sums of their weights."""
    a, b, c = words
    bits = max(1, int(size).bit_length())
    packed = 3 * bits <= 63
    if packed:
        key = (a << (2 * bits)) | (b << bits) | c
    else:
        pairs, at = np.unique(a << 32 | b, return_inverse=True)
        key = at << 32 | c
    order = np.argsort(key, kind="stable")
    key, weights = key[order], weights[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    sums = np.add.reduceat(weights, first) if len(first) else weights
    key = key[first]
    if packed:
        low = (1 << bits) - 1
        return key >> (2 * bits), (key >> bits) & low, key & low, sums
    pair = pairs[key >> 32]
    return pair >> 32, pair & 0xFFFFFFFF, key & 0xFFFFFFFF, sums


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal values begins, and the end."""
    new = np.zeros(len(columns[0]), np.bool_)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of each of the given stretches, one stretch behind the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _shared(starts: np.ndarray, label: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(state of each run, runs that are kept)``: runs of equal arcs become one state. Hashes propose, arcs decide."""
    sizes = np.diff(starts)
    place = np.arange(len(label)) - np.repeat(starts[:-1], sizes)
    mixed = (label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ target.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(0x165667B1))
    mixed ^= mixed >> np.uint64(29)
    _, first, of = np.unique(np.add.reduceat(mixed, starts[:-1]), return_index=True, return_inverse=True)
    like = first[of]
    other = np.minimum(np.repeat(starts[:-1][like], sizes) + place, len(label) - 1)
    equal = np.logical_and.reduceat((label == label[other]) & (target == target[other]), starts[:-1]) & (sizes == sizes[like])
    like = np.where(equal, like, np.arange(len(like)))
    kept, state = np.unique(like, return_inverse=True)
    return state, kept


class Automaton:
    """A minimal acyclic automaton over triples of words, with a weight on each last arc.

    ``words`` are in byte order and numbered from 1; 0 is the end mark. Each of the three layers has states, which are
    stretches of arcs sorted by label.
    """

    def __init__(self, words: list[bytes], layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.words, self.layers = words, layers  # of each layer: where states begin, labels, targets or weights

    @classmethod
    def of(cls, words: list[bytes], a: np.ndarray, b: np.ndarray, c: np.ndarray, weights: np.ndarray) -> Automaton:
        """Of sorted distinct triples, at least one."""
        pairs, firsts = _runs(a, b), _runs(a)
        state, kept = _shared(pairs, c, weights)
        sizes = np.diff(pairs)[kept]
        arcs = _spread(pairs[:-1][kept], sizes)
        last = np.append(0, np.cumsum(sizes)), c[arcs], weights[arcs]
        second = b[pairs[:-1]]
        begins = np.append(np.searchsorted(pairs[:-1], firsts[:-1]), len(second))
        above, kept = _shared(begins, second, state)
        sizes = np.diff(begins)[kept]
        arcs = _spread(begins[:-1][kept], sizes)
        middle = np.append(0, np.cumsum(sizes)), second[arcs], state[arcs]
        root = np.array([0, len(firsts) - 1]), a[firsts[:-1]], above
        return cls(words, [root, middle, last])

    def paths(self) -> tuple[np.ndarray, ...]:
        """The triples in order, and their weights."""
        (_, a, to), (begin_b, b, to_b), (begin_c, c, weight) = self.layers
        sizes = np.diff(begin_b)[to]
        arcs = _spread(begin_b[:-1][to], sizes)
        a, b, to = np.repeat(a, sizes), b[arcs], to_b[arcs]
        sizes = np.diff(begin_c)[to]
        arcs = _spread(begin_c[:-1][to], sizes)
        return np.repeat(a, sizes), np.repeat(b, sizes), c[arcs], weight[arcs]

    def weights_of(self, *triples: np.ndarray) -> np.ndarray:
        """The weights of triples of word numbers, 0 where there is no such path; numbers below 0 are on none."""
        width = len(self.words) + 1
        state, on = np.zeros(len(triples[0]), np.int64), np.ones(len(triples[0]), np.bool_)
        for label, (begins, labels, targets) in zip(triples, self.layers):
            arcs = np.repeat(np.arange(len(begins) - 1), np.diff(begins)) * width + labels
            want = state * width + label
            at = np.minimum(np.searchsorted(arcs, want), len(arcs) - 1)
            on &= (label >= 0) & (arcs[at] == want)
            state = np.where(on, targets[at], 0)
        return np.where(on, state, 0)

    def to_bytes(self) -> bytes:
        """All of it, compressed."""
        arrays = [np.array([len(w) for w in self.words], np.int64)] + [x for begins, labels, targets in self.layers for x in (np.diff(begins), labels, targets)]
        narrow = [x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in arrays]
        head = np.array([y for x in narrow for y in (len(x), x.dtype.itemsize)], np.int64).tobytes()
        raw = b"".join([head, *(x.tobytes() for x in narrow), *self.words])
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @classmethod
    def from_bytes(cls, data: bytes) -> Automaton:
        """What :meth:`to_bytes` gave."""
        raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
        head, at, arrays = np.frombuffer(raw, np.int64, 20).reshape(10, 2).tolist(), 160, []
        for n, width in head:
            arrays.append(np.frombuffer(raw, f"<u{width}", n, at).astype(np.int64))
            at += n * width
        ends = (np.cumsum(arrays[0]) + at).tolist()
        words = [raw[i:j] for i, j in zip([at, *ends[:-1]], ends)]
        return cls(words, [(np.append(0, np.cumsum(arrays[k])), arrays[k + 1], arrays[k + 2]) for k in (1, 4, 7)])


def _numbered(words: Iterable[bytes]) -> tuple[list[bytes], dict[bytes, int]]:
    """The distinct words in byte order, and their numbers from 1."""
    ordered = sorted(set(words))
    return ordered, {w: i for i, w in enumerate(ordered, 1)}


def _counted(data: bytes) -> tuple[list[bytes], tuple[np.ndarray, ...]] | None:
    """Words in order and summed triples of normalised text, in which a line feed ends a piece."""
    split = pc.split_pattern(pa.array([data.replace(b"\n", b" \n ")], pa.large_binary()), pattern=b" ").flatten().dictionary_encode()
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    found = split.dictionary.to_pylist()
    words, number = _numbered(w for w in found if w not in (b"", b"\n"))
    if not words:
        return None
    of = np.array([-1 if w == b"" else number.get(w, 0) for w in found], np.int64)
    seq = of[np.asarray(split.indices)]
    seq = np.concatenate([seq[seq >= 0], np.zeros(2, np.int64)])
    a, b = seq[:-2], seq[1:-1]
    c = np.where(b > 0, seq[2:], 0)
    word = a > 0
    a, b, c = a[word], b[word], c[word]
    return words, _summed((a, b, c), np.ones(len(a), np.int64), len(words) + 1)


def _part(words: list[bytes], triples: tuple[np.ndarray, ...]) -> Automaton:
    """An automaton of some triples with their words only."""
    a, b, c, weights = triples
    used = np.unique(np.concatenate([a, b, c]))
    used = used[used > 0]
    new = np.zeros(len(words) + 1, np.int64)
    new[used] = np.arange(1, len(used) + 1)
    return Automaton.of([words[i - 1] for i in used.tolist()], new[a], new[b], new[c], weights)


def _before(words: list[bytes], triples: tuple[np.ndarray, ...], bound: tuple[bytes, ...]) -> int:
    """How many of the sorted triples are smaller than a boundary of three words."""
    low, high = 0, len(triples[0])
    for column, word in zip(triples, bound):
        at = bisect.bisect_left(words, word) + 1 if word else 0
        from_here = low + int(np.searchsorted(column[low:high], at, "left"))
        if word and (at > len(words) or words[at - 1] != word):
            return from_here
        low, high = from_here, low + int(np.searchsorted(column[low:high], at, "right"))
    return low


def _pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Long normalised text in stretches that end where pieces do."""
    at = 0
    while len(data) - at > 2 * size:
        to = data.rfind(b"\n", at, at + size)
        if to <= at:
            to = data.find(b"\n", at + size)
        if to < 0:
            break
        yield data[at:to]
        at = to
    yield data[at:] if at else data


def boundaries(docs: DataFrame, range_bytes: int) -> DataFrame:
    """``(lang, bounds)`` of ``(lang, text)``: sorted triples that cut each language's paths into ranges of about equal weight.

    Samples are taken at places dealt by bytes. Where all boundaries would hold more than ``MOST_BROADCAST`` bytes, ranges are larger.
    """
    sizes = materialise(docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")), "sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    range_bytes = max(range_bytes, ceil(total * 128 / MOST_BROADCAST))
    step = float(max(1, range_bytes // SAMPLES))
    points = F.floor(F.octet_length("text") / F.lit(step) + F.rand(13)).cast("int")
    drawn = docs.withColumn("points", points).where("points > 0").select("lang", "text", F.explode(F.sequence(F.lit(1), "points")), F.length("text").alias("n"))
    around = F.substring(F.col("text"), (F.rand(17) * F.col("n")).cast("int") + 1, F.lit(256))
    words = F.regexp_extract_all(F.translate(around, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([^\x20\x09.,;:!?\x0A-\x0D]+)"), F.lit(1))
    word = lambda i: F.coalesce(F.get(F.col("w"), F.lit(i)), F.lit(""))
    samples = drawn.select("lang", words.alias("w")).where("size(w) > 1").select("lang", F.struct(word(1).alias("w1"), word(2).alias("w2"), word(3).alias("w3")).alias("path"))
    numbered = materialise(samples, "samples").withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("path")))
    bounds = numbered.where(f"at % {SAMPLES} = 0").groupBy("lang").agg(F.array_sort(F.collect_set("path")).alias("bounds"))
    return materialise(sizes.select("lang").join(bounds, "lang", "left").select("lang", F.coalesce("bounds", F.expr("cast(array() as array<struct<w1: string, w2: string, w3: string>>)")).alias("bounds")), "bounds")


def automata(docs: DataFrame, bounds: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(lang, range, automaton)`` of ``(lang, text)``: of each stretch of text, an automaton for every prefix range."""
    spark = docs.sparkSession
    cuts = spark.sparkContext.broadcast({r.lang: [tuple(w.encode() for w in b) for b in r.bounds] for r in bounds.collect()})
    small_batches(spark)

    def made(lang: str, data: bytes) -> Iterator[tuple[str, int, bytes]]:
        for piece in _pieces(data.translate(_NORMAL), shard_bytes):
            if (counted := _counted(piece)) is None:
                continue
            words, triples = counted
            at = 0
            for i, to in enumerate([*(_before(words, triples, b) for b in cuts.value.get(lang, ())), len(triples[0])]):
                if to > at:
                    yield lang, i, _part(words, tuple(x[at:to] for x in triples)).to_bytes()
                at = to
        give_back()

    def batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["lang", "range", "automaton"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sizes[lang] >= shard_bytes or sum(sizes.values()) >= 4 * shard_bytes:
                    largest = max(sizes, key=sizes.get)
                    del sizes[largest]
                    yield batch(list(made(largest, b"\n".join(held.pop(largest)))))
        for lang in list(held):
            yield batch(list(made(lang, b"\n".join(held.pop(lang)))))

    return docs.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, range int, automaton binary")


def _united(parts: list[bytes]) -> tuple[list[bytes], tuple[np.ndarray, ...]]:
    """Words and triples of several automata, weights of equal triples summed."""
    numbers: dict[bytes, int] = {}
    rows: list[tuple[np.ndarray, ...]] = []
    for data in parts:
        one = Automaton.from_bytes(data)
        of = np.array([0] + [numbers.setdefault(w, len(numbers) + 1) for w in one.words], np.int64)
        a, b, c, weights = one.paths()
        rows.append((of[a], of[b], of[c], weights))
    words, final = _numbered(numbers)
    new = np.zeros(len(words) + 1, np.int64)
    for w, i in numbers.items():
        new[i] = final[w]
    a, b, c, weights = (np.concatenate(x) for x in zip(*rows))
    return words, _summed((new[a], new[b], new[c]), weights, len(words) + 1)


def _frequent(words: list[bytes], triples: tuple[np.ndarray, ...], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words, pairs and triples that may be frequent in all, with the weights below their prefixes.

    The first and the last word and pair may go on in the ranges beside; their sums are partial and stay whatever they are.
    """
    a, b, c, weights = triples
    zero = np.zeros(len(a), np.int64)
    for depth, runs in ((1, _runs(a)), (2, _runs(a, b))):
        sums = np.add.reduceat(weights, runs[:-1])
        keep = sums >= least
        keep[[0, -1]] = True
        if depth == 2:
            keep &= b[runs[:-1]] > 0
        at = runs[:-1][keep]
        yield a[at], b[at] if depth == 2 else zero[at], zero[at], sums[keep]
    keep = (c > 0) & (weights >= least)
    yield a[keep], b[keep], c[keep], weights[keep]


def counts(docs: DataFrame, bounds: DataFrame, least: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(lang, w1, w2, w3, f)``: words, pairs and triples that occur ``least`` times in a language, and all words of it as a row of empty words."""

    def run(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        words, triples = _united(table.column("automaton").to_pylist())
        text = np.array(["", *(w.decode("utf-8", "replace") for w in words)], object)
        parts = list(_frequent(words, triples, least))
        w1, w2, w3, f = (np.concatenate(x) for x in zip(*parts))
        columns = [[*text[w1], ""], [*text[w2], ""], [*text[w3], ""], [*f.tolist(), int(triples[3].sum())]]
        give_back()
        return pa.table({"lang": pa.array([lang] * len(columns[0]), pa.string()), "w1": pa.array(columns[0], pa.string()), "w2": pa.array(columns[1], pa.string()), "w3": pa.array(columns[2], pa.string()), "f": pa.array(columns[3], pa.int64())})

    found = automata(docs, bounds, shard_bytes).groupBy("lang", "range").applyInArrow(run, "lang string, w1 string, w2 string, w3 string, f long")
    return found.groupBy("lang", "w1", "w2", "w3").agg(F.sum("f").alias("f")).where(f"f >= {least} or w1 = ''")


def part_counts(frequent: DataFrame, bounds: DataFrame) -> DataFrame:
    """``(lang, w1, w2, w3, a, k, l, r)``: for each frequent phrase of several words and each cut, how often the parts occur.

    Parts meet the automata of frequent words and pairs in the prefix range that the part falls in. Parts of one range are
    dealt to as many tasks as their number asks for, so that a word in very many phrases is no hot key.
    """
    most = bounds.agg(F.max(F.size("bounds"))).first()[0] or 0
    lookup = if_small(bounds, "48 * size(bounds)")

    def placed(df: DataFrame, *words: str) -> DataFrame:
        path = F.struct(*(F.coalesce(F.col(w), F.lit("")).alias(f"w{i}") for i, w in enumerate(words, 1)), F.lit("").alias("w3"))
        return df.join(lookup, "lang").withColumn("range", place_in("bounds", path, most)).drop("bounds")

    part = lambda k, side, p1, p2=None: F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), F.col(p1).alias("p1"), (F.col(p2) if p2 else F.lit("")).alias("p2"))
    pairs, triples = [part(1, "l", "w1"), part(1, "r", "w2")], [part(1, "l", "w1"), part(1, "r", "w2", "w3"), part(2, "l", "w1", "w2"), part(2, "r", "w3")]
    cut = F.when(F.col("w3") == "", F.array(*pairs)).otherwise(F.array(*triples))
    parts = placed(frequent.where("w2 <> ''").select("lang", "w1", "w2", "w3", F.col("f").alias("a"), F.explode(cut).alias("part")).select("lang", "w1", "w2", "w3", "a", "part.*"), "p1", "p2")
    parts = materialise(parts, "parts")
    sizes = if_small(materialise(parts.groupBy("lang", "range").agg(F.ceil(F.count("*") / _CHUNK).cast("int").alias("chunks")), "chunks"), "2")
    left = parts.join(sizes, ["lang", "range"]).withColumn("chunk", F.pmod(F.xxhash64("w1", "w2", "w3", "k", "side"), F.col("chunks")).cast("int")).drop("chunks")
    right = placed(frequent.where("w1 <> '' and w3 = ''").select("lang", "w1", "w2", "f"), "w1", "w2").join(sizes, ["lang", "range"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def compose(asked: pa.Table, known: pa.Table) -> pa.Table:
        p1, p2 = asked.column("p1").to_pylist(), asked.column("p2").to_pylist()
        w1, w2 = known.column("w1").to_pylist(), known.column("w2").to_pylist()
        found = np.zeros(len(p1), np.int64)
        if w1 and p1:
            words, number = _numbered(w.encode() for w in (*w1, *w2) if w)
            number[b""] = 0
            ids = lambda column: np.array([number.get(w.encode(), -1) for w in column], np.int64)
            zeros = np.zeros(len(w1), np.int64)
            automaton = Automaton.of(words, *_summed((ids(w1), ids(w2), zeros), np.asarray(known.column("f")), len(words) + 1))
            found = automaton.weights_of(ids(p1), ids(p2), np.zeros(len(p1), np.int64))
        return asked.select(["lang", "w1", "w2", "w3", "a", "k", "side"]).append_column("f", pa.array(found))

    keys = ["lang", "range", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compose, "lang string, w1 string, w2 string, w3 string, a long, k int, side string, f long")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f"))).alias(s)
    return found.groupBy("lang", "w1", "w2", "w3", "a", "k").agg(side("l"), side("r"))


def collocations(df: DataFrame, most: int = 2000, least: int = 10, range_bytes: int = RANGE_BYTES, shard_bytes: int = SHARD_BYTES, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the strongest phrases of two and three words of each language.

    A phrase that occurs ``a >= least`` times is a candidate. Of its cuts into parts that occur ``l`` and ``r`` times the
    one with the lowest ``floor(1000000 a^2 / (l r))`` counts, the first of equal ones. Candidates that a longer
    candidate holds, which occurs at least half as often, go. ``n`` are all words of the language; the arithmetic is exact.

    Edge cases: a NULL language is ``und``, as is that name itself; a NULL or empty text has no words; phrases do not
    go beyond a piece or a text; ties in score and count are ordered by the phrase's bytes; repeated rows count again; other columns
    are not read, whatever their names; very long texts are cut where pieces end; an empty table gives no rows.
    """
    lang = F.coalesce(F.col(f"`{lang_column}`").cast("string"), F.lit("und"))
    docs = df.select(lang.alias("lang"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    bounds = boundaries(docs, range_bytes)
    frequent = materialise(counts(docs, bounds, least, shard_bytes), "frequent")
    cuts = part_counts(frequent, bounds)
    whole = lambda c: f"cast({c} as decimal(15, 0))"
    score = F.expr(f"({whole('a')} * {whole('a')} * cast(1000000 as decimal(7, 0))) div ({whole('l')} * {whole('r')})")
    lowest = cuts.groupBy("lang", "w1", "w2", "w3", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("at")).select("lang", "w1", "w2", "w3", "a", "at.score", "at.l", "at.r")
    inside = F.explode(F.array(F.struct(F.col("w1").alias("x"), F.col("w2").alias("y")), F.struct(F.col("w2").alias("x"), F.col("w3").alias("y"))))
    longer = frequent.where("w3 <> ''").select("lang", inside.alias("held"), "f").groupBy("lang", F.col("held.x").alias("w1"), F.col("held.y").alias("w2")).agg(F.max("f").alias("longest")).withColumn("w3", F.lit(""))
    scored = materialise(lowest, "scored")
    left = scored.join(longer, ["lang", "w1", "w2", "w3"], "left").where("longest is null or 100 * longest < 50 * a")
    phrase = F.concat_ws(" ", "w1", "w2", F.when(F.col("w3") != "", F.col("w3")))
    strongest = lambda *group: F.row_number().over(Window.partitionBy("lang", *group).orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    of_bucket = left.select("lang", phrase.alias("phrase"), "a", "l", "r", "score").withColumn("rank", strongest(F.pmod(F.xxhash64("phrase"), F.lit(_BUCKETS)))).where(f"rank <= {most}")
    ranked = of_bucket.withColumn("rank", strongest()).where(f"rank <= {most}")  # at most _BUCKETS * most rows of a language meet in one task
    of_lang = frequent.where("w1 = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(of_lang, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS t FROM p),
g AS (SELECT lang, k, t[i : i + k - 1] AS q FROM (SELECT lang, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) s(k))),
f AS (SELECT lang, q, k AS size, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(len(t)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, q, size, f AS a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
s AS (SELECT c.*, x.f AS l, y.f AS r, CAST(CAST(a AS HUGEINT) * a * 1000000 // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM c JOIN f x ON x.lang = c.lang AND x.q = c.q[1 : k] JOIN f y ON y.lang = c.lang AND y.q = c.q[k + 1 :]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, q ORDER BY score, k) = 1),
h AS (SELECT lang, q, max(f) AS longest FROM (SELECT lang, unnest([q[1 : 2], q[2 : 3]]) AS q, f FROM f WHERE size = 3) GROUP BY ALL),
d AS (SELECT b.*, array_to_string(b.q, ' ') AS phrase FROM b LEFT JOIN h ON h.lang = b.lang AND h.q = b.q WHERE longest IS NULL OR 100 * longest < 50 * a)
SELECT d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM d JOIN n ON n.lang = d.lang QUALIFY rank <= 2000
"""
