"""Byte-pair encoding and decoding by a pair occurrence index.

A worker takes the pre-tokens of a slice of its partition that it has not met yet, lays their byte symbols out in one
linked sequence, and keeps for each mergeable pair the list of all positions at which it occurs. Pairs that occur are
*active*; they are applied in ascending order of rank, each to all its positions from left to right, and a merge adds
the two pairs it creates to their lists. Entries that a merge made stale are recognised when their list is taken.
"""

from __future__ import annotations

import gc
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fennelmill.llm.common import slices, small_batches

#: Fixed value: the split pattern of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept by a worker, and the longest kept; beyond them encoding is repeated, never skipped.
KEPT_WORDS, KEPT_CHARS = 400_000, 64
_SHIFT = 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    own = set(plain)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """What encoding needs of a tokenizer file: byte symbols, ranked pairs, bytes of each id, special strings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        ids = model["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.first = [ids[c] for c in letters]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(ids[a] << _SHIFT | ids[b], (rank, ids[a + b]))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"] if not (x["lstrip"] or x["rstrip"] or x["single_word"])}
        if len(self.special) != len(spec["added_tokens"]):
            raise ValueError(f"added tokens that strip or need word ends aren't supported: {path}")
        self.bytes_of: dict[int, bytes] = {i: bytes(of_letter[c] for c in s) for s, i in ids.items() if all(c in of_letter for c in s)}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = regex.compile(SPLIT)

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text between special strings, and the ids of those, in order."""
        at = 0
        if self.cut is not None and any(s in text for s in self.special):
            for m in self.cut.finditer(text):
                yield text[at : m.start()], self.special[m.group()]
                at = m.end()
        yield text[at:], None


def apply_pairs(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """The ids of each word, by one index over the pair occurrences of all of them."""
    first, pairs = vocabulary.first, vocabulary.pairs
    symbol = [first[b] for w in words for b in w]
    n = len(symbol)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    starts, at = [], 0
    for w in words:
        starts.append(at)
        if w:
            before[at] = -1
            at += len(w)
            after[at - 1] = -1
    where: dict[int, list[int]] = {}
    for i in range(n):
        j = after[i]
        if j >= 0 and (key := symbol[i] << _SHIFT | symbol[j]) in pairs:
            if (at_pair := where.get(key)) is None:
                where[key] = [i]
            else:
                at_pair.append(i)
    active = [(pairs[key][0], key) for key in where]
    heapq.heapify(active)
    while active:
        key = heapq.heappop(active)[1]
        a, b, new = key >> _SHIFT, key & (1 << _SHIFT) - 1, pairs[key][1]
        positions = where.pop(key)
        positions.sort()
        for i in positions:
            if symbol[i] != a or (j := after[i]) < 0 or symbol[j] != b:
                continue
            symbol[i], symbol[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                follows = new << _SHIFT | symbol[k]
                if follows in pairs:
                    if follows in where:
                        where[follows].append(i)
                    else:
                        where[follows] = [i]
                        heapq.heappush(active, (pairs[follows][0], follows))
            if (h := before[i]) >= 0:
                leads = symbol[h] << _SHIFT | new
                if leads in pairs:
                    if leads in where:
                        where[leads].append(h)
                    else:
                        where[leads] = [h]
                        heapq.heappush(active, (pairs[leads][0], leads))
    out = []
    for w, s in zip(words, starts):
        one, i = [], s if w else -1
        while i >= 0:
            one.append(symbol[i])
            i = after[i]
        out.append(one)
    return out


class Codec:
    """Encodes and decodes texts in one worker; pre-tokens met before are kept up to a bound."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, bytes] = {}
        self.one = {i: i.to_bytes(4, "little") for i in self.vocabulary.bytes_of}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers. No garbage is collected meanwhile: what is made has no cycles."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = self.vocabulary.split.findall
        parts = [[(split(t), special) for t, special in self.vocabulary.segments(text)] for text in texts]
        known, one = self.known, self.one
        if len(known) > KEPT_WORDS:  # what this slice has again is frequent, and stays
            again = {w for segments in parts for words, _ in segments for w in words if w in known}
            known = self.known = {w: known[w] for w in again}
        fresh = list({w for segments in parts for words, _ in segments for w in words if w not in known})
        for w, ids in zip(fresh, apply_pairs([w.encode() for w in fresh], self.vocabulary)):
            known[w] = np.array(ids, "<u4").tobytes() if len(ids) > 16 else b"".join([one[i] for i in ids])
        out = [b"".join([b"".join(map(known.__getitem__, words)) + (b"" if special is None else special.to_bytes(4, "little")) for words, special in segments]) for segments in parts]
        for w in fresh:
            if len(w) > KEPT_CHARS:
                del known[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        of = self.vocabulary.bytes_of
        return b"".join(map(of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each file and Python worker."""
    return Codec(path)


def encode_decode(df: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, ids BINARY, decoded STRING)`` for each row; no shuffle, and memory bounded by a slice of a partition.

    ``ids`` are little-endian unsigned 32-bit integers as the tokenizer file gives them without added begin or end
    tokens; strings of special tokens inside a text become those tokens. ``decoded`` is the text of the ids.

    Edge cases: a NULL or empty text has empty ids and an empty decoded text; a NULL id stays NULL; repeated rows give
    repeated results; other columns of the input are not read, whatever their names; an empty table gives no rows; a
    very long text is a slice of its own and a very long pre-token is encoded whole but not kept.
    """
    source = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(tokenizer_path)
        for part in slices(batches, "text", 2 << 20):
            coded = tool.encode([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(coded, pa.binary()), pa.array(map(tool.decode, coded), pa.string())], ["id", "ids", "decoded"])

    return source.mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_column)


def digests(df: DataFrame, *columns: str) -> DataFrame:
    """Some columns (``doc_id``) and the digests of an :func:`encode_decode` result, row by row: NULL and repeated ids stay, an empty table gives no rows."""
    return df.select(
        *(columns or ["doc_id"]),
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
