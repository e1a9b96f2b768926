"""Token counts by finite-state machines compiled from a byte-level BPE file.

Two deterministic transducers, both with token counts on their transitions:

* :class:`Splitter` reads character classes and marks where pre-tokens begin. It has eight states, so the effect of a
  chunk of text is a map of eight entries. Chunks are mapped side by side, the maps are composed by a parallel prefix
  scan, and every chunk is then run from its true state.
* :class:`Counter` reads the bytes of one pre-token. A state stands for all prefixes with the same future: the longest
  suffix that begins some vocabulary entry, with the last token and the relative token count at each position inside
  it. A transition carries the change of the token count. States are made when first reached and kept in a table of
  bounded size; chunks of all pre-tokens of a slice run through the table in step with each other. A chunk's map, from the
  states met to the state at its end and a count, is composed with those before it.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fennelmill.llm.bpe import Vocabulary
from fennelmill.llm.common import slices, small_batches

_NEVER = 1 << 30
#: States that a worker keeps; when there are more, those not in use are forgotten and made again when reached.
MOST_STATES = 400_000
#: Bytes of a chunk of a pre-token.
CHUNK = 256
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: In a state's key: the token that stands for the beginning of the pre-token, and the relative count 0.
_BEGIN, _EVEN = 1 << 20, 512


class Counter:
    """Lazily determinised transducer from the bytes of a pre-token to its token count."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.rank = {k: v[0] for k, v in vocabulary.pairs.items()}
        made = {new: (k >> 20, k & 0xFFFFF, rank) for k, (rank, new) in vocabulary.pairs.items()}
        special = set(vocabulary.special.values())
        tokens = {b: i for i, b in vocabulary.bytes_of.items() if i not in special}
        self.right = {i: self._spine(i, made, 1) for i in tokens.values()}
        self.left = {i: self._spine(i, made, 0) for i in tokens.values()}
        self.fits: dict[int, bool] = {}
        self._trie(tokens)
        self._reachable(tokens, made)
        self.clear()

    @staticmethod
    def _spine(token: int, made: dict, side: int) -> list[tuple[int, int]]:
        """Symbols at one edge of a token while it is built, first to last, with the rank that ends each."""
        out, ends = [(token, _NEVER)], _NEVER
        while token in made:
            ends = made[token][2]
            token = made[token][side]
            out.append((token, ends))
        return out[::-1]

    def _pair_fits(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay apart when their bytes are merged together."""
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            xs, ys, rank = self.right[a], self.left[b], self.rank
            i = j = 0
            known = True
            while True:
                (x, x_ends), (y, y_ends) = xs[i], ys[j]
                r = rank.get(x << 20 | y, _NEVER)
                if r < x_ends and r <= y_ends and r < _NEVER:
                    known = False
                    break
                if x_ends == y_ends == _NEVER:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _trie(self, tokens: dict[bytes, int]) -> None:
        """An automaton of the vocabulary's prefixes, with the fallback of each node to its longest proper suffix."""
        child: list[dict[int, int]] = [{}]
        self.token, self.depth = [-1], [0]
        for text, i in tokens.items():
            at = 0
            for b in text:
                if b not in child[at]:
                    child[at][b] = len(child)
                    child.append({})
                    self.token.append(-1)
                    self.depth.append(self.depth[at] + 1)
                at = child[at][b]
            self.token[at] = i
        back = [0] * len(child)
        queue = list(child[0].values())
        for node in queue:
            for b, to in child[node].items():
                f = back[node]
                while f and b not in child[f]:
                    f = back[f]
                back[to] = child[f].get(b, 0)
                queue.append(to)
        self.child, self.back = child, back

    def _reachable(self, tokens: dict[bytes, int], made: dict) -> None:
        """Drop entries that merging their own bytes never yields: they end no encoding."""
        bad = set()
        for t in sorted(self.right, key=lambda i: len(self.right[i])):
            if t in made and (made[t][0] in bad or made[t][1] in bad or not self._meets(made[t])):
                bad.add(t)
        self.token = [-1 if t in bad else t for t in self.token]

    def _meets(self, how: tuple[int, int, int]) -> bool:
        """Whether the last merge of an entry is the first to join its two halves."""
        xs, ys = self.right[how[0]], self.left[how[1]]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            r = self.rank.get(x << 20 | y, _NEVER)
            if x_ends == y_ends == _NEVER:
                return r == how[2]
            if r < x_ends and r <= y_ends:
                return False
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def clear(self) -> None:
        self.states: dict[bytes, int] = {}
        self.what: list[bytes] = []
        self.made = 0
        self._table(16)
        self._state(array("i", [0, _BEGIN << 10 | _EVEN]).tobytes())

    def _table(self, bits: int) -> None:
        """An empty open-addressing table: ``state << 8 | byte`` to the next state and the gain."""
        self.bits = bits
        self.keys = np.full(1 << bits, -1, np.int64)
        self.next = np.zeros(1 << bits, np.int32)
        self.gain = np.zeros(1 << bits, np.int8)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot that holds each key, or the free one where it belongs."""
        mask = (1 << self.bits) - 1
        at = ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[at]
        off = np.flatnonzero((held != keys) & (held >= 0))
        while off.size:
            at[off] = (at[off] + 1) & mask
            held = self.keys[at[off]]
            off = off[(held != keys[off]) & (held >= 0)]
        return at

    def _put(self, keys: np.ndarray, to: np.ndarray, gain: np.ndarray) -> None:
        """Add transitions that the table lacks."""
        if 3 * (self.made + len(keys)) > 1 << self.bits:
            full = self.keys >= 0
            keys, to, gain = (np.concatenate([x[full], new]) for x, new in ((self.keys, keys), (self.next, to), (self.gain, gain)))
            self.made = 0
            while 3 * len(keys) > 1 << self.bits:
                self.bits += 2
            self._table(self.bits)
        self.made += len(keys)
        while len(keys):  # of keys that want the same free slot one gets it, and the others go on
            at = self._slots(keys)
            at, first = np.unique(at, return_index=True)
            self.keys[at], self.next[at], self.gain[at] = keys[first], to[first], gain[first]
            left = np.ones(len(keys), np.bool_)
            left[first] = False
            keys, to, gain = keys[left], to[left], gain[left]

    def _state(self, key: bytes) -> int:
        i = self.states.get(key)
        if i is None:
            i = self.states[key] = len(self.what)
            self.what.append(key)
        return i

    def _go(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte: the next state and the gain.

        A state's key is the automaton's node and, for each position from here back to where the node's string begins,
        the last token with the token count relative to here. ``_BEGIN`` stands for the beginning of the pre-token.
        """
        node, *tail = memoryview(self.what[state]).cast("i")
        child, back, depth = self.child, self.back, self.depth
        while node and byte not in child[node]:
            node = back[node]
        node = s = child[node].get(byte, 0)
        while True:
            if (t := self.token[s]) >= 0:
                before = tail[depth[s] - 1]
                if before >> 10 == _BEGIN or self._pair_fits(before >> 10, t):
                    break
            s = back[s]
            if not s:
                raise ValueError(f"no vocabulary entry ends here: state {state}, byte {byte}")
        gain = (before & 1023) - _EVEN + 1
        key = array("i", [node, t << 10 | _EVEN, *[x - gain for x in tail[: depth[node]]]])
        return self._state(key.tobytes()), gain

    def count(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Token counts of the pre-tokens ``data[start : start + size]``.

        Pre-tokens are cut into chunks, which run side by side. A chunk's map says in which state it ends and how many
        tokens it adds for a state in which it begins; it is made for the states that are met. Every chunk is first run
        from the state of a beginning; then the maps are composed along each pre-token, and where a chunk turns out to
        begin in a state that its map lacks, these are run, side by side again, until the composition is whole. The machine
        forgets where it began within some bytes, so that mostly is the second time. Chunks of equal bytes share a map.
        """
        chunks = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(sizes)), chunks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        begin = starts[owner] + nth * CHUNK
        size = np.minimum(CHUNK, sizes[owner] - nth * CHUNK)
        pieces = np.flatnonzero(np.repeat(chunks > 1, chunks))
        alone = np.flatnonzero(np.repeat(chunks == 1, chunks))
        out = np.zeros(len(sizes), np.int64)
        out[owner[alone]] = self._run(data, begin[alone], size[alone], np.zeros(len(alone), np.int64), {})[1]
        if not len(pieces):
            return out
        numbers: dict[bytes, int] = {}
        kind = [numbers.setdefault(data[b : b + n].tobytes(), len(numbers)) for b, n in zip(begin[pieces].tolist(), size[pieces].tolist())]
        _, first = np.unique(kind, return_index=True)
        at, length = begin[pieces][first], size[pieces][first]
        begins_word, words = (nth[pieces] == 0).tolist(), owner[pieces].tolist()
        maps: dict[tuple[int, int], tuple[int, int]] = {}
        wanted = [(k, 0) for k in range(len(numbers))]
        while wanted:
            which = np.array([k for k, _ in wanted], np.int64)
            entry = np.array([q for _, q in wanted], np.int64)
            exits, gains, entry = self._run(data, at[which], length[which], entry, maps)
            maps.update(zip(zip(which.tolist(), entry.tolist()), zip(exits.tolist(), gains.tolist())))
            missing: dict[tuple[int, int], None] = {}
            total = np.zeros(len(sizes), np.int64)
            state = 0
            for k, new, word in zip(kind, begins_word, words):
                state = 0 if new else state
                if (k, state) not in maps:
                    missing[k, state] = None
                state, gain = maps.get((k, state)) or maps[k, 0]
                total[word] += gain
            wanted = list(missing)
        return out + total

    def _run(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, entry: np.ndarray, maps: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Last states, token counts and first states (numbers may change) of chunks, run in step, the longest first; states in ``maps`` stay known."""
        order = np.argsort(-sizes, kind="stable")
        starts, less, entry = starts[order], -sizes[order], entry[order]
        state, total = entry.copy(), np.zeros(len(order), np.int64)
        for step in range(int(-less[0]) if len(order) else 0):
            live = int(np.searchsorted(less, -step, "left"))
            keys = state[:live] << 8 | data[starts[:live] + step]
            at = self._slots(keys)
            if (miss := np.flatnonzero(self.keys[at] < 0)).size:
                new = np.unique(keys[miss])
                made = np.array([self._go(k >> 8, k & 255) for k in new.tolist()], np.int64)
                self._put(new, made[:, 0].astype(np.int32), made[:, 1].astype(np.int8))
                at = self._slots(keys)
            total[:live] += self.gain[at]
            state[:live] = self.next[at]
            if len(self.what) > MOST_STATES + 2 * (len(maps) + len(order)):
                state, entry = self._start_over(state, entry, maps)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], total[back], entry[back]

    def _start_over(self, state: np.ndarray, entry: np.ndarray, maps: dict) -> tuple[np.ndarray, np.ndarray]:
        """Empty the table but for the states in use, renumbered."""
        held = list(maps.items())
        flat = np.array([q for (_, q), (to, _) in held] + [to for _, (to, _) in held], np.int64)
        used = np.unique(np.concatenate([np.zeros(1, np.int64), state, entry, flat]))
        keys = [self.what[i] for i in used.tolist()]
        self.clear()
        new = np.array([self._state(k) for k in keys], np.int64)
        numbered = lambda x: new[np.searchsorted(used, x)]
        flat = numbered(flat).tolist()
        maps.clear()
        maps.update({(k, q): (to, gain) for ((k, _), (_, gain)), q, to in zip(held, flat[: len(held)], flat[len(held) :])})
        return numbered(state), numbered(entry)


#: Classes of characters. An apostrophe's class says how many letters of a contraction follow it, white space's whether
#: something else follows it.
_LETTER, _NUMBER, _OTHER, _SHORT, _LONG, _SPACE_THEN, _WHITE, _WHITE_THEN, _NOTHING = range(9)
#: States: between pre-tokens; in letters, numbers, others, white space; behind a leading space; 1 or 2 letters of a
#: contraction to come.
_FRESH, _IN_LETTERS, _IN_NUMBERS, _IN_OTHERS, _IN_WHITE, _LED, _ONE_MORE, _TWO_MORE = range(8)
#: Contractions of the split pattern, and the characters of Unicode's White_Space property.
_CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
_WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


class Splitter:
    """Transducer from characters to the beginnings of pre-tokens."""

    def __init__(self, chunk: int = 128) -> None:
        self.chunk = chunk
        kinds = {"L": _LETTER, "N": _NUMBER}
        self.kind = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        self.kind[list(_WHITE_SPACE)] = _WHITE
        anew = {_LETTER: _IN_LETTERS, _NUMBER: _IN_NUMBERS, _OTHER: _IN_OTHERS, _SHORT: _ONE_MORE, _LONG: _TWO_MORE, _SPACE_THEN: _LED, _WHITE: _IN_WHITE, _WHITE_THEN: _FRESH}
        go, begins = np.zeros((9, 8), np.uint8), np.zeros((9, 8), np.bool_)
        others = (_OTHER, _SHORT, _LONG)
        for q in range(8):
            for c, to in anew.items():
                go[c, q], begins[c, q] = to, True
            stays = {_IN_LETTERS: {_LETTER: q}, _IN_NUMBERS: {_NUMBER: q}, _IN_OTHERS: dict.fromkeys(others, q), _IN_WHITE: {_WHITE: q}}.get(q, {})
            if q == _LED:
                stays = {_LETTER: _IN_LETTERS, _NUMBER: _IN_NUMBERS, **dict.fromkeys(others, _IN_OTHERS)}
            if q in (_ONE_MORE, _TWO_MORE):
                stays = dict.fromkeys(anew, _FRESH if q == _ONE_MORE else _ONE_MORE)
            for c, to in stays.items():
                go[c, q], begins[c, q] = to, False
            go[_NOTHING, q] = q
        self.go, self.begins = go.ravel(), begins.ravel()

    def classes(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The class of each character; ``ends`` are the positions after each segment's last character."""
        kind = self.kind[points]
        last = np.zeros(len(points), np.bool_)
        last[ends[ends > 0] - 1] = True
        white = kind == _WHITE
        then = np.zeros(len(points), np.bool_)
        then[:-1] = ~white[1:]
        then &= ~last
        kind[white & then] = _WHITE_THEN
        kind[white & then & (points == 0x20)] = _SPACE_THEN
        at = np.flatnonzero((points == 0x27) & ~last)
        padded = np.append(points, [0, 0])
        one, two = padded[at + 1], np.where(last[np.minimum(at + 1, len(last) - 1)], 0, padded[at + 2])
        for letters in _CONTRACTIONS:
            hit = one == ord(letters[0])
            kind[at[hit if len(letters) == 1 else hit & (two == ord(letters[1]))]] = _SHORT if len(letters) == 1 else _LONG
        return kind

    def split(self, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether a pre-token begins at each character of consecutive segments of the given sizes."""
        ends = np.cumsum(sizes)
        chunks = -(-sizes // self.chunk)
        n = int(chunks.sum())
        if not n:
            return np.zeros(0, np.bool_)
        nth = np.arange(n) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        size = np.minimum(self.chunk, np.repeat(sizes, chunks) - nth * self.chunk)
        inside = np.arange(self.chunk) < size[:, None]
        rows = np.full((n, self.chunk), _NOTHING, np.uint8)
        rows[inside] = self.classes(points, ends)
        columns = np.ascontiguousarray(rows.T).astype(np.uint8) * np.uint8(8)
        maps = np.tile(np.arange(8, dtype=np.uint8), (n, 1))
        for column in columns:  # what each chunk makes of each state
            maps = self.go[column[:, None] + maps]
        step, most = 1, int(chunks.max())
        while step < most:  # composition of each chunk with those before it in its segment
            later = np.flatnonzero(nth >= step)
            maps[later] = np.take_along_axis(maps[later], maps[later - step], 1)
            step *= 2
        state = np.zeros(n, np.uint8)
        state[1:] = np.where(nth[1:] > 0, maps[:-1, _FRESH], _FRESH)
        begins = np.empty((self.chunk, n), np.bool_)
        for i, column in enumerate(columns):
            at = column + state
            begins[i] = self.begins[at]
            state = self.go[at]
        return begins.T[inside]


class Tokens:
    """Counts the tokens of texts in one worker."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.counter, self.splitter = Counter(self.vocabulary), Splitter()

    def __call__(self, texts: list[str]) -> np.ndarray:
        parts, owner, out = [], [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            for part, special in self.vocabulary.segments(text):
                parts.append(part)
                owner.append(k)
                out[k] += special is not None
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(whole.encode(), np.uint8)
        begins = self.splitter.split(points, np.fromiter(map(len, parts), np.int64, len(parts)))
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.cumsum(width) - width
        first = np.flatnonzero(begins)
        starts = at[first]
        tokens = self.counter.count(data, starts, np.diff(starts, append=len(data)))
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        np.add.at(out, np.asarray(owner)[np.searchsorted(ends, first, "right")], tokens)
        return out


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    """One pair of transducers for each file and Python worker."""
    return Tokens(path)


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for each row, without a shuffle.

    ``n_tokens`` is what the tokenizer file gives for the whole text, without added begin or end tokens; a special
    token's string inside a text counts as that token. ``over_limit`` is ``n_tokens > limit``.

    Edge cases: a NULL or empty text has 0 bytes and 0 tokens; a NULL id stays NULL; repeated rows give repeated
    results; other columns are not read, whatever their names; an empty table gives no rows; a very long text is
    counted whole, as a slice of its own.
    """
    source = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    small_batches(df.sparkSession)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokens(tokenizer_path)
        for part in slices(batches, "text"):
            texts = part.column("text")
            sizes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            counts = tool([t or "" for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("id"), sizes, pa.array(counts), pa.array(counts > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_column)
