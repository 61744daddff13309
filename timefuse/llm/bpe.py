"""Byte-level BPE by prefix dynamic programming, and decoding.

A byte string has one BPE encoding, and so has each of its prefixes; the table
keeps the last token of each prefix. A token may follow another when plain
merging of the two together gives just these two, and a sequence is the
encoding of its bytes when all neighbours may follow each other. So the last
token of a prefix is the one that ends there and may follow the last token of
the prefix before it. Appending extends the table; an edit recomputes it from
the edit until it agrees with the old one over the longest token's length.

Texts are split by the vocabulary's pattern and each match is encoded by
itself. The tables of many short matches are filled together, one end of a
prefix and one token length at a time, by array operations over all of them.
Defined results: null and empty texts have no ids; decoding the ids
of a text gives its UTF-8 bytes; ids outside the vocabulary raise; other columns
stay, columns with the result's names are replaced.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: pieces that a worker remembers as objects once they return (some 20 MB), and as bytes: pieces and their length (36 MB at most)
RECENT, PIECES, PIECE_BYTES = 1 << 17, 1 << 19, 32 << 20
#: places of the worker's table of token pairs, a power of two (8 MB)
PAIRS, SPREAD = 1 << 20, 40_503
#: longer pieces (in characters, of four bytes at most) are not remembered
REMEMBERED = 48
#: characters of texts that are encoded together
TOGETHER = 1 << 18
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain_merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Textbook BPE: merge the adjacent pair of lowest rank until none has one."""
    none = len(ranks)
    parts = [data[i:i + 1] for i in range(len(data))]
    merged = [ranks.get(data[i:i + 2], none) for i in range(len(data) - 1)]
    while merged and (best := min(merged)) < none:
        at = merged.index(best)
        parts[at:at + 2] = [both := parts[at] + parts[at + 1]]
        del merged[at]
        if at:
            merged[at - 1] = ranks.get(parts[at - 1] + both, none)
        if at < len(merged):
            merged[at] = ranks.get(both + parts[at + 1], none)
    return [ranks[p] for p in parts]


class Trie:
    """All tokens by their bytes: steps from many nodes at once, through a hash table of (node, byte)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens, sizes = list(ranks), np.fromiter(map(len, ranks), np.int64, len(ranks))
        last = np.fromiter(ranks.values(), np.int32, len(ranks))
        data, begin = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes
        steps, node, n = [], np.zeros(len(tokens), dtype=np.int64), 1
        ends = []
        for k in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > k)
            keys, which = np.unique(node[live] << 8 | data[begin[live] + k], return_inverse=True)
            steps.append(keys)
            node[live] = n + which
            n += len(keys)
            ends.append(live[sizes[live] == k + 1])
        #: the token that ends at each node, or -1
        self.token = np.full(n, -1, dtype=np.int32)
        for whole in ends:
            self.token[node[whole]] = last[whole]
        keys = np.concatenate([*steps, np.zeros(0, dtype=np.int64)])
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.nodes = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        value, place = np.arange(1, n), self._place(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[place] < 0)
            self.keys[place[free]] = keys[free]
            there = self.keys[place] == keys
            self.nodes[place[there]] = value[there]
            keys, value, place = keys[~there], value[~there], place[~there] + 1 & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _MIX >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node that each byte leads to, or 0."""
        keys = node.astype(np.int64) << 8 | byte
        place = self._place(keys)
        found = self.keys[place]
        out = np.where(found == keys, self.nodes[place], 0)
        again = np.flatnonzero((found != keys) & (found >= 0))
        place, keys = place[again], keys[again]
        while len(again):
            place = place + 1 & self.mask
            found = self.keys[place]
            same = found == keys
            out[again[same]] = self.nodes[place[same]]
            more = np.flatnonzero(~same & (found >= 0))
            again, place, keys = again[more], place[more], keys[more]
        return out


class Vocabulary:
    """Ranks of a tiktoken file, an automaton that finds every token, and the
    memory of which tokens may follow which."""

    def __init__(self, path: str) -> None:
        self.tokens = _tokens(path)
        self.ranks = {t: r for r, t in self.tokens.items()}
        self.longest = max(map(len, self.ranks))
        self.sizes = np.zeros(max(self.tokens) + 1, dtype=np.int64)
        self.sizes[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.trie = Trie(self.ranks)
        self.pairs = array("q", [-1]) * PAIRS
        self._pairs = np.frombuffer(self.pairs, dtype=np.int64)

    @cached_property
    def automaton(self):
        """Finds the tokens of one long string; made when the first one comes."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        automaton.make_automaton()
        return automaton

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``; -1 stands for the start.

        An answer is kept with its pair in one place of the table, where the
        next pair of that place replaces it."""
        pair = (left + 1 << 32) + (right << 1)
        known = self.pairs[at := left * SPREAD + right & PAIRS - 1] ^ pair
        if known not in (0, 1):
            head = [] if left < 0 else [left]
            data = b"".join(self.tokens[t] for t in [*head, right])
            known = plain_merge(data, self.ranks) == [*head, right]
            self.pairs[at] = pair | known
        return bool(known)

    def follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``follows`` for each pair of two arrays."""
        pair = (left + 1 << 32) + (right << 1)
        known = self._pairs[left * SPREAD + right & PAIRS - 1] ^ pair
        new = np.flatnonzero(known & ~1)
        if len(new):
            pairs, which = np.unique(pair[new], return_inverse=True)
            known[new] = np.array([self.follows((p >> 32) - 1, (p & 0xFFFFFFFF) >> 1) for p in pairs.tolist()])[which]
        return known == 1

    def last_tokens(self, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The prefix tables of many short strings that lie one after the other in ``data``."""
        first = np.repeat(begin, sizes)
        room = first + np.repeat(sizes, sizes) - np.arange(len(data))
        at, node, k, found = np.arange(len(data)), np.zeros(len(data), dtype=np.int64), 0, []
        while len(at):
            node = self.trie.step(node, data[at + k])
            token = self.trie.token[node]
            whole = np.flatnonzero(token >= 0)
            found.append((at[whole], token[whole].astype(np.int64), np.full(len(whole), k + 1)))
            k += 1
            more = np.flatnonzero((node > 0) & (room[at] > k))
            at, node = at[more], node[more]
        start, token, size = (np.concatenate(x) for x in zip(*found))
        # by the end of the prefix in its string, then the longest first
        turn = (start - first[start] + size) * (self.longest + 1) - size
        order = np.argsort(turn.astype(np.min_scalar_type(int(turn.max()))), kind="stable")
        start, token, size, turn = start[order], token[order], size[order], turn[order]
        last = np.full(len(data), -2, dtype=np.int64)  # -2: no token yet
        cut = np.flatnonzero(np.concatenate([[True], turn[1:] != turn[:-1], [True]])).tolist()
        for a, b in zip(cut, cut[1:]):
            s, t = start[a:b], token[a:b]
            end = s + (size[a] - 1)
            open_ = np.flatnonzero(last[end] == -2)
            if len(open_):
                s, t, end = s[open_], t[open_], end[open_]
                left = np.where(s == first[s], -1, last[s - 1])
                ok = np.flatnonzero((left > -2) & self.follow(np.maximum(left, -1), t))
                last[end[ok]] = t[ok]
        return last

    def encode(self, strings: list[bytes], dtype: str) -> list[bytes]:
        """Packed ids of short strings that are not empty."""
        width = np.dtype(dtype).itemsize
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        ends = np.cumsum(sizes)
        last = self.last_tokens(np.frombuffer(b"".join(strings), np.uint8), ends - sizes, sizes)
        is_end, at, low = np.zeros(len(last), dtype=bool), ends - 1, ends - sizes
        while len(at):
            is_end[at] = True
            at = at - self.sizes[last[at]]
            more = np.flatnonzero(at >= low)
            at, low = at[more], low[more]
        packed = last[is_end].astype(dtype).tobytes()
        cut = [0, *(np.cumsum(is_end)[ends - 1] * width).tolist()]
        return [packed[a:b] for a, b in zip(cut, cut[1:])]


class PrefixTable:
    """The last token of each prefix of one byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", array("i")
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the string; nothing before its old end is computed again."""
        self.data += more
        self._fill(len(self.last))

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Replace the bytes from ``start`` to ``stop``; the table is computed
        from ``start`` until it agrees with the old one."""
        tail = self.last[stop:]
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = self.last[:start]
        self._fill(start, start + len(new), tail)

    def _fill(self, start: int, same_from: int = 0, old: array | None = None) -> None:
        voc, last, agree = self.vocabulary, self.last, 0
        pairs, follows = voc.pairs, voc.follows
        window = max(0, start - voc.longest)
        for end, (token, size) in voc.automaton.iter(self.data[window:].decode("latin-1")):
            end += window
            if end != len(last):  # before the start, or this prefix has its token
                continue
            left = last[end - size] if end >= size else -1
            # 1 and 0 are the table's yes and no, anything else is another pair
            known = pairs[left * SPREAD + token & PAIRS - 1] ^ (left + 1 << 32) + (token << 1)
            if known == 1 or known and follows(left, token):
                last.append(token)
                if old is not None and end >= same_from:
                    agree = agree + 1 if old[end - same_from] == token else 0
                    if agree >= voc.longest:
                        last.extend(old[end - same_from + 1:])
                        return

    def ids(self) -> list[int]:
        out, at = [], len(self.last) - 1
        while at >= 0:
            out.append(self.last[at])
            at -= len(self.vocabulary.tokens[self.last[at]])
        return out[::-1]


class Pieces:
    """Pieces and their packed ids in one buffer, found by a table of places: an
    eighth of the memory of as many objects. Emptied when full."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.clear()

    def clear(self) -> None:
        self.places, self.buffer, self.n = array("i", [-1]) * (2 * PIECES), bytearray(), 0

    def get(self, piece: bytes) -> bytes | None:
        buffer, places, at, size = self.buffer, self.places, hash(piece) % len(self.places), len(piece)
        while (place := places[at]) >= 0:
            if buffer[place] == size and buffer.startswith(piece, place + 2):
                start = place + 2 + size
                return bytes(buffer[start:start + self.width * buffer[place + 1]])
            at = (at + 1) % len(places)
        return None

    def add(self, piece: bytes, packed: bytes) -> None:
        """Add a piece that is not there, of 255 bytes at most."""
        if self.n >= PIECES or len(self.buffer) >= PIECE_BYTES:
            self.clear()
        at = hash(piece) % len(self.places)
        while self.places[at] >= 0:
            at = (at + 1) % len(self.places)
        self.places[at] = len(self.buffer)
        self.buffer += bytes((len(piece), len(packed) // self.width)) + piece + packed
        self.n += 1


class Encoder(dict):
    """Ids of whole texts as packed little-endian integers; as a dict, the memory of recent pieces."""

    def __init__(self, path: str, pattern: str, dtype: str = "<u4") -> None:
        import regex

        super().__init__()
        self.vocabulary, self.dtype = Vocabulary(path), dtype
        self.known = Pieces(np.dtype(dtype).itemsize)
        self.pieces = regex.compile(pattern).findall

    def _packed(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of each piece: remembered, or computed for all new ones together."""
        found, new = {}, []
        for piece in pieces:
            packed = self.get(piece)
            if packed is None:
                data = piece.encode()
                if len(piece) > REMEMBERED:
                    whole = self.vocabulary.ranks.get(data)
                    ids = [whole] if whole is not None else PrefixTable(self.vocabulary, data).ids()
                    packed = np.array(ids, dtype=self.dtype).tobytes()
                elif (packed := self.known.get(data)) is None:
                    new.append((piece, data))
                    continue
                else:  # met again
                    if len(self) >= RECENT:
                        self.clear()
                    self[piece] = packed
            found[piece] = packed
        ranks = self.vocabulary.ranks
        parts = [x for x in new if x[1] not in ranks]
        if parts:
            found.update(zip((p for p, _ in parts), self.vocabulary.encode([d for _, d in parts], self.dtype)))
        for piece, data in new:
            if piece not in found:
                found[piece] = np.array([ranks[data]], dtype=self.dtype).tobytes()
            self.known.add(data, found[piece])
        return found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out, held, size = [], [], 0
        for i, text in enumerate(texts):
            held.append(self.pieces(text))
            size += len(text)
            if size >= TOGETHER or i + 1 == len(texts):
                packed = self._packed(set().union(*held)).__getitem__
                out += [b"".join(map(packed, pieces)) for pieces in held]
                held, size = [], 0
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str, dtype: str = "<u4") -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path, pattern, dtype)


def _encoding(path: str, pattern: str, names: list[str]) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in slices(batches):
            packed = pa.array(enc.encode_all(b.column(b.num_columns - 1).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], packed], names=names)

    return run


def _decoding(path: str, at: int, names: list[str]) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        for b in slices(batches):
            column = b.column(at).to_pylist()
            out = [None if x is None else b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist()))
                   for x in column]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=names)

    return run


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids",
           decoded: str | None = None) -> DataFrame:
    """Replace the text column by ``ids``: its token ids as little-endian
    unsigned 32-bit integers. With ``decoded``, also decode them as ``decode``
    does, in the same pass: a worker less for each task, and one copy of the ids less."""
    rest = [c for c in df.columns if c not in (text, ids, decoded)]
    src = df.select(*rest, text_or_empty(text).alias("__text"))
    schema = df.select(*rest, F.lit(b"").alias(ids), *[F.lit(b"").alias(c) for c in (decoded,) if c]).schema
    forth = _encoding(path, pattern, [*rest, ids])
    if not decoded:
        return src.mapInArrow(forth, schema)
    back = _decoding(path, len(rest), [*rest, ids, decoded])
    return src.mapInArrow(lambda batches: back(forth(batches)), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``, the bytes that the packed ids stand for (null: null)."""
    src = df.drop(decoded)
    names = [*src.columns, decoded]
    return src.mapInArrow(_decoding(path, src.columns.index(ids), names),
                          src.withColumn(decoded, F.lit(b"").cast("binary")).schema)


@lru_cache(maxsize=4)
def _tokens(path: str) -> dict[int, bytes]:
    with open(path, "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
