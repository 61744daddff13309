"""Fill-in-the-middle transformation with cuts found by word-wide bit arithmetic.

A batch of texts is one run of UTF-8 bytes, viewed as little-endian uint64
words. A byte ends a code point when the byte after it is no continuation byte
(``10xxxxxx``); eight bytes are marked at a time by shifts and masks, and
``bitwise_count`` gives the ends in each word. The cut behind the k-th code
point is then a binary search of the cumulated counts for its word and a select
inside that word: a multiplication gives the ends up to each byte, a subtraction
compares all eight with the rank, and the number of bytes below it is the place.
No text is decoded, and all cuts of a batch are found together.

Every text is cut into prefix, middle and suffix at two code-point positions
drawn from the hash of its id, and written as ``<P>``prefix``<S>``suffix``<M>``middle
(psm) or ``<S>``suffix``<P>``prefix``<M>``middle (spm). An empty text, one that
contains a mark, and the share of texts that is to stay as it is are plain.

Defined results: a null text counts as empty; rows of equal ids are cut at
positions drawn from the same numbers; a null id draws from the empty id; parts
may be empty; an empty table gives an empty result; other columns are handed on
unless they are named like the result's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: percent of the texts that are transformed, and percent of those in suffix-first order
RATE, SPM_RATE = 90, 20
SEED = 1
_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)


class Units:
    """Counts and positions of the code points in a run of UTF-8 bytes."""

    def __init__(self, data: np.ndarray) -> None:
        self.size = len(data)
        padded = np.zeros(self.size // 8 * 8 + 16, dtype=np.uint8)  # zero bytes start units, so the last text byte ends one
        padded[: self.size] = data
        w = padded.view("<u8")
        starts = ~(w >> np.uint64(7) & ~(w >> np.uint64(6))) & _ONES
        self.ends = starts[:-1] >> np.uint64(8) | starts[1:] << np.uint64(56)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)])

    def count_to(self, at: np.ndarray) -> np.ndarray:
        """Units that end in front of each byte offset."""
        word = at >> 3
        low = (np.uint64(1) << (at & 7).astype(np.uint64) * np.uint64(8)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.ends[word] & low)

    def offset_of(self, k: np.ndarray) -> np.ndarray:
        """The byte offset behind the first ``k`` units."""
        word = np.searchsorted(self.before, np.maximum(k, 1), "left") - 1
        rank = (np.maximum(k, 1) - self.before[word]).astype(np.uint64)
        to_byte = self.ends[word] * _ONES  # in each byte, the ends up to it
        reached = ((to_byte | _HIGH) - rank * _ONES) & _HIGH
        return np.where(k > 0, word * 8 + 9 - np.bitwise_count(reached), 0)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, and where each text starts and the last ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def draws(row_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a row: the first 32 hex digits of the hash of seed and id."""
    d = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).digest()
    return tuple(int.from_bytes(d[i:i + 4], "big") for i in (0, 4, 8, 12))


_ADDED = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
          ("output", pa.string())]


def transform(docs: DataFrame, text: str = "text", id_col: str = "doc_id", seed: int = SEED, rate: int = RATE,
              spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` without ``text``, with ``n`` (code points), ``form`` (plain, psm
    or spm), ``prefix_chars`` and ``middle_chars`` (null if plain) and ``output``."""
    added = {k for k, _ in _ADDED}
    rest = [c for c in docs.columns if c not in (text, id_col) and c.lower() not in added]
    src = docs.select(F.col(id_col).cast("bigint").alias(id_col), *[F.col(f"`{c}`") for c in rest],
                      text_or_empty(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if not b.num_rows:
                continue
            data, at = _texts(b.column(b.num_columns - 1))
            raw, units = data.tobytes(), Units(data)
            first = units.count_to(at)
            n = np.diff(first)
            h = np.array([draws(i, seed) for i in b.column(0).to_pylist()], dtype=np.int64)
            c1, c2 = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            low, high = np.minimum(c1, c2), np.maximum(c1, c2)
            cut1, cut2 = (np.where(c > 0, units.offset_of(first[:-1] + c), at[:-1]) for c in (low, high))
            form, out = [], []
            for s, p, m, e, keep, kind in zip(at[:-1].tolist(), cut1.tolist(), cut2.tolist(), at[1:].tolist(),
                                              (h[:, 2] % 100 >= rate).tolist(), (h[:, 3] % 100 < spm_rate).tolist()):
                t = raw[s:e]
                if keep or not t or PREFIX in t or SUFFIX in t or MIDDLE in t:
                    form.append("plain")
                    out.append(t)
                elif kind:
                    form.append("spm")
                    out.append(b"".join((SUFFIX, raw[m:e], PREFIX, raw[s:p], MIDDLE, raw[p:m])))
                else:
                    form.append("psm")
                    out.append(b"".join((PREFIX, raw[s:p], SUFFIX, raw[m:e], MIDDLE, raw[p:m])))
            plain = np.array([f == "plain" for f in form])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(n), pa.array(form), pa.array(low, mask=plain), pa.array(high - low, mask=plain),
                 pa.array(out, pa.binary()).cast(pa.string())], names=[id_col, *rest, *(k for k, _ in _ADDED)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), "n bigint", "form string",
                        "prefix_chars bigint", "middle_chars bigint", "output string"])
    return src.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form") -> F.Column:
    """The text that an output was made of, from the output and its form alone.
    No part contains a mark, and a mark overlaps no other, so the first one found ends its part."""
    mark = {"P": PREFIX.decode(), "S": SUFFIX.decode(), "M": MIDDLE.decode()}
    o = F.col(output)

    def between(a: str, b: str) -> F.Column:
        return F.substring_index(F.substring(o, F.instr(o, mark[a]) + 3, F.length(o)), mark[b], 1)

    middle = F.substring(o, F.instr(o, mark["M"]) + 3, F.length(o))
    return F.when(F.col(form) == "psm", F.concat(between("P", "S"), middle, between("S", "M"))) \
        .when(F.col(form) == "spm", F.concat(between("P", "M"), middle, between("S", "P"))).otherwise(o)
