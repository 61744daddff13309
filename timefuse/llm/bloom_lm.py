"""Language-model scores from a log-frequency Bloom filter.

Training counts the words and word pairs of whole texts. Words and pairs are
64-bit hashes; a segment is a range of hashes, and there are as many segments
as keep each within ``SEGMENT_CHARS`` of training text, so a task that counts
or looks up one holds a bounded share at any size.

The filter holds every word and pair with its count on a log scale: a key
counted c times is inserted once for each level up to 1 + log(c) / log(STEP).
A probe asks for level 1, 2, ... until one is missing. Each segment fills its
own parts of the filter, one for words and one for pairs, with ``BITS`` bits an
insertion, so the filter grows with the corpus and is as good at any size. It
is broadcast in blocks of neighbouring segments, ``FILTER_BYTES`` at a time.
Each block is one pass over the documents: the blocks of words give every
token the level of its word, one byte carried along with the text; each block
of pairs then gives the sum of those tokens of a document whose pair it holds.
Few large blocks cost fewer passes; the parameter says how much memory the
workers have for one.

The model: p(w | v) = (c(v w) + MU * p(w)) / (c(v) + MU) with
p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)), all counts from the filter.

The base score needs exact counts. Words that make up 1 / 2^20 of the training
tokens or more (so 2^20 words at most) are broadcast with their counts; the
others of each document go to the segment that counted them, where no word is
frequent enough to make a segment uneven, and come back as one sum.

Defined results: null and empty texts have one token, the end; repeated rows
are counted and scored one by one; without training documents N = V = 0; empty
tables give an empty result; other columns stay, columns with the result's
names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, text_or_empty, written

ADD = 0.1
MU = 300.0
STEP = 2 ** 0.5
MOST_LEVELS = 80
BITS = 10
HASHES = 4
#: bytes of the filter that are broadcast at a time
FILTER_BYTES = 64 << 20
FREQUENT = 1 << 20
SEGMENT_CHARS = 8 << 20
#: tokens that a task counts before it hands them on
FLUSH = 1 << 21
#: bytes of text that a task scores at a time
SCORED_BYTES = 2 << 20
#: segments of counts in one Arrow batch
SENT = 8
SEED = 7
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: the hash of the end of a text; a text's first word follows it
END = np.uint64(0x5851F42D4C957F2D)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words, then the end) and the number of each text's tokens."""
    from xxhash import xxh64_digest

    parts, sizes, end = [], np.zeros(len(texts), dtype=np.int64), int(END).to_bytes(8)
    for i, t in enumerate(texts):
        words = t.translate(LOWER_BYTES).split()
        parts.append(b"".join([xxh64_digest(w, SEED) for w in words]))
        parts.append(end)
        sizes[i] = len(words) + 1
    return np.frombuffer(b"".join(parts), ">u8").astype(np.uint64), sizes


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, the number of each token (each text's
    words, then the end) in them, and the number of each text's tokens."""
    tokens, sizes = token_hashes(texts)
    hashes, which = np.unique(tokens, return_inverse=True)
    return hashes, which, sizes


def pair_hashes(tokens: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it."""
    before = np.concatenate([[END], tokens[:-1]]).astype(np.uint64)
    return mixed(before * _A + tokens)


def _bounds(segment_bits: int) -> np.ndarray:
    return np.arange(1, 1 << segment_bits, dtype=np.uint64) << np.uint64(64 - segment_bits) if segment_bits else \
        np.zeros(0, dtype=np.uint64)


def _cut(keys: np.ndarray, segment_bits: int) -> np.ndarray:
    """Where each segment begins and ends in sorted keys."""
    return np.concatenate([[0], np.searchsorted(keys, _bounds(segment_bits)), [len(keys)]])


def _texts(batch: pa.RecordBatch, column: int, most: int = FLUSH * 3) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of a batch's texts of a bounded number of bytes, with the row of the first."""
    first, held, size = 0, [], 0
    for i, t in enumerate(batch.column(column).cast(pa.binary())):
        held.append(t.as_py())
        size += len(held[-1])
        if size >= most:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _merged(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts from packed runs."""
    k = np.concatenate([np.frombuffer(x, "<u8") for x in keys])
    c = np.concatenate([np.frombuffer(x, "<u4") for x in counts]).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[len(k) > 0], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(STEP) + 1e-9), MOST_LEVELS).astype(np.int64)


#: the count that a level stands for (0: not in the filter)
LEVEL_COUNT = np.concatenate([[0.0], (STEP ** np.arange(MOST_LEVELS) + np.maximum(
    np.ceil(STEP ** np.arange(1, MOST_LEVELS + 1)) - 1, STEP ** np.arange(MOST_LEVELS))) / 2])


def _hashed(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a key's places at a level begin, and how far they are apart (both before the modulus)."""
    h = mixed(keys + np.uint64(level * int(_A) & (1 << 64) - 1))
    return h, mixed(h) | np.uint64(1)


def fill(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A part of the filter: each key inserted at all its levels."""
    there = np.zeros(bits, dtype=bool)
    top = levels(counts)
    for level in range(1, int(top.max(initial=0)) + 1):
        place, step = _hashed(keys[top >= level], level)
        for _ in range(HASHES):
            there[place % np.uint64(bits)] = True
            place += step
    return np.packbits(there, bitorder="little").tobytes()


class Filter:
    """Parts of the filter, one after the other in one array of bytes."""

    def __init__(self, sizes: list[tuple[int, int]], segment_bits: int) -> None:
        """An empty filter for parts of ``sizes``: (segment, bits)."""
        n = 1 << segment_bits
        self.shift, self.size, self.start = segment_bits, np.ones(n, dtype=np.uint64), np.zeros(n, dtype=np.int64)
        at = 1  # segments without a part share an empty byte
        for segment, bits in sizes:
            self.size[segment], self.start[segment] = bits, 8 * at
            at += (bits + 7) // 8
        self.data = np.zeros(at, dtype=np.uint8)

    def put(self, segment: int, part: bytes) -> None:
        at = int(self.start[segment]) >> 3
        self.data[at:at + len(part)] = np.frombuffer(part, dtype=np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key by repeated probes; 0 where a key has no part here."""
        level = np.zeros(len(keys), dtype=np.int64)
        live = np.arange(len(keys))
        segment = (keys >> np.uint64(64 - self.shift)).astype(np.int64) if self.shift else np.zeros(len(keys), dtype=int)
        start, size = self.start[segment], self.size[segment]
        for n in range(1, MOST_LEVELS + 1):
            place, step = _hashed(keys, n)
            # all places of a level together: most keys have them all, and keeping the others out costs more than to look
            there = np.ones(len(keys), dtype=np.uint8)
            for _ in range(HASHES):
                at = start + (place % size).astype(np.int64)
                there &= self.data[at >> 3] >> (at & 7).astype(np.uint8)
                place += step
            more = np.flatnonzero(there)
            if not len(more):
                break
            live, keys, start, size = live[more], keys[more], start[more], size[more]
            level[live] = n
        return level

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count that the filter gives each key."""
        return LEVEL_COUNT[self.levels(keys)]


def count_grams(spark: SparkSession, train: DataFrame, text: str = "text", segment_chars: int = SEGMENT_CHARS,
                docs: DataFrame | None = None) -> tuple[DataFrame, int]:
    """One row per segment: its words with exact counts and its parts of the
    filter; and the segments' bits, from the larger of training text and ``docs``."""
    src = train.select(text_or_empty(text).alias("t"))
    chars = max(df.agg(F.sum(F.length("t"))).first()[0] or 0
                for df in (src, *([docs.select(text_or_empty(text).alias("t"))] if docs is not None else [])))
    bits = max(6, (chars // segment_chars).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            tokens = np.concatenate(held)
            columns = []
            for keys in (tokens, pair_hashes(tokens)):
                k, c = np.unique(keys, return_counts=True)
                cut = _cut(k, bits)
                columns.append([k[a:b].astype("<u8").tobytes() for a, b in zip(cut, cut[1:])])
                columns.append([c[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:])])
            some = [i for i in range(1 << bits) if columns[0][i] or columns[2][i]]
            for at in range(0, len(some), SENT):
                part = some[at:at + SENT]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int64()), *[pa.array([c[i] for i in part], pa.binary()) for c in columns]],
                    names=["segment", "words", "word_counts", "pairs", "pair_counts"])

        size = 0
        for b in batches:
            for _, texts in _texts(b, 0):
                held.append(token_hashes(texts)[0])
                size += len(held[-1])
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    runs = src.mapInArrow(count, "segment bigint, words binary, word_counts binary, pairs binary, pair_counts binary")

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        words, word_counts = _merged(group["words"].to_pylist(), group["word_counts"].to_pylist())
        pairs, pair_counts = _merged(group["pairs"].to_pylist(), group["pair_counts"].to_pylist())
        size = [max(64, BITS * int(levels(c).sum())) for c in (word_counts, pair_counts)]
        return pa.table({"segment": [key[0].as_py()], "words": [words.astype("<u8").tobytes()],
                         "word_counts": [word_counts.astype("<i8").tobytes()], "n": [int(word_counts.sum())],
                         "types": [len(words)], "word_bits": [size[0]], "word_part": [fill(words, word_counts, size[0])],
                         "pair_bits": [size[1]], "pair_part": [fill(pairs, pair_counts, size[1])]},
                        schema=pa.schema([("segment", pa.int64()), ("words", pa.binary()), ("word_counts", pa.binary()),
                                          ("n", pa.int64()), ("types", pa.int64()),
                                          ("word_bits", pa.int64()), ("word_part", pa.binary()),
                                          ("pair_bits", pa.int64()), ("pair_part", pa.binary())]))

    # as many partitions as segments: a task's share stays as it is when the corpus grows
    model = runs.repartition(1 << bits, "segment").groupBy("segment").applyInArrow(
        merge, "segment bigint, words binary, word_counts binary, n bigint, types bigint, "
               "word_bits bigint, word_part binary, pair_bits bigint, pair_part binary")
    return written(spark, model, "model"), bits


def _frequent(model: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with at least 1 / FREQUENT of all tokens, and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, counts = np.frombuffer(w, "<u8"), np.frombuffer(c, "<i8")
                often = counts * FREQUENT >= total
                yield pa.RecordBatch.from_arrays([pa.array([words[often].tobytes()], pa.binary()),
                                                  pa.array([counts[often].tobytes()], pa.binary())], names=["w", "c"])

    rows = model.select("words", "word_counts").mapInArrow(run, "w binary, c binary").collect()
    words = np.frombuffer(b"".join(r["w"] for r in rows), "<u8")
    counts = np.frombuffer(b"".join(r["c"] for r in rows), "<i8")
    order = np.argsort(words)
    return words[order], counts[order]


def _looked_up(keys: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each key in sorted words, or 0."""
    if not len(words):
        return np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
    return np.where(words[at] == keys, counts[at], 0)


def _blocks(model: DataFrame, kind: str, segment_bits: int, filter_bytes: int) -> Iterator[tuple[int, int, Filter]]:
    """The filter of words or pairs in blocks of ``filter_bytes`` (one segment at
    least), each gathered on the driver when its turn comes, with the first
    segment it answers for and the one after its last."""
    sizes = sorted(tuple(r) for r in model.select("segment", f"{kind}_bits").collect())
    blocks: list[list[tuple[int, int]]] = [[]]
    held = 0
    for segment, bits in sizes:
        if blocks[-1] and held + bits > 8 * filter_bytes:
            blocks.append([])
            held = 0
        blocks[-1].append((segment, bits))
        held += bits
    starts = [0, *[b[0][0] for b in blocks[1:]], 1 << segment_bits]
    for block, low, high in zip(blocks, starts, starts[1:]):
        out = Filter(block, segment_bits)
        parts = model.filter((F.col("segment") >= low) & (F.col("segment") < high)).select("segment", f"{kind}_part")
        for r in parts.toLocalIterator():
            out.put(r[0], r[1])
        yield low, high, out


def _with_levels(spark: SparkSession, state: DataFrame, block: Filter) -> DataFrame:
    """``state`` with the levels that a block of words gives added to ``__levels``."""
    shared = spark.sparkContext.broadcast(block)
    at = state.columns.index("__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = shared.value
        for b in batches:
            for first, texts in _texts(b, at, SCORED_BYTES):
                part = b.slice(first, len(texts))
                words, which, sizes = numbered(texts)
                found = words_of.levels(words).astype(np.uint8)[which]
                ends = np.cumsum(sizes)
                cut = [found[e - n:e] for e, n in zip(ends.tolist(), sizes.tolist())]
                old = part.column(at + 1).to_pylist()
                new = [(x + np.frombuffer(o, np.uint8) if o else x).tobytes() for x, o in zip(cut, old)]
                yield pa.RecordBatch.from_arrays([*part.columns[:at + 1], pa.array(new, pa.binary())], names=b.schema.names)

    return written(spark, state.mapInArrow(run, state.schema), "levels")


def score(spark: SparkSession, train: DataFrame, docs: DataFrame, text: str = "text", mu: float = MU,
          filter_bytes: int = FILTER_BYTES, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``n_known`` (of a word seen
    in training), ``train_tokens``, ``base_score`` and ``score`` (log10)."""
    model, bits = count_grams(spark, train, text, segment_chars, docs)
    sums = model.agg(F.sum("n"), F.sum("types")).first()
    total, types = int(sums[0] or 0), int(sums[1] or 0)
    weight = total + ADD * (types + 1)
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    rest = [c for c in docs.columns if c != text and c not in added]
    state = docs.select(*rest, F.monotonically_increasing_id().alias("__row"), text_or_empty(text).alias("__text"),
                        F.expr("x''").alias("__levels"))
    for _, _, block in _blocks(model, "word", bits, filter_bytes):
        state = _with_levels(spark, state, block)
    # the first pass over the pairs gives both the rows of documents and, with a segment, runs of (row, word) to look up there
    out_schema = docs.select(*rest).selectExpr(
        "*", "0L __row", "0L n_tokens", "0L __known", "0D __base", "0D score", "0L __segment", "x'' __rows", "x'' __words", "x'' __times") \
        .schema
    for f in out_schema:
        f.nullable = True
    n_rest = len(rest)
    names = out_schema.names

    def log_p(pairs_of: Filter, low: int, high: int, tokens: np.ndarray, sizes: np.ndarray, level: bytes) -> np.ndarray:
        """The log10 probability of each token whose pair is in the block, and 0 of the others."""
        about = LEVEL_COUNT[np.frombuffer(level, np.uint8)]
        before = np.concatenate([about[-1:], about[:-1]])
        before[tokens_begin(sizes)] = about[-1]  # the last token of all is an end
        keys = pair_hashes(tokens)
        segment = (keys >> np.uint64(64 - bits)).astype(np.int64)
        here = np.flatnonzero((segment >= low) & (segment < high))
        pairs, place = np.unique(keys[here], return_inverse=True)
        before, about = before[here], about[here]
        both = np.minimum(pairs_of.counts(pairs)[place], np.minimum(before, about))
        out = np.zeros(len(tokens))
        out[here] = np.log10((both + mu * (about + ADD) / weight) / (before + mu))
        return out

    def first_pass(low: int, high: int, block: Filter) -> DataFrame:
        # a broadcast value is read by each worker from its own file, so it never is another run's
        shared = spark.sparkContext.broadcast((block, *_frequent(model, total)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs_of, often, often_counts = shared.value
            for b in batches:
                numbers = b.column(n_rest).to_numpy(zero_copy_only=False)
                for first, texts in _texts(b, n_rest + 1, SCORED_BYTES):
                    n = len(texts)
                    level = b"".join(b.column(n_rest + 2).slice(first, n).to_pylist())
                    words, which, sizes = numbered(texts)
                    tokens, doc = words[which], np.repeat(np.arange(n), sizes)
                    p = log_p(pairs_of, low, high, tokens, sizes, level)
                    exact = _looked_up(words, often, often_counts)
                    known = (exact > 0)[which]
                    base = np.where(known, np.log10((exact + ADD) / weight)[which], 0.0)
                    found = numbers[first:first + n]
                    yield pa.RecordBatch.from_arrays(
                        [*b.slice(first, n).columns[:n_rest], pa.array(found), pa.array(sizes),
                         pa.array(np.bincount(doc, known, n).astype(np.int64)), pa.array(np.bincount(doc, base, n)),
                         pa.array(np.bincount(doc, p, n)),
                         pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.binary())] * 3], names=names)
                    rare = np.flatnonzero(~known)
                    if len(rare):
                        t, d = tokens[rare], doc[rare]
                        order = np.lexsort((d, t))
                        t, d = t[order], d[order]
                        once = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])]))
                        times = np.diff(np.append(once, len(t))).astype("<u4")
                        cut, keys, rows = _cut(t[once], bits), t[once].astype("<u8"), found[d[once]].astype("<i8")
                        some = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
                        yield pa.RecordBatch.from_arrays(
                            [*[pa.nulls(len(some), c.type) for c in b.columns[:n_rest]],
                             *[pa.nulls(len(some), pa.int64())] * 3, *[pa.nulls(len(some), pa.float64())] * 2,
                             pa.array(some, pa.int64()),
                             *[pa.array([x[cut[i]:cut[i + 1]].tobytes() for i in some], pa.binary()) for x in (rows, keys, times)]],
                            names=names)

        return written(spark, state.mapInArrow(run, out_schema), "scored")

    def next_pass(low: int, high: int, block: Filter) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for first, texts in _texts(b, 1, SCORED_BYTES):
                    n = len(texts)
                    tokens, sizes = token_hashes(texts)
                    p = log_p(shared.value, low, high, tokens, sizes, b"".join(b.column(2).slice(first, n).to_pylist()))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(first, n), pa.array(np.zeros(n, dtype=np.int64)), pa.array(np.zeros(n)),
                         pa.array(np.bincount(np.repeat(np.arange(n), sizes), p, n))], names=["row", "known", "base", "score"])

        return written(spark, state.select("__row", "__text", "__levels").mapInArrow(
            run, "row bigint, known bigint, base double, score double"), "scored-more")

    blocks = _blocks(model, "pair", bits, filter_bytes)
    scored = first_pass(*next(blocks))
    more = [next_pass(*b) for b in blocks]

    def look_up(key: tuple, wanted: pa.Table, counted: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, "<i8") for x in wanted["rows"].to_pylist()] or [np.zeros(0, "<i8")])
        keys = np.concatenate([np.frombuffer(x, "<u8") for x in wanted["words"].to_pylist()] or [np.zeros(0, "<u8")])
        times = np.concatenate([np.frombuffer(x, "<u4") for x in wanted["times"].to_pylist()] or [np.zeros(0, "<u4")])
        words = np.frombuffer(b"".join(counted["words"].to_pylist()), "<u8")
        counts = np.frombuffer(b"".join(counted["word_counts"].to_pylist()), "<i8")
        exact = _looked_up(keys, words, counts)
        docs_, which = np.unique(rows, return_inverse=True)
        n = len(docs_)
        return pa.table({"row": docs_.astype(np.int64),
                         "known": np.bincount(which, times * (exact > 0), n).astype(np.int64),
                         "base": np.bincount(which, times * np.log10((exact + ADD) / weight), n).astype(np.float64)})

    rare = scored.filter("__segment is not null").select(
        F.col("__segment").alias("segment"), F.col("__rows").alias("rows"), F.col("__words").alias("words"),
        F.col("__times").alias("times"))
    # again one partition a segment on both sides
    counted = model.select("segment", "words", "word_counts").repartition(1 << bits, "segment")
    sums = rare.repartition(1 << bits, "segment").groupBy("segment").cogroup(counted.groupBy("segment")) \
        .applyInArrow(look_up, "row bigint, known bigint, base double").withColumn("score", F.lit(0.0))
    for part in more:
        sums = sums.unionByName(part)
    sums = sums.groupBy(F.col("row").alias("__row")).agg(
        F.sum("known").alias("__rare"), F.sum("base").alias("__rare_base"), F.sum("score").alias("__more"))
    out = scored.filter("__segment is null").drop("__segment", "__rows", "__words", "__times").join(sums, "__row", "left")
    return out.select(
        *rest, "n_tokens", (F.col("__known") + F.coalesce("__rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("__base") + F.coalesce("__rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("__more", F.lit(0.0))).alias("score"))


def tokens_begin(sizes: np.ndarray) -> np.ndarray:
    """The place of each text's first token."""
    return np.cumsum(sizes) - sizes
