"""Removal of passages that repeat across documents, by suffix automata of reference shards.

A window of ``WINDOW`` words is removed if a document with a smaller id has it.
The references are the documents themselves, so sending an automaton of all of
them to all documents is quadratic. Shards are cut so that a document needs
few of them:

* Each window has a key that depends on its words alone: the smallest hash of
  its runs of ``GRAM`` words. Neighbouring windows mostly share it and form a
  run, so a document of n words has about n / 22 runs. Equal windows have equal
  keys, wherever they are.
* Keys of one document only are left out. A bitmap of fixed size tells the
  tasks which keys may be in several; what it lets through wrongly is dropped
  by the aggregate that follows.
* A key with more than ``HOT`` runs that are not nearly all equal (a passage
  in very many different documents) is refined: a bitmap tells which of its
  windows may be in several documents, and what neighbours of these are left
  are its runs. So what surrounds a passage goes, and equal passages are equal
  runs. If more than ``HOT`` different ones are left, the windows stand alone,
  keyed by the hash of all their words. Whether runs are equal is read off a sketch
  of 64 bits for each key (one bit for each run's hash); with ``SPREAD`` of
  them set there are some 180 different runs, so a key that is not refined
  holds at most ``HOT`` or a few hundred different passages.
* Equal runs of words (exact copies) are one reference passage, owned by the
  smallest id.

Keys are dealt to shards of about ``SHARD_WORDS`` words. A shard's suffix
automaton (see ``suffix``) is built where its passages are and not sent to
tasks that hold none of its keys. The passages are streamed through it for
their matching statistics; a match of ``WINDOW`` words ends in a state that
knows the smallest owner. The hashes only decide what meets; what is equal is
decided on words, but that equal runs are recognised by 128 bits. Each document
takes the answers of its runs and drops the words under windows of smaller
owners.

All sizes are alike: there is no other path for small or large inputs. Written
tables in the shared folder keep a lost executor from costing more than its
tasks. A text is in one task as a whole.

Defined results: null and empty texts have no words and lose none; a text of
fewer than ``WINDOW`` words loses none; rows of equal ids do not remove each
other's words, nor a text its own repeats; a null id counts as larger than any
other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, text_or_empty, written
from .suffix import SuffixAutomaton

WINDOW = 50
GRAM = 8
#: runs of one key beyond which its windows are keyed one by one; grows with
#: the input so that at most ``MOST_HOT`` keys are hot (8 MB sent to the tasks)
HOT, MOST_HOT = 2_000, 1_000_000
SPREAD = 60
#: bits of the map of keys that several documents may have (8 MB)
BITMAP_BITS = 1 << 26
SHARD_WORDS = 60_000
_NO_ID = 2**63 - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _rolled(x: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(x) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * _BASE + x[k:k + n]
    out = (out ^ out >> np.uint64(32)) * _MIX
    return out ^ out >> np.uint64(29)


def _smallest(x: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each ``size`` neighbours."""
    step = 1
    while 2 * step <= size:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:len(x) - (size - step)], x[size - step:]) if size > step else x


def window_keys(x: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The key of each window of the words with hashes ``x``."""
    return _smallest(_rolled(x, gram), window - gram + 1).view(np.int64)


def _runs(keys: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys, each of ``longest`` windows at most."""
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    parts = -(-sizes // longest)
    first = np.repeat(starts, parts)
    nth = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = first + nth * longest
    return at, np.minimum(longest, np.repeat(starts + sizes, parts) - at)


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys & np.int64(bits - 1)


class Runs:
    """The runs of windows of one text that share a key: ``key``, first window
    ``at``, windows ``n`` and hash of the words ``content``, as arrays."""

    def __init__(self, text: str, window: int, gram: int) -> None:
        words = text.encode().split()
        self.key = self.at = self.n = self.content = np.zeros(0, dtype=np.int64)
        if len(words) < window:
            return
        keys = window_keys(_hashes(words), window, gram)
        self.at, self.n = _runs(keys, window - gram + 1)
        self.key = keys[self.at]
        self.joined, self.window = b" ".join(words), window
        self.ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        self.begins = np.concatenate([[0], self.ends[:-1] + 1])

    def hashed(self) -> "Runs":
        """With ``content`` filled in."""
        from xxhash import xxh3_64_intdigest

        if len(self.at):
            begins, ends = self.begins[self.at].tolist(), self.ends[self.at + self.n + self.window - 2].tolist()
            self.content = np.fromiter((xxh3_64_intdigest(self.joined[b:e]) for b, e in zip(begins, ends)),
                                       dtype=np.uint64, count=len(begins)).view(np.int64)
        return self

    def keep(self, some: np.ndarray) -> "Runs":
        self.key, self.at, self.n = self.key[some], self.at[some], self.n[some]
        return self


class Candidates:
    """Runs of windows whose keys may be in several documents."""

    def __init__(self, hot: np.ndarray, bitmap: np.ndarray, window: int, gram: int) -> None:
        self.hot, self.bitmap, self.window, self.gram = hot, bitmap, window, gram

    def of(self, text: str) -> list[tuple[int, int, int, int]]:
        """(key, hash of the words, first window, windows, None) of each run; of
        those with a hot key, the windows with that key at the end."""
        from xxhash import xxh3_64_intdigest, xxh64_intdigest

        runs = Runs(text, self.window, self.gram)
        bucket = _bucket(runs.key, 8 * len(self.bitmap))
        runs.keep(self.bitmap[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1 > 0)
        single, out = np.isin(runs.key, self.hot), []
        for hot, a, k in zip(runs.key[single].tolist(), runs.at[single].tolist(), runs.n[single].tolist()):
            for i in range(a, a + k):
                run = runs.joined[runs.begins[i]:runs.ends[i + self.window - 1]]
                out.append((xxh64_intdigest(run) - 2**63, xxh3_64_intdigest(run) - 2**63, i, 1, hot))
        runs.keep(~single).hashed()
        return out + [(*r, None) for r in zip(runs.key.tolist(), runs.content.tolist(), runs.at.tolist(), runs.n.tolist())]


def _key_counts(src: DataFrame, window: int, gram: int) -> DataFrame:
    """``key, n`` (runs), ``several`` (whether in more than one document) and
    ``spread`` (bits of the sketch) of every key that occurs twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[], [], [], []]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                runs = Runs(text, window, gram).hashed()
                if len(runs.key):
                    order = np.argsort(runs.key)
                    key = runs.key[order]
                    at = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
                    bits = np.uint64(1) << (runs.content[order].view(np.uint64) & np.uint64(63))
                    for column, v in zip(out, (key[at], np.full(len(at), doc_id), np.diff(np.append(at, len(key))),
                                               np.bitwise_or.reduceat(bits, at).view(np.int64))):
                        column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["key", "id", "n", "bits"])

    rows = src.mapInArrow(run, "key bigint, id bigint, n bigint, bits bigint")
    return rows.groupBy("key").agg(F.sum("n").alias("n"), (F.min("id") < F.max("id")).alias("several"),
                                   F.bit_count(F.bit_or("bits")).alias("spread")).filter("n > 1")


def _bitmap(counts: DataFrame, bits: int) -> np.ndarray:
    """One bit for each bucket of keys that several documents have; as many rows as it has words at most."""
    bucket = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = counts.filter("several").select(F.shiftright(bucket, 6).alias("at"),
                                            F.expr(f"shiftleft(1L, cast(key & 63 as int))").alias("bit")) \
        .groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(max(bits // 64, 1), dtype="<i8")
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


_RUN = pa.struct([("key", pa.int64()), ("content", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("hot", pa.int64())])


def _candidates(spark: SparkSession, src: DataFrame, window: int, gram: int, hot: int, spread: int, bits: int) -> DataFrame:
    """``row, id, text, runs`` of every document, written."""
    counts = written(spark, _key_counts(src, window, gram), "window-keys")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(hot, total // MOST_HOT)
    different = (F.col("n") > least) & F.col("several") & (F.col("spread") >= spread)
    hot_keys = np.array([r[0] for r in counts.filter(different).select("key").collect()], dtype=np.int64)
    shared = spark.sparkContext.broadcast((np.sort(hot_keys), _bitmap(counts, bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Candidates(*shared.value, window, gram)
        for b in slices(batches):
            runs = [find.of(t) for t in b.column(1).to_pylist()]
            flat = list(zip(*(r for of_text in runs for r in of_text))) or [[]] * 5
            fields = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, _RUN)], fields=list(_RUN))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, fields)], names=["id", "text", "runs"])

    out = src.mapInArrow(run, "id bigint, text string, runs array<struct<key:bigint,content:bigint,at:int,n:int,hot:bigint>>")
    return written(spark, out.withColumn("row", F.monotonically_increasing_id()), "window-runs")


def regrouped(windows: list[dict], bitmap: np.ndarray, alone: np.ndarray, longest: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs, as from ``Candidates.of``, of the neighbours among one text's windows
    under hot keys that the bitmap has; windows of the keys ``alone`` stay single."""
    from xxhash import xxh3_64_intdigest

    key, content, at, hot = (np.array([w[c] for w in windows], dtype=np.int64) for c in ("key", "content", "at", "hot"))
    bucket = _bucket(key, 8 * len(bitmap))
    some = bitmap[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1 > 0
    key, content, at, hot = key[some], content[some], at[some], hot[some]
    if not len(key):
        return
    apart = np.concatenate([[0], np.cumsum((np.diff(at) != 1) | (np.diff(hot) != 0))])
    for i, n in zip(*(x.tolist() for x in _runs(apart, longest))):
        if len(alone) and np.isin(hot[i], alone):
            yield from zip(key[i:i + n].tolist(), content[i:i + n].tolist(), at[i:i + n].tolist(), [1] * n)
        else:
            words = xxh3_64_intdigest(key[i:i + n].tobytes() + content[i:i + n].tobytes()) - 2**63
            yield int(hot[i]), words, int(at[i]), n


def _runs_of(spark: SparkSession, found: DataFrame, window: int, gram: int, hot: int, bits: int) -> DataFrame:
    """``row, id, key, content, at, n`` of every run; those with hot keys regrouped and written."""
    whole = found.select("row", "id", F.inline("runs")).filter("hot is null").drop("hot")
    cut = found.select("row", "id", F.filter("runs", lambda r: r["hot"].isNotNull()).alias("runs")).filter("size(runs) > 0")
    shared = cut.select("id", F.inline("runs")).groupBy("key").agg((F.min("id") < F.max("id")).alias("several"))
    bitmap = spark.sparkContext.broadcast(_bitmap(shared, bits))

    def written_runs(alone: list[int]) -> DataFrame:
        single = spark.sparkContext.broadcast(np.array(alone, dtype=np.int64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                out = [(row, doc_id, *r) for row, doc_id, windows in zip(*(c.to_pylist() for c in b.columns))
                       for r in regrouped(windows, bitmap.value, single.value, window - gram + 1)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.int32()] * 2)],
                                                     names=["row", "id", "key", "content", "at", "n"])

        return written(spark, cut.mapInArrow(run, "row bigint, id bigint, key bigint, content bigint, at int, n int"), "hot-runs")

    again = written_runs([])
    many = again.groupBy("key", "content").agg(F.count("*")).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
    alone = [r[0] for r in many.select("key").collect()]
    return whole.unionByName(written_runs(alone) if alone else again)


def _passages(spark: SparkSession, found: DataFrame, runs: DataFrame, window: int, shard_words: int) -> DataFrame:
    """``shard, key, content, owner, last, words``: each different run of words under a key of several documents."""
    distinct = runs.groupBy("key", "content").agg(
        F.min("id").alias("owner"), F.max("id").alias("last"), F.min(F.struct("row", "at", "n")).alias("place"))
    several = distinct.groupBy("key").agg(F.min("owner").alias("a"), F.max("last").alias("b")).filter("a < b").select("key")
    distinct = written(spark, distinct.join(several, "key", "left_semi").select(
        "key", "content", "owner", "last", "place.*"), "references")
    words = distinct.agg(F.sum(F.col("n") + F.lit(window - 1))).first()[0] or 0
    shard = F.pmod(F.xxhash64("key"), F.lit(words // shard_words + 1))
    wanted = distinct.groupBy("row").agg(F.collect_list(F.struct(
        shard.alias("shard"), "key", "content", "owner", "last", "at", "n")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            out = []
            for text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                split = text.encode().split()
                out += [(p["shard"], p["key"], p["content"], p["owner"], p["last"],
                         b" ".join(split[p["at"]:p["at"] + p["n"] + window - 1])) for p in places]
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())],
                                                 names=["shard", "key", "content", "owner", "last", "words"])

    texts = found.filter("size(runs) > 0").select("row", "text")
    return texts.join(wanted, "row").select("text", "wanted").mapInArrow(
        run, "shard bigint, key bigint, content bigint, owner bigint, last bigint, words binary")


def _matched(passages: DataFrame, window: int) -> DataFrame:
    """``key, content, owners``: for each window of a passage the smallest owner
    that has it, from the automaton of its shard; passages that no smaller owner has are left out."""
    def answer(rows: list[tuple]) -> Iterator[tuple]:
        automaton = SuffixAutomaton()
        for _, _, owner, _, words in rows:
            automaton.add(words.split(b" "), owner)
        automaton.settle()
        for key, content, _, last, words in rows:
            owners = automaton.owners_of_windows(words.split(b" "), window)
            if min(owners) < last:
                yield key, content, owners

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shards() -> Iterator[list[tuple]]:
            at, rows = None, []
            for b in batches:
                for shard, *row in zip(*(c.to_pylist() for c in b.columns)):
                    if shard != at and rows:
                        yield rows
                        rows = []
                    at = shard
                    rows.append(tuple(row))
            if rows:
                yield rows

        for rows in shards():
            key, content, owners = list(zip(*answer(rows))) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(content, pa.int64()),
                                              pa.array(owners, pa.list_(pa.int64()))], names=["key", "content", "owners"])

    return passages.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        run, "key bigint, content bigint, owners array<bigint>")


def remove_repeats(spark: SparkSession, docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW,
                   gram: int = GRAM, hot: int = HOT, spread: int = SPREAD, bitmap_bits: int = BITMAP_BITS,
                   shard_words: int = SHARD_WORDS) -> DataFrame:
    """``id_col, n_words, n_removed, kept`` (the words that stay, joined by one
    space) and ``spans`` (first word and words of each removed span) of every row."""
    src = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("id"), text_or_empty(text).alias("text"))
    found = _candidates(spark, src, window, gram, hot, spread, bitmap_bits)
    runs = _runs_of(spark, found, window, gram, hot, bitmap_bits)
    answers = _matched(_passages(spark, found, runs, window, shard_words), window)
    runs = runs.join(answers, ["key", "content"])
    removed = F.filter(F.transform("owners", lambda o, i: F.when(o < F.col("id"), F.col("at") + i)), lambda x: x.isNotNull())
    removed = runs.select("row", removed.alias("at")).filter("size(at) > 0") \
        .groupBy("row").agg(F.flatten(F.collect_list("at")).alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for doc_id, t, windows in zip(*(c.to_pylist() for c in b.columns)):
                words = t.encode().split()
                keep = np.ones(len(words) + 1, dtype=np.int8)
                if windows:
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                    at = np.unique(np.array(windows))
                    edges[at] += 1
                    edges[at + window] -= 1
                    keep = (np.cumsum(edges) == 0).astype(np.int8)
                    keep[-1] = 1
                change = np.flatnonzero(np.diff(keep, prepend=np.int8(1)))
                starts, ends = change[::2].tolist(), change[1::2].tolist()
                left = words if not starts else [w for w, k in zip(words, keep.tolist()) if k]
                out.append((None if doc_id == _NO_ID else doc_id, len(words), len(words) - len(left),
                            b" ".join(left), [{"at": s, "n": e - s} for s, e in zip(starts, ends)]))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary()).cast(pa.string()),
                     pa.array(columns[4], pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))],
                    names=[id_col, "n_words", "n_removed", "kept", "spans"])

    schema = f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<at:int,n:int>>"
    # only documents with candidates can lose words: the others' texts are not shuffled
    none = F.lit(None).cast("array<int>")
    some = found.filter("size(runs) > 0").select("row", "id", "text").join(removed, "row", "left").select("id", "text", "windows")
    return some.unionByName(found.filter("size(runs) = 0").select("id", "text", none.alias("windows"))).mapInArrow(run, schema)
