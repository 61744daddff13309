"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint is cut into three segments of 22, 21 and 21 bits. Three differing
bits fall on them in one of two ways (pigeonhole): one bit in each segment, or
one segment is equal and another differs in one bit at most. So two kinds of
keys are enough: (equal segment, Golay index of another segment) for the six
ordered pairs of segments, and (the Golay indices of all three). Strings one
bit apart differ in parity: a segment of even parity gives the indices of all
its one-bit neighbours, one of odd parity gives its own only, and the two
always share one. A fingerprint has about 60 keys of 34 to 38 bits.

Equal fingerprints are one row before any key is made. Buckets of two give
their pair in the aggregate that counts the buckets; larger ones are joined
with themselves, with the bit distance in the join condition. A bucket with
more members than a fingerprint has neighbours in two bits (``DENSE``) is not
joined: its members go to hubs instead (see ``_hub_links``), which links
exactly the same components with rows in proportion to the members.

Defined results: null or empty text has the fingerprint zero and links like
any other; repeated rows and repeated ids each keep their row; a null id is
never the id of a component unless its component has no other; an empty table
gives an empty result; columns of the input with the result's names are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golay
from .common import LOWER_BYTES, connected_components, slices, text_or_empty, written

SHINGLE = 3
MAX_BITS = 3
SEED = 42
SEGMENTS = (22, 21, 21)
#: fingerprints within two bits of a given one: 1 + 64 + 64 * 63 / 2
DENSE = 2081
#: keys (or hub rows) that one task makes, and counts in an aggregate, about 80 MB
TASK_KEYS = 600_000
#: keys that a fingerprint has, about
KEYS = 60
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text (0 when it has no word)."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    counts, n = np.zeros(64, dtype=np.int64), len(starts)
    for i in range(0, n, _CHUNK):
        h = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[i:i + _CHUNK], ends[i:i + _CHUNK])),
                        dtype=np.uint64, count=min(_CHUNK, n - i))
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint as a bigint) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()),
                              dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    src = df.select(F.col(id_col).cast("bigint").alias(id_col), text_or_empty(text).alias("__text"))
    return src.mapInArrow(run, f"`{id_col}` bigint, fp bigint")


def _cut(fps: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for bits in SEGMENTS:
        out.append((fps >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.uint32))
        at += bits
    return out


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fps``, key) of all keys of the fingerprints."""
    segs = _cut(fps)
    odd = [np.bitwise_count(s) & 1 for s in segs]
    near = []
    for s, o, bits in zip(segs, odd, SEGMENTS):
        m = golay.near_indices(s, bits)
        m[o == 1, 1:] = -1
        m[o == 1, 0] = golay.index(s[o == 1])
        near.append(m)
    rows, keys, tag = [], [], 0
    for i in range(3):
        for j in range(3):
            if i != j:
                r, c = np.nonzero(near[j] >= 0)
                rows.append(r)
                keys.append((tag << 40) | (segs[i][r].astype(np.int64) << 12) | near[j][r, c])
                tag += 1
    a, b, c = near
    ok = (a >= 0)[:, :, None, None] & (b >= 0)[:, None, :, None] & (c >= 0)[:, None, None, :]
    r, x, y, z = np.nonzero(ok)
    # all three parities differ between the two sides, so their pairwise sums agree
    par = ((odd[0] ^ odd[1]).astype(np.int64) << 1) | (odd[0] ^ odd[2])
    rows.append(r)
    keys.append((tag << 40) | (par[r] << 36) | (a[r, x] << 24) | (b[r, y] << 12) | c[r, z])
    return np.concatenate(rows), np.concatenate(keys)


def _dealt(written_fps: DataFrame, each: int) -> DataFrame:
    """Fingerprints in as many tasks as the rows made of them need, ``each`` of
    one: a file of a few MB holds the fingerprints of millions of such rows."""
    return written_fps.select("fp").repartition(1 + written_fps.count() * each // TASK_KEYS, "fp")


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), 2000):
                part = fps[i:i + 2000]
                row, key = golay_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])

    return _dealt(distinct, KEYS).mapInArrow(run, "key bigint, fp bigint")


def _hub_links(spark: SparkSession, members: DataFrame) -> DataFrame:
    """Links with the same components as all links of three bits or fewer
    between ``members`` (distinct fingerprints), without listing pairs.

    A hub is any 64-bit value. Each fingerprint is a centre of the 65 hubs
    within one bit, and one of odd parity is also on the rim of the 2,016 hubs
    at two bits. Fingerprints one or two bits apart are centres of a common hub;
    those three bits apart differ in parity, so the odd one is on the rim of a
    hub whose centre is the even one. All that meet at a hub are within three
    bits of its smallest centre. A hub has 2,081 members at most.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.uint64(1) << np.arange(64, dtype=np.uint64)
        i, j = np.triu_indices(64, 1)
        two = one[i] | one[j]
        near = np.concatenate([[np.uint64(0)], one])
        for batch in batches:
            for fp in batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64):
                rim = fp ^ two if np.bitwise_count(fp) & 1 else two[:0]
                hubs = np.concatenate([fp ^ near, rim])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hubs.view(np.int64)), pa.array(np.full(len(hubs), fp).view(np.int64)),
                     pa.array(np.arange(len(hubs)) < 65)], names=["hub", "fp", "centre"])

    distinct = written(spark, members.select("fp").distinct(), "hub-members")
    rows = _dealt(distinct, DENSE).mapInArrow(run, "hub bigint, fp bigint, centre boolean")
    centres = rows.groupBy("hub").agg(F.min(F.when(F.col("centre"), F.col("fp"))).alias("a"),
                                      F.count("*").alias("n")).filter("a is not null and n > 1")
    links = rows.join(centres, "hub").filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return written(spark, links, "hub-links")


def links(spark: SparkSession, distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """Pairs ``a, b`` of fingerprints that differ in three bits or fewer; of
    the members of dense buckets, links that give the same components."""
    keyed = _keyed(distinct)
    buckets = written(spark, keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "buckets")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = buckets.filter("n = 2").select("a", "b").filter(near)
    larger = buckets.agg(F.max("n")).first()[0] or 0
    if larger > 2:
        members = written(spark, keyed.join(buckets.filter("n > 2").select("key", "n").hint("merge"), "key"),
                          "members")
        joined = members.filter(F.col("n") <= dense)
        left, right = joined.select("key", F.col("fp").alias("a")), joined.select("key", F.col("fp").alias("b"))
        pairs = pairs.unionByName(left.join(right, "key").filter(F.col("a") < F.col("b")).filter(near).select("a", "b"))
        if larger > dense:
            pairs = pairs.unionByName(_hub_links(spark, members.filter(F.col("n") > dense)))
    return pairs.distinct()


def _labelled(spark: SparkSession, df: DataFrame, text: str, id_col: str, shingle: int,
              dense: int) -> tuple[DataFrame, DataFrame]:
    """``id_col, fp`` of every row, and ``fp, component, component_id`` of every fingerprint."""
    fps = written(spark, fingerprints(df, text, id_col, shingle), "fingerprints")
    distinct = written(spark, fps.groupBy("fp").agg(F.min(id_col).alias("rep")), "distinct")
    comps = connected_components(spark, links(spark, distinct, dense)).withColumnRenamed("node", "fp")
    labelled = distinct.join(comps, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    return fps, labelled.join(ids, "component").select("fp", "component", "component_id")


def near_duplicates(spark: SparkSession, df: DataFrame, text: str = "text", id_col: str = "doc_id",
                    shingle: int = SHINGLE, dense: int = DENSE) -> DataFrame:
    """``id_col, fingerprint`` (16 hex digits) and ``component_id`` (the
    smallest id reachable by links of three bits or fewer) of every row."""
    fps, by_fp = _labelled(spark, df, text, id_col, shingle, dense)
    return fps.join(by_fp.drop("component"), "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each component, a row with its smallest id; a row without an
    id where no row of the component has one. Rows of a repeated id (or of
    none) are written with a number, and the first of a component's rows stays,
    so rows of one id in two components are told apart."""
    fps, by_fp = _labelled(spark, df, text, id_col, SHINGLE, DENSE)
    first = F.col(id_col).eqNullSafe(F.col("component_id")).cast("int")
    kept = written(spark, fps.join(by_fp, "fp").groupBy(id_col).agg(F.count("*").alias("__rows"), F.max(first).alias("__first"))
                   .filter("__first = 1").select(F.col(id_col).alias("__kept"), "__rows"), "kept")

    def of(ids: DataFrame) -> DataFrame:
        # the ids kept grow with the input: never broadcast
        return df.join(ids.select("__kept").hint("merge"), F.col(id_col).cast("bigint").eqNullSafe(F.col("__kept")), "left_semi")

    once = of(kept.filter("__rows = 1"))
    if (kept.agg(F.max("__rows")).first()[0] or 0) > 1:
        again = written(spark, of(kept.filter("__rows > 1")).withColumn("__row", F.monotonically_increasing_id()), "repeated-ids")
        rows = fingerprints(again, text, "__row").join(by_fp, "fp").select("__row", "component", "component_id")
        rows = rows.join(again.select("__row", F.col(id_col).cast("bigint").alias("__id")), "__row").filter("__id <=> component_id")
        rows = written(spark, rows.groupBy("component").agg(F.min("__row").alias("__row")).select("__row"), "kept-rows")
        once = once.unionByName(again.join(rows.hint("merge"), "__row", "left_semi").select(df.columns))
    return once
