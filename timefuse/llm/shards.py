"""Sharding by histogram sort: shards of nearly equal bytes in key order.

Splitters between shards are found by counting. Each round sends candidate key
boundaries (probes) to all partitions, which return the exact bytes and rows
between neighbouring probes; the interval that holds a splitter's target is
probed again until its bytes are within the tolerance or one row is left in
it. Then the rows move once, each to the range that its key falls in.

A key is the pair of the key column and the row's number in the written input,
so equal keys (a hot key, repeated rows) are split like any other. A shard is
made of as many ranges as keep a range below ``range_bytes``, so no task holds
a whole shard.

Defined results: null texts have no bytes, null keys sort first; empty tables
give an empty result; a row larger than a share makes its shard larger;
columns with the result's names are replaced, all others are kept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty, written

SHARDS = 40
#: of a range's share, by which a splitter may miss its target
TOLERANCE = 0.002
RANGE_BYTES = 512 << 20
PROBES = 16
_LEAST = -(1 << 63)


class _Probes:
    """Sorted (key, tie) boundaries; ``place`` counts the boundaries at or below each row."""

    def __init__(self, bounds: list[tuple[int, int]]) -> None:
        self.keys = np.array([k for k, _ in bounds], dtype=np.int64)
        self.ties = np.array([t for _, t in bounds], dtype=np.int64)

    def place(self, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        out = low.copy()
        met = np.flatnonzero(high > low)
        if len(met):
            order = met[np.argsort(low[met], kind="stable")]
            at, first = np.unique(low[order], return_index=True)
            for a, rows in zip(at.tolist(), np.split(order, first[1:])):
                out[rows] = a + np.searchsorted(self.ties[a:high[rows[0]]], tie[rows], "right")
        return out


def _histogram(keyed: DataFrame, bounds: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows between neighbouring boundaries (one value more than boundaries)."""
    shared = keyed.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _Probes(shared.value)
        size, rows = np.zeros(len(shared.value) + 1, dtype=np.int64), np.zeros(len(shared.value) + 1, dtype=np.int64)
        for b in batches:
            k, t, s = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            at = probes.place(k, t)
            np.add.at(size, at, s)
            rows += np.bincount(at, minlength=len(rows))
        got = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(size[got]), pa.array(rows[got])],
                                         names=["gap", "size", "rows"])

    found = keyed.select("__key", "__tie", "__size").mapInArrow(run, "gap bigint, size bigint, rows bigint") \
        .groupBy("gap").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect()
    size, rows = [0] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for r in found:
        size[r["gap"]], rows[r["gap"]] = r["size"], r["rows"]
    return size, rows


def _between(low: tuple[int, int], high: tuple[int, int], n: int) -> list[tuple[int, int]]:
    """Up to ``n`` boundaries strictly between two; ties are probed once the keys are next to each other."""
    (a, s), (b, t) = low, high
    if b - a > 1:
        step = sorted({a + (b - a) * i // (n + 1) for i in range(1, n + 1)} - {a, b})
        return [(k, _LEAST) for k in step]
    s, t = max(s, -1), t if b == a else 1 << 62  # rows of the key a, from the tie s on
    step = sorted({s + (t - s) * i // (n + 1) for i in range(1, n + 1)} - {s, t})
    return [(a, k) for k in step]


def splitters(keyed: DataFrame, ranges: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[tuple[int, int]]:
    """``ranges - 1`` boundaries that cut the bytes of ``keyed`` into nearly equal ranges."""
    r = keyed.agg(F.sum("__size"), F.min("__key"), F.max("__key"), F.count("*")).first()
    if not r[3]:
        return []
    total, low, high = int(r[0]), (int(r[1]), -1), (int(r[2]), 1 << 62)
    targets = [total * j / ranges for j in range(1, ranges)]
    allowed = tolerance * total / ranges
    # known boundaries with the bytes below each and the rows from each to the next
    known, below, rows = [low, high], [0, total], [int(r[3]), 0]
    while True:
        todo: set[tuple[int, int]] = set()
        for target in targets:
            i = max(0, bisect_left(below, target) - 1)
            if min(target - below[i], below[i + 1] - target) > allowed and rows[i] > 1:
                todo.update(_between(known[i], known[i + 1], probes))
        if not todo:
            break
        bounds = sorted({*known, *todo})
        size, rows = _histogram(keyed, bounds)
        rows, known = rows[1:], bounds
        below = np.cumsum(size).tolist()[:len(bounds)]
        # drop boundaries that no target needs
        need = {0, len(known) - 1}
        for target in targets:
            i = max(0, bisect_left(below, target) - 1)
            need |= {i, i + 1}
        kept = sorted(need)
        rows = [sum(rows[a:b]) for a, b in zip(kept, [*kept[1:], len(known)])]
        known, below = [known[i] for i in kept], [below[i] for i in kept]
    out = []
    for target in targets:
        i = max(0, bisect_left(below, target) - 1)
        out.append(known[i] if target - below[i] <= below[i + 1] - target else known[i + 1])
    return out


def shard_by_bytes(spark: SparkSession, df: DataFrame, size: Column, shards: int = SHARDS, key: str = "doc_id",
                   tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``df`` in key order with ``size``, ``shard`` and ``slot`` (the place in the shard, from 0)."""
    rest = [c for c in df.columns if c not in ("size", "shard", "slot")]
    keyed = df.withColumns({"__key": F.coalesce(F.col(key).cast("bigint"), F.lit(_LEAST + 1)),
                            "__tie": F.monotonically_increasing_id(), "__size": size.cast("bigint")})
    keyed = written(spark, keyed.select(*rest, "__key", "__tie", "__size"), "shard-input")
    total = keyed.agg(F.sum("__size")).first()[0] or 0
    parts = max(1, -(-total // (shards * range_bytes)))
    bounds = splitters(keyed, shards * parts, tolerance)
    _, rows = _histogram(keyed, bounds) if bounds else ([], [0])
    offsets = [(i, sum(rows[i - i % parts:i])) for i in range(len(rows))]
    shared = spark.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _Probes(shared.value)
        for b in batches:
            k, t = (b.column(i).to_numpy(zero_copy_only=False) for i in (b.num_columns - 3, b.num_columns - 2))
            place = pa.array(probes.place(k, t), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, place], names=[*b.schema.names, "__range"])

    placed = keyed.mapInArrow(run, keyed.withColumn("__range", F.lit(0)).schema)
    moved = placed.repartitionById(max(1, len(rows)), F.col("__range")).sortWithinPartitions("__key", "__tie")
    # a partition is one range, so a row's number in its partition is its place in the range
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    starts = spark.createDataFrame(offsets, "__range int, __start bigint")
    return moved.withColumn("__nth", nth).join(F.broadcast(starts), "__range").select(
        *rest, F.col("__size").alias("size"), F.floor(F.col("__range") / parts).cast("int").alias("shard"),
        (F.col("__start") + F.col("__nth")).alias("slot"))


def document_size(text: str = "text") -> Column:
    """UTF-8 bytes of a text and 16 for its frame."""
    return F.octet_length(text_or_empty(text)).cast("bigint") + 16
