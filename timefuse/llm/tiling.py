"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and underscores in lower case. A document and
a test item become candidates when they share a seed, the rolling hash of
``MIN_MATCH`` neighbouring words. Of a candidate pair, the longest common run
of words that are not yet marked is marked on both sides, again and again,
until none of ``MIN_MATCH`` words is left (running Karp-Rabin matching with a
falling search length; of equally long runs the first in the document, then in
the item). Runs may lie in any order, so a passage with its parts
swapped is caught. A pair counts when the tiles cover ``MIN_COVERAGE`` of the
item's words.

The items are the stated query set: blocks of them of a bounded number of
words are sent to all workers, and each block is one pass over the documents.

Defined results: null or empty texts match nothing; items of fewer than
``MIN_MATCH`` words are no evidence and match nothing; repeated rows on either
side give repeated pairs; an empty table on either side gives an empty result;
rows without an id keep a null id; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, text_or_empty

MIN_MATCH = 5
MIN_COVERAGE = 0.5
#: words of test items that are sent to the workers at a time
BLOCK_WORDS = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_words = re.compile(r"\w+").findall


def words(text: str) -> list[str]:
    return _words(text.lower())


def _hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """The rolling hash of each run of ``size`` words."""
    n = len(ids) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    if n > 0:
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(size):
            out = out * _BASE + x[k:k + n]
    return out


def _runs(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of runs of ``size`` free places."""
    total = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(total[size:] - total[:-size] == size) if len(free) >= size else np.zeros(0, dtype=np.int64)


def _starts(doc: np.ndarray, item: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Places (d, p) where a common run of ``size`` or more words begins, by the
    hashes of all runs. Marked words are -1 in ``doc`` and -2 in ``item``.

    Pairs of equal hash whose words in front agree too lie inside a run that
    began before; they are sorted out in bulk, so texts of one word repeated
    cost one comparison of arrays and not a search from every pair."""
    if size > len(item) or size > len(doc):
        return
    hd, hi = _hashes(doc, size), _hashes(item, size)
    at_d, at_i = _runs(doc >= 0, size), _runs(item >= 0, size)
    at_d = at_d[np.isin(hd[at_d], hi[at_i])]
    order = at_i[np.argsort(hi[at_i], kind="stable")]
    low, high = (np.searchsorted(hi[order], hd[at_d], side) for side in ("left", "right"))
    front_d, front_i = np.concatenate([[-3], doc])[at_d], np.concatenate([[-4], item])
    by_hash = np.argsort(low, kind="stable")
    cut = np.flatnonzero(np.diff(low[by_hash])) + 1
    for group in np.split(by_hash, cut) if len(by_hash) else []:
        places = order[low[group[0]]:high[group[0]]]
        for k in range(0, len(group), step := max(1, (1 << 17) // len(places))):
            part = group[k:k + step]
            d, p = np.nonzero(front_d[part][:, None] != front_i[places][None, :])
            yield from zip(at_d[part][d].tolist(), places[p].tolist())


def _common(doc: np.ndarray, item: np.ndarray, d: int, p: int) -> int:
    """The words that agree from (d, p) on."""
    n, most, step = 0, min(len(doc) - d, len(item) - p), 16
    while n < most:
        end = min(n + step, most)
        other = np.flatnonzero(doc[d + n:d + end] != item[p + n:p + end])
        if len(other):
            return n + int(other[0])
        n, step = end, 4 * step
    return n


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(place in ``doc``, place in ``item``, words) of the greedy tiles: always
    the longest common run of unmarked words, of equally long ones that with the
    smallest place in ``doc``, then in ``item``."""
    doc, item = np.where(doc >= 0, doc, -1), np.where(item >= 0, item, -2)
    found: list[tuple[int, int, int]] = []
    size = max(min_match, min(len(item), 32))
    while True:
        queue = [(-n, d, p) for d, p in _starts(doc, item, size) if (n := _common(doc, item, d, p)) >= size]
        longest = -min(queue, default=(0,))[0]
        if longest > 2 * size:
            size = longest
            continue
        heapq.heapify(queue)
        while queue:
            n, d, p = heapq.heappop(queue)
            n = -n
            free = (doc[d:d + n] >= 0) & (item[p:p + n] >= 0)
            if free.all():
                doc[d:d + n], item[p:p + n] = -1, -2
                found.append((d, p, n))
                continue
            # what is left of it goes back at its own length
            edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b - a >= size:
                    heapq.heappush(queue, (a - b, d + a, p + a))
        if size == min_match:
            return found
        size = max(min_match, size // 2) if size > 2 * min_match else min_match


class _Unknown(dict):
    def __missing__(self, key: str) -> int:
        return -1


class Index:
    """Vocabulary, word numbers and seeds of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], min_match: int) -> None:
        self.vocabulary, self.min_match = _Unknown(), min_match
        self.items: list[tuple[int | None, np.ndarray]] = []
        seeds, owners = [], []
        for item_id, text in items:
            w = words(text or "")
            if len(w) < min_match:
                continue
            ids = np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], dtype=np.int64)
            h = np.unique(_hashes(ids, min_match))
            seeds.append(h)
            owners.append(np.full(len(h), len(self.items)))
            self.items.append((item_id, ids))
        seeds = np.concatenate([*seeds, np.zeros(0, dtype=np.uint64)])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owners = seeds[order], np.concatenate([*owners, np.zeros(0, dtype=np.int64)]).astype(int)[order]

    def candidates(self, text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(item number, places of the document that a shared seed covers, their
        word numbers with -1 between separate places, words in the document)."""
        w = words(text)
        ids = np.fromiter(map(self.vocabulary.__getitem__, w), dtype=np.int64, count=len(w))
        starts = _runs(ids >= 0, self.min_match)
        if not len(starts):
            return
        h = _hashes(ids, self.min_match)[starts]
        low, high = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
        hit = np.flatnonzero(high > low)
        by_item = defaultdict(list)
        for k in hit.tolist():
            for owner in self.owners[low[k]:high[k]].tolist():
                by_item[owner].append(int(starts[k]))
        for owner, places in sorted(by_item.items()):
            cover = np.unique(np.add.outer(np.array(places), np.arange(self.min_match)).ravel())
            gaps = np.flatnonzero(np.diff(cover) > 1) + 1
            yield owner, np.insert(cover, gaps, -1), np.insert(ids[cover], gaps, -1), len(w)


_index: dict[str, Index] = {}


def _shared(spark: SparkSession, block: list[tuple[int | None, str]]):
    """A block of items for all workers, with a name by which a worker keeps its index."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, block))


def _index_of(shared, min_match: int) -> Index:
    name, block = shared.value
    if name not in _index:
        if len(_index) >= 4:
            _index.clear()
        _index[name] = Index(block, min_match)
    return _index[name]


SCHEMA = ("doc_id bigint, item_id bigint, n_tiles int, covered int, item_words int, coverage double, "
          "tiles array<struct<doc_at:int,item_at:int,n:int>>")


def _blocks(items: DataFrame, text: str, id_col: str, block_words: int) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of about ``block_words`` words, collected one block at a time."""
    sized = items.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text).alias("t"))
    total = sized.agg(F.sum(F.length("t"))).first()[0] or 0
    n = total // (4 * block_words) + 1
    for k in range(n):
        part = sized if n == 1 else sized.filter(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()]


_ROW = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_tiles", pa.int32()), ("covered", pa.int32()),
    ("item_words", pa.int32()), ("coverage", pa.float64()),
    ("tiles", pa.list_(pa.struct([("doc_at", pa.int32()), ("item_at", pa.int32()), ("n", pa.int32())])))])


def _searched(index: Index, text: str, min_coverage: float) -> Iterator[dict]:
    """Items that a text covers far enough, with their tiles."""
    for owner, places, ids, _ in index.candidates(text):
        item, numbers = index.items[owner]
        found = tiles(ids, numbers, index.min_match)
        covered = sum(n for _, _, n in found)
        if covered >= min_coverage * len(numbers):
            yield {"item_id": item, "n_tiles": len(found), "covered": covered, "item_words": len(numbers),
                   "coverage": covered / len(numbers),
                   "tiles": [{"doc_at": int(places[d]), "item_at": p, "n": n} for d, p, n in sorted(found)]}


def matches(spark: SparkSession, docs: DataFrame, items: DataFrame, min_coverage: float = MIN_COVERAGE,
            min_match: int = MIN_MATCH, text: str = "text", id_col: str = "doc_id", item_text: str = "text",
            item_id: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and item whose tiles cover ``min_coverage`` of the
    item: their ids, the number of tiles, the words covered and the tiles."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text).alias("__text"))
    out = None
    for block in _blocks(items, item_text, item_id, block_words):
        shared = _shared(spark, block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index_of(shared, min_match)
            for b in slices(batches):
                rows = [{"doc_id": doc_id, **row} for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                        for row in _searched(index, t, min_coverage)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

        found = src.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, min_coverage: float = MIN_COVERAGE,
          min_match: int = MIN_MATCH, text: str = "text", item_text: str = "text", item_id: str = "item_id",
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that reach the coverage for no item, with all their
    columns: a filter of each block of items in turn, without a shuffle."""
    at = docs.columns.index(text)
    for block in _blocks(items, item_text, item_id, block_words):
        shared = _shared(spark, block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index_of(shared, min_match)
            for b in slices(batches):
                stays = [not any(True for _ in _searched(index, t or "", min_coverage))
                         for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(stays, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
