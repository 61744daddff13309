"""Spelling variants: words one edit apart, found by a dictionary of trie-node pairs.

Every prefix of a word is a node of the trie of all words, every suffix a node
of the trie of the reversed words. The nodes are numbered while scanning the
sorted words: a prefix that a word shares with the word before it has that
word's number, a longer one is new. The scan runs by sorted ranges of words;
nodes that span a border get the number of the range before, from one row per
range (its first and last word).

A pair (prefix node, suffix node) stands for a word with a place between them.
With one code point of a word skipped it names what the words that differ in
that code point have in common; with nothing skipped it names a place for an
inserted code point. Numbers, not strings, are matched, and they are equal
exactly if both parts are, so no pair is checked again:

* words that skip to the same pair differ by one replaced code point;
* a word whose skip gives the gap of another one is that one with a code point
  inserted. Of a run of equal code points only the first is skipped this way,
  so each such pair of words meets once.

All that meet at a pair are words of one length that differ in one code point
(at most one for each letter of the alphabet) and the one word without it: a
group is bounded by the alphabet whatever the input. A group tells each member
how many neighbours it has there and which of them has the largest count; no
list of pairs is made. Long words cost numbers in proportion to their length.

Counts are made per task and merged, so a very frequent word is a few rows.
Forms at least double the count, so the chain from a word to its root is short;
it is followed by joining the table of forms with itself, which doubles the
steps each time.

Defined results: null and empty texts have no words; a null id is the empty
string in the rule that drops letters; repeated rows count again; ties of the
count go to the word that is smallest in code-point order; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, slices, text_or_empty, written

LETTERS = "a-zÀ-ÿ"
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
#: one run of letters in so many (by hash) loses a letter
DROP = 97
#: distinct words that a task holds before it hands their counts on
HELD = 200_000
_PIECE = 1_000_000


def counted(doc_id: int | None, text: str, min_length: int = MIN_LENGTH) -> Counter:
    """The words of one text after dropping letters by the rule, with their counts."""
    low = text.encode("utf-8", "replace").translate(LOWER_BYTES).decode()
    # runs below the length stay below it; a long text is read in pieces that end behind a run
    find = re.compile(f"[{LETTERS}]{{{min_length},}}").findall
    runs: Counter = Counter()
    if len(low) <= _PIECE:
        runs.update(find(low))
    else:
        for piece in re.finditer(f"(?s).{{1,{_PIECE}}}[{LETTERS}]*", low):
            runs.update(find(piece[0]))
    start, out = crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = crc32(run.encode(), start)
        if h % DROP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < min_length:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: the distinct words of all texts with enough occurrences."""
    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                          names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in slices(batches):
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for word, n in counted(doc_id, t, min_length).items():
                    held[word] += n
                if len(held) >= HELD:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    src = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text).alias("t"))
    return src.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")) \
        .filter(F.col("n") >= min_count)


def _common(a: str, b: str) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


_PART = 40  # a node's number is its range, then its place in the range


def trie_nodes(spark: SparkSession, words: DataFrame, name: str, reverse: bool = False) -> tuple[DataFrame, dict[int, list[int]]]:
    """The trie nodes of distinct words (of the reversed words).

    Returns ``word, n, part, place, shared, nodes``: the range of the word, its
    place in it, the length of its common prefix with the first word of the
    range, and the number of each of its prefixes within the range; and per
    range the numbers to take for the first nodes of its first word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << _PART
        place, fresh, last, nodes, shared = 0, 0, "", [], 0
        for b in slices(batches, 5000):
            out: list[list] = [[], [], []]
            for word in b.column(0).to_pylist():
                key = word[::-1] if reverse else word
                same = _common(key, last)
                shared = min(shared, same) if place else len(key)
                nodes = nodes[:same] + list(range(part + fresh, part + fresh + len(key) - same))
                fresh += len(key) - same
                for column, v in zip(out, (place, shared, nodes)):
                    column.append(v)
                place, last = place + 1, key
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(b.num_rows, part >> _PART)), pa.array(out[0], pa.int64()),
                 pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))],
                names=["word", "n", "part", "place", "shared", "nodes"])

    key = F.reverse("word") if reverse else F.col("word")
    ranged = words.withColumn("key", key).repartitionByRange("key").sortWithinPartitions("key").select("word", "n")
    table = written(spark, ranged.mapInArrow(
        run, "word string, n bigint, part bigint, place bigint, shared bigint, nodes array<bigint>"), name)
    # one row per range: its first and last word
    borders = table.groupBy("part").agg(F.min_by("word", "place").alias("first"),
                                        F.max_by(F.struct("word", "shared", "nodes"), "place").alias("last")).collect()
    heads: dict[int, list[int]] = {}
    before, path = "", []
    for r in sorted(borders, key=lambda r: r["part"]):
        first, end = (w[::-1] if reverse else w for w in (r["first"], r["last"]["word"]))
        heads[r["part"]] = path[:_common(first, before)]
        before, path = end, _taken(list(r["last"]["nodes"]), r["last"]["shared"], heads[r["part"]])
    return table, heads


def _taken(nodes: list[int], shared: int, head: list[int]) -> list[int]:
    k = min(shared, len(head))
    return head[:k] + nodes[k:] if k else nodes


def node_pairs(spark: SparkSession, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words with an ``id`` in code-point order, and one row per place of a
    word: ``p, s`` (the pair), ``id, n``, and ``kind``: 0 a gap, 1 a skipped
    code point, 2 one that equals the code point before it."""
    forward, heads = trie_nodes(spark, words, "forward-nodes")
    backward, tails = trie_nodes(spark, words, "backward-nodes", reverse=True)
    numbered = forward.select(
        "word", "n", (F.shiftleft("part", _PART) + F.col("place")).alias("id"), "part", "shared", "nodes")
    rows = numbered.join(backward.select("word", F.col("part").alias("part2"), F.col("shared").alias("shared2"),
                                         F.col("nodes").alias("nodes2")), "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            word, n, ids, *paths = (c.to_pylist() for c in b.columns)
            p, s, size = [], [], []
            for part, shared, nodes, part2, shared2, nodes2 in zip(*paths):
                p.append(-1)
                p += _taken(nodes, shared, heads[part])
                s += _taken(nodes2, shared2, tails[part2])[::-1]
                s.append(-1)
                size.append(len(nodes) + 1)
            if not size:
                continue
            p, s, size = np.array(p), np.array(s), np.array(size)
            # place i of a word is its node pair (prefix of i, suffix behind i)
            row = np.repeat(np.arange(len(size)), size)
            skip = np.ones(len(row), dtype=bool)
            skip[np.cumsum(size) - 1] = False
            skip = np.flatnonzero(skip)
            points = np.frombuffer("".join(word).encode("utf-32-le"), dtype="<u4")
            again = np.zeros(len(skip), dtype=bool)
            again[1:] = (points[1:] == points[:-1]) & (row[skip][1:] == row[skip][:-1])
            at = np.concatenate([row, row[skip]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([p, p[skip]])), pa.array(np.concatenate([s, s[skip + 1]])),
                 pa.array(np.array(ids)[at]), pa.array(np.array(n)[at]),
                 pa.array(np.concatenate([np.zeros(len(row)), 1 + again]).astype(np.int8))], names=["p", "s", "id", "n", "kind"])

    pairs = rows.select("word", "n", "id", "part", "shared", "nodes", "part2", "shared2", "nodes2").mapInArrow(
        run, "p bigint, s bigint, id bigint, n bigint, kind tinyint")
    return numbered.select("word", "n", "id"), pairs


def neighbours(pairs: DataFrame) -> DataFrame:
    """``id, n_near`` and ``best`` (n, -id of the near word with the largest
    count, the smallest word on ties) of every word with a near word."""
    # members from the largest count down; the gap's word meets those whose skip counts as an insertion
    group = pairs.groupBy("p", "s").agg(F.sort_array(F.collect_list(F.struct("n", (-F.col("id")).alias("neg"), "kind")), False)
                                        .alias("g")).filter("size(g) > 1")
    told = group.select(F.filter("g", lambda x: x["kind"] > 0).alias("skips"),
                        F.get(F.filter("g", lambda x: x["kind"] == 0), F.lit(0)).alias("gap"),
                        F.filter("g", lambda x: x["kind"] == 1).alias("inserted"))
    pair = "struct<n:bigint,neg:bigint>"

    def bare(x):
        return F.struct(x["n"], x["neg"]).cast(pair)

    def member(x):
        first, others = F.get("skips", F.lit(0)), F.size("skips") - 1
        top = F.when(others > 0, bare(F.get("skips", (first["neg"] == x["neg"]).cast("int"))))
        meets = (x["kind"] == 1) & F.col("gap").isNotNull()
        return F.struct((-x["neg"]).alias("id"), (others + meets.cast("int")).cast("bigint").alias("near"),
                        F.greatest(top, F.when(meets, bare(F.col("gap")))).alias("best"))

    own = F.when(F.col("gap").isNotNull(), F.array(F.struct(
        (-F.col("gap")["neg"]).alias("id"), F.size("inserted").cast("bigint").alias("near"),
        F.when(F.size("inserted") > 0, bare(F.get("inserted", F.lit(0)))).alias("best"))))
    own = F.coalesce(own, F.array().cast(f"array<struct<id:bigint,near:bigint,best:{pair}>>"))
    each = told.select(F.inline(F.concat(F.transform("skips", member), own)))
    return each.filter("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def variants(spark: SparkSession, docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word: its near words, the
    near word of the largest count if that is ``ratio`` times its own, and the
    last word of the chain of forms."""
    words = written(spark, word_counts(docs, text, id_col, min_length, min_count), "words")
    numbered, pairs = node_pairs(spark, words)
    known = written(spark, numbered.join(neighbours(pairs), "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        *[F.when(F.col("best")["n"] >= ratio * F.col("n"), F.col("best")[c]).alias(a) for c, a in (("n", "form_n"), ("neg", "neg"))])
        .withColumn("form_id", -F.col("neg")).drop("neg"), "known")
    forms = known.filter("form_id is not null").select("id", F.col("form_id").alias("to"))
    while True:
        forms = written(spark, forms, "roots")
        step = forms.select(F.col("id").alias("to"), F.col("to").alias("next"))
        if not forms.join(step, "to", "left_semi").limit(1).count():
            break
        forms = forms.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    name = numbered.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    last = forms.join(numbered.select(F.col("id").alias("to"), F.col("word").alias("root")), "to").select("id", "root")
    return known.join(name, "form_id", "left").join(last, "id", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
