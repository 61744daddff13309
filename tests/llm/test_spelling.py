"""Spelling variants by trie-node pairs against all pairs of words, and the defined edge cases."""
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from timefuse.llm import spelling


def near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def by_hand(rows, min_length=5, min_count=3):
    counts = Counter()
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    out, form = [], {}
    around = {w: [v for v in counts if near(w, v)] for w in counts}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, counts[w], len(around[w]), form[w], counts.get(form[w]), root))
    return sorted(out)


def result(df, **kw):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(df.sparkSession, df, **kw).collect())


@pytest.mark.parametrize("seed", range(4))
def test_against_all_pairs(spark, seed, request):
    if seed % 2:  # several ranges of words
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        request.addfinalizer(lambda: spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true"))
    rng = random.Random(seed)
    letters = ["ab", "abé", "abcÿ", "aab"][seed]
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words[:rng.randrange(1, 300)]) for _ in range(60))) for i in range(60)]
    rows += [(None, "Aabba aabba AABBA 1aabba2"), (7, None), (7, ""), (8, "x" * 3000 + " " + "x" * 2999 + "y"), (8, " \n ")] * 3
    rows += [(1000, " ".join(w for k, w in ((3, "qqqqa"), (7, "qqqqab"), (15, "qqqqabc"), (31, "qqqqabcd")) for _ in range(k)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {c: F.lit("clash") for c in ("word", "n", "id", "p", "s", "form", "root")}).repartition(5)
    want = by_hand(rows)
    assert any(w[2] > 1 for w in want) and any(w[5] not in (w[0], w[3]) for w in want)
    assert result(df) == want


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "alpha Beta gammadelta, alpha ÀÉÿxx -- deltagamma " * 50 + "x" * 500
    whole = spelling.counted(3, text)
    for piece in (1, 7, 64):
        monkeypatch.setattr(spelling, "_PIECE", piece)
        assert spelling.counted(3, text) == whole


def test_empty_table(spark):
    assert result(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_node_numbers_hold_across_ranges(spark, request):
    words = sorted({"".join(random.Random(i).choice("abc") for _ in range(i % 9 + 1)) for i in range(400)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true"))
    for reverse in (False, True):
        table, heads = spelling.trie_nodes(spark, df.repartition(3), "t", reverse)
        rows = table.collect()
        assert len({r.part for r in rows}) > 1
        seen = {}
        for r in rows:
            w = r.word[::-1] if reverse else r.word
            for i, node in enumerate(spelling._taken(list(r.nodes), r.shared, heads[r.part]), 1):
                assert seen.setdefault(node, w[:i]) == w[:i]
        assert len(set(seen.values())) == len(seen)
