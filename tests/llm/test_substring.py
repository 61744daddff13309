"""Repeated passages by suffix automata: the automaton and the operator against brute force, and the edge cases."""
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timefuse.llm import substring
from timefuse.llm.suffix import SuffixAutomaton

texts = st.lists(st.tuples(st.text("ab", max_size=14), st.integers(0, 9)), max_size=8)


@settings(max_examples=300, deadline=None)
@given(texts, st.text("abc", max_size=20), st.integers(1, 6))
def test_automaton_against_all_substrings(passages, query, window):
    a = SuffixAutomaton()
    for words, owner in passages:
        a.add(words, owner)
    a.settle()
    for k, (n, _) in enumerate(a.matches(query, 100), 1):
        assert n == max(m for m in range(k + 1) if m == 0 or any(query[k - m:k] in w for w, _ in passages))
    assert a.owners_of_windows(query, window) == [
        min((o for w, o in passages if query[i:i + window] in w), default=None) for i in range(len(query) - window + 1)]


def by_hand(rows, window):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    order = {None: 2**70}
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            run = tuple(w[k:k + window])
            first[run] = min(first.get(run, 2**80), order.get(i, i))
    out = []
    for i, w in split:
        gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k:k + window])] < order.get(i, i) for p in range(k, k + window)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


def result(df, **kw):
    out = substring.remove_repeats(df.sparkSession, df, **kw).collect()
    for r in out:
        assert sum(s.n for s in r.spans) == r.n_removed
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out), key=repr)


def corpus(seed):
    """Copies, near copies, shared passages, periodic texts, texts of few different words, odd rows."""
    rng = random.Random(seed)
    word = [f"w{i}" for i in range(400)] + ["é€", "x y", "　"]
    prose = [[rng.choice(word) for _ in range(rng.randrange(5, 160))] for _ in range(40)]
    passage = [[rng.choice(word) for _ in range(rng.randrange(10, 40))] for _ in range(5)]
    rows = []
    for i in range(150):
        w = list(rng.choice(prose))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passage)
        if rng.random() < .5:
            w[rng.randrange(len(w))] = "new"
        rows.append((rng.randrange(-50, 1000), rng.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(i, "one " * rng.randrange(5, 90)) for i in range(5)] + [(i, "two three " * 40) for i in (3, 2000)]
    rows += [(i, " ".join(rng.choice("ab") for _ in range(300))) for i in (7, 8)]
    return rows + [(None, rows[0][1]), (None, None), (5, None), (5, ""), (6, " \n "), rows[3], rows[3], (rows[4][0], rows[5][1])]


@pytest.mark.parametrize("seed, window, gram, hot", [(0, 12, 4, 2000), (1, 12, 4, 3), (2, 50, 8, 2000), (3, 7, 7, 2), (4, 9, 1, 1)])
def test_against_brute_force(spark, seed, window, gram, hot):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {c: F.lit("clash") for c in ("id", "row", "key", "runs", "kept", "n_words")}).repartition(6)
    want = by_hand(rows, window)
    assert sum(w[2] for w in want) > 100
    assert result(df, window=window, gram=gram, hot=hot, spread=1 + hot % 3, bitmap_bits=1 << 10, shard_words=300) == want


def test_a_passage_in_very_many_texts_is_a_few_runs_of_each(spark, monkeypatch):
    """No row for each window of a passage that thousands of different texts and near copies have."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(90)]
    rows = []
    for i in range(2_500):
        w = list(passage)
        if i % 3 == 0:
            w[rng.randrange(90)] = f"new{i}"
        rows.append((i, " ".join([f"a{i}-{k}" for k in range(30)] + w + [f"b{i}-{k}" for k in range(30)])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    seen, runs_of = [], substring._runs_of
    monkeypatch.setattr(substring, "_runs_of", lambda *a: seen.append(runs_of(*a)) or seen[-1])
    assert result(df, hot=1_000) == by_hand(rows, 50)
    assert seen[0].count() < 8 * len(rows)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert result(none) == []
    assert result(spark.createDataFrame([(1, "a b " * 100)], none.schema)) == [(1, 200, 0, ("a b " * 100).strip())]


def test_very_long_text(spark):
    long = " ".join(str(i * 7919 % 100_003) for i in range(300_000))
    rows = [(2, long), (1, " ".join(long.split()[1000:1100])), (3, "x " + long)]
    assert result(spark.createDataFrame(rows, "doc_id bigint, text string")) == by_hand(rows, 50)
