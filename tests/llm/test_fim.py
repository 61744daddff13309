"""Fill-in-the-middle by word-wide marks: positions, forms, exact text back, and the defined edge cases."""
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timefuse.llm import fim


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_units_are_code_points(text):
    text = text.encode("utf-8", "ignore").decode()
    units = fim.Units(np.frombuffer(text.encode(), dtype=np.uint8))
    k = np.arange(len(text) + 1)
    ends = [len(text[:i].encode()) for i in k]
    assert units.offset_of(k).tolist() == ends
    assert units.count_to(np.array(ends)).tolist() == k.tolist()


def by_hand(row_id, text, seed=1, rate=90, spm=20):
    """The contract, over code points."""
    text = text or ""
    d = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()
    h = [int(d[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", "a", "é", "😀", "<P>", "x <S> y", "end <M>", "<P", "<<S", "a<P>b" * 3, " \n\t ", "ends in <", "M>S>P>",
       "héllo wörld € 😀 " * 50, "\0\x7f\u0080߿ࠀ￿𐀀", "long é " * 200_000]


def test_rows_against_the_contract(spark):
    rows = [(i * 7 - 20, t) for i, t in enumerate(ODD * 12)] + [(5, "same"), (5, "same"), (None, "no id é"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {"form": F.lit("clash"), "Output": F.lit(1), "lang": F.lit("xx"), "n": F.lit(2)}).repartition(3)
    out = fim.transform(df).withColumn("back", fim.restored()).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out), key=repr)
    want = sorted(((i, *by_hand(i, t), t or "") for i, t in rows), key=repr)
    assert got == want
    assert {r.lang for r in out} == {"xx"} and {r.form for r in out} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("rate, spm", [(0, 0), (100, 100), (100, 0)])
def test_shares_are_parameters(spark, rate, spm):
    df = spark.createDataFrame([(i, f"text {i} é") for i in range(50)], "doc_id bigint, text string")
    out = fim.transform(df, seed=9, rate=rate, spm_rate=spm).collect()
    assert sorted((r.doc_id, r.form, r.output) for r in out) == sorted(
        (i, (w := by_hand(i, f"text {i} é", 9, rate, spm))[1], w[4]) for i in range(50))


def test_empty_table(spark):
    out = fim.transform(spark.createDataFrame([], "doc_id bigint, text string"))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and out.count() == 0
