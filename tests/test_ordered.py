"""Ranges of an order key, ranks per segment and fills, against pandas and brute force."""
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from timefuse.operators import impute
from timefuse.plans import ordered


def rows(seed, n=400, heavy=True):
    """(k, id, a, b): a third of all rows share one k, some k are null, values have gaps."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = 50 if heavy and rng.random() < .34 else rng.choice([None, rng.randrange(100)])
        out.append((k, i, rng.choice([None, None, rng.random()]), rng.choice([None, rng.choice("xyz")])))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("kind", ["bigint", "double", "timestamp_ntz", "date", "decimal(12,2)"])
def test_buckets_follow_the_order_and_cut_heavy_values(spark, kind):
    df = spark.createDataFrame(rows(1), "k long, id long, a double, b string")
    value = {"timestamp_ntz": "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(k as int))", "date": "date_add(date'2024-01-01', cast(k as int))"}
    df = df.withColumn("k", F.expr(value.get(kind, f"cast(k as {kind})")))
    got = df.withColumn("p", ordered.order_buckets(df, ["k", "id"], 8)).orderBy(F.col("k").asc_nulls_first(), "id").collect()
    p = [r.p for r in got]
    assert p == sorted(p) and len(set(p)) >= 7
    assert max(p.count(x) for x in set(p)) < len(p) / 4  # the hot value alone holds a third


def test_nan_and_infinity_have_a_place(spark):
    df = spark.createDataFrame([(x,) for x in [float("nan"), float("inf"), float("-inf"), None, *map(float, range(50))]], "k double")
    got = df.withColumn("p", ordered.order_buckets(df, ["k"], 6)).orderBy(F.col("k").asc_nulls_first()).collect()
    assert [r.p for r in got] == sorted(r.p for r in got)
    none = spark.createDataFrame([(None,)], "k double")
    assert none.withColumn("p", ordered.order_buckets(none, ["k"], 6)).first().p == 0
    assert ordered.order_buckets(spark.createDataFrame([("a",)], "k string"), ["k"]) is None


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("text_key", [False, True])
def test_fills_against_pandas(spark, seed, text_key):
    data = rows(seed)
    df = spark.createDataFrame(data, "k long, id long, a double, b string").withColumn("_k", F.lit(1))
    key = ["k", "id"]
    if text_key:  # no numeric order: the checkpointed path
        df, key = df.withColumn("t", F.format_string("%05d", "id")), ["t"]
    pdf = pd.DataFrame(data, columns=["k", "id", "a", "b"])
    pdf = pdf.sort_values("id" if text_key else ["k", "id"], na_position="first")
    for name, fill in (("forward_fill", lambda x: x.ffill()), ("backward_fill", lambda x: x.bfill()), ("fill_both", lambda x: x.ffill().bfill())):
        out = getattr(impute, name)(df.drop("_k"), ["a", "b"], key)
        assert out.columns == df.drop("_k").columns
        got = {r.id: (r.a, r.b) for r in out.collect()}
        want = pdf[["id"]].join(fill(pdf[["a", "b"]].astype(object).where(pdf[["a", "b"]].notna(), None)))
        assert got == {r.id: (None if pd.isna(r.a) else r.a, None if pd.isna(r.b) else r.b) for r in want.itertuples()}


def test_fill_needs_an_order_without_ties(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (2, 3.0)], "k long, a double")
    with pytest.raises(Exception, match="order without ties"):
        impute.forward_fill(df, ["a"], ["k"]).collect()


def test_fill_moves_the_rows_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(rows(3), "k long, id long, a double, b string").withColumn("wide", F.repeat("b", 50))
        plan = impute.fill_both(df, ["a"], ["k", "id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(_pid" in line]
    summary = [line for line in plan.splitlines() if "Exchange SinglePartition" in line]
    assert len(moved) == 2 and len(summary) <= 2  # the rows, and the partial summary (one row a range and task)
    assert sum("wide" in line for line in plan.splitlines() if "Scan" in line or "LocalTable" in line) <= 1
    assert "Checkpoint" not in plan and "RDD[" not in plan.split("Exchange hashpartitioning")[0]


def test_segment_ranks(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.choice("xyz"), float(rng.randrange(6)), rng.randrange(1, 4)) for _ in range(60)]
    df = spark.createDataFrame(data, "seg string, cls string, s double, n long").groupBy("seg", "cls", "s").agg(F.sum("n").alias("n"))
    for r in ordered.segment_ranks(df, "seg", "s", "n").collect():
        mine = sorted(s for g, _, s, n in data if g == r.seg for _ in range(n))
        places = [i for i, s in enumerate(mine, 1) if s == r.s]
        assert r["rank"] == sum(places) / len(places)
