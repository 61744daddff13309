"""Exact quantiles by refinement and pairwise-complete correlations, against numpy and pandas."""
import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from timefuse.operators import profile

QS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def check(df, cols, qs=QS, **kw):
    got = {(r.column_name, r.q): r.quantile for r in profile.exact_quantiles(df, cols, qs, **kw).collect()}
    for c in cols:
        x = np.array([r[0] for r in df.select(F.col(c).cast("double")).collect() if r[0] is not None and not math.isnan(r[0])])
        for q in qs:
            assert got.pop((c, q)) == pytest.approx(np.quantile(x, q), rel=1e-12), (c, q)
    assert not got


def test_quantiles_of_odd_distributions(spark):
    df = spark.range(40_000).select(
        F.expr("pow(2.0, id % 1000 - 500)").alias("tails"), F.expr("if(id % 3 = 0, 7.0, id * 0.37 - 5000)").alias("hot"), F.lit(-0.0).alias("same"),
        F.expr("if(id % 5 = 0, null, if(id % 7 = 0, double('nan'), cast(xxhash64(id) as double)))").alias("gaps"),
        F.expr("if(id = 0, 1.0, null)").alias("one"), F.expr("cast(id % 2 as int)").alias("two"), F.expr("cast(id as decimal(20,2))").alias("dec"))
    check(df, df.columns)
    check(df, ["tails", "hot", "gaps"], accuracy=20)


def test_ranks_that_the_sketch_missed(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    for b in ([5.0, 6.0, 7.0], [990.0, 991.0, 992.0], [-5.0, -4.0, -3.0], [2e9, 2e9, 2e9]):
        check(df, ["x"], [0.5], first={"x": (1000, b)})


def test_quantiles_need_no_window_or_sort(spark, monkeypatch):
    df = spark.range(300_000).select((F.xxhash64("id") % 1_000_000 / 8).alias("a"), F.rand(3).alias("b"), F.lit(None).cast("double").alias("c"))
    passes = []
    slots = profile._slots
    monkeypatch.setattr(profile, "_slots", lambda *a: passes.append(1) or slots(*a))
    r = {x.column_name: x for x in profile.target_describe(df, ["a", "b", "c"]).collect()}
    assert len(passes) == 1 and r["c"]["count"] == 0 and r["c"].p50 is None
    a = np.array([x[0] for x in df.select("a").collect()])
    assert (r["a"].p25, r["a"].p50, r["a"].p75) == tuple(np.quantile(a, [.25, .5, .75]))
    assert r["a"]["std"] == pytest.approx(a.std(ddof=1)) and r["a"]["min"] == a.min()


def gappy(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a = rng.gauss(1e9, 3)
        r = [a, a * .5 + rng.gauss(0, 1), rng.choice([1.0, 2.0]), 0.1, rng.gauss(0, 1e-9), rng.randrange(9) * 1.0]
        rows.append(tuple(x if rng.random() > .3 else rng.choice([None, float("nan")]) for x in r))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_pairwise_complete_correlations(spark, seed):
    names = list("abcdef")
    rows = gappy(seed)
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    got = {(r.target, r.column_name): r.corr for r in profile.target_correlations(df, ["a", "c", "d"], names).collect()}
    want = pd.DataFrame(rows, columns=names, dtype=float).corr()
    for t in ("a", "c", "d"):
        for c in names:
            if "d" in (t, c):  # a constant
                assert got[(t, c)] is None
            else:
                assert got[(t, c)] == pytest.approx(want[t][c], abs=1e-6)


def test_correlations_without_common_rows(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, 5.0), (None, 3.0, 5.0), (None, float("inf"), 5.0)], "a double, b double, k double")
    got = {(r.target, r.column_name): r.corr for r in profile.target_correlations(df, ["a"], ["b", "k"]).collect()}
    assert got == {("a", "a"): 1.0, ("a", "b"): None, ("a", "k"): None}
    none = {(r.target, r.column_name): r.corr for r in profile.target_correlations(df.limit(0), ["a"], ["b"]).collect()}
    assert none == {("a", "a"): None, ("a", "b"): None}


def test_two_hundred_columns_in_seconds(spark):
    df = spark.range(20_000).select(*[F.sin(F.col("id") * (i + 1) / 7).alias(f"c{i}") for i in range(200)])
    t = time.time()
    got = profile.target_correlations(df, [f"c{i}" for i in range(10)], df.columns).count()
    assert got == 2000 and time.time() - t < 60
