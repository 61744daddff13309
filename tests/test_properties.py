"""Property tests: distributed order-dependent operators against plain
Python, mergeable statistics, round trips and guards."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timefuse.operators import align, encode, evaluate, impute, linear, profile
from timefuse.plans import ordered


def _series(spark, n=400, seed=1, null_share=0.4, leading=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        v = None if (i < leading or rnd.random() < null_share) else round(rnd.uniform(-5, 5), 3)
        rows.append((i, rnd.randint(0, 20), v))  # many ties on the time key
    return spark.createDataFrame(rows, "id long, t long, v double"), rows


def _py_fill(rows, forward=True):
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    if not forward:
        order = order[::-1]
    out, last = {}, None
    for i, _, v in order:
        last = v if v is not None else last
        out[i] = last
    return out


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_forward_backward_fill_match_python(spark, parts):
    df, rows = _series(spark)
    f = {r.id: r.v for r in ordered.fill_ordered(df, ["v"], ["t", "id"], "forward", parts).collect()}
    b = {r.id: r.v for r in ordered.fill_ordered(df, ["v"], ["t", "id"], "backward", parts).collect()}
    both = {r.id: r.v for r in ordered.fill_ordered(df, ["v"], ["t", "id"], "both", parts).collect()}
    pf, pb = _py_fill(rows), _py_fill(rows, forward=False)
    assert f == pf and b == pb
    assert both == {i: (pf[i] if pf[i] is not None else pb[i]) for i in pf}


def test_fill_idempotent(spark):
    df, _ = _series(spark)
    once = impute.fill_both(df, ["v"], ["t", "id"])
    twice = impute.fill_both(once, ["v"], ["t", "id"])
    assert sorted(once.collect()) == sorted(twice.collect())


def test_prefix_sums_match_cumsum(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, x long")
    got = {r.k: r.cum_x for r in ordered.prefix_sums(df, ["k"], ["x"], num_partitions=5).collect()}
    run = 0
    for k, x in rows:
        run += x
        assert got[k] == run


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(5)
    vals = [float(rnd.randint(0, 30)) for _ in range(501)] + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r.q: r.quantile for r in profile.exact_quantiles(df, ["x"], [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]).collect()}
    arr = np.array([v for v in vals if v is not None and not math.isnan(v)])
    for q, v in got.items():
        assert v == pytest.approx(np.quantile(arr, q))


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,), (None,), (None,)], "c string")
    assert profile.mode_value(df, "c").first().c == "a"


def test_correlation_guard_constant_column(spark):
    df = spark.createDataFrame([(float(i), 1.0, float(i % 3)) for i in range(20)], "y double, k double, z double")
    res = {(r.target, r.column_name): r.corr for r in profile.target_correlations(df, ["y"], ["k", "z"]).collect()}
    assert res[("y", "k")] is None
    assert res[("y", "y")] == pytest.approx(1.0)


def test_scale_inverse_identity(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(10)], "a double, c double")
    stats = encode.fit_scaler(df, ["a", "c"])
    assert stats["c"][1] == 0.0  # zero std divides by 1
    back = encode.inverse_scale(encode.standard_scale(df, stats), stats).collect()
    assert [v for r in back for v in (r.a, r.c)] == pytest.approx([v for i in range(10) for v in (float(i), 3.0)])


def test_split_statistics_equal_whole(spark):
    rnd = random.Random(9)
    rows = [(rnd.random(), rnd.random(), 0.0) for _ in range(200)]
    rows = [(a, b, 2 * a - b + 0.5 + rnd.gauss(0, 0.01)) for a, b, _ in rows]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    whole, _ = linear.fit_linear_multi(df, ["a", "b"], ["y"])
    _, first = linear.fit_linear_multi(df.where("a < 0.5"), ["a", "b"], ["y"])
    merged, _ = linear.partial_fit(first, df.where("a >= 0.5"), ["a", "b"], ["y"])
    for k in ("intercept", "a", "b"):
        assert merged["y"][k] == pytest.approx(whole["y"][k], rel=1e-9)
    assert whole["y"]["a"] == pytest.approx(2.0, abs=0.05)


def test_sgd_budget_tends_to_least_squares(spark):
    rnd = random.Random(2)
    rows = [(x, 3 * x + 1 + rnd.gauss(0, 0.1)) for x in (rnd.uniform(0, 10) for _ in range(300))]
    df = spark.createDataFrame(rows, "x double, y double")
    coefs, losses = linear.fit_sgd_budget(df, ["x"], ["y"], iterations=60, learning_rate=0.5)
    assert losses[-1] < losses[0]
    assert coefs["y"]["x"] == pytest.approx(3.0, abs=0.1)


def test_auc_ties_and_symmetry(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert evaluate.roc_auc(df, "y", "s").first().auc == pytest.approx(0.875)
    rnd = random.Random(4)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 15))) for _ in range(300)]
    d2 = spark.createDataFrame(rows, "y int, s double")
    a = evaluate.roc_auc(d2, "y", "s").first().auc
    b = evaluate.roc_auc(d2.withColumn("s", -F.col("s")), "y", "s").first().auc
    assert a + b == pytest.approx(1.0)
    one_class = spark.createDataFrame([(1, 0.2), (1, 0.3)], "y int, s double")
    assert evaluate.roc_auc(one_class, "y", "s").first().auc is None


def test_daily_mean_keeps_empty_days(spark):
    import datetime as dt
    rows = [(dt.datetime(2024, 1, 1, 5), 1.0), (dt.datetime(2024, 1, 1, 7), 3.0), (dt.datetime(2024, 1, 4, 1), 5.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    got = [(r.ts.day, r.v) for r in align.daily_mean(df).orderBy("ts").collect()]
    assert got == [(1, 2.0), (2, None), (3, None), (4, 5.0)]


def test_category_codes_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    got = sorted(r.c for r in encode.category_codes(df, "c").collect())
    assert got == [-1, 0, 1, 1]


def test_one_hot_unknown_is_all_zero(spark):
    df = spark.createDataFrame([("x",), ("z",), (None,)], "c string")
    out = encode.one_hot_ignore_unknown(df, "c", ["x", "y"]).collect()
    assert [(r.c_x, r.c_y) for r in out] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_exact_quantiles_by_refinement(spark, accuracy):
    # a coarse first sketch leaves wide brackets, which take several passes
    rnd = random.Random(11)
    vals = [float(rnd.randint(0, 2000)) / 7 for _ in range(3000)] + [5.0] * 1000  # a hot value
    df = spark.createDataFrame([(v, -v) for v in vals], "x double, y double")
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r.column_name, r.q): r.quantile for r in profile.exact_quantiles(df, ["x", "y"], qs, accuracy).collect()}
    for c, arr in (("x", np.array(vals)), ("y", -np.array(vals))):
        for q in qs:
            assert got[(c, q)] == pytest.approx(np.quantile(arr, q)), (c, q)


def test_hot_key_spreads_over_partitions(spark):
    """A third of the rows share one timestamp; range partitioning on
    (ts, id) still spreads them, and the fill stays exact."""
    import datetime as dt
    rnd = random.Random(7)
    hot = dt.datetime(2024, 1, 1, 12)
    rows = []
    for i in range(3000):
        ts = hot if i % 3 == 0 else hot + dt.timedelta(seconds=rnd.randint(-50000, 50000))
        rows.append((i, ts, None if rnd.random() < 0.5 else float(i)))
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, v double")
    parts = ordered.ordered_partitions(df, ["ts", "id"], 6).groupBy("_pid").count().collect()
    sizes = sorted(r["count"] for r in parts)
    assert len(sizes) == 6 and sizes[-1] < 2 * (3000 / 6)
    got = {r.id: r.v for r in ordered.fill_ordered(df, ["v"], ["ts", "id"], "forward", 6).collect()}
    last, want = None, {}
    for i, ts, v in sorted(rows, key=lambda r: (r[1], r[0])):
        last = v if v is not None else last
        want[i] = last
    assert got == want


def test_wide_fit_equals_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1000, 200))
    y = x @ rng.normal(size=200) + 3 + rng.normal(size=1000) * 0.01
    names = [f"f{i}" for i in range(200)]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)],
                               ", ".join(f"{c} double" for c in [*names, "y"])).repartition(4)
    got, _ = linear.fit_linear_multi(df, names, ["y"])
    want = np.linalg.lstsq(np.column_stack([np.ones(1000), x]), y, rcond=None)[0]
    assert [got["y"][k] for k in ["intercept", *names]] == pytest.approx(want.tolist(), abs=1e-8)


def test_large_offsets_keep_their_digits(spark):
    rows = [(1.7e9 + i, float(i // 50 % 7), 2 * (1.7e9 + i) + 3 * (i // 50 % 7), None if i % 5 else 1.0) for i in range(500)]
    df = spark.createDataFrame(rows, "epoch double, hour double, y double, constant double")
    coefs, _ = linear.fit_linear_multi(df.repartition(5), ["epoch", "hour"], ["y"])
    assert coefs["y"]["epoch"] == pytest.approx(2.0, abs=1e-9)
    assert coefs["y"]["hour"] == pytest.approx(3.0, abs=1e-7)
    _, first = linear.fit_linear_multi(df.where("epoch < 1.7e9 + 100"), ["epoch", "hour"], ["y"])
    merged, _ = linear.partial_fit(first, df.where("epoch >= 1.7e9 + 100"), ["epoch", "hour"], ["y"])
    assert merged["y"]["epoch"] == pytest.approx(2.0, abs=1e-9)
    assert linear.fit_linear_multi(df, ["constant"], ["y"])[0]["y"]["constant"] == 0.0


def test_all_columns_imputed_from_one_pass(spark):
    from timefuse.operators import impute
    rows = [(float(i), 2.0 * i + 1 if i % 3 else None, -1.0 * i if i % 4 else float("nan"), None) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, none double")
    got = impute.impute_regression(df, ["a", "b", "c", "none"], ["a"]).collect()
    for i, r in enumerate(got, 1):
        assert (r.a, r.b, r.c, r.none) == (float(i), pytest.approx(2.0 * i + 1), pytest.approx(-1.0 * i), None)


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "id long, ts timestamp_ntz, v double, y int, c string")
    assert align.daily_mean(e, cols=["v"]).count() == 0
    assert ordered.fill_ordered(e, ["v"], ["ts", "id"], "both").count() == 0
    assert ordered.fill_ordered(e, ["v"], ["ts", "id"], "backward").count() == 0
    assert profile.exact_quantiles(e, ["v"], [0.5]).count() == 0
    assert evaluate.roc_auc(e, "y", "v").first().auc is None
    assert encode.category_codes(e, "c").count() == 0
    coefs, _ = linear.fit_linear_multi(e, ["v"], ["y"])
    assert coefs["y"]["v"] is None


@pytest.mark.parametrize("direction", ["forward", "backward", "both"])
def test_fills_use_running_frames(spark, direction):
    """A frame that ends at UNBOUNDED FOLLOWING is re-evaluated for every row
    (quadratic in the partition size); fills must only use running frames."""
    df, _ = _series(spark, n=50)
    plan = ordered.fill_ordered(df, ["v"], ["t", "id"], direction, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan
    assert "unboundedfollowing" not in plan.lower()


def test_strict_json_cells(spark):
    from timefuse.functions import jsoncols
    cells = {'{"a":1} junk': False, "[1,2] x": False, "12": True, '"s"': True, '{"a":1}': True, "": False, "1,2": False,
             "}": False, "nul": False, "[1]": True, None: None}
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert {r.c: r.ok for r in df.select("c", jsoncols.is_json_text(F.col("c")).alias("ok")).collect()} == cells


def test_numeric_modes_tie_by_value(spark):
    df = spark.createDataFrame([(11452,), (2338,), (2338,), (11452,), (9,)], "v bigint")
    from timefuse.operators import profile
    assert profile.mode_values(df, ["v"]).first().mode == "2338"


def test_auc_without_labelled_rows(spark):
    from timefuse.operators import evaluate
    df = spark.createDataFrame([(None, 0.5)], "label int, score double")
    assert evaluate.roc_auc_ovr(df, "label", "score").first().auc is None


def test_scaler_is_fitted_on_filled_columns(spark):
    from timefuse.plans import preprocess
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, None, None, None, 9.0])], "k int, v double")
    state = preprocess.fit(df, preprocess.Roles(numeric=["v"], categorical=[], text=[], targets=[], order_by=["k"]))
    assert abs(state.scaler["v"][0] - 2.6) < 1e-9


def test_joins_leave_the_base_in_place(spark):
    """Right sides are broadcast by their counted size, whatever the planner's threshold."""
    base = spark.range(1000).select("id", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(id % 9)").alias("ts"))
    daily = align.daily_mean(base, cols=["id"])
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        for out in (align.multi_left_join(base, [("d", daily)]), align.align_left_join(base, daily, "d"),
                    align.null_safe_left_join(base, daily, "d")):
            assert out.count() == 1000
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_null_safe_join_beyond_the_broadcast_bound(spark):
    base = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(30)], "id int, k string")
    for rows in ([("a", 1), (None, 2), ("z", 3)], [("a", 1)], [("a", 1), (None, 2), (None, 4)]):
        right = spark.createDataFrame(rows, "k string, v int")
        got = [sorted((r.id, r.k, r.r_v or 0) for r in align.null_safe_left_join(base, right, "r", "k", cells).collect())
               for cells in (0, 1 << 20)]
        want = sorted((b.id, b.k, v or 0) for b in base.collect() for v in ([v for k, v in rows if k == b.k] or [None]))
        assert got[0] == got[1] == want


def test_nan_is_unknown_in_profiles(spark):
    from timefuse.operators import profile
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 4.0), (3.0, 6.0), (5.0, float("nan"))], "a double, b double")
    got = {r.column_name: r for r in profile.target_describe(df, ["a", "b"]).collect()}
    assert (got["a"]["count"], got["a"]["mean"], got["a"]["max"]) == (3, 3.0, 5.0)
    assert {r.column_name: r.null_pct for r in profile.null_ratio(df).collect()} == {"a": 25.0, "b": 25.0}
    assert profile.target_correlations(df, ["a"], ["b"]).where("column_name = 'b'").first().corr == pytest.approx(1.0)
