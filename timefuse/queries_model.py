"""Registered queries: profiling, encoding, text, fill/imputation, models, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import encode, evaluate, impute, linear, profile, text
from .queries_core import EVENTS_GAPPY_SQL, UNION_SQL, cust_supp, events_gappy
from .catalog import register
from .session import scratch_path
from .sources import scan
from .tables import load, r6, rounded


def _union_all(parts):
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------------------
# Profile (A3-A10, T1, S4-S6)
# ---------------------------------------------------------------------------
DESC_COLS = ["o_totalprice", "o_custkey"]


@register("target_describe", _union_all([
    f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) + 0.0 AS mean,
       round(stddev_samp({c}), 6) + 0.0 AS std, round(min({c}), 6) + 0.0 AS min,
       round(quantile_cont({c}, 0.25), 6) + 0.0 AS p25, round(quantile_cont({c}, 0.5), 6) + 0.0 AS p50,
       round(quantile_cont({c}, 0.75), 6) + 0.0 AS p75, round(max({c}), 6) + 0.0 AS max FROM orders""" for c in DESC_COLS]))
def q_target_describe(spark, sf):
    d = profile.target_describe(load(spark, sf, "orders"), DESC_COLS)
    return rounded(d, ["mean", "std", "min", "p25", "p50", "p75", "max"])


TEXT_COLS = ["o_orderstatus", "o_orderpriority"]


@register("describe_text", _union_all([
    f"""SELECT '{c}' AS column_name, count({c}) AS count, count(DISTINCT {c}) AS unique,
       (SELECT {c} FROM orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top,
       (SELECT count(*) FROM orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS freq
       FROM orders""" for c in TEXT_COLS]))
def q_describe_text(spark, sf):
    return profile.describe_strings(load(spark, sf, "orders"), TEXT_COLS)


CORR_T = ["l_extendedprice", "l_tax"]
CORR_F = ["l_quantity", "l_discount", "l_tax"]
_CORR_COLS = list(dict.fromkeys([*CORR_T, *CORR_F]))


def _corr_sql(t, c):
    return f"covar_samp({t}, {c}) / nullif(stddev_samp({t}) * stddev_samp({c}), 0)"


@register("target_correlations", _union_all([
    f"SELECT '{t}' AS target, '{c}' AS column_name, round({_corr_sql(t, c)}, 6) + 0.0 AS corr FROM lineitem"
    for t in CORR_T for c in _CORR_COLS]))
def q_target_correlations(spark, sf):
    c = profile.target_correlations(load(spark, sf, "lineitem"), CORR_T, CORR_F)
    return c.withColumn("corr", r6("corr"))


# every column unknown in rows of its own
_GAPPY_CORR = """(SELECT CASE WHEN l_orderkey % 3 <> 0 THEN l_extendedprice END AS l_extendedprice, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END AS l_quantity,
  CASE WHEN l_suppkey % 7 <> 1 THEN l_tax END AS l_tax, CASE WHEN l_linenumber <> 2 THEN l_discount END AS l_discount, 0.25 AS same FROM lineitem)"""
_GAPPY_COLS = ["l_extendedprice", "l_tax", "l_quantity", "l_discount", "same"]


@register("target_correlations_gappy", _union_all([
    f"SELECT '{t}' AS target, '{c}' AS column_name, round(covar_samp({t}, {c}) / nullif(stddev_samp({t}) FILTER (WHERE {c} IS NOT NULL) * "
    f"stddev_samp({c}) FILTER (WHERE {t} IS NOT NULL), 0), 6) + 0.0 AS corr FROM {_GAPPY_CORR}"
    for t in _GAPPY_COLS[:2] for c in _GAPPY_COLS]))
def q_target_correlations_gappy(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_orderkey % 3 <> 0 THEN l_extendedprice END AS l_extendedprice", "CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END AS l_quantity",
        "CASE WHEN l_suppkey % 7 <> 1 THEN l_tax END AS l_tax", "CASE WHEN l_linenumber <> 2 THEN l_discount END AS l_discount", "0.25D AS same")
    return profile.target_correlations(df, _GAPPY_COLS[:2], _GAPPY_COLS[2:]).withColumn("corr", r6("corr"))


@register("rank_correlations", "SELECT target, column_name, round(corr, 6) + 0.0 AS corr, "
          "row_number() OVER (PARTITION BY target ORDER BY corr DESC NULLS LAST, column_name) AS rank FROM (" + _union_all([
              f"SELECT '{t}' AS target, '{c}' AS column_name, {_corr_sql(t, c)} AS corr FROM lineitem"
              for t in CORR_T for c in _CORR_COLS]) + ")")
def q_rank_correlations(spark, sf):
    c = profile.rank_correlations(profile.target_correlations(load(spark, sf, "lineitem"), CORR_T, CORR_F))
    return c.withColumn("corr", r6("corr")).withColumn("rank", F.col("rank").cast("bigint"))


EV_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@register("null_ratio", _union_all([
    f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 6) + 0.0 AS null_pct FROM ({EVENTS_GAPPY_SQL})"
    for c in EV_COLS]))
def q_null_ratio(spark, sf):
    return profile.null_ratio(events_gappy(spark, sf)).withColumn("null_pct", r6("null_pct"))


@register("non_null_counts", _union_all([
    f"SELECT '{c}' AS column_name, count({c}) AS non_null FROM ({EVENTS_GAPPY_SQL})" for c in EV_COLS]))
def q_non_null_counts(spark, sf):
    return profile.non_null_counts(events_gappy(spark, sf))


MODE_COLS = ["o_orderstatus", "o_orderpriority", "o_custkey"]


@register("mode_value", _union_all([
    f"""SELECT * FROM (SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS mode, count(*) AS freq FROM orders
        WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""
    for c in MODE_COLS]))
def q_mode_value(spark, sf):
    return profile.mode_values(load(spark, sf, "orders"), MODE_COLS)


MEAN_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("column_means", "SELECT " + ", ".join(f"round(avg({c}), 6) + 0.0 AS {c}" for c in MEAN_COLS) + " FROM lineitem")
def q_column_means(spark, sf):
    return rounded(profile.column_means(load(spark, sf, "lineitem"), MEAN_COLS), MEAN_COLS)


@register("contains_any", _union_all([
    f"SELECT '{c}' AS column_name, coalesce(bool_or(contains({c}, 'http')), false) AS has_marker FROM pages"
    for c in ["url", "html"]]))
def q_contains_any(spark, sf):
    return profile.contains_any(load(spark, sf, "pages"), ["url", "html"])


SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@register("scaler_stats", _union_all([
    f"SELECT '{c}' AS column_name, round(avg({c}), 6) + 0.0 AS mean, round(stddev_pop({c}), 6) + 0.0 AS std FROM lineitem"
    for c in SCALE_COLS]))
def q_scaler_stats(spark, sf):
    return rounded(profile.scaler_stats(load(spark, sf, "lineitem"), SCALE_COLS), ["mean", "std"])


_ROLE_ROWS = [("o_orderkey", "numeric", "bigint"), ("o_custkey", "numeric", "bigint"),
              ("o_orderstatus", "categorical", "string"), ("o_totalprice", "target", "double"),
              ("o_orderdate", "time", "timestamp_ntz"), ("o_orderpriority", "categorical", "string")]


@register("infer_roles", _union_all([
    f"SELECT '{c}' AS column_name, CASE WHEN count({c}) > 0 THEN '{r}' ELSE 'unknown' END AS role, '{t}' AS dtype FROM orders"
    for c, r, t in _ROLE_ROWS]))
def q_infer_roles(spark, sf):
    return profile.infer_roles(load(spark, sf, "orders"), ["o_totalprice", "humidity"], time_key="o_orderdate")


def _inventory_sql(table, cols):
    return [f"SELECT '{table}' AS source, '{c}' AS column_name, count({c}) AS non_null, count(*) AS n_rows FROM {table}"
            for c in cols]


@register("column_inventory", _union_all(
    _inventory_sql("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])
    + _inventory_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])))
def q_column_inventory(spark, sf):
    return scan.column_inventory({"part": load(spark, sf, "part"), "customer": load(spark, sf, "customer")})


@register("distinct_count_sources", """
SELECT count(DISTINCT nationkey) AS n_distinct FROM (SELECT c_nationkey AS nationkey FROM customer
  UNION ALL SELECT s_nationkey FROM supplier)
""")
def q_distinct_count_sources(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"))
    s = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return scan.distinct_count_sources([c, s], "nationkey")


# ---------------------------------------------------------------------------
# Text and encoding
# ---------------------------------------------------------------------------
@register("tfidf", r"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT tf.doc_id, tf.term, tf.tf * (ln(CAST(1 + n.n AS DOUBLE) / (1 + dfq.df)) + 1) AS w FROM tf JOIN dfq USING (term), n)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) + 0.0 AS weight FROM w
""")
def q_tfidf(spark, sf):
    # the table is a file of one row group, so one task would read and count all of it: the caller deals it out
    docs = load(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    return text.tfidf(docs, "doc_id", "text").withColumn("weight", r6("weight"))


@register("tfidf_transform", r"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
fitted AS (SELECT doc_id FROM documents WHERE source <> 'src1'),
dfq AS (SELECT term, count(*) AS df FROM tf WHERE doc_id IN (SELECT doc_id FROM fitted) GROUP BY term),
w AS (SELECT tf.doc_id, tf.term, tf.tf * (ln(CAST(1 + (SELECT count(*) FROM fitted) AS DOUBLE) / (1 + dfq.df)) + 1) AS w FROM tf JOIN dfq USING (term)
      WHERE doc_id NOT IN (SELECT doc_id FROM fitted))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) + 0.0 AS weight FROM w
""")
def q_tfidf_transform(spark, sf):
    """The documents of one source, by the stored vocabulary of all others."""
    docs, path = load(spark, sf, "documents").select("doc_id", "text", "source"), scratch_path(spark, "vocabulary")
    text.tfidf_fit(docs.where("source = 'src1'"), "text", path)
    text.tfidf_fit(docs.where("source <> 'src1'"), "text", path)  # the newest version counts
    new = docs.where("source = 'src1' or source is null")
    return text.tfidf_transform(new, "doc_id", "text", text.tfidf_vocabulary(spark, path)).withColumn("weight", r6("weight"))


@register("one_hot_sparse", """
SELECT l_orderkey, l_linenumber, CASE WHEN p.code IS NULL THEN 0 ELSE 1 END AS n, p.code, CASE WHEN p.code IS NOT NULL THEN 1.0 END AS v
FROM lineitem LEFT JOIN (SELECT l_partkey, CAST(row_number() OVER (ORDER BY l_partkey) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')) p USING (l_partkey)
""")
def q_one_hot_sparse(spark, sf):
    """Parts as categories, fitted on the early lines; the join is by shuffle and by broadcast, half of the rows each."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    table = encode.category_table(li.where("l_shipdate < timestamp_ntz'1998-01-01'"), "l_partkey")
    halves = [encode.one_hot_sparse(li.where(f"l_orderkey % 2 = {i}"), "l_partkey", table, "hot", broadcast_bytes=most)
              for i, most in ((0, 0), (1, 1 << 26))]
    out = halves[0].unionByName(halves[1])
    code = F.get(F.map_keys("hot"), F.lit(0))
    return out.select("l_orderkey", "l_linenumber", F.size("hot").alias("n"), code.alias("code"), F.get(F.map_values("hot"), F.lit(0)).alias("v"))


@register("category_codes", f"""
SELECT c_custkey, s_suppkey, CASE WHEN c_mktsegment IS NULL THEN -1 ELSE
  CAST(dense_rank() OVER (PARTITION BY c_mktsegment IS NULL ORDER BY c_mktsegment) - 1 AS INTEGER) END AS c_mktsegment
FROM ({UNION_SQL})
""")
def q_category_codes(spark, sf):
    u = cust_supp(spark, sf).select("c_custkey", "s_suppkey", "c_mktsegment")
    return encode.category_codes(u, "c_mktsegment").select("c_custkey", "s_suppkey", "c_mktsegment")


_EV_TYPES = ["click", "error", "purchase", "signup", "view"]


@register("one_hot_drop_first", "SELECT event_id, " + ", ".join(
    f"coalesce(event_type = '{v}', false) AS event_type_{v}" for v in _EV_TYPES[1:]) + " FROM events")
def q_one_hot_drop_first(spark, sf):
    ev = load(spark, sf, "events").select("event_id", "event_type")
    return encode.one_hot_drop_first(ev, "event_type")


_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


@register("one_hot_ignore_unknown", "SELECT o_orderkey, " + ", ".join(
    f"CASE WHEN o_orderpriority = '{v}' THEN 1.0 ELSE 0.0 END AS \"o_orderpriority_{v}\"" for v in _PRIOS) + " FROM orders")
def q_one_hot_ignore_unknown(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    cats = encode.fitted_categories(o.where(F.col("o_orderpriority") != "5-LOW"), "o_orderpriority")
    return encode.one_hot_ignore_unknown(o, "o_orderpriority", cats)


_SC = ["l_quantity", "l_discount"]


@register("standard_scale", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) + 0.0 AS {c}" for c in _SC)
    + " FROM lineitem")
def q_standard_scale(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_SC)
    stats = encode.fit_scaler(li, _SC)
    return rounded(encode.standard_scale(li, stats), _SC)


@register("inverse_scale", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _SC)
          + " FROM lineitem")
def q_inverse_scale(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_SC)
    stats = encode.fit_scaler(li, _SC)
    return rounded(encode.inverse_scale(encode.standard_scale(li, stats), stats), _SC)


# ---------------------------------------------------------------------------
# Fill and imputation
# ---------------------------------------------------------------------------
_W = "ORDER BY ts, event_id ROWS BETWEEN"


@register("forward_fill", f"""
SELECT event_id, last_value(value IGNORE NULLS) OVER ({_W} UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM ({EVENTS_GAPPY_SQL})
""")
def q_forward_fill(spark, sf):
    return impute.forward_fill(events_gappy(spark, sf), ["value"], ["ts", "event_id"]).select("event_id", "value")


@register("backward_fill", f"""
SELECT event_id, first_value(value IGNORE NULLS) OVER ({_W} CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM ({EVENTS_GAPPY_SQL})
""")
def q_backward_fill(spark, sf):
    return impute.backward_fill(events_gappy(spark, sf), ["value"], ["ts", "event_id"]).select("event_id", "value")


@register("fill_both", f"""
SELECT event_id, coalesce(last_value(value IGNORE NULLS) OVER ({_W} UNBOUNDED PRECEDING AND CURRENT ROW),
                          first_value(value IGNORE NULLS) OVER ({_W} CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
FROM ({EVENTS_GAPPY_SQL})
""")
def q_fill_both(spark, sf):
    return impute.fill_both(events_gappy(spark, sf), ["value"], ["ts", "event_id"]).select("event_id", "value")


@register("impute_regression", """
WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linestatus <> 'O' THEN l_extendedprice END AS y FROM lineitem),
m AS (SELECT regr_slope(y, l_quantity) AS b, regr_intercept(y, l_quantity) AS a FROM d)
SELECT l_orderkey, l_linenumber, round(coalesce(y, a + b * l_quantity), 6) + 0.0 AS l_extendedprice FROM d, m
""")
def q_impute_regression(spark, sf):
    li = load(spark, sf, "lineitem")
    d = li.select("l_orderkey", "l_linenumber", "l_quantity",
                  F.when(F.col("l_linestatus") != "O", F.col("l_extendedprice")).alias("l_extendedprice"))
    out = impute.impute_regression(d, ["l_extendedprice"], ["l_quantity"])
    return out.select("l_orderkey", "l_linenumber", r6("l_extendedprice").alias("l_extendedprice"))


@register("impute_mode", f"""
WITH u AS ({UNION_SQL}), m AS (SELECT c_mktsegment AS mode FROM u WHERE c_mktsegment IS NOT NULL
                               GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT c_custkey, s_suppkey, coalesce(c_mktsegment, m.mode) AS c_mktsegment FROM u, m
""")
def q_impute_mode(spark, sf):
    u = cust_supp(spark, sf).select("c_custkey", "s_suppkey", "c_mktsegment")
    return impute.impute_mode(u, ["c_mktsegment"])


@register("impute_mean", f"""
WITH u AS ({UNION_SQL}) SELECT c_custkey, s_suppkey, round(coalesce(c_acctbal, avg(c_acctbal) OVER ()), 6) + 0.0 AS c_acctbal FROM u
""")
def q_impute_mean(spark, sf):
    u = cust_supp(spark, sf).select("c_custkey", "s_suppkey", "c_acctbal")
    return rounded(impute.impute_mean(u, ["c_acctbal"]), ["c_acctbal"])


@register("fill_missing_columns", f"""
WITH d AS ({EVENTS_GAPPY_SQL}), m AS (SELECT regr_slope(value, user_id) AS b, regr_intercept(value, user_id) AS a FROM d)
SELECT event_id, round(coalesce(value, a + b * user_id), 6) + 0.0 AS value, CAST(user_id AS DOUBLE) AS user_id, event_type,
       0.0 AS p_weight, 'missing' AS p_container FROM d, m
""")
def q_fill_missing_columns(spark, sf):
    ev = events_gappy(spark, sf).select("event_id", "value", "user_id", "event_type")
    out = impute.fill_missing_columns(ev, ["value", "user_id", "p_weight"], ["event_type", "p_container"], ["event_id"])
    return out.withColumn("value", r6("value"))


# ---------------------------------------------------------------------------
# Linear models (M1-M4)
# ---------------------------------------------------------------------------
LIN_X, LIN_Y = ["l_quantity"], ["l_extendedprice", "l_tax"]
LIN_SQL = _union_all([
    f"SELECT '{t}' AS target, 'intercept' AS term, round(regr_intercept({t}, l_quantity), 6) + 0.0 AS coef FROM lineitem\n"
    f"UNION ALL SELECT '{t}', 'l_quantity', round(regr_slope({t}, l_quantity), 6) + 0.0 FROM lineitem" for t in LIN_Y])


@register("fit_linear_multi", LIN_SQL)
def q_fit_linear_multi(spark, sf):
    coefs, _ = linear.fit_linear_multi(load(spark, sf, "lineitem"), LIN_X, LIN_Y)
    return linear.coefficients_frame(spark, coefs).withColumn("coef", r6("coef"))


@register("partial_fit", LIN_SQL)
def q_partial_fit(spark, sf):
    li = load(spark, sf, "lineitem")
    cut = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    _, first = linear.fit_linear_multi(li.where(cut), LIN_X, LIN_Y)
    coefs, _ = linear.partial_fit(first, li.where(~cut), LIN_X, LIN_Y)
    return linear.coefficients_frame(spark, coefs).withColumn("coef", r6("coef"))


@register("predict_linear", """
WITH m AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS a1, regr_slope(l_extendedprice, l_quantity) AS b1,
                  regr_intercept(l_tax, l_quantity) AS a2, regr_slope(l_tax, l_quantity) AS b2 FROM lineitem)
SELECT l_orderkey, l_linenumber, round(a1 + b1 * l_quantity, 6) + 0.0 AS pred_l_extendedprice,
       round(a2 + b2 * l_quantity, 6) + 0.0 AS pred_l_tax FROM lineitem, m
""")
def q_predict_linear(spark, sf):
    li = load(spark, sf, "lineitem")
    coefs, _ = linear.fit_linear_multi(li, LIN_X, LIN_Y)
    out = linear.predict_linear(li.select("l_orderkey", "l_linenumber", "l_quantity"), coefs, prefix="pred_")
    return rounded(out.drop("l_quantity"), ["pred_l_extendedprice", "pred_l_tax"])


SGD_STEPS, SGD_RATE = 20, 0.1


def _sgd_sql(t):
    """Gradient steps on the standardised column: the slope's recursion on the correlation."""
    return f"""(WITH RECURSIVE m AS (SELECT avg(l_quantity) AS mx, avg({t}) AS my, stddev_pop(l_quantity) AS sx, stddev_pop({t}) AS sy,
                       corr(l_quantity, {t}) AS c FROM lineitem WHERE l_quantity IS NOT NULL AND {t} IS NOT NULL),
    w AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS w UNION ALL
          SELECT k + 1, w - {SGD_RATE} / pow(k + 1, 0.25) * (w - c) FROM w, m WHERE k < {SGD_STEPS}),
    f AS (SELECT sy * w / sx AS slope, mx, my FROM w, m WHERE k = {SGD_STEPS})
    SELECT '{t}' AS target, 'intercept' AS term, round(my - slope * mx, 6) + 0.0 AS coef FROM f
    UNION ALL SELECT '{t}', 'l_quantity', round(slope, 6) + 0.0 FROM f)"""


@register("fit_sgd_budget", "SELECT * FROM " + " UNION ALL SELECT * FROM ".join(_sgd_sql(t) for t in LIN_Y))
def q_fit_sgd_budget(spark, sf):
    coefs, _ = linear.fit_sgd_budget(load(spark, sf, "lineitem"), LIN_X, LIN_Y, iterations=SGD_STEPS, learning_rate=SGD_RATE)
    return linear.coefficients_frame(spark, coefs).withColumn("coef", r6("coef"))


# Two predictors, one with the large offset of epoch seconds: the normal
# equations of the centred columns, written out.
_LIN2_SQL = """
WITH d AS (SELECT CAST(floor(epoch(ts)) AS DOUBLE) AS x1, CAST(hour(ts) AS DOUBLE) AS x2, value AS y FROM events
           WHERE ts IS NOT NULL AND value IS NOT NULL),
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2,
             covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM d),
b AS (SELECT (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2, * FROM m)
SELECT 'value' AS target, 'intercept' AS term, round(my - b1 * (m1 - 1.7e9) - b2 * m2, 4) + 0.0 AS coef FROM b
UNION ALL SELECT 'value', 'day', round(b1 * 86400, 6) + 0.0 FROM b
UNION ALL SELECT 'value', 'hour', round(b2, 6) + 0.0 FROM b
"""


@register("fit_linear_two_features", _LIN2_SQL)
def q_fit_linear_two_features(spark, sf):
    """Epoch seconds and hour as predictors; the slope is given per day and
    the intercept at epoch 1.7e9, where its digits mean something."""
    ev = load(spark, sf, "events").select(
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("epoch"), F.hour("ts").alias("hour"), "value")
    c = linear.fit_linear_multi(ev, ["epoch", "hour"], ["value"])[0]["value"]
    at = None if c["epoch"] is None else c["intercept"] + 1.7e9 * c["epoch"]
    rows = [("value", "intercept", None if at is None else round(at, 4) + 0.0),
            ("value", "day", None if at is None else round(c["epoch"] * 86400, 6) + 0.0),
            ("value", "hour", None if at is None else round(c["hour"], 6) + 0.0)]
    return spark.createDataFrame(rows, "target string, term string, coef double")


# ---------------------------------------------------------------------------
# Evaluation (M9, M10), sort / limit
# ---------------------------------------------------------------------------
def _auc_sql(label):
    return f"""(WITH d AS (SELECT CAST(d.n_chars AS DOUBLE) AS s, l.{label} AS y FROM labels l JOIN documents d USING (doc_id)
                 WHERE l.{label} IS NOT NULL),
     r AS (SELECT y, (2 * rank() OVER (ORDER BY s) + count(*) OVER (PARTITION BY s) - 1) / 2.0 AS ar FROM d),
     c AS (SELECT CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE y <> 1) AS DOUBLE) AS n,
                  sum(ar) FILTER (WHERE y = 1) AS sr FROM r)
     SELECT '{label}' AS target, round((sr - p * (p + 1) / 2) / nullif(p * n, 0), 6) + 0.0 AS auc FROM c)"""


def _auc_input(spark, sf):
    return load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")


@register("roc_auc", f"SELECT auc, CAST(p AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg FROM (" + _auc_sql("quality").replace(
    f"SELECT 'quality' AS target, round((sr - p * (p + 1) / 2) / nullif(p * n, 0), 6) + 0.0 AS auc FROM c",
    "SELECT round((sr - p * (p + 1) / 2) / nullif(p * n, 0), 6) + 0.0 AS auc, p, n FROM c") + ")")
def q_roc_auc(spark, sf):
    return evaluate.roc_auc(_auc_input(spark, sf), "quality", "n_chars").withColumn("auc", r6("auc"))


@register("auc_by_target", f"SELECT * FROM {_auc_sql('quality')} UNION ALL SELECT * FROM {_auc_sql('toxic')}")
def q_auc_by_target(spark, sf):
    return evaluate.auc_by_target(_auc_input(spark, sf), ["quality", "toxic"], "n_chars").withColumn("auc", r6("auc"))


@register("roc_auc_ovr", """
WITH d AS (SELECT lang AS y, CAST(n_chars AS DOUBLE) AS s FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL),
r AS (SELECT y, (2 * rank() OVER (ORDER BY s) + count(*) OVER (PARTITION BY s) - 1) / 2.0 AS ar FROM d),
c AS (SELECT y, CAST(count(*) AS DOUBLE) AS p, CAST((SELECT count(*) FROM d) - count(*) AS DOUBLE) AS n, sum(ar) AS sr FROM r GROUP BY y)
SELECT round(avg((sr - p * (p + 1) / 2) / nullif(p * n, 0)), 6) + 0.0 AS auc FROM c
""")
def q_roc_auc_ovr(spark, sf):
    return evaluate.roc_auc_ovr(load(spark, sf, "documents").select("lang", "n_chars"), "lang", "n_chars").withColumn("auc", r6("auc"))


def _evaluated_auc(target, y, s, where="true"):
    """The larger class of two against the other, the mean of all one-vs-rest AUCs of more."""
    return f"""(WITH d AS (SELECT {y} AS y, CAST({s} AS DOUBLE) AS s FROM lineitem WHERE {where}),
     r AS (SELECT y, (2 * rank() OVER (ORDER BY s) + count(*) OVER (PARTITION BY s) - 1) / 2.0 AS ar FROM d),
     c AS (SELECT y, CAST(count(*) AS DOUBLE) AS p, CAST((SELECT count(*) FROM d) - count(*) AS DOUBLE) AS n, sum(ar) AS sr FROM r GROUP BY y),
     a AS (SELECT y, (sr - p * (p + 1) / 2) / nullif(p * n, 0) AS auc FROM c)
     SELECT '{target}' AS target, count(*) AS n_classes, CASE WHEN count(*) > 2 THEN avg(auc) ELSE arg_max(auc, y) END AS auc FROM a)"""


_LM_SQL = """m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS a1,
       regr_slope(l_tax, l_quantity) AS b2, regr_intercept(l_tax, l_quantity) AS a2 FROM lineitem)"""


@register("evaluate_model", f"""
WITH {_LM_SQL}, e AS (
  SELECT 'l_extendedprice' AS target, avg((l_extendedprice - a1 - b1 * l_quantity) ** 2) AS e, var_pop(l_extendedprice) AS v FROM lineitem, m
  UNION ALL SELECT 'l_tax', avg((l_tax - a2 - b2 * l_quantity) ** 2), var_pop(l_tax) FROM lineitem, m
  UNION ALL SELECT 'l_linenumber', avg((l_linenumber - l_discount) ** 2), var_pop(l_linenumber) FROM lineitem),
a AS (SELECT * FROM {_evaluated_auc('l_returnflag', 'l_returnflag', 'l_quantity')} UNION ALL
      SELECT * FROM {_evaluated_auc('l_linestatus', 'l_linestatus', 'l_discount')} UNION ALL
      SELECT * FROM {_evaluated_auc('l_linenumber', 'l_linenumber', 'l_discount')})
SELECT coalesce(e.target, a.target) AS target, a.n_classes, round(a.auc, 6) + 0.0 AS auc, round(sqrt(e), 6) + 0.0 AS rmse,
       round(1 - e / nullif(v, 0), 6) + 0.0 AS r2
FROM e FULL JOIN a ON e.target = a.target
""")
def q_evaluate_model(spark, sf):
    """Each target against its own prediction: two regressions, a class of two, one of three, one of seven."""
    li = load(spark, sf, "lineitem")
    coefs, _ = linear.fit_linear_multi(li, LIN_X, LIN_Y)
    pairs = {"l_extendedprice": "pred_l_extendedprice", "l_tax": "pred_l_tax", "l_returnflag": "l_quantity",
             "l_linestatus": "l_discount", "l_linenumber": "l_discount"}
    out = evaluate.evaluate_model(linear.predict_linear(li, coefs, prefix="pred_"), pairs, ["l_returnflag", "l_linestatus", "l_linenumber"])
    return rounded(out, ["auc", "rmse", "r2"])


@register("head_n", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def q_head_n(spark, sf):
    return load(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)


@register("first_prediction", """
SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' ORDER BY ts, event_id LIMIT 1
""")
def q_first_prediction(spark, sf):
    day = scan.load_for_date(load(spark, sf, "events"), "2024-01-10")
    return day.orderBy("ts", "event_id").limit(1)
