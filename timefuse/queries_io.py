"""Registered queries: sources, sinks, stored state, forecasting plans, streaming.

Queries that exercise a source or sink first write a table derived from the
input tables with Spark into a fresh folder under the session's shared
checkpoint folder, then read it back through the operator under test.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from .functions import timeparse as tp
from .operators import align, linear
from .plans import forecast, preprocess, train
from .queries_model import LIN_SQL, LIN_X, LIN_Y
from .catalog import register
from .session import scratch_path
from .sources import models, scan, sinks
from .streaming import files as streams
from .tables import load, r6, rounded

AS_OF = "2024-01-20 12:00:00"
EV_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
CSV_TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def events_model(spark, sf):
    """value ~ hour of day, fitted on the whole events table."""
    ev = tp.calendar_parts(load(spark, sf, "events"))
    coefs, _ = linear.fit_linear_multi(ev, ["hour"], ["value"])
    return ev, coefs


EV_MODEL_CTE = "m AS (SELECT regr_intercept(value, hour(ts)) AS a, regr_slope(value, hour(ts)) AS b FROM events)"


def write_events_csv(spark, sf, partition_by, extra=None):
    """A CSV tree derived from ``events`` (Spark-written, partitioned)."""
    root = scratch_path(spark, "csv-tree")
    ev = load(spark, sf, "events").withColumn("yr", F.year("ts"))
    if extra:
        ev = ev.withColumns(extra)
    ev.write.option("header", True).option("timestampNTZFormat", CSV_TS) \
      .partitionBy(*partition_by).csv(f"{root}/events_csv")
    return root


# ---------------------------------------------------------------------------
# Sources (S1, S2, S7, S8, S9)
# ---------------------------------------------------------------------------
SPARK_LAYOUT = {"events": r"/events_csv/event_type=(?<category>[^/]+)/yr=(?<year>\d{4})/[^/]+\.csv$"}


@register("scan_dispatch", """
SELECT event_id, ts, user_id, value, props, 'events' AS source, event_type AS category, CAST(year(ts) AS INTEGER) AS year FROM events
""")
def q_scan_dispatch(spark, sf):
    """Files of one tree with their columns in two orders, one of them with an extra column."""
    root = scratch_path(spark, "csv-tree")
    ev = load(spark, sf, "events").withColumn("yr", F.year("ts"))
    turned = F.col("event_type").isin("click", "purchase")
    for part, cols in ((ev.where(turned), ["props", "value", "event_id", "user_id", "extra", "ts"]),
                       (ev.where(~turned | F.col("event_type").isNull()), ["event_id", "ts", "user_id", "value", "props"])):
        part.withColumn("extra", F.lit("x")).select(*cols, "event_type", "yr").write.mode("append").option("header", True) \
            .option("timestampNTZFormat", CSV_TS).partitionBy("event_type", "yr").csv(f"{root}/events_csv")
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, value double, props string"
    out = scan.scan_csv_tree(spark, root, SPARK_LAYOUT, schema, {"timestampNTZFormat": CSV_TS})
    return out.select("event_id", "ts", "user_id", "value", "props", "source", "category", "year")


# M12 over CSV trees: orders as the base series, lineitem as the event log, both
# in files of two column orders.
_M12_SQL = """
WITH ld AS (SELECT CAST(l_shipdate AS DATE) AS d, avg(l_quantity) AS l_quantity, avg(l_discount) AS l_discount FROM lineitem
            WHERE l_shipdate IS NOT NULL GROUP BY 1),
j AS (SELECT o_orderkey, o_totalprice, o_orderdate AS ts, round(ld.l_quantity, 6) + 0.0 AS space_l_quantity,
             round(ld.l_discount, 6) + 0.0 AS space_l_discount
      FROM orders LEFT JOIN ld ON CAST(o_orderdate AS DATE) = ld.d)
SELECT * FROM j
"""


@register("combine_csv_trees", _M12_SQL)
def q_combine_csv_trees(spark, sf):
    """Base series and event log read from CSV trees, aligned by day and profiled."""
    from .plans.combine import load_and_combine
    root = scratch_path(spark, "csv-trees")

    def put(df, path, cols):
        df.select(*cols).write.mode("append").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss") \
            .option("nullValue", "NaN").csv(f"{root}/{path}")

    orders = load(spark, sf, "orders").withColumnRenamed("o_orderdate", "UTC_DATE")
    put(orders.where("o_orderkey % 2 = 0"), "base/a", ["UTC_DATE", "o_orderkey", "o_totalprice"])
    put(orders.where("o_orderkey % 2 <> 0"), "base/b", ["o_totalprice", "UTC_DATE", "o_orderkey"])
    li = load(spark, sf, "lineitem").withColumnRenamed("l_shipdate", "UTC_DATE")
    put(li.where("l_orderkey % 2 = 0"), "log/even_events_2024", ["l_quantity", "UTC_DATE", "l_discount"])
    put(li.where("l_orderkey % 2 <> 0"), "log/odd_events_2024", ["UTC_DATE", "l_discount", "l_quantity"])
    res = load_and_combine(spark, f"{root}/base", f"{root}/log", targets=["o_totalprice"], events_glob="*.csv")
    return res.data.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_totalprice", "ts",
                           r6("space_l_quantity").alias("space_l_quantity"), r6("space_l_discount").alias("space_l_discount"))


_M12_TREE = """
base AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS mostly_null,
                CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 END AS humidity, o_orderdate AS ts FROM orders),
c AS (SELECT CAST(l_shipdate AS DATE) AS d, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS cq, avg(l_tax) FILTER (WHERE l_returnflag = 'A') AS ct,
             avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS fq, avg(l_tax) FILTER (WHERE l_returnflag = 'R') AS ft FROM lineitem GROUP BY 1),
s AS (SELECT CAST(l_shipdate AS DATE) AS d, avg(l_discount) AS sd FROM lineitem GROUP BY 1),
j AS (SELECT base.*, cq, ct, fq, ft, sd FROM base LEFT JOIN c ON CAST(ts AS DATE) = c.d LEFT JOIN s ON CAST(ts AS DATE) = s.d)"""
_M12_FEATS = {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "space_l_discount": "sd", "near_earth_CME_l_quantity": "cq",
              "near_earth_CME_l_tax": "ct", "near_earth_FLR_l_quantity": "fq", "near_earth_FLR_l_tax": "ft"}
_M12_NULL = "(SELECT 100.0 * count(*) FILTER (WHERE {e} IS NULL) / count(*) FROM j) > 50"


@register("combine_profile", f"WITH {_M12_TREE}, r AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS target, '{c}' AS column_name, {_M12_NULL.format(e=e)} AS sparse, covar_samp({t}, {e}) / nullif(stddev_samp({t}) FILTER (WHERE {e} IS NOT NULL) * "
    f"stddev_samp({e}) FILTER (WHERE {t} IS NOT NULL), 0) AS corr FROM j"
    for t in ("o_totalprice", "humidity") for c, e in {"o_totalprice": "o_totalprice", "humidity": "humidity", **_M12_FEATS}.items()) + """)
SELECT 'correlation' AS kind, target, column_name, round(corr, 6) + 0.0 AS value FROM r WHERE NOT sparse OR column_name IN ('o_totalprice', 'humidity')
UNION ALL SELECT 'thin target', 'visibility', NULL, CAST(count(*) FILTER (WHERE o_orderkey <= 40) AS DOUBLE) FROM orders
UNION ALL SELECT 'dropped', NULL, 'mostly_null', NULL
""" + "".join(f"UNION ALL SELECT 'dropped', NULL, '{c}', NULL WHERE EXISTS (SELECT 1 FROM r WHERE column_name = '{c}' AND sparse)\n" for c in _M12_FEATS))
def q_combine_profile(spark, sf):
    """M12 over all three trees: what it drops (a sparse column, a target with too few values) and the correlations it ranks."""
    from .plans.combine import load_and_combine
    root = scratch_path(spark, "csv-trees")
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def put(df, folder, name):
        """CSV files of that name and a number, one of each task that has rows, in the reference's layout of trees."""
        at = scratch_path(spark, "csv-file")
        df.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(at)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        parts = sorted(f.getPath().getName() for f in fs.listStatus(hadoop(at)) if f.getPath().getName().endswith(".csv"))
        fs.mkdirs(hadoop(f"{root}/{folder}"))
        for i, part in enumerate(parts):
            fs.rename(hadoop(f"{at}/{part}"), hadoop(f"{root}/{folder}/{name}-{i:05d}.csv"))

    o = load(spark, sf, "orders").select(
        F.col("o_orderdate").alias("UTC_DATE"), "o_orderkey", "o_custkey", "o_totalprice", F.expr("if(o_orderkey % 4 = 0, o_totalprice, null)").alias("mostly_null"),
        F.expr("if(o_orderkey % 2 = 0, o_totalprice * 2, null)").alias("humidity"), F.expr("if(o_orderkey <= 40, 1.5, null)").alias("visibility"))
    put(o, "base", "town")
    li = load(spark, sf, "lineitem").withColumnRenamed("l_shipdate", "startTime")
    put(li.select("startTime", "l_discount"), "log", "space_events_2024")
    for cat, flag in (("CME", "A"), ("FLR", "R"), ("XYZ", "N")):
        put(li.where(F.col("l_returnflag") == flag).select("l_tax", "startTime", "l_quantity"), "kinds", f"{cat}-2024")
    res = load_and_combine(spark, f"{root}/base", f"{root}/log", f"{root}/kinds", targets=["o_totalprice", "humidity", "visibility"],
                           categories=["CME", "FLR"])
    dropped = [c for c in ["mostly_null", *_M12_FEATS] if c not in res.data.columns]
    out = res.correlations.select(F.lit("correlation").alias("kind"), "target", "column_name", r6("corr").alias("value"))
    thin = res.thin_targets.where("not kept").select(F.lit("thin target").alias("kind"), "target", F.lit(None).cast("string").alias("column_name"),
                                                     F.col("non_null").cast("double").alias("value"))
    gone = spark.createDataFrame([("dropped", None, c, None) for c in dropped], out.schema)
    return out.unionByName(thin).unionByName(gone)


@register("year_from_content", """
SELECT event_id, event_type AS category, CAST(year(ts) AS INTEGER) AS year FROM events
""")
def q_year_from_content(spark, sf):
    root = write_events_csv(spark, sf, ["event_type"], {"dt": F.unix_seconds(F.col("ts").cast("timestamp"))})
    out = scan.scan_csv_tree(spark, root, {"events": r"/events_csv/event_type=(?<category>[^/]+)/[^/]+\.csv$"},
                             "event_id bigint, dt bigint", epoch_cols=("dt", "UNIX_TIMESTAMP"))
    return out.select("event_id", "category", "year")


@register("load_for_date", """
SELECT TIMESTAMP '2024-01-10 00:00:00' AS ts, round(avg(value), 6) + 0.0 AS value, round(avg(user_id), 6) + 0.0 AS user_id
FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'
""")
def q_load_for_date(spark, sf):
    out = scan.load_for_date(load(spark, sf, "events"), "2024-01-10",
                             aggregate=lambda d: align.daily_mean(d, cols=["value", "user_id"]))
    return rounded(out, ["value", "user_id"])


@register("latest_predictions", """
SELECT * FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders) ORDER BY o_orderkey LIMIT 5
""")
def q_latest_predictions(spark, sf):
    return sinks.latest_predictions(load(spark, sf, "orders"), "o_orderdate", ["o_orderkey"], 5)


def _save_models(spark, sf, path):
    li = load(spark, sf, "lineitem")
    early = li.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    old, _ = linear.fit_linear_multi(early, LIN_X, LIN_Y)
    sinks.sink_model_state(spark, path, old, None, '{"targets": []}', version=0)
    coefs, _ = linear.fit_linear_multi(li, LIN_X, LIN_Y)
    from .operators.encode import fit_scaler
    sinks.sink_model_state(spark, path, coefs, fit_scaler(li, LIN_X),
                           '{"targets": ["l_extendedprice", "l_tax"], "numeric": ["l_quantity"]}', version=1)


@register("load_model_state", LIN_SQL)
def q_load_model_state(spark, sf):
    path = scratch_path(spark, "model")
    _save_models(spark, sf, path)
    table, _ = sinks.load_model_state(spark, path)
    return table.withColumn("coef", r6("coef"))


@register("load_model_parts", f"""
SELECT 'coefficient' AS part, target, term AS name, coef AS value, CAST(NULL AS DOUBLE) AS spread, CAST(NULL AS VARCHAR) AS text FROM ({LIN_SQL})
UNION ALL SELECT 'scaler', NULL, 'l_quantity', round(avg(l_quantity), 6) + 0.0, round(stddev_pop(l_quantity), 6) + 0.0, NULL FROM lineitem
UNION ALL SELECT 'roles', NULL, NULL, NULL, NULL, '{{"targets": ["l_extendedprice", "l_tax"], "numeric": ["l_quantity"]}}'
UNION ALL SELECT 'feature', NULL, 'l_quantity', 0.0, NULL, NULL
UNION ALL SELECT 'target', NULL, t, i, NULL, NULL FROM (VALUES ('l_extendedprice', 0.0), ('l_tax', 1.0)) v(t, i)
""")
def q_load_model_parts(spark, sf):
    """Everything stored with the newest version: model, scaler, roles; nothing where nothing is stored."""
    path = scratch_path(spark, "model")
    assert sinks.load_model(spark, path) is None
    _save_models(spark, sf, path)
    return rounded(models.state_table(spark, sinks.load_model(spark, path)), ["value", "spread"])


@register("sink_model_state", f"SELECT *, 1 AS version FROM ({LIN_SQL})")
def q_sink_model_state(spark, sf):
    path = scratch_path(spark, "model")
    _save_models(spark, sf, path)
    c, _ = sinks.load_model_state(spark, path, version=1)
    return c.select("target", "term", r6("coef").alias("coef"), F.lit(1).alias("version"))


# ---------------------------------------------------------------------------
# Forecasting plans (M5-M8, M11) and sinks (K1-K3)
# ---------------------------------------------------------------------------
PERIODS_SQL = ", ".join(f"('{n}', {d})" for n, d in forecast.FORECAST_PERIODS)
FORECAST_SQL = f"""
WITH {EV_MODEL_CTE}, p AS (SELECT * FROM (VALUES {PERIODS_SQL}) p(forecast_period, days_ahead))
SELECT round(m.a + m.b * hour(e.ts), 6) + 0.0 AS value, p.forecast_period, TIMESTAMP '{AS_OF}' AS timestamp,
       CAST(CAST(TIMESTAMP '{AS_OF}' AS DATE) + p.days_ahead AS TIMESTAMP) AS forecast_date, e.ts
FROM events e, m, p WHERE e.ts < CAST(CAST(TIMESTAMP '{AS_OF}' AS DATE) + p.days_ahead AS TIMESTAMP)
"""


def _forecasts(spark, sf):
    ev, coefs = events_model(spark, sf)
    out = forecast.forecast_periods(ev, coefs, spark, AS_OF, run_ts=AS_OF)
    return out.withColumn("value", r6("value"))


@register("forecast_periods", FORECAST_SQL)
def q_forecast_periods(spark, sf):
    return _forecasts(spark, sf)


@register("sink_forecast_append", FORECAST_SQL)
def q_sink_forecast_append(spark, sf):
    path = scratch_path(spark, "forecasts")
    forecasts = _forecasts(spark, sf)
    sinks.sink_forecast_append(forecasts, path, "first")
    sinks.sink_forecast_append(forecasts, path, "first")  # a retried append adds nothing
    forecasts.write.partitionBy("forecast_period").parquet(f"{path}/run=r-second")  # an attempt that never got to its commit
    sinks._ledger(spark, path).commit("begun-second", {})
    return sinks.read_committed(spark, path).select("value", "forecast_period", "timestamp", "forecast_date", "ts")


HORIZON_START_SQL = "(SELECT date_trunc('hour', max(ts)) + INTERVAL 1 HOUR AS st FROM events)"
FUTURE_SQL = f"""
SELECT datetime, CAST(hour(datetime) AS INTEGER) AS hour, CAST(day(datetime) AS INTEGER) AS day,
       CAST(month(datetime) AS INTEGER) AS month, CAST(isodow(datetime) - 1 AS INTEGER) AS weekday
FROM (SELECT CAST(unnest(generate_series(st, st + INTERVAL {forecast.HORIZON_HOURS - 1} HOUR, INTERVAL 1 HOUR)) AS TIMESTAMP) AS datetime
      FROM {HORIZON_START_SQL})
"""


def _horizon_start(spark, sf):
    ev = load(spark, sf, "events")
    return ev.agg((F.date_trunc("hour", F.max("ts")) + F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz").alias("start"))


@register("future_hours", FUTURE_SQL)
def q_future_hours(spark, sf):
    return forecast.future_hours(spark, _horizon_start(spark, sf))


HORIZON_SQL = f"""
WITH {EV_MODEL_CTE}, f AS ({FUTURE_SQL})
SELECT f.datetime, round(m.a + m.b * f.hour, 6) + 0.0 AS value, 0.0 AS humidity FROM f, m
"""


def _horizon(spark, sf):
    _, coefs = events_model(spark, sf)
    out = forecast.forecast_horizon(spark, _horizon_start(spark, sf), coefs, ["hour"], ["value", "humidity"])
    return out.withColumn("value", r6("value"))


@register("forecast_horizon", HORIZON_SQL)
def q_forecast_horizon(spark, sf):
    return _horizon(spark, sf)


@register("sink_json_by_time", HORIZON_SQL)
def q_sink_json_by_time(spark, sf):
    path = scratch_path(spark, "horizon-json")
    sinks.sink_json_by_time(_horizon(spark, sf), path)
    return sinks.read_json_by_time(spark, path, "value double, humidity double")


@register("predict_for_date", f"""
WITH {EV_MODEL_CTE}
SELECT e.ts, round(m.a + m.b * hour(e.ts), 6) + 0.0 AS value FROM events e, m
WHERE e.ts >= TIMESTAMP '2024-01-10' AND e.ts < TIMESTAMP '2024-01-11' ORDER BY e.ts LIMIT 1
""")
def q_predict_for_date(spark, sf):
    _, coefs = events_model(spark, sf)
    out = forecast.predict_for_date(load(spark, sf, "events"), "2024-01-10", coefs, prepare=tp.calendar_parts)
    return out.withColumn("value", r6("value"))


@register("sink_prediction_by_day", """
WITH m AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS a1, regr_slope(l_extendedprice, l_quantity) AS b1 FROM lineitem)
SELECT l_orderkey, l_linenumber, round(a1 + b1 * l_quantity, 6) + 0.0 AS l_extendedprice,
       DATE '2024-01-20' AS run_date, 'lineitem.parquet' AS source_file FROM lineitem, m
""")
def q_sink_prediction_by_day(spark, sf):
    li = load(spark, sf, "lineitem")
    coefs, _ = linear.fit_linear_multi(li, LIN_X, ["l_extendedprice"])
    pred = linear.predict_linear(li.select("l_orderkey", "l_linenumber", "l_quantity"), coefs) \
        .withColumns({"run_date": F.lit(_dt.date(2024, 1, 20)), "source_file": F.lit("lineitem.parquet")}) \
        .select("l_orderkey", "l_linenumber", r6("l_extendedprice").alias("l_extendedprice"), "run_date", "source_file")
    path, pred = scratch_path(spark, "predictions"), pred.drop("run_date")
    sinks.sink_run_by_day(pred, path, "lineitem-0", _dt.date(2024, 1, 20))
    sinks.sink_run_by_day(pred, path, "lineitem-0", _dt.date(2024, 1, 21))  # a replay after midnight changes nothing
    return sinks.read_committed(spark, path) \
        .select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("run_date").cast("date"), "source_file")


_PRE_NUM = ["user_id", "props", "year", "month", "day", "hour", "day_of_week"]
_PRE_CATS = ["click", "error", "purchase", "signup", "view"]
PREPROCESS_SQL = r"""
WITH e AS (SELECT event_id, ts, CAST(user_id AS DOUBLE) AS user_id,
                  TRY_CAST(regexp_extract(props, '(\d+)', 1) AS DOUBLE) AS props,
                  CAST(year(ts) AS DOUBLE) AS year, CAST(month(ts) AS DOUBLE) AS month, CAST(day(ts) AS DOUBLE) AS day,
                  CAST(hour(ts) AS DOUBLE) AS hour, CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week, event_type, value
           FROM events)
SELECT event_id, ts, """ + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) + 0.0 AS {c}" for c in _PRE_NUM) \
    + ", " + ", ".join(f"CASE WHEN event_type = '{v}' THEN 1.0 ELSE 0.0 END AS event_type_{v}" for v in _PRE_CATS) \
    + ", value FROM e"


@register("preprocess", PREPROCESS_SQL)
def q_preprocess(spark, sf):
    ev = load(spark, sf, "events")
    roles = preprocess.Roles(targets=["value"], numeric=["user_id"], categorical=["event_type"], text=["props"],
                             time_key="ts", order_by=["ts", "event_id"])
    state = preprocess.fit(ev, roles)
    out = preprocess.transform(ev, state, keep=["event_id", "ts"])
    return rounded(out, [c for c in state.features if c in _PRE_NUM])


# The whole chain on rows with unknown cells everywhere: a time as text under one
# of the source spellings, a column without any value, an unknown target, number,
# category and digit text, and a prose column. Fitted on the even events, stored
# with a model, read back and applied to all of them.
_CHAIN_SRC = """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS startTime, CASE WHEN event_id % 7 <> 0 THEN CAST(user_id AS DOUBLE) END AS load,
  CASE WHEN event_id % 3 <> 0 THEN value END AS value, CAST(event_id % 50 AS DOUBLE) AS qty, CAST(NULL AS DOUBLE) AS nothing,
  CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 5 <> 0 THEN 'n' || (event_id % 13) END AS code,
  CASE WHEN event_id % 4 <> 0 THEN event_type || ' of ' || (event_id % 3) || 'x ' || event_type END AS note, ts FROM events"""
_CHAIN_NUM = ["value", "qty", "code", "year", "month", "day", "hour", "day_of_week"]
_CHAIN_TERMS = 3
CHAIN_SQL = f"""
WITH s AS ({_CHAIN_SRC}), c AS (SELECT *, TRY_CAST(regexp_extract(code, '([0-9]+)', 1) AS DOUBLE) AS cn, CAST(year(ts) AS DOUBLE) AS year,
  CAST(month(ts) AS DOUBLE) AS month, CAST(day(ts) AS DOUBLE) AS day, CAST(hour(ts) AS DOUBLE) AS hour, CAST(isodow(ts) - 1 AS DOUBLE) AS dow FROM s),
f AS (SELECT * FROM c WHERE event_id % 2 = 0 AND load IS NOT NULL),
m AS (SELECT regr_slope(value, qty) AS b, regr_intercept(value, qty) AS a, avg(cn) AS cm,
             (SELECT event_type FROM f WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode FROM f),
tok AS (SELECT event_id, unnest(regexp_extract_all(lower(note), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM c),
tf AS (SELECT event_id, term, count(*) AS n FROM tok GROUP BY ALL),
voc AS (SELECT term, row_number() OVER (ORDER BY sum(n) DESC, term) AS k, ln(CAST(1 + (SELECT count(*) FROM f) AS DOUBLE) / (1 + count(*))) + 1 AS idf
        FROM tf WHERE event_id IN (SELECT event_id FROM f) GROUP BY term QUALIFY k <= {_CHAIN_TERMS}),
w AS (SELECT event_id, k, n * idf AS w FROM tf JOIN voc USING (term)),
t AS (SELECT event_id, {", ".join(f"sum(CASE WHEN k = {k} THEN w END) / sqrt(sum(w * w)) AS t{k}" for k in range(1, _CHAIN_TERMS + 1))} FROM w GROUP BY 1),
x AS (SELECT c.event_id, load, coalesce(value, a + b * qty) AS value, qty, coalesce(cn, cm) AS code, year, month, day, hour, dow AS day_of_week,
      {", ".join(f"coalesce(t{k}, 0) AS t{k}" for k in range(1, _CHAIN_TERMS + 1))}, coalesce(event_type, mode) AS event_type FROM c CROSS JOIN m LEFT JOIN t USING (event_id)),
z AS (SELECT {", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in [*_CHAIN_NUM, *[f't{k}' for k in range(1, _CHAIN_TERMS + 1)]])}
      FROM x WHERE event_id IN (SELECT event_id FROM f))
SELECT event_id, load, {", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}" for c in [*_CHAIN_NUM, *[f't{k}' for k in range(1, _CHAIN_TERMS + 1)]])},
       {", ".join(f"CASE WHEN event_type = '{v}' THEN 1.0 ELSE 0.0 END AS event_type_{v}" for v in _PRE_CATS)} FROM x, z
"""


@register("preprocess_chain", CHAIN_SQL)
def q_preprocess_chain(spark, sf):
    ev = load(spark, sf, "events")
    gone = lambda n, c: F.when(F.col("event_id") % n != 0, c)
    src = ev.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startTime"), gone(7, F.col("user_id").cast("double")).alias("load"),
        gone(3, F.col("value")).alias("value"), (F.col("event_id") % 50).cast("double").alias("qty"), F.lit(None).cast("double").alias("nothing"),
        gone(11, F.col("event_type")).alias("event_type"), gone(5, F.concat(F.lit("n"), (F.col("event_id") % 13).cast("string"))).alias("code"),
        gone(4, F.concat("event_type", F.lit(" of "), (F.col("event_id") % 3).cast("string"), F.lit("x "), "event_type")).alias("note"))
    roles = preprocess.Roles(targets=["load"], numeric=["value", "qty", "nothing"], categorical=["event_type"], text=["code"], prose=["note"],
                             time_text="UTC_DATE")
    state = preprocess.fit(src.where("event_id % 2 = 0"), roles, fill="model", rename=True, terms=_CHAIN_TERMS)
    path = scratch_path(spark, "model")
    sinks.sink_model_state(spark, path, {"load": {"intercept": 0.0}}, state.scaler, None, preparation=state.to_json())
    stored = preprocess.PreprocessState.from_json(sinks.load_model(spark, path).preparation)
    out = preprocess.transform(src, stored, keep=["event_id"])
    terms = {f"note_{t}": f"t{k}" for k, (t, _) in enumerate(stored.vocabulary["note"], 1)}
    out = out.withColumnsRenamed(terms)
    return rounded(out, [*_CHAIN_NUM, *terms.values()])


# A model trained with scaled features and targets is the plain regression in the end.
@register("train_and_forecast", f"""
WITH {EV_MODEL_CTE}, f AS ({FUTURE_SQL})
SELECT f.datetime, round(m.a + m.b * f.hour, 6) + 0.0 AS value, 0.0 AS humidity FROM f, m
""")
def q_train_and_forecast(spark, sf):
    """Train, store, forecast the next hours from the stored version, write them as JSON and read them back."""
    ev, path, sink = load(spark, sf, "events"), scratch_path(spark, "model"), scratch_path(spark, "horizon-json")
    train.train(spark, ev.select("ts", "value"), preprocess.Roles(targets=["value"], numeric=[], calendar=["hour"]), path)
    train.forecast_json(spark, path, _horizon_start(spark, sf), ["value", "humidity"], sink)
    return rounded(sinks.read_json_by_time(spark, sink, "value double, humidity double"), ["value"])


def _three_sources(spark, sf):
    """Events as the base series; orders as an event log; lineitem as event categories, all in January 2024."""
    day = lambda k: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast({k} % 30 as int))")
    log = load(spark, sf, "orders").select(day("o_orderkey").alias("ts"), "o_totalprice")
    kinds = load(spark, sf, "lineitem").select(day("l_orderkey").alias("ts"), "l_returnflag", "l_quantity")

    def by_category(d):
        daily = align.daily_mean_by_category(d, "l_returnflag", cols=["l_quantity"], allowed=["A", "R"])
        return daily.groupBy("ts").pivot("l_returnflag", ["A", "R"]).agg(F.first("l_quantity"))

    return [("space", log, lambda d: align.daily_mean(d, cols=["o_totalprice"])), ("near_earth", kinds, by_category)]


_THREE_CTE = """o AS (SELECT CAST(o_orderkey % 30 AS INTEGER) AS d, avg(o_totalprice) AS p FROM orders GROUP BY 1),
q AS (SELECT CAST(l_orderkey % 30 AS INTEGER) AS d, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a,
             avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
e AS (SELECT events.*, o.p, q.a, q.r FROM events LEFT JOIN o ON CAST(ts AS DATE) = DATE '2024-01-01' + o.d
      LEFT JOIN q ON CAST(ts AS DATE) = DATE '2024-01-01' + q.d)"""


@register("load_sources_for_date", f"""
WITH {_THREE_CTE} SELECT event_id, ts, round(p, 6) + 0.0 AS space_o_totalprice, round(a, 6) + 0.0 AS near_earth_A, round(r, 6) + 0.0 AS near_earth_R
FROM e WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'
""")
def q_load_sources_for_date(spark, sf):
    out = train.load_sources_for_date(load(spark, sf, "events").select("event_id", "ts"), _three_sources(spark, sf), "2024-01-10")
    return rounded(out, ["space_o_totalprice", "near_earth_A", "near_earth_R"])


@register("predict_for_date_three_sources", f"""
WITH {_THREE_CTE}, m AS (SELECT regr_intercept(value, p) AS a, regr_slope(value, p) AS b FROM e)
SELECT ts, event_id, round(m.a + m.b * p, 6) + 0.0 AS value FROM e, m
WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' ORDER BY ts, event_id LIMIT 1
""")
def q_predict_for_date_three_sources(spark, sf):
    """A model of the combined sources, stored, and its prediction for one day's rows from all three."""
    ev, sources, path = load(spark, sf, "events"), _three_sources(spark, sf), scratch_path(spark, "model")
    combined = ev
    for name, rows, aggregate in sources:
        combined = align.align_left_join(combined, aggregate(rows), name)
    roles = preprocess.Roles(targets=["value"], numeric=["space_o_totalprice"], calendar=[], order_by=["ts", "event_id"])
    train.train(spark, combined.select("ts", "event_id", "value", "space_o_totalprice"), roles, path)
    day = train.load_sources_for_date(ev, sources, "2024-01-10")
    return rounded(train.predict_day(spark, path, day, ["ts", "event_id"]), ["value"])


# ---------------------------------------------------------------------------
# Streaming (L1, L2): a CSV directory derived from events, read as a stream
# ---------------------------------------------------------------------------
@register("stream_score_files", f"""
WITH {EV_MODEL_CTE}
SELECT e.event_id, e.ts, round(m.a + m.b * hour(e.ts), 6) + 0.0 AS pred_value FROM events e, m
""")
def q_stream_score_files(spark, sf):
    _, coefs = events_model(spark, sf)
    root = write_events_csv(spark, sf, ["event_type"])
    sink, ckpt, model = (scratch_path(spark, n) for n in ("stream-sink", "stream-ckpt", "stream-model"))
    sinks.sink_model_state(spark, model, coefs, None, None)
    q = streams.stream_score_files(spark, f"{root}/events_csv", _stream_schema(), model, tp.calendar_parts,
                                   sink, ckpt, max_files=4, options={"timestampNTZFormat": CSV_TS},
                                   keep=["event_id", "ts"])
    q.awaitTermination()
    return streams.read_predictions(spark, sink).select("event_id", "ts", r6("pred_value").alias("pred_value"))


def _stream_schema():
    return "event_id bigint, ts timestamp_ntz, user_id bigint, value double, props string, yr int"


@register("stream_update_model", """
SELECT 'value' AS target, 'intercept' AS term, round(regr_intercept(value, hour(ts)), 6) + 0.0 AS coef FROM events
UNION ALL SELECT 'value', 'hour', round(regr_slope(value, hour(ts)), 6) + 0.0 FROM events
""")
def q_stream_update_model(spark, sf):
    root = write_events_csv(spark, sf, ["event_type"])
    model, ckpt = scratch_path(spark, "stream-model"), scratch_path(spark, "stream-ckpt")
    q = streams.stream_update_model(spark, f"{root}/events_csv", _stream_schema(), ["hour"], ["value"],
                                    tp.calendar_parts, model, ckpt, max_files=4,
                                    options={"timestampNTZFormat": CSV_TS})
    q.awaitTermination()
    coefs = streams.model_from_state(spark, model)
    return linear.coefficients_frame(spark, coefs).withColumn("coef", r6("coef"))


# Three deliveries of the events: each is scored by the model of those before
# it (the first by none), then taken into the model.
_LOOP_PARTS = [("click",), ("error", "view"), ("purchase", "signup")]
_LOOP_SQL = """
WITH e AS (SELECT *, CASE WHEN event_type = 'click' THEN 0 WHEN event_type IN ('error', 'view') THEN 1
                          WHEN event_type IN ('purchase', 'signup') THEN 2 END AS part FROM events),
m AS (SELECT p.part, regr_intercept(value, hour(ts)) AS a, regr_slope(value, hour(ts)) AS b
      FROM e JOIN (VALUES (1), (2), (3)) p(part) ON e.part < p.part GROUP BY p.part)
SELECT 'prediction' AS kind, e.event_id, round(m.a + m.b * hour(e.ts), 6) + 0.0 AS value FROM e JOIN m ON m.part = e.part
UNION ALL SELECT 'intercept', NULL, round(a, 6) + 0.0 FROM m WHERE part = 3
UNION ALL SELECT 'slope', NULL, round(b, 6) + 0.0 FROM m WHERE part = 3
UNION ALL SELECT 'version', NULL, 2.0
"""


@register("stream_model_loop", _LOOP_SQL)
def q_stream_model_loop(spark, sf):
    """The model loop over three deliveries, with every delivery's batch run once more at the end, a day later."""
    ev = load(spark, sf, "events").withColumn("yr", F.year("ts"))
    root, sink, ckpt, model = (scratch_path(spark, n) for n in ("csv-tree", "loop-sink", "loop-ckpt", "loop-model"))
    options = {"timestampNTZFormat": CSV_TS}

    def deliver(k):
        ev.where(F.col("event_type").isin(*_LOOP_PARTS[k])).select("event_id", "ts", "user_id", "value", "props", "yr") \
            .write.option("header", True).options(**options).csv(f"{root}/part-{k}")

    spark.createDataFrame([], _stream_schema()).write.csv(f"{root}/none")
    for k in range(3):
        deliver(k)
        streams.stream_model_loop(spark, root, _stream_schema(), ["hour"], ["value"], tp.calendar_parts, model, sink, ckpt,
                                  options=options, keep=["event_id"]).awaitTermination()
    for k in range(3):  # a replay of each batch
        batch = spark.read.schema(_stream_schema()).option("header", True).options(**options).csv(f"{root}/part-{k}") \
            .withColumns({"source_file": F.lit("again"), "source_id": F.lit(0)})
        streams.model_batch(spark, batch, k, ["hour"], ["value"], tp.calendar_parts, model, sink, "loop",
                            keep=["event_id"], run_date=_dt.date(2099, 1, 1))
    state = sinks.load_model(spark, model)
    c = state.coefs["value"]
    parts = spark.createDataFrame([("intercept", None, c["intercept"]), ("slope", None, c["hour"]), ("version", None, float(state.version))],
                                  "kind string, event_id bigint, value double")
    out = streams.read_predictions(spark, sink).select(F.lit("prediction").alias("kind"), "event_id", F.col("pred_value").alias("value"))
    return out.unionByName(parts).withColumn("value", r6("value"))
