"""Scoring plans (M5-M8): one date, fixed horizons, the next 8,760 hours.

The four periods are a literal array each row filters and explodes, and the
future hours are generated by ``spark.range`` on the executors; neither needs
a join or a shuffle of the data, and all periods are scored in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions import timeparse as tp
from ..operators import linear, schema
from ..sources.scan import load_for_date

# Fixed values from the reference: forecast periods and their day offsets,
# and the hourly horizon (365 days x 24 hours).
FORECAST_PERIODS = [("monthly", 30), ("daily", 1), ("weekly", 7), ("yearly", 365)]
HORIZON_HOURS = 365 * 24


def forecast_periods(data: DataFrame, coefs: dict, spark: SparkSession, as_of, key: str = "ts",
                     run_ts=None) -> DataFrame:
    """M6: for each period, the rows before its start date scored and tagged.

    One pass, no join: each row carries the fixed list of the four periods
    and keeps (explodes) those whose start lies after the row."""
    a = as_of if hasattr(as_of, "_jc") else F.lit(as_of).cast("timestamp_ntz")
    periods = F.array(*[F.struct(F.lit(name).alias("forecast_period"),
                                 tp.horizon_start(a, days).alias("forecast_date"))
                        for name, days in FORECAST_PERIODS])
    scored = linear.predict_linear(data, coefs)
    run = run_ts if run_ts is not None else F.current_timestamp().cast("timestamp_ntz")
    targets = list(coefs)
    row_ts = F.col(key)
    mine = F.filter(periods, lambda p: row_ts < p["forecast_date"])
    # as in the reference: targets, period, ``timestamp`` = the run time,
    # ``forecast_date``; the scored row's own time is kept as ``key``
    return scored.select(*targets, key, F.explode(mine).alias("_p")) \
                 .select(*targets, F.col("_p.forecast_period").alias("forecast_period"),
                         (run if hasattr(run, "_jc") else F.lit(run).cast("timestamp_ntz")).alias("timestamp"),
                         F.col("_p.forecast_date").alias("forecast_date"), F.col(key))


def future_hours(spark: SparkSession, start, hours: int = HORIZON_HOURS) -> DataFrame:
    """M7: ``hours`` hourly stamps from ``start`` (a one-row frame or literal)
    with hour, day, month, weekday (Monday = 0)."""
    base = spark.range(hours).withColumnRenamed("id", "h")
    if isinstance(start, DataFrame):
        start = start.first()[0]  # one value
    s = F.lit(start).cast("timestamp_ntz")
    dt = (s + F.make_dt_interval(hours=F.col("h").cast("int"))).cast("timestamp_ntz")
    out = base.select(dt.alias("datetime"))
    return out.withColumns({"hour": F.hour("datetime"), "day": F.dayofmonth("datetime"),
                            "month": F.month("datetime"), "weekday": F.weekday("datetime")})


def forecast_horizon(spark: SparkSession, start, coefs: dict, features: list[str], targets: list[str],
                     target_scaler: dict | None = None) -> DataFrame:
    """M8: future hours -> conform to the model's features (absent = 0) ->
    predict -> inverse-scale -> pad missing targets -> non-finite to 0."""
    fut = future_hours(spark, start)
    x = schema.conform_schema(fut, ["datetime", *features], fill=0.0)
    pred = linear.predict_linear(x, coefs).select("datetime", *coefs)
    if target_scaler:
        from ..operators.encode import inverse_scale
        pred = inverse_scale(pred, {t: s for t, s in target_scaler.items() if t in pred.columns})
    pred = schema.pad_targets(pred, targets)
    return pred.select("datetime", *[fc.clean_nonfinite(F.col(t)).alias(t) for t in targets])


def predict_for_date(df: DataFrame, day, coefs: dict, key: str = "ts", prepare=None) -> DataFrame:
    """M5: the day's rows -> (optional) preparation -> the first row's
    prediction; no rows give an empty frame (not an error)."""
    d = load_for_date(df, day, key)
    if prepare is not None:
        d = prepare(d)
    scored = linear.predict_linear(d, coefs)
    return scored.orderBy(key).limit(1).select(key, *coefs)
