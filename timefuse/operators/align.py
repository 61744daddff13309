"""Resampling to a daily grid and the time joins.

The daily tables hold one row per day between the first and last day, so
their size is bounded by the time span, not by the data volume. Joins write
the right side as a small table first. It is broadcast when its measured bytes are
within ``BROADCAST_BYTES``, and the big side then stays where it is; a larger
one is joined by an ordinary shuffle join, in which the NULL keys of a null-safe
join are kept apart (see ``multi_left_join``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..session import BROADCAST_BYTES, join_side, written
from .schema import numeric_columns

# Fixed values from the reference: event categories that have a time keeper
# and are therefore aggregated; other categories give no rows.
REFERENCE_CATEGORIES = [
    "CME", "CMEAnalysis", "FLR", "GST", "HSS", "IPS", "MPC", "notifications",
    "RBE", "SEP", "WSAEnlilSimulations",
]

DAY = "_day"


def _mean(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    x = F.col(c)
    if isinstance(dt, (DoubleType, FloatType)):
        x = F.when(~F.isnan(x), x)  # pandas skips NaN like NULL
    return F.avg(x).alias(c)


def daily_mean(df: DataFrame, key: str = "ts", cols: list[str] | None = None) -> DataFrame:
    """A1: mean of every numeric column per UTC day, empty days as NULL rows.

    One scan: the empty days come from the gap between a day and the next in
    the aggregate, a window over one row per day (the calendar bounds it, not
    the data). Without numeric columns the days alone are returned."""
    cols = cols if cols is not None else numeric_columns(df, exclude=(key,))
    src = df.where(F.col(key).isNotNull()).withColumn(DAY, F.to_date(key))
    # the count keeps the aggregate valid without numeric columns
    agg = src.groupBy(DAY).agg(F.count(F.lit(1)).alias("_n"), *[_mean(src, c) for c in cols])
    last = F.date_sub(F.lead(DAY).over(Window.orderBy(DAY)), 1)
    days = agg.withColumn("_to", F.coalesce(last, F.col(DAY))) \
              .select("*", F.explode(F.sequence(DAY, "_to", F.expr("INTERVAL 1 DAY"))).alias("_d"))
    seen = F.col("_d") == F.col(DAY)
    return days.select(F.col("_d").cast("timestamp_ntz").alias(key), *[F.when(seen, F.col(c)).alias(c) for c in cols])


def daily_mean_by_category(df: DataFrame, category: str, key: str = "ts", year: str | None = None,
                           cols: list[str] | None = None,
                           allowed: list[str] | None = None) -> DataFrame:
    """A2: A1 per (category, year) in one job; only ``allowed`` categories.

    Each (category, year) gets its own day spine from its first to its last
    day, as when each category file of a year is resampled by itself.
    """
    allowed = REFERENCE_CATEGORIES if allowed is None else allowed
    cols = cols if cols is not None else numeric_columns(df, exclude=(key,))
    yr = F.col(year) if year else F.year(key)
    src = df.where(F.col(key).isNotNull() & F.col(category).isin(allowed)) \
            .withColumns({"year": yr, DAY: F.to_date(key)})
    cols = [c for c in cols if c != "year"]
    agg = src.groupBy(category, "year", DAY).agg(*[_mean(src, c) for c in cols])
    spine = agg.groupBy(category, "year").agg(F.min(DAY).alias("lo"), F.max(DAY).alias("hi")) \
               .select(category, "year", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias(DAY))
    out = spine.join(agg, [category, "year", DAY], "left")
    return out.select(category, "year", F.col(DAY).cast("timestamp_ntz").alias(key), *cols)


def prefix_columns(df: DataFrame, prefix: str, key: str = "ts") -> DataFrame:
    return df.select(*[F.col(c) if c == key else F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def _right_side(base: DataFrame, right: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The right side as a written table, and whether its measured size allows a broadcast."""
    return join_side(written(base.sparkSession, right, "join-side"), most)


def multi_left_join(base: DataFrame, sources: list[tuple[str, DataFrame]], key: str = "ts",
                    null_safe: bool = False, skip_empty: bool = False,
                    broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """J1 (+J3): base left-joined to each source on equal time, in order.

    Right columns are prefixed by the source name up front, so names never
    collide; fan-out of several right rows per key is kept. ``skip_empty``
    leaves out sources without rows (as the reference does). Right sides within
    ``broadcast_bytes`` are broadcast, so the base is never shuffled for them.
    Beyond that, a null-safe join takes the base rows without a key out of the
    shuffle: they have one partner set, which is joined to them as its own
    (broadcast) side when it is a single row, as after an aggregate."""
    out = base
    for name, src in sources:
        if src is None or (skip_empty and src.isEmpty()):
            continue
        right, small = _right_side(base, prefix_columns(src, name, key).withColumnRenamed(key, "_rk"), broadcast_bytes)
        if small or not null_safe:
            cond = out[key].eqNullSafe(right["_rk"]) if null_safe else out[key] == right["_rk"]
            out = out.join(right, cond, "left").drop("_rk")
            continue
        keyed = out.join(right, out[key] == right["_rk"], "left").drop("_rk")
        unkeyed = right.where("_rk IS NULL")
        if unkeyed.limit(2).count() < 2:
            only = unkeyed.first()
            filler = [F.lit(only[c] if only else None).cast(right.schema[c].dataType).alias(c)
                      for c in right.columns if c != "_rk"]
            out = keyed.where(F.col(key).isNotNull()).unionByName(out.where(F.col(key).isNull()).select("*", *filler))
        else:
            out = out.join(right, out[key].eqNullSafe(right["_rk"]), "left").drop("_rk")
    return out


def align_left_join(base: DataFrame, daily: DataFrame, name: str, key: str = "ts",
                    grain: str = "day", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each base row joined to the aggregate of its day (or other grain)."""
    def bucket(c):
        return F.to_date(c) if grain == "day" else F.date_trunc(grain, c).cast("timestamp_ntz")
    right = prefix_columns(daily, name, key)
    right, _ = _right_side(base, right.withColumn("_g", bucket(F.col(key))).drop(key), broadcast_bytes)
    return base.withColumn("_g", bucket(F.col(key))).join(right, "_g", "left").drop("_g")


def null_safe_left_join(base: DataFrame, other: DataFrame, name: str, key: str = "ts",
                        broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left join where NULL keys match NULL keys (as pandas merge does)."""
    return multi_left_join(base, [(name, other)], key, null_safe=True, broadcast_bytes=broadcast_bytes)
