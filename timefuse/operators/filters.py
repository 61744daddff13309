"""Row and column filters (F1-F8). Row predicates are plain ``where``s on the
raw key so Catalyst pushes them into the scan; column decisions take one
aggregate for all columns."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values from the reference: a numeric feature with more than this
# share of nulls is dropped; a target needs at least this many values.
MAX_NULL_SHARE = 0.5
MIN_TARGET_DATA_POINTS = 100


def drop_null_key(df: DataFrame, key: str = "ts") -> DataFrame:
    """F1."""
    return df.dropna(subset=[key])


def drop_null_any_target(df: DataFrame, targets: list[str]) -> DataFrame:
    """F2."""
    return df.dropna(how="any", subset=[t for t in targets if t in df.columns])


def before_cutoff(df: DataFrame, cutoff, key: str = "ts") -> DataFrame:
    """``key < cutoff``."""
    c = cutoff if hasattr(cutoff, "_jc") else F.lit(cutoff).cast("timestamp_ntz")
    return df.where(F.col(key) < c)


def on_date(df: DataFrame, day, key: str = "ts") -> DataFrame:
    """one calendar day as a half-open range (prunable, unlike to_date(k) = d)."""
    d = day if isinstance(day, _dt.date) else _dt.date.fromisoformat(str(day))
    start = _dt.datetime(d.year, d.month, d.day)
    end = start + _dt.timedelta(days=1)
    return df.where((F.col(key) >= F.lit(start).cast("timestamp_ntz")) & (F.col(key) < F.lit(end).cast("timestamp_ntz")))


def null_shares(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of nulls per column in one pass: (column_name, null_share)."""
    row = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, null_share)")


def drop_sparse_columns(df: DataFrame, numeric: list[str], limit: float = MAX_NULL_SHARE) -> DataFrame:
    """drop numeric features with strictly more than ``limit`` nulls."""
    shares = {r.column_name: r.null_share for r in null_shares(df, numeric).collect()}
    return df.drop(*[c for c, s in shares.items() if s is not None and s > limit])


def thin_targets(df: DataFrame, targets: list[str], minimum: int = MIN_TARGET_DATA_POINTS) -> DataFrame:
    """F6 as a table: (target, non_null, kept)."""
    t = [c for c in targets if c in df.columns]
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in t])
    stack = ", ".join(f"'{c}', `{c}`" for c in t)
    return row.selectExpr(f"stack({len(t)}, {stack}) as (target, non_null)") \
              .withColumn("kept", F.col("non_null") >= F.lit(minimum))


def drop_thin_targets(df: DataFrame, targets: list[str], minimum: int = MIN_TARGET_DATA_POINTS) -> DataFrame:
    """drop targets with fewer than ``minimum`` values."""
    thin = [r.target for r in thin_targets(df, targets, minimum).where(~F.col("kept")).collect()]
    return df.drop(*thin)


def split_null(df: DataFrame, col: str, flag: str = "is_null") -> DataFrame:
    """null / not-null partition as one flag column (one pass, no
    duplicate scan); ``where(flag)`` / ``where(~flag)`` give the two parts."""
    return df.withColumn(flag, F.col(col).isNull())


def uncastable_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """F8 as a table: (column_name, castable) where castable means at least
    one value survives a numeric coercion."""
    from ..functions.columns import coerce_numeric
    row = df.agg(*[(F.count(coerce_numeric(F.col(c))) > 0).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, castable)")
