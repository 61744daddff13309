"""Category codes, one-hot and scaling.

A column's categories are a fitted table ``value, code`` (``category_table``),
written to shared storage and never collected, so a column may have millions of
them. Rows take their code by a join with it: a broadcast when the table's
measured bytes allow one, otherwise a shuffle join whose hot values AQE splits,
past which the rows without a value are led. One-hot rows of many categories are
sparse (``one_hot_sparse``); dummies of one column each (E3, E4) need the
categories as names when the plan is made, and are bounded by ``MOST_DUMMIES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import dense_codes
from ..session import BROADCAST_BYTES, join_side, written
from .profile import scaler_stats

#: columns that dummies may make of one column
MOST_DUMMIES = 10_000


def category_table(df: DataFrame, col: str) -> DataFrame:
    """The fitted categories of ``col``: ``value, code``, sorted distinct values -> 0..n-1."""
    return written(df.sparkSession, dense_codes(df, col, "code").select(F.col(col).alias("value"), "code"), "categories")


def with_codes(df: DataFrame, col: str, table: DataFrame, out: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``out``: the code of each row's value in a category table, NULL for
    NULL and unfitted values."""
    right, small = join_side(table.select(F.col("value").alias("_value"), F.col("code").alias("_code")), broadcast_bytes)

    def joined(rows: DataFrame) -> DataFrame:
        return rows.join(right, F.col(f"`{col}`") == F.col("_value"), "left").withColumn(out, F.col("_code")).drop("_value", "_code")

    if small:
        return joined(df)
    known = F.col(f"`{col}`").isNotNull()
    return joined(df.where(known)).unionByName(df.where(~known).withColumn(out, F.lit(None).cast(table.schema["code"].dataType)))


def category_codes(df: DataFrame, col: str, out: str | None = None, table: DataFrame | None = None,
                   broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Sorted distinct values -> 0..n-1, NULL -> -1; with a fitted ``table``
    its codes, and -1 for values it does not have."""
    table = category_table(df, col) if table is None else table
    res = with_codes(df, col, table, "__code", broadcast_bytes)
    return res.withColumn(out or col, F.coalesce(F.col("__code"), F.lit(-1))).drop("__code")


def one_hot_sparse(df: DataFrame, col: str, table: DataFrame, out: str | None = None, drop_first: bool = False,
                   broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """E3, E4 for any number of categories: ``out`` is a map from code to 1.0,
    empty for NULL, unfitted values and, with ``drop_first``, the first category."""
    res = with_codes(df, col, table, "__code", broadcast_bytes)
    none = F.create_map().cast("map<int,double>")
    there = F.col("__code") > 0 if drop_first else F.col("__code").isNotNull()
    hot = F.when(there, F.create_map(F.col("__code"), F.lit(1.0))).otherwise(none)
    return res.withColumn(out or f"{col}_onehot", hot).drop("__code")


def fitted_categories(df: DataFrame, col: str, most: int = MOST_DUMMIES) -> list:
    """Sorted distinct non-null values (the fitted state of dummies); more than
    ``most`` are an error, for which ``one_hot_sparse`` is."""
    found = df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} categories: encode it with category_table and one_hot_sparse")
    return [r[0] for r in found]


def _name(col: str, v) -> str:
    return f"{col}_{v}"


def one_hot_drop_first(df: DataFrame, col: str, categories: list | None = None) -> DataFrame:
    """Boolean dummies for every category but the first; NULL -> all false."""
    cats = categories if categories is not None else fitted_categories(df, col)
    dummies = {_name(col, v): F.coalesce(F.col(col) == F.lit(v), F.lit(False)) for v in cats[1:]}
    return df.withColumns(dummies).drop(col)


def one_hot_ignore_unknown(df: DataFrame, col: str, categories: list) -> DataFrame:
    """0/1 dummies of the fitted categories; unseen or NULL -> all zero."""
    dummies = {_name(col, v): F.coalesce((F.col(col) == F.lit(v)).cast("double"), F.lit(0.0)) for v in categories}
    return df.withColumns(dummies).drop(col)


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Scaler state: mean and population std per column (one aggregate)."""
    return {r.column_name: (r.mean, r.std) for r in scaler_stats(df, cols).collect()}


def standard_scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """E5: (x - mean) / std, a zero std divides by 1."""
    out = {}
    for c, (m, s) in stats.items():
        scale = s if s not in (None, 0.0) else 1.0
        out[c] = (F.col(c).cast("double") - F.lit(m if m is not None else 0.0)) / F.lit(scale)
    return df.withColumns(out)


def inverse_scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """X * std + mean."""
    out = {}
    for c, (m, s) in stats.items():
        scale = s if s not in (None, 0.0) else 1.0
        out[c] = F.col(c) * F.lit(scale) + F.lit(m if m is not None else 0.0)
    return df.withColumns(out)
