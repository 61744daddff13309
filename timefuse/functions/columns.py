"""Per-cell value rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker that makes a text column a link column, and the
# first-digit-run rule applied to every other text column.
LINK_MARKER = "http"
DIGIT_RUN = r"(\d+)"
# A plain decimal number or an infinity, as a strict numeric parser reads it
# (no type suffixes such as 1d / 1f, which Spark's cast would accept).
NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def link_flag(c: Column) -> Column:
    """1 when the cell holds ``http``, else 0 (null -> 0)."""
    return F.coalesce(c.cast("string").contains(LINK_MARKER), F.lit(False)).cast("int")


def first_number(c: Column) -> Column:
    """First run of digits as a double; none -> NULL."""
    return F.regexp_extract(c.cast("string"), DIGIT_RUN, 1).try_cast("double")


def coerce_numeric(c: Column) -> Column:
    """Numeric text -> double, anything else -> NULL."""
    s = c.cast("string")
    return F.when(s.rlike(NUMERIC_TEXT), F.trim(s).try_cast("double"))


def is_nonfinite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def clean_nonfinite(c: Column) -> Column:
    """NULL, NaN and +-inf -> 0."""
    x = c.cast("double")
    return F.when(x.isNull() | is_nonfinite(x), F.lit(0.0)).otherwise(x)


def has_nonfinite(c: Column) -> Column:
    """X19 (aggregate): any NaN / inf in the column."""
    return F.coalesce(F.bool_or(is_nonfinite(c.cast("double"))), F.lit(False))
