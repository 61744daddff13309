"""JSON-in-text columns (X15-X17) as Column expressions.

The lenient repair of the reference (strip, single -> double quotes, add the
missing brackets, drop a trailing comma or semicolon) is done with string
functions; the parse is ``from_json`` with a declared schema, so no Python
runs per row. A repaired text that is an object is read as a one-element
array so every row has the same type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def repair_json_text(c: Column) -> Column:
    """The text edits of the lenient parser, in the reference's order."""
    v = F.trim(c.cast("string"))
    v = F.replace(v, F.lit("'"), F.lit('"'))
    v = F.when(v.startswith("[") | v.startswith("{"), v).otherwise(F.concat(F.lit("["), v, F.lit("]")))
    v = F.when(v.endswith("]") | v.endswith("}"), v).otherwise(F.concat(v, F.lit("]")))
    v = F.regexp_replace(v, ",+$", "")
    v = F.regexp_replace(v, ";+$", "")
    return v


def _as_array_schema(schema):
    if isinstance(schema, str):
        return schema if schema.strip().lower().startswith("array<") else f"array<{schema}>"
    return schema if isinstance(schema, ArrayType) else ArrayType(schema)


def is_json_text(c: Column) -> Column:
    """Cell is one whole JSON value, scalars included. A parse alone would let
    text after the value pass; inside an array and inside an object it can't."""
    in_array = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return F.when(c.isNotNull(), in_array.isNotNull() & in_object.isNotNull())


def parse_json_lenient(c: Column, element_schema: StructType) -> Column:
    """Repaired text -> ``array<element_schema>``; unparsable -> NULL."""
    v = repair_json_text(c)
    arr = _as_array_schema(element_schema)
    as_array = F.when(v.startswith("{"), F.concat(F.lit("["), v, F.lit("]"))).otherwise(v)
    opts = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}
    return F.from_json(as_array, arr, opts)


def parse_json_strict(c: Column, schema: DataType) -> Column:
    """Strict parse of one cell (no repair); unparsable -> NULL."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})


def json_column_decisions(df: DataFrame, cols: list[str], schema: DataType) -> DataFrame:
    """One row per column: does *every* non-null cell parse as JSON?

    The reference keeps a column as text if any cell fails; the decision is
    one aggregate over the table (one pass for all columns).
    """
    aggs = []
    for c in cols:
        ok = F.col(c).isNull() | is_json_text(F.col(c))
        aggs.append(F.coalesce(F.bool_and(ok), F.lit(True)).alias(c))
    row = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, is_json)")


def json_first_fields(arr: Column, fields: list[str], prefix: str = "") -> dict[str, Column]:
    """The named fields of the first array element (NULL when empty)."""
    first = F.get(arr, 0)
    return {f"{prefix}{f}": first.getField(f) for f in fields}


# Fixed values from the reference: the JSON columns it reads (after the
# rename) and the fields taken from their first element.
REFERENCE_JSON_FIELDS = {
    "impact_list": ("impact_", ["latitude", "longitude"]),
    "cme_analyses": ("cme_", ["speed"]),
}


def extract_reference_json_features(df: DataFrame) -> DataFrame:
    """X17 for the reference's columns: ``impact_latitude``,
    ``impact_longitude`` from ``impact_list`` and ``cme_speed`` from
    ``cme_analyses`` (lenient parse; missing or broken -> NULL)."""
    out = df
    for col, (prefix, fields) in REFERENCE_JSON_FIELDS.items():
        if col in df.columns:
            arr = parse_json_lenient(F.col(col), "struct<" + ", ".join(f"{f}: double" for f in fields) + ">")
            out = out.withColumns(json_first_fields(arr, fields, prefix))
    return out
