"""Sources (S1-S3, S5-S7).

CSV trees are read in one scan per distinct header, each file by its own
header, and appended by name: Spark lists the files, ``probe`` reads the first
bytes of each, the category and year come from the file's path by a regex
chosen by the parent directory (or the year from the first row), and files
whose name matches no pattern are not read. The text is scanned once: with a
schema lazily, without one into a Parquet table of text cells, whose columns
then say their types in one aggregate.
"""

from __future__ import annotations

import datetime as _dt
from collections import Counter
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DataType, DoubleType, FloatType, NumericType, StringType, StructField,
                               StructType)

from ..session import written
from .probe import probe

# Fixed values from the reference: the file-name shapes of its three source
# directories (no year, `<prefix>_events_<year>.csv`, `<category>-<year>.csv`)
# are built by ``reference_patterns`` below.


def dispatch_columns(file_path, patterns: dict[str, str]):
    """(source, category, year, matched) columns for a file path.

    ``patterns`` maps a source name to a Java regex over the file path with
    optional named groups ``category`` and ``year``; the first source whose
    pattern matches wins (e.g. ``/Space Data/(?<prefix>...)_events_(?<year>...)\\.csv$``,
    or the ``key=value`` directories a partitioned Spark write leaves).
    """
    matched = F.lit(False)
    source = F.lit(None).cast("string")
    category = F.lit(None).cast("string")
    year = F.lit(None).cast("int")
    for name, rx in reversed(list(patterns.items())):
        hit = file_path.rlike(rx)
        matched = matched | hit
        source = F.when(hit, F.lit(name)).otherwise(source)
        if "(?<category>" in rx:
            category = F.when(hit, F.regexp_extract(file_path, rx, _group_index(rx, "category"))).otherwise(category)
        else:
            category = F.when(hit, F.lit(None).cast("string")).otherwise(category)
        if "(?<year>" in rx:
            year = F.when(hit, F.regexp_extract(file_path, rx, _group_index(rx, "year")).try_cast("int")).otherwise(year)
        else:
            year = F.when(hit, F.lit(None).cast("int")).otherwise(year)
    return source, category, year, matched


def reference_patterns(base_dir: str, events_dir: str, category_dir: str) -> dict[str, str]:
    """The three source shapes of the reference, rooted at the given directory names."""
    import re as _re
    return {
        "base": "/" + _re.escape(base_dir) + "/[^/]+\\.csv$",
        "events": "/" + _re.escape(events_dir) + "/\\w+_events_(?<year>\\d{4})\\.csv$",
        "category": "/" + _re.escape(category_dir) + "/(?<category>\\w+)-(?<year>\\d{4})\\.csv$",
    }


def _group_index(rx: str, group: str) -> int:
    """Position of a named group among the capturing groups of ``rx``."""
    import re as _re
    idx = 0
    for m in _re.finditer(r"(?<!\\)\((?!\?[:=!]|\?<[=!])(\?<(\w+)>)?", rx):
        idx += 1
        if m.group(2) == group:
            return idx
    raise ValueError(group)


# The words that pandas' CSV reader takes for an unknown value.
NULL_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
              "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def headers(spark: SparkSession, root: str | list[str], glob: str = "*.csv", path_filter=None,
            options: dict | None = None) -> dict[tuple[str, ...], list[str]]:
    """Header -> the files that have it, for all CSV files under ``root`` (only
    those whose decoded path meets ``path_filter``); empty files have none.

    The driver receives a row per file, as it does from Spark's own listing."""
    out: dict[tuple[str, ...], list[str]] = {}
    for r in probe(spark, root, glob, options, path_filter=path_filter).where("header is not null").orderBy("path").collect():
        out.setdefault(tuple(r["header"]), []).append(r["path"])
    return out


def _by_name(cells: tuple[str, ...], wanted: StructType) -> StructType:
    """The schema of files with this header: types by name, text for unknown
    columns; unnamed and repeated columns are named as Spark's reader does."""
    types = {f.name: f.dataType for f in wanted}
    often = Counter(c.lower() for c in cells)
    names = [f"_c{i}" if not c else f"{c}{i}" if often[c.lower()] > 1 else c for i, c in enumerate(cells)]
    return StructType([StructField(c, types.get(c, StringType())) for c in names])


def _wider(a: DataType, b: DataType) -> DataType:
    if a == b:
        return a
    if isinstance(a, NumericType) and isinstance(b, NumericType):
        return DoubleType()
    return StringType()


def union_widened(frames: list[DataFrame]) -> DataFrame:
    """Append by name; a column read with several types becomes double when all
    are numbers, else text."""
    types: dict[str, DataType] = {}
    for f in frames:
        for c in f.schema:
            types[c.name] = _wider(types[c.name], c.dataType) if c.name in types else c.dataType
    return union_by_name([f.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) for c in f.columns]) for f in frames])


def read_csv_by_header(spark: SparkSession, root: str | list[str], glob: str = "*.csv",
                       schema: StructType | str | None = None, path_filter=None,
                       options: dict | None = None) -> DataFrame | None:
    """All CSV files under ``root``, each read by its own header and appended
    by name, with ``source_file`` and ``source_path``; None without any file.

    ``schema`` gives types by name (columns it does not name are text; one that
    no file has is an error) and saves the written table from which types are
    learned without it. Words for unknown values and NaN are NULL. Quoted line
    breaks need the option ``multiLine``, which keeps a file in one task."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    found = headers(spark, root, glob, path_filter, options)
    if not found:
        return None
    absent = {f.name for f in schema or []} - {f.name for cells in found for f in _by_name(cells, StructType())}
    if absent:
        raise ValueError(f"columns that no file has: {', '.join(sorted(absent))}")
    parts = []
    for cells, paths in found.items():
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE").options(**(options or {}))
        part = reader.schema(_by_name(cells, schema or StructType())).csv(paths)
        words = [f.name for f in part.schema if isinstance(f.dataType, StringType)]
        floats = [f.name for f in part.schema if isinstance(f.dataType, (DoubleType, FloatType))]
        known = {c: F.when(~F.trim(F.col(f"`{c}`")).isin(NULL_WORDS), F.col(f"`{c}`")) for c in words}
        known |= {c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}
        parts.append(part.withColumns({"source_path": F.url_decode(F.col("_metadata.file_path")),
                                       "source_file": F.col("_metadata.file_name"), **known}))
    if schema is not None:
        return union_widened(parts)
    return typed(written(spark, union_by_name(parts), "csv-cells"), ("source_path", "source_file"))


_WHOLE, _NUMBER, _TRUTH = r"^\s*[+-]?[0-9]{1,18}\s*$", r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$", r"(?i)^\s*(true|false)\s*$"


def typed(cells: DataFrame, leave: tuple[str, ...] = ()) -> DataFrame:
    """Text columns by what all their known cells are, from one aggregate:
    whole numbers, numbers, truth values, else text."""
    columns = [f.name for f in cells.schema if isinstance(f.dataType, StringType) and f.name not in leave]
    if not columns:
        return cells
    # a flag for each kind of cell; a cell is matched until one pattern fits, and once
    flag = {c: F.when(F.col(f"`{c}`").rlike(_WHOLE), 1).when(F.col(f"`{c}`").rlike(_NUMBER), 2)
            .when(F.col(f"`{c}`").rlike(_TRUTH), 4).otherwise(8) for c in columns}
    r = cells.agg(*[F.bit_or(F.when(F.col(f"`{c}`").isNotNull(), flag[c])).alias(f"k{i}") for i, c in enumerate(columns)]).first()
    kinds = {1: "bigint", 2: "double", 3: "double", 4: "boolean"}
    types = {c: kinds.get(r[f"k{i}"]) for i, c in enumerate(columns)}
    return cells.withColumns({c: F.trim(F.col(f"`{c}`")).cast(kind) for c, kind in types.items() if kind})


def scan_csv_tree(spark: SparkSession, root: str, patterns: dict[str, str], schema: StructType | str | None = None,
                  options: dict | None = None, epoch_cols: tuple[str, ...] = ()) -> DataFrame:
    """Recursive CSV scan of ``root``; keeps files whose path matches a
    source pattern and adds ``source``, ``category``, ``year``, ``source_file``.
    With ``epoch_cols``, files without a year in their name take it from their
    first known epoch (S2), and those without one drop out."""
    df = read_csv_by_header(spark, root, "*.csv", schema, lambda path: dispatch_columns(path, patterns)[3], options)
    if df is None:
        wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema or StructType()
        df = spark.createDataFrame([], wanted).withColumns(
            {"source_path": F.lit(None).cast("string"), "source_file": F.lit(None).cast("string")})
    source, category, year, _ = dispatch_columns(F.col("source_path"), patterns)
    df = df.withColumns({"source": source, "category": category, "year": year})
    if epoch_cols:
        unnamed = lambda path: dispatch_columns(path, patterns)[3] & dispatch_columns(path, patterns)[2].isNull()
        years = probe(spark, root, "*.csv", options, epoch_cols, unnamed).where("year is not null")
        df = _with_years(df, years.select(F.col("path").alias("source_path"), F.col("year").alias("_y")), "source_path")
    return df.drop("source_path")


#: files whose years are sent to all tasks; 32 MB at 300 bytes a path
YEAR_FILES = 100_000


def _with_years(df: DataFrame, years: DataFrame, file_col: str) -> DataFrame:
    """Fill ``year`` by file from ``years`` (``file_col, _y``), and drop rows without any."""
    years = written(df.sparkSession, years, "file-years")  # one row a file
    if years.count() <= YEAR_FILES:
        years = F.broadcast(years)
    year = F.coalesce(F.col("year"), F.col("_y")) if "year" in df.columns else F.col("_y")
    return df.join(years, file_col, "left").withColumn("year", year).drop("_y").where("year is not null")


def _position(df: DataFrame) -> Column:
    """Where a row is in its file: the start of its block, then its place there
    (rows of a block are in one task, in their order)."""
    try:
        block = df.select("_metadata.file_block_start") and F.col("_metadata.file_block_start")
    except (AnalysisException, Py4JJavaError):
        raise ValueError("the rows' order is not known: give order_col, or a file scan") from None
    return F.struct(block.alias("block"), F.monotonically_increasing_id().alias("line"))


def year_from_content(df: DataFrame, epoch_cols=("dt", "UNIX_TIMESTAMP"), file_col: str = "source_file",
                      order_col: str | None = None) -> DataFrame:
    """S2 on rows read already: for files without a year in the name, the year
    of the file's first known epoch; files without any drop out. Files on
    storage are better served by ``scan_csv_tree(epoch_cols=...)``, which reads
    their first bytes only."""
    col = next((c for c in epoch_cols if c in df.columns), None)
    if col is None:
        return df.limit(0)
    src = df.select(file_col, col, (F.col(order_col) if order_col else _position(df)).alias("_at"))
    first = src.where(F.col(col).isNotNull()).groupBy(file_col).agg(
        F.min_by(F.year(F.timestamp_seconds(F.col(col).cast("bigint"))), "_at").alias("_y"))
    return _with_years(df, first, file_col)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """S3: append frames of unlike schema; missing columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def column_inventory(sources: dict[str, DataFrame]) -> DataFrame:
    """One row per (source, column) with row and non-null counts; one
    aggregate per source, all unioned."""
    parts = []
    for name, df in sources.items():
        cols = df.columns
        row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_nn{i}") for i, c in enumerate(cols)])
        stack = ", ".join(f"'{c}', _nn{i}" for i, c in enumerate(cols))
        parts.append(row.selectExpr(f"'{name}' as source", f"stack({len(cols)}, {stack}) as (column_name, non_null)", "_rows as n_rows"))
    return union_by_name(parts)


def distinct_count_sources(sources: list[DataFrame], col: str, approx: bool = False) -> DataFrame:
    """Distinct non-null values of ``col`` over several sources."""
    u = union_by_name([s.select(col) for s in sources if col in s.columns])
    agg = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return u.agg(agg.alias("n_distinct"))


def load_for_date(df: DataFrame, day, key: str = "ts",
                  aggregate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Optional user aggregation, then one calendar day.

    The day is a half-open range on the raw key; it is applied before the
    aggregation when that commutes (per-day aggregates), so the scan is pruned.
    """
    d = day if isinstance(day, _dt.date) else _dt.date.fromisoformat(str(day))
    start = _dt.datetime(d.year, d.month, d.day)
    end = start + _dt.timedelta(days=1)
    cond = (F.col(key) >= F.lit(start).cast("timestamp_ntz")) & (F.col(key) < F.lit(end).cast("timestamp_ntz"))
    pre = df.where(cond)
    return aggregate(pre).where(cond) if aggregate else pre
