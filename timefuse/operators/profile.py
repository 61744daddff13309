"""Profiling (A3-A10, T1, S4): every statistic of every column in as few
aggregates as possible; exact quantiles and modes without gathering a column
into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, NumericType, StringType


def _stack(row: DataFrame, names: list[str], value_cols: dict[str, str], label: str = "column_name") -> DataFrame:
    """Turn a one-row frame with per-column aggregates into one row per column.

    ``value_cols`` maps output name -> template with ``{i}`` for the column index.
    """
    parts = []
    for i, n in enumerate(names):
        parts.append(f"'{n}'")
        parts.extend(t.format(i=i) for t in value_cols.values())
    k = len(value_cols) + 1
    outs = ", ".join([label, *value_cols.keys()])
    return row.selectExpr(f"stack({len(names)}, {', '.join(parts)}) as ({outs})")


def long_values(df: DataFrame, cols: list[str], group: str = "column_name", value: str = "value") -> DataFrame:
    """Unpivot numeric columns to (column_name, value) as doubles."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias(group), F.col(c).cast("double").alias(value))
                                          for c in cols])).alias("_kv")).select("_kv.*")


#: values of a bracket that one pass tells apart
GRID = 400


def _probes(qs: list[float], accuracy: int) -> list[float]:
    """Three shares for each quantile: it, and a bit more than the sketch's error to either side."""
    m = 1.2 / accuracy
    return [p for q in qs for p in (max(0.0, q - m), q, min(1.0, q + m))]


#: of the sketches inside brackets: GRID values or fewer are kept exactly
FINE = 25 * GRID


def _slots(df: DataFrame, borders: dict[str, list[float]], inner: dict[str, set[int]]) -> dict[str, dict]:
    """Of each column, the known values at each border (slot 2i + 1 is border i)
    and between them (slot 2i is below border i): their number, and ``GRID``
    values at even shares of those in the ``inner`` slots. One aggregate for all
    columns; the driver receives a row for each slot."""
    cells = []
    for c, at in borders.items():
        v = F.col(f"`{c}`").cast("double")
        slot = F.when(v.isNull() | F.isnan(v), None)
        for i, x in enumerate(at):
            slot = slot.when(v < x, 2 * i).when(v == x, 2 * i + 1)
        slot = slot.otherwise(2 * len(at))
        cells.append(F.struct(F.lit(c).alias("c"), slot.alias("slot"), F.when(slot.isin(sorted(inner[c])), v).alias("v")))
    long = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("slot is not null")
    rows = long.groupBy("c", "slot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(
        "v", [(i + 0.5) / GRID for i in range(GRID)], FINE).alias("grid")).collect()
    out: dict[str, dict] = {c: {} for c in borders}
    for r in rows:
        out[r["c"]][r["slot"]] = (r["n"], r["grid"])
    return out


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float], accuracy: int = 10000,
                    first: dict[str, tuple[int, list[float]]] | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles of several columns: ``column_name, q, quantile``.

    Each wanted rank has a bracket of values, from a quantile sketch at first.
    A pass counts the values at the borders of all brackets of all columns and
    between them, and takes ``GRID`` even quantiles of those inside. A border,
    or at most that many values between two, gives its rank's value exactly; a
    larger bracket shrinks a hundredfold, and a value that very many rows share
    becomes a border. So the passes grow with the logarithm of the rows, two up
    to some 800,000, and nothing is sorted, shuffled by value or gathered: the
    same at every size. ``first`` are (known values, sketch at ``_probes``)
    where the caller has them.
    """
    spark, inf = df.sparkSession, float("inf")
    if first is None:
        known = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in cols}
        r = df.agg(*[F.count(known[c]).alias(f"n{i}") for i, c in enumerate(cols)],
                   *[F.percentile_approx(known[c], _probes(qs, accuracy), accuracy).alias(f"b{i}") for i, c in enumerate(cols)]).first()
        first = {c: (r[f"n{i}"], r[f"b{i}"]) for i, c in enumerate(cols)}
    wanted: dict[str, dict[int, set[float]]] = {}
    for c in cols:
        n, b = first[c]
        for i, q in enumerate(qs if n else []):
            pos = q * (n - 1)
            for rank in {int(pos // 1), int(-(-pos // 1))}:
                wanted.setdefault(c, {})[rank] = {b[3 * i], b[3 * i + 2]}
    value: dict[str, dict[int, float]] = {c: {} for c in cols}
    while any(wanted.values()):
        borders = {c: sorted(set().union(*w.values())) for c, w in wanted.items() if w}
        inner = {c: {2 * i for i, x in enumerate(at) if any(min(p) < x <= max(p) for p in wanted[c].values())}
                 for c, at in borders.items()}
        found = _slots(df, borders, inner)
        for c, at in borders.items():
            below, left = 0, {}
            for slot in range(2 * len(at) + 1):
                n, grid = found[c].get(slot, (0, None))
                i = slot // 2
                for rank in [r for r in wanted[c] if below <= r < below + n]:
                    share = (rank - below + 0.5) / n
                    if slot % 2:
                        value[c][rank] = at[i]
                    elif grid and (n <= GRID or grid[0] == grid[-1]):
                        value[c][rank] = grid[min(GRID - 1, int(share * GRID))]
                    elif grid:
                        reach = 1.5 + GRID / FINE
                        low, high = int(share * GRID - reach), int(share * GRID + reach) + 1
                        left[rank] = {at[i - 1], grid[max(low, 0)], grid[min(high, GRID - 1)], at[i]}
                    else:  # the sketch missed the rank
                        left[rank] = {at[i - 1] if i else -inf, at[i] if i < len(at) else inf}
                below += n
            wanted[c] = left
    rows = []
    for c in cols:
        for q in qs if first[c][0] else []:
            pos = q * (first[c][0] - 1)
            low, high = value[c][int(pos // 1)], value[c][int(-(-pos // 1))]
            rows.append((c, float(q), low if low == high else low + (pos - pos // 1) * (high - low)))
    return spark.createDataFrame(rows, "column_name string, q double, quantile double")


def target_describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """A3: count, mean, std (sample), min, 25/50/75 %, max per numeric column; NaN is unknown.
    The first pass of the quantiles is that of the other statistics."""
    qs, accuracy, aggs = [0.25, 0.5, 0.75], 10000, []
    for i, c in enumerate(cols):
        x = F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"),
                 F.max(x).alias(f"hi{i}"), F.percentile_approx(x, _probes(qs, accuracy), accuracy).alias(f"b{i}")]
    r = df.agg(*aggs).first()
    quantiles = {(x["column_name"], x["q"]): x["quantile"] for x in exact_quantiles(
        df, cols, qs, accuracy, {c: (r[f"n{i}"], r[f"b{i}"]) for i, c in enumerate(cols)}).collect()}
    rows = [(c, r[f"n{i}"], r[f"m{i}"], r[f"s{i}"], r[f"lo{i}"], *[quantiles.get((c, q)) for q in qs], r[f"hi{i}"])
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double")


def describe_strings(df: DataFrame, cols: list[str]) -> DataFrame:
    """A3 for text: count, unique, top (most frequent, ties -> smallest), freq."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                                          for c in cols])).alias("_kv")).select("_kv.*").where(F.col("value").isNotNull())
    vc = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("freq"))
    return vc.groupBy("column_name").agg(F.sum("freq").alias("count"), F.count(F.lit(1)).alias("unique"),
                                         F.min_by("value", F.struct(-F.col("freq"), F.col("value"))).alias("top"),
                                         F.max("freq").alias("freq"))


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NaN cells of floating-point columns as NULL: both mean "unknown"."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType)) and (cols is None or f.name in cols)]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else df


def pair_moments(df: DataFrame, targets: list[str], cols: list[str]) -> DataFrame:
    """``target, column_name, n, sx, sy, sxx, syy, sxy``: sums over the rows
    where both are known, of values moved by a constant of each column.

    Each Arrow batch is six matrix products of the values, their squares and
    the masks of known cells; sums add up over tasks in one small exchange.
    The constants are medians of the first rows: any value of the column's own
    size keeps its digits, and a constant column is exactly zero."""
    names = list(dict.fromkeys([*targets, *cols]))
    at = [names.index(t) for t in targets]
    near = df.select([F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)]).limit(1000)
    near = near.agg(*[F.percentile_approx(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)), 0.5, 10000).alias(c)
                      for c in near.columns]).first()
    away = np.array([near[i] or 0.0 for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(at), len(names)))
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) - away
            known = np.isfinite(x)
            x, m = np.where(known, x, 0.0), known.astype(float)
            xt, mt = x[:, at], m[:, at]
            total += [mt.T @ m, xt.T @ m, mt.T @ x, (xt * xt).T @ m, mt.T @ (x * x), xt.T @ x]
        t, c = np.divmod(np.arange(len(at) * len(names)), len(names))
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(c, pa.int32()), *(pa.array(s.ravel()) for s in total)],
                                         names=["t", "c", *_SUMS])

    src = df.select([F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    sums = src.mapInArrow(run, "t int, c int, " + ", ".join(f"{s} double" for s in _SUMS))
    named = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), F.col(i) + 1)
    return sums.groupBy("t", "c").agg(*[F.sum(s).alias(s) for s in _SUMS]) \
        .select(named(targets, "t").alias("target"), named(names, "c").alias("column_name"), *_SUMS)


_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def target_correlations(df: DataFrame, targets: list[str], features: list[str]) -> DataFrame:
    """A4: correlation of each target with every target and numeric feature over
    the rows where both are known, all pairs from one pass at any number of
    columns; (target, column_name, corr). NaN and infinity are unknown; of a
    column that does not vary over those rows it is NULL."""
    def left(square: str, total: str):
        raw = F.col(square) - F.col(total) * F.col(total) / F.col("n")
        return F.when(raw > F.col(square) * 1e-13, raw)  # what is left of a constant is rounding

    m = pair_moments(df, targets, list(dict.fromkeys([*targets, *features]))).where("n > 1")
    corr = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(left("sxx", "sx") * left("syy", "sy"))
    pairs = df.sparkSession.createDataFrame([(t, c) for t in targets for c in dict.fromkeys([*targets, *features])],
                                            "target string, column_name string")
    return pairs.join(m.select("target", "column_name", F.when(F.abs(corr) > 1, F.sign(corr)).otherwise(corr).alias("corr")),
                      ["target", "column_name"], "left")


def rank_correlations(corrs: DataFrame) -> DataFrame:
    """Per target, correlations in descending order (NULLs last) with rank.

    The correlation table has (#targets x #columns) rows, so the window is
    over a small table."""
    w = Window.partitionBy("target").orderBy(F.desc_nulls_last("corr"), "column_name")
    return corrs.withColumn("rank", F.row_number().over(w))


def null_ratio(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A5: percent null (or NaN) per column, one pass."""
    cols = cols or df.columns
    df = nan_to_null(df, cols)
    row = df.agg(*[(F.avg(F.col(f"`{c}`").isNull().cast("double")) * 100).alias(f"r{i}") for i, c in enumerate(cols)])
    return _stack(row, cols, {"null_pct": "r{i}"})


def non_null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A6."""
    cols = cols or df.columns
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)])
    return _stack(row, cols, {"non_null": "n{i}"})


def mode_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent non-null value per column, ties -> smallest.

    Value counts are a partial+final aggregate on (column, value); the pick is
    a second aggregate per column, so no column is collected into one task.
    """
    numeric = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}
    # numbers tie by value, everything else by text
    long = df.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"),
        (F.col(c) if c in numeric else F.lit(None)).cast("double").alias("number")) for c in cols])).alias("_kv")) \
        .select("_kv.*").where(F.col("value").isNotNull())
    vc = long.groupBy("column_name", "value", "number").agg(F.count(F.lit(1)).alias("freq"))
    return vc.groupBy("column_name").agg(F.min_by("value", F.struct(-F.col("freq"), F.col("number"), F.col("value"))).alias("mode"),
                                         F.max("freq").alias("freq"))


def mode_value(df: DataFrame, col: str):
    """Mode of one column as a one-row frame (typed like the column)."""
    vc = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_f"))
    return vc.agg(F.min_by(col, F.struct(-F.col("_f"), F.col(col))).alias(col))


def column_means(df: DataFrame, cols: list[str]) -> DataFrame:
    """A8 (one row, one column per input column); NaN is skipped like NULL."""
    df = nan_to_null(df, cols)
    return df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])


def contains_any(df: DataFrame, cols: list[str], marker: str = "http") -> DataFrame:
    """Does any cell of the column hold ``marker``."""
    row = df.agg(*[F.coalesce(F.bool_or(F.col(c).contains(marker)), F.lit(False)).alias(f"b{i}") for i, c in enumerate(cols)])
    return _stack(row, cols, {"has_marker": "b{i}"})


def scaler_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """A10: mean and population std per column (zero std kept as 0); NaN is skipped like NULL."""
    df = nan_to_null(df, cols)
    row = df.agg(*[e for i, c in enumerate(cols)
                   for e in (F.avg(F.col(c).cast("double")).alias(f"m{i}"),
                             F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}"))])
    return _stack(row, cols, {"mean": "m{i}", "std": "s{i}"})


def infer_roles(df: DataFrame, targets: list[str], time_key: str = "ts") -> DataFrame:
    """Role of every column: target / numeric / categorical / time / unknown.

    One aggregate tells which columns hold any value; the type tells the rest
    (a boolean counts as categorical, as in the reference).
    """
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    rows = []
    for f in df.schema.fields:
        if f.name == time_key:
            role = "'time'"
        elif f.name in targets:
            role = "'target'"
        elif isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType):
            role = "'numeric'"
        elif isinstance(f.dataType, (StringType, BooleanType)):
            role = "'categorical'"
        else:
            role = "'other'"
        rows.append(f"'{f.name}', CASE WHEN `{f.name}` > 0 THEN {role} ELSE 'unknown' END, '{f.dataType.simpleString()}'")
    return counts.selectExpr(f"stack({len(rows)}, {', '.join(rows)}) as (column_name, role, dtype)")
