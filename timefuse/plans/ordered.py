"""Order-dependent work without a single-partition window.

Operators whose answer depends on a global row order (forward fill, running
totals, ranks) are computed in two levels: rows are dealt to ranges of the
order key, each range is scanned by itself (parallel, bounded by the range's
size), and a summary with one row per range (the proven size bound of its
broadcast) carries the state across the borders.

Keys that begin with a number, date or time are dealt by ``order_buckets``: the
borders come from one quantile aggregate and are part of the plan, so a row's
range is a function of the row alone, whatever is recomputed after a lost
executor, and nothing is written. Other keys (text) are range-partitioned and
checkpointed to the shared folder, which fixes each row's range as well. A key
value that holds many rows is cut by the second key column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

PID = "_pid"


def _as_number(df: DataFrame, col: str) -> str | None:
    """SQL of a number in the order of a column, or None if there is no such."""
    kind, name = df.schema[col].dataType, f"`{col}`"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return f"unix_micros(CAST({name} AS TIMESTAMP))"
    if isinstance(kind, T.DateType):
        return f"unix_date({name})"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return f"CAST({name} AS DOUBLE)"
    return f"CAST({name} AS BIGINT)" if isinstance(kind, T.IntegralType) else None


def _literal(v) -> str:
    return f"{v!r}D" if isinstance(v, float) else f"{v}L"


def order_buckets(df: DataFrame, order_cols: list[str], buckets: int | None = None) -> Column | None:
    """A range number for each row, rising with the order of ``order_cols``
    (nulls first, NaN last), from the quantiles of the first column; a value
    that spans several quantiles is cut at those of the second column among its
    rows. None if the first column has no numeric order.

    The expression is a search tree over the borders: as many comparisons as
    the logarithm of their number."""
    first = _as_number(df, order_cols[0])
    if first is None:
        return None
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return F.lit(0)
    shares = ", ".join(f"{i / n!r}D" for i in range(1, n))
    accuracy = max(10_000, 20 * n)

    def quantiles(k: str, where: str = "true", q: str = shares) -> Column:
        nan = "" if "DOUBLE" not in k else f" AND NOT isnan({k})"
        return F.expr(f"percentile_approx(CASE WHEN {where}{nan} THEN {k} END, array({q}), {accuracy})")

    r = df.agg(quantiles(first).alias("q"), F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"int({first} IS NULL)")).alias("null")).first()
    found = [v for v in (r["q"] or []) if abs(v) != float("inf")]
    times: dict = {}
    for v in found:
        times[v] = times.get(v, 0) + 1
    second = _as_number(df, order_cols[1]) if len(order_cols) > 1 else None
    heavy = {v: (f"{first} = {_literal(v)}", m) for v, m in times.items()}
    heavy[None] = (f"{first} IS NULL", r["null"] * n // r["n"] if r["n"] else 0)
    heavy = {v: (where, m) for v, (where, m) in heavy.items() if m > 1 and second}
    cuts: dict = {}
    if heavy:
        row = df.agg(*[quantiles(second, where, ", ".join(f"{i / m!r}D" for i in range(1, m))).alias(f"q{j}")
                       for j, (where, m) in enumerate(heavy.values())]).first()
        cuts = {v: sorted(w for w in set(row[f"q{j}"] or []) if abs(w) != float("inf")) for j, v in enumerate(heavy)}
    nulls = cuts.pop(None, [])
    borders: list[tuple] = []
    for v in sorted(times):
        borders += [(v, None), *((v, w) for w in cuts.get(v, []))]

    def below(i: int) -> str:
        v, w = borders[i]
        here = f"{first} < {_literal(v)}"
        return here if w is None else f"({here} OR {first} = {_literal(v)} AND coalesce({second} < {_literal(w)}, true))"

    def tree(low: int, high: int, test, base: int = 0) -> str:
        if low == high:
            return str(base + low)
        mid = (low + high) // 2
        return f"CASE WHEN {test(mid)} THEN {tree(low, mid, test, base)} ELSE {tree(mid + 1, high, test, base)} END"

    null = tree(0, len(nulls), lambda i: f"coalesce({second} < {_literal(nulls[i])}, true)")
    return F.expr(f"CASE WHEN {first} IS NULL THEN {null} ELSE {tree(0, len(borders), below, len(nulls))} END")


def segment_ranks(df: DataFrame, segment: str, order: str, weight: str, out: str = "rank") -> DataFrame:
    """The average rank of each row's ``order`` value among the ``weight`` copies
    of all rows of its ``segment`` (ties share theirs; the first rank is 1).

    One scan for all segments: rows are dealt by ranges of ``order``, and the
    weights of a segment's lower ranges are carried from a summary of one row
    per segment and range. Read twice, so a written table is best."""
    d = df.withColumn(PID, order_buckets(df, [order]))
    lower = Window.partitionBy(segment).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    carried = d.groupBy(segment, PID).agg(F.sum(weight).alias("_w")) \
        .select(segment, PID, F.coalesce(F.sum("_w").over(lower), F.lit(0)).alias("_below"))
    mine = Window.partitionBy(segment, PID).orderBy(order)
    upto = F.sum(weight).over(mine.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.sum(weight).over(Window.partitionBy(segment, PID, order))
    # segments x ranges rows
    return d.withColumns({"_upto": upto, "_same": same}).join(F.broadcast(carried), [segment, PID]) \
        .withColumn(out, F.col("_below") + F.col("_upto") - F.col("_same") + (F.col("_same") + 1) / 2.0) \
        .drop(PID, "_upto", "_same", "_below")


def ordered_partitions(df: DataFrame, order_cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """Range-partition on ``order_cols``, tag the partition id, checkpoint.

    Without an explicit count the exchange uses the session's shuffle
    partitions and AQE may coalesce them to fit the data; coalescing only
    merges neighbouring ranges, so partition ids stay in key order."""
    ensure_checkpoint_dir(df.sparkSession)
    keys = [F.col(c).asc_nulls_first() for c in order_cols]
    d = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    return d.withColumn(PID, F.spark_partition_id()).checkpoint(eager=True)


def _offsets(summary: DataFrame, cols: list[str], how: str) -> DataFrame:
    """Exclusive carry across partitions on the P-row summary."""
    w = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    # "first after" as "last before" in reverse order: Spark re-evaluates a
    # frame that ends at UNBOUNDED FOLLOWING for every row (quadratic), while a
    # frame that starts at UNBOUNDED PRECEDING grows incrementally
    wf = Window.orderBy(F.col(PID).desc()).rowsBetween(Window.unboundedPreceding, -1)
    exprs = []
    for c in cols:
        if how == "sum":
            exprs.append(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c))
        elif how == "last":
            exprs.append(F.last(c, ignorenulls=True).over(w).alias(c))
        elif how == "first":
            exprs.append(F.last(c, ignorenulls=True).over(wf).alias(c))
    return summary.select(PID, *exprs)


def prefix_sums(df: DataFrame, order_cols: list[str], value_cols: list[str],
                inclusive: bool = True, num_partitions: int | None = None) -> DataFrame:
    """Running sums of ``value_cols`` in the global order of ``order_cols``.

    Adds ``cum_<v>`` (inclusive, or exclusive when ``inclusive=False``).
    Ties in the order key are broken by the partition scan order, so callers
    pass a unique key (e.g. after grouping by it).
    """
    d = ordered_partitions(df, order_cols, num_partitions)
    frame = (Window.unboundedPreceding, Window.currentRow) if inclusive else (Window.unboundedPreceding, -1)
    w = Window.partitionBy(PID).orderBy(*order_cols).rowsBetween(*frame)
    local = d.withColumns({f"_loc_{v}": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in value_cols})
    summary = d.groupBy(PID).agg(*[F.sum(v).alias(v) for v in value_cols])
    off = _offsets(summary, value_cols, "sum").select(PID, *[F.col(v).alias(f"_off_{v}") for v in value_cols])
    out = local.join(F.broadcast(off), PID, "left")
    out = out.withColumns({f"cum_{v}": F.col(f"_loc_{v}") + F.coalesce(F.col(f"_off_{v}"), F.lit(0))
                           for v in value_cols})
    return out.drop(PID, *[f"_loc_{v}" for v in value_cols], *[f"_off_{v}" for v in value_cols])


def dense_codes(values: DataFrame, col: str, out: str = "code", num_partitions: int | None = None) -> DataFrame:
    """0-based position of each distinct non-null value of ``col`` in sorted order."""
    distinct = values.select(col).where(F.col(col).isNotNull()).distinct().withColumn("_one", F.lit(1))
    ranked = prefix_sums(distinct, [col], ["_one"], inclusive=False, num_partitions=num_partitions)
    return ranked.select(col, F.col("cum__one").cast("int").alias(out))


def fill_ordered(df: DataFrame, cols: list[str], order_cols: list[str], direction: str = "forward",
                 num_partitions: int | None = None) -> DataFrame:
    """Carry non-null values along the global order of ``order_cols``.

    ``direction`` is ``forward`` (last non-null so far), ``backward`` (next
    non-null) or ``both`` (forward, then backward for the leading gap). The
    order must be one: rows of equal ``order_cols`` raise an error, since which
    of them comes first would be left to chance.

    The rows go through one exchange, by range; the summaries read the key and
    the filled columns only.
    """
    bucket = order_buckets(df, order_cols, num_partitions)
    d = ordered_partitions(df, order_cols, num_partitions) if bucket is None else df.withColumn(PID, bucket)
    key = F.struct(*[F.col(c) for c in order_cols])
    known = {c: F.when(F.col(c).isNotNull(), key) for c in cols}
    # backward = forward over the reversed order (see ``_offsets``): a running
    # frame, not one re-evaluated per row up to UNBOUNDED FOLLOWING
    reverse = direction == "backward"
    order = [F.col(c).desc_nulls_last() if reverse else F.col(c).asc_nulls_first() for c in order_cols]
    w = Window.partitionBy(PID).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pick = F.min_by if reverse else F.max_by
    summary = d.groupBy(PID).agg(*[pick(c, known[c]).alias(c) for c in cols],
                                 *[F.min_by(c, known[c]).alias(f"_first_{c}") for c in cols if direction == "both"])
    lower = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    upper = Window.orderBy(F.col(PID).desc()).rowsBetween(Window.unboundedPreceding, -1)
    # after a forward pass only the rows before the first non-null stay null;
    # their backward value is the first one in their own or a later range
    onward = Window.orderBy(F.col(PID).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = summary.select(PID, *[F.last(c, ignorenulls=True).over(upper if reverse else lower).alias(f"_c_{c}") for c in cols],
                           *[F.last(f"_first_{c}", ignorenulls=True).over(onward).alias(f"_b_{c}")
                             for c in cols if direction == "both"])
    again = F.lag(F.col("_k")).over(w).eqNullSafe(F.col("_k"))
    out = d.withColumn("_k", key).withColumns({**{c: F.last(c, ignorenulls=True).over(run) for c in cols}, "_again": again}) \
        .join(F.broadcast(carry), PID, "left")
    late = {c: [F.col(f"_b_{c}")] if direction == "both" else [] for c in cols}
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_c_{c}"), *late[c]) for c in cols})
    checked = F.when(F.col("_again"), F.raise_error(F.lit(f"rows of equal {', '.join(order_cols)}: give an order without ties")))
    return out.withColumn(cols[0], F.coalesce(checked.cast(out.schema[cols[0]].dataType), F.col(cols[0]))).select(*df.columns) if cols \
        else df
