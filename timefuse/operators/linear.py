"""Linear models from mergeable sufficient statistics (M1-M4) and the
budgeted gradient fit (M2).

The data pass gathers, per task, the row count, the column means and the
co-moments around those means (sums of products of deviations, one matrix
product per Arrow batch). Counts, means and co-moments of two parts merge
exactly into those of their union, so a fit touches the data once at any number
of columns, batches add up (M3), and large offsets such as epoch seconds cost
no accuracy, since no raw square is ever summed. Tasks hand on one row per
column; those are merged in two steps, so no merge sees more than
``MERGE_TASKS`` tasks' rows or one row per such bucket. Only the final
statistics, of the model's size, reach the driver for the solve. Scoring is a
generated Column dot product (whole-stage codegen, no UDF).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INTERCEPT = "intercept"
#: tasks whose statistics are merged together in the first step
MERGE_TASKS = 256
STATE = "model string, pos int, column string, n double, means array<double>, co array<double>"


@dataclass
class Group:
    """A set of columns whose joint statistics are wanted over the rows where
    the ``required`` ones are known; ``fill`` replaces unknown other cells."""
    model: str
    columns: list[str]
    required: list[str]
    fill: dict[str, float]


def _merged(n: np.ndarray, means: np.ndarray, co: np.ndarray, pos: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, means and co-moments of one column (``pos``) with all, over several parts."""
    total = n.sum()
    if total == 0:
        return 0.0, np.zeros(means.shape[1]), np.zeros(co.shape[1])
    mean = n @ means / total
    away = means - mean
    return total, mean, co.sum(axis=0) + (n * away[:, pos]) @ away


def _combine(parts: DataFrame, keys: list[str]) -> DataFrame:
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        n, mean, co = _merged(pdf["n"].to_numpy(), np.stack(pdf["means"]), np.stack(pdf["co"]), int(first["pos"]))
        return pd.DataFrame({"model": [first["model"]], "pos": [first["pos"]], "column": [first["column"]],
                             "n": [n], "means": [mean.tolist()], "co": [co.tolist()]})

    return parts.groupBy("model", "pos", *keys).applyInPandas(merge, STATE)


def group_stats(df: DataFrame, groups: list[Group]) -> DataFrame:
    """Statistics (``STATE``) of several groups of columns in one pass over ``df``."""
    columns = list(dict.fromkeys(c for g in groups for c in g.columns))
    at = {c: i for i, c in enumerate(columns)}
    plans = [(g.model, g.columns, [at[c] for c in g.columns], [at[c] for c in g.required],
              np.array([g.fill.get(c, np.nan) for c in g.columns])) for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [None] * len(plans)
        for b in batches:
            if not b.num_rows:
                continue
            task = b.column(len(columns))[0].as_py()
            values = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(float)
                                      for i in range(len(columns))])
            known = np.isfinite(values)
            for k, (_, _, mine, required, fill) in enumerate(plans):
                rows = known[:, required].all(axis=1)
                z = np.where(known[rows][:, mine], values[rows][:, mine], fill)
                z = z[np.isfinite(z).all(axis=1)]
                if not len(z):
                    continue
                mean = z.mean(axis=0)
                away = z - mean
                n, co = float(len(z)), away.T @ away
                if held[k] is not None:
                    n0, mean0, co0 = held[k]
                    gap = mean - mean0
                    co = co0 + co + np.outer(gap, gap) * (n0 * n / (n0 + n))
                    mean, n = mean0 + gap * (n / (n0 + n)), n0 + n
                held[k] = (n, mean, co)
        for (model, names, _, _, _), stats in zip(plans, held):
            if stats is None:
                continue
            n, mean, co = stats
            m = len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([model] * m), pa.array(range(m), pa.int32()), pa.array(names), pa.array([n] * m),
                 pa.array([mean] * m, pa.list_(pa.float64())), pa.array(list(co), pa.list_(pa.float64())),
                 pa.array([task // MERGE_TASKS] * m, pa.int32())],
                names=["model", "pos", "column", "n", "means", "co", "part"])

    src = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)],
                    F.spark_partition_id().alias("task"))
    parts = src.mapInArrow(run, f"{STATE}, part int")
    return _combine(_combine(parts, ["part"]), [])


def gram_stats(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """Statistics of features and targets, one row per column (``STATE``).

    Rows with a NULL, NaN or infinite feature or target are left out (the
    reference drops them before fitting)."""
    columns = [*features, *targets]
    return group_stats(df, [Group("", columns, columns, {})])


def merge_stats(*stats: DataFrame) -> DataFrame:
    """M3: statistics of several batches merged into those of their union."""
    u = stats[0]
    for s in stats[1:]:
        u = u.unionByName(s)
    return _combine(u, [])


def solve(stats_rows, features: list[str], targets: list[str], ridge: float = 0.0) -> dict[str, dict[str, float]]:
    """Least squares (ridge on the slopes, intercept free) from the statistics.

    Columns are brought to unit scale for the solve; a column that does not
    vary gets the slope 0, and dependent columns share theirs (least norm)."""
    rows = sorted(stats_rows, key=lambda r: r["pos"])
    p = len(features)
    n = rows[0]["n"] if rows else 0.0
    if n <= 0:
        return {t: {INTERCEPT: None, **{f: None for f in features}} for t in targets}
    mean = np.array(rows[0]["means"])
    co = np.array([r["co"] for r in rows])
    mx, cxx = mean[:p], co[:p, :p]
    var = np.diag(cxx).copy() if p else np.zeros(0)
    still = var <= n * (1e-14 * np.abs(mx)) ** 2
    scale = np.where(still, 1.0, np.sqrt(np.where(still, 1.0, var + ridge)))
    a = (cxx + ridge * np.eye(p)) / np.outer(scale, scale)
    a[still, :] = a[:, still] = 0.0
    out = {}
    for k, t in enumerate(targets):
        cxy = np.where(still, 0.0, co[:p, p + k] / scale)
        beta = np.linalg.lstsq(a, cxy, rcond=None)[0] / scale if p else np.zeros(0)
        out[t] = {INTERCEPT: float(mean[p + k] - mx @ beta), **{f: float(b) for f, b in zip(features, beta)}}
    return out


def coefficients_frame(spark: SparkSession, coefs: dict[str, dict[str, float]]) -> DataFrame:
    """Model state as a table (target, term, coef)."""
    rows = [(t, term, v) for t, cs in coefs.items() for term, v in cs.items()]
    return spark.createDataFrame(rows, "target string, term string, coef double")


def fit_linear_multi(df: DataFrame, features: list[str], targets: list[str], ridge: float = 0.0):
    """M1: one least-squares model per target; returns (coefs, stats frame)."""
    stats = gram_stats(df, features, targets)
    return solve(stats.collect(), features, targets, ridge), stats


def partial_fit(stored: DataFrame, batch: DataFrame, features: list[str], targets: list[str], ridge: float = 0.0):
    """M3: add a batch's statistics to the stored ones and re-solve."""
    merged = merge_stats(stored, gram_stats(batch, features, targets))
    return solve(merged.collect(), features, targets, ridge), merged


def predict_linear(df: DataFrame, coefs: dict[str, dict[str, float]], prefix: str = "") -> DataFrame:
    """M4: one prediction column per target as a Column expression."""
    cols = {}
    for t, cs in coefs.items():
        e = F.lit(cs.get(INTERCEPT) or 0.0)
        for f, b in cs.items():
            if f != INTERCEPT:
                e = e + F.lit(b or 0.0) * F.col(f).cast("double")
        cols[f"{prefix}{t}"] = e
    return df.withColumns(cols)


def fit_sgd_budget(df: DataFrame, features: list[str], targets: list[str], iterations: int = 50,
                   learning_rate: float = 0.1, seconds: float | None = None):
    """M2: full-batch gradient steps on standardised features until the
    iteration budget (and optional wall-clock budget) ends.

    On standardised columns the mean squared error and its gradient depend on
    the data only through the covariances of the features with each other and
    with the targets, so the statistics of one pass (``gram_stats``) are all
    that is read; every step after it is exact arithmetic on those
    (p+1)-sized moments. Returns (coefs in original units, losses)."""
    import time

    rows = sorted(gram_stats(df, features, targets).collect(), key=lambda r: r["pos"])
    if not rows:
        return {t: {INTERCEPT: None, **{f: None for f in features}} for t in targets}, []
    p, columns = len(features), [*features, *targets]
    mean = dict(zip(columns, rows[0]["means"]))
    cov = np.array([r["co"] for r in rows]) / rows[0]["n"]
    # a constant column is divided by 1, as the scaler does
    spread = np.where(np.diag(cov) > 0, np.sqrt(np.diag(cov)), 1.0)
    scale = dict(zip(columns, spread))
    z = cov / np.outer(spread, spread)
    cz = z[:p, :p]  # E[z_a z_b]
    czy = {t: z[:p, p + k] for k, t in enumerate(targets)}  # E[z_a z_y]
    vzy = {t: z[p + k, p + k] for k, t in enumerate(targets)}  # E[z_y^2]
    w = {t: np.zeros(p + 1) for t in targets}
    losses = []
    start = time.time()
    for it in range(iterations):
        step = learning_rate / (it + 1) ** 0.25
        total = 0.0
        for t in targets:
            w0, wv = w[t][0], w[t][1:]
            # err = w0 + w.z - z_y, and every z has mean 0
            total += w0 * w0 + float(wv @ cz @ wv) - 2.0 * float(wv @ czy[t]) + vzy[t]
            grad = np.concatenate([[w0], cz @ wv - czy[t]])
            w[t] = w[t] - step * grad
        losses.append(total)
        if seconds is not None and time.time() - start > seconds:
            break
    coefs = {}
    for t in targets:
        slopes = {f: scale[t] * w[t][k + 1] / scale[f] for k, f in enumerate(features)}
        b0 = mean[t] + scale[t] * w[t][0] - sum(slopes[f] * mean[f] for f in features)
        coefs[t] = {INTERCEPT: float(b0), **{f: float(v) for f, v in slopes.items()}}
    return coefs, losses
