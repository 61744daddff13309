"""Filling and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import fill_ordered
from .linear import INTERCEPT, Group, group_stats, solve
from .profile import column_means, mode_values
from .schema import add_default_columns, numeric_columns, string_columns


def forward_fill(df: DataFrame, cols: list[str], order_by: list[str]) -> DataFrame:
    """Last non-null value so far in the order of ``order_by``."""
    return fill_ordered(df, cols, order_by, "forward")


def backward_fill(df: DataFrame, cols: list[str], order_by: list[str]) -> DataFrame:
    """Next non-null value in the order of ``order_by``."""
    return fill_ordered(df, cols, order_by, "backward")


def fill_both(df: DataFrame, cols: list[str], order_by: list[str]) -> DataFrame:
    """Forward fill, then backward fill for the leading gap."""
    return fill_ordered(df, cols, order_by, "both")


def impute_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL -> column mean (one aggregate; the one-row result is inlined)."""
    means = column_means(df, cols).first()  # one row
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c]).cast("double")) for c in cols})


def impute_mode(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL category -> most frequent value (ties -> smallest), all columns from one aggregate."""
    modes = {r["column_name"]: r["mode"] for r in mode_values(df, cols).collect()} if cols else {}  # one row per column
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m).cast(df.schema[c].dataType)) for c, m in modes.items()})


#: values (columns squared, over the models of one pass) that a task holds for I1
MODEL_CELLS = 1 << 24


def _value(c: str):
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


def fit_imputer(df: DataFrame, cols: list[str], predictors: list[str] | None = None) -> dict:
    """I1 as a fitted state: ``means`` of the columns with any known value, and
    in ``models`` the regression of each column that has unknown cells on the
    other predictors (their unknown cells read as their mean), fitted on the
    rows where the column is known.

    One aggregate gives the means and the columns that need a model at all, and
    one pass the statistics of all models (a further pass for each
    ``MODEL_CELLS`` values of them)."""
    pool = predictors if predictors is not None else numeric_columns(df)
    names = list(dict.fromkeys([*cols, *pool]))
    if not names:
        return {"means": {}, "models": {}}
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(_value(c)).alias(f"m{i}") for i, c in enumerate(names)],
               *[F.count(_value(c)).alias(f"k{i}") for i, c in enumerate(names)]).first()
    means = {c: r[f"m{i}"] for i, c in enumerate(names) if r[f"k{i}"]}
    wanted = [c for i, c in enumerate(names) if c in cols and 0 < r[f"k{i}"] < r["n"]]
    usable = [p for p in pool if p in means]
    groups = [Group(c, [*[p for p in usable if p != c], c], [c], {p: means[p] for p in usable if p != c}) for c in wanted]
    block, models = max(1, MODEL_CELLS // (len(usable) + 1) ** 2), {}
    for i in range(0, len(groups), block):
        rows = group_stats(df, groups[i:i + block]).collect()  # model size
        for g in groups[i:i + block]:
            models[g.model] = solve([x for x in rows if x["model"] == g.model], g.columns[:-1], [g.model])[g.model]
    return {"means": means, "models": models}


def apply_imputer(df: DataFrame, state: dict, cols: list[str]) -> DataFrame:
    """Unknown cells of ``cols`` by the fitted models, else by the fitted means;
    expressions alone, no data is looked at. Columns without any known value stay."""
    means, filled = state["means"], {}
    for c in cols:
        if c in state["models"]:
            e = F.lit(state["models"][c][INTERCEPT])
            for p, b in state["models"][c].items():
                if p != INTERCEPT:
                    e = e + F.lit(b) * F.coalesce(_value(p) if p in df.columns else F.lit(None).cast("double"), F.lit(means[p]))
            filled[c] = F.coalesce(_value(c), e)
        elif c in means:
            filled[c] = F.coalesce(_value(c), F.lit(means[c]).cast("double"))
    return df.withColumns(filled)


def impute_regression(df: DataFrame, cols: list[str], predictors: list[str] | None = None) -> DataFrame:
    """NULL numeric cells predicted by a regression on the other numeric
    columns (their NULLs read as their mean), fitted on the rows where the
    column is known; columns without any known value are left as they are."""
    state = fit_imputer(df, cols, predictors)
    if not state["models"]:
        return df.withColumns({c: F.col(f"`{c}`").cast("double") for c in cols if c in state["means"]})
    return apply_imputer(df, state, cols)


def fill_missing_columns(df: DataFrame, numeric: list[str], categorical: list[str],
                         targets: list[str]) -> DataFrame:
    """I4: absent features get defaults (numeric 0, categorical 'missing');
    present numeric features with NULLs are regression-filled from the other
    numeric features; present categorical ones take their mode. Targets are
    neither filled nor used as predictors."""
    out = add_default_columns(df, numeric, categorical)
    num = [c for c in numeric if c in df.columns and c not in targets]
    cat = [c for c in categorical if c in df.columns and c not in targets]
    if num:
        out = impute_regression(out, num, predictors=num)
    if cat:
        out = impute_mode(out, cat)
    return out


__all__ = ["forward_fill", "backward_fill", "fill_both", "impute_mean", "impute_mode",
           "impute_regression", "fill_missing_columns", "numeric_columns", "string_columns"]
