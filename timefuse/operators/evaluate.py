"""Evaluation: exact ROC AUC of any number of targets and classes, RMSE and R2.

All targets go through one plan. Rows are counted by (target, class, score);
the ranks of the scores are taken within each target by one ordered scan over
ranges of the score, with the counts of lower ranges carried per target
(``plans.ordered.segment_ranks``). The AUC of a class against the others then
is its rank sum, so no class is a job of its own and no list of classes
reaches the driver. Ties count one half. A class without a positive or a
negative row has the AUC NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import segment_ranks
from ..session import written


def _known(c: Column) -> Column:
    """A double with NaN as unknown."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def class_aucs(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """``target, class, auc, n_pos, n_neg`` for every class of every target
    against the others, each target by its own score column. ``class`` is the
    label as text; rows with an unknown label or score are left out."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(f"`{t}`").cast("string").alias("class"), _known(F.col(f"`{s}`")).alias("score"))
        for t, s in pairs.items()])).alias("x")).select("x.*").where("class is not null and score is not null")
    counts = written(df.sparkSession, long.groupBy("target", "class", "score").agg(F.count(F.lit(1)).alias("n")), "score-counts")
    ranked = segment_ranks(counts, "target", "score", "n")
    by_class = ranked.groupBy("target", "class").agg(F.sum("n").alias("n_pos"), F.sum(F.col("n") * F.col("rank")).alias("_r"))
    totals = counts.groupBy("target").agg(F.sum("n").alias("_all"))  # one row a target
    p, q = F.col("n_pos").cast("double"), (F.col("_all") - F.col("n_pos")).cast("double")
    return by_class.join(F.broadcast(totals), "target").select(
        "target", "class", ((F.col("_r") - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0.0))).alias("auc"), "n_pos",
        (F.col("_all") - F.col("n_pos")).alias("n_neg"))


def target_aucs(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """``target, n_classes, auc`` of every target against its own score:
    of two classes the AUC of the larger one (by number if both are numbers),
    of more the mean over the classes, each against the others."""
    c = class_aucs(df, pairs)
    order = F.struct(F.expr("try_cast(class as double)").alias("v"), F.col("class").alias("c"))
    out = c.groupBy("target").agg(F.count(F.lit(1)).alias("n_classes"), F.avg("auc").alias("_macro"),
                                  F.max_by("auc", order).alias("_larger"))
    have = out.select("target", "n_classes", F.when(F.col("n_classes") <= 2, F.col("_larger")).otherwise(F.col("_macro")).alias("auc"))
    names = df.sparkSession.createDataFrame([(t,) for t in pairs], "target string")  # a target without a row stays
    return names.join(have, "target", "left").select("target", F.coalesce("n_classes", F.lit(0)).alias("n_classes"), "auc")


def roc_auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """M9 (binary): one row with ``auc``, ``n_pos``, ``n_neg``."""
    marked = df.select((F.col(f"`{label}`") == F.lit(positive)).cast("int").alias("y"), F.col(f"`{score}`").alias("s"))
    one = class_aucs(marked, {"y": "s"}).groupBy().agg(
        F.max(F.when(F.col("class") == "1", F.col("auc"))).alias("auc"),
        F.max(F.when(F.col("class") == "1", F.col("n_pos")).otherwise(F.col("n_neg"))).alias("n_pos"),
        F.max(F.when(F.col("class") == "0", F.col("n_pos")).otherwise(F.col("n_neg"))).alias("n_neg"))
    return one


def roc_auc_ovr(df: DataFrame, label: str, score: str) -> DataFrame:
    """M9 for more than two classes: one-vs-rest per class, then the macro mean."""
    return class_aucs(df, {label: score}).agg(F.avg("auc").alias("auc"))


def auc_by_target(df: DataFrame, targets: list[str], score: str | dict[str, str]) -> DataFrame:
    """(target, auc) for several label columns, each against its own score
    column or all against one."""
    pairs = score if isinstance(score, dict) else {t: score for t in targets}
    return target_aucs(df, {t: pairs[t] for t in targets}).select("target", "auc")


def regression_errors(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """``target, n, rmse, r2`` of continuous targets against their predictions,
    over the rows where both are known, from one aggregate. The R2 of a target
    that does not vary is NULL."""
    known = {t: (_known(F.col(f"`{t}`")), _known(F.col(f"`{p}`"))) for t, p in pairs.items()}
    aggs = []
    for i, (y, p) in enumerate(known.values()):
        both = F.when(p.isNotNull(), y)
        aggs += [F.count(both + p).alias(f"n{i}"), F.avg((y - p) * (y - p)).alias(f"e{i}"), F.var_pop(both).alias(f"v{i}")]
    rows = [F.struct(F.lit(t).alias("target"), F.col(f"n{i}").alias("n"), F.sqrt(f"e{i}").alias("rmse"),
                     (1 - F.col(f"e{i}") / F.nullif(F.col(f"v{i}"), F.lit(0.0))).alias("r2")) for i, t in enumerate(pairs)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def evaluate_model(df: DataFrame, pairs: dict[str, str], classes: list[str]) -> DataFrame:
    """M9 for a whole model: one row for each target and its prediction. Targets
    in ``classes`` get an AUC, those with numbers RMSE and R2 (a class coded as
    a number gets both)."""
    numeric = {t: p for t, p in pairs.items() if df.schema[t].dataType.simpleString() != "string"}
    names = df.sparkSession.createDataFrame([(t,) for t in pairs], "target string")
    labelled = {t: pairs[t] for t in pairs if t in classes}
    empty = "target string, n bigint, rmse double, r2 double"
    errors = regression_errors(df, numeric) if numeric else df.sparkSession.createDataFrame([], empty)
    aucs = target_aucs(df, labelled) if labelled else df.sparkSession.createDataFrame([], "target string, n_classes bigint, auc double")
    return names.join(errors, "target", "left").join(aucs, "target", "left") \
        .select("target", "n_classes", "auc", "rmse", "r2")
