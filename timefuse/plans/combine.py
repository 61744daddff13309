"""Load and combine the three source trees.

Base series (hourly rows) <- daily means of the event log <- daily means of
each whitelisted event category (one row per day, columns prefixed by
category), then the profile decisions: sparse numeric features and thin
targets are dropped, and target correlations are reported.

Every file is read by its own header (``scan.read_csv_by_header``). Each tree,
and the combined table, is parsed once and written as Parquet, so the profile
passes read columns and not text. A category without files adds nothing; a
file that cannot be read is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeparse as tp
from ..operators import align, filters, profile, schema
from ..session import written
from ..sources import scan


@dataclass
class Combined:
    data: DataFrame
    numeric: list[str]
    targets: list[str]
    correlations: DataFrame
    thin_targets: DataFrame


def _prepare(spark: SparkSession, df: DataFrame | None, name: str) -> DataFrame | None:
    """Rename to the standard vocabulary (first of colliding columns wins),
    parse the time key, drop rows without one, and write the result."""
    if df is None:
        return None
    df = schema.rename_columns(df.drop("source_path", "source_file"))
    if "UTC_DATE" not in df.columns:
        return None
    df = df.withColumn("UTC_DATE", F.col("UTC_DATE").cast("string"))
    return written(spark, tp.standardize_time(df, "UTC_DATE", "ts").drop("UTC_DATE"), name)


def load_and_combine(spark: SparkSession, base_dir: str, events_dir: str | None = None,
                     category_dir: str | None = None, targets: list[str] | None = None,
                     categories: list[str] | None = None, base_schema=None,
                     events_glob: str = "*_events_*.csv") -> Combined:
    """M12. ``base_schema`` (a saved StructType/DDL) skips schema inference on
    the base tree; the other trees infer once per schema group."""
    targets = schema.REFERENCE_TARGETS if targets is None else targets
    categories = align.REFERENCE_CATEGORIES if categories is None else categories

    base = _prepare(spark, scan.read_csv_by_header(spark, base_dir, schema=base_schema), "base-series")
    if base is None:
        raise ValueError("base series has no time column")

    sources = []
    if events_dir:
        ev = _prepare(spark, scan.read_csv_by_header(spark, events_dir, events_glob), "events")
        if ev is not None:
            sources.append(("space", align.daily_mean(ev)))
    if category_dir:
        parts = []
        for cat in categories:
            p = _prepare(spark, scan.read_csv_by_header(spark, category_dir, f"{cat}-*.csv"), f"category-{cat}")
            if p is not None:
                parts.append(p.withColumn("category", F.lit(cat)))
        if parts:
            cat_df = scan.union_widened(parts)
            nums = schema.numeric_columns(cat_df, exclude=("ts",))
            daily = align.daily_mean_by_category(cat_df, "category", cols=nums, allowed=categories)
            # one row per day, one column per (category, measure)
            if nums:
                wide = daily.groupBy("ts").pivot("category", categories) \
                            .agg(*[F.first(c).alias(c) for c in nums])
                if len(nums) == 1:
                    wide = wide.withColumnsRenamed({c: f"{c}_{nums[0]}" for c in categories if c in wide.columns})
                sources.append(("near_earth", wide))

    combined = base
    for name, daily in sources:
        combined = align.align_left_join(combined, daily, name)

    combined = written(spark, combined, "combined")
    numeric = schema.numeric_columns(combined, exclude=("ts",))
    present_targets = [t for t in targets if t in combined.columns]
    feats = [c for c in numeric if c not in present_targets]
    combined = filters.drop_sparse_columns(combined, feats)
    feats = [c for c in feats if c in combined.columns]
    thin = filters.thin_targets(combined, present_targets) if present_targets else None
    if thin is not None:
        drop = [r.target for r in thin.where(~F.col("kept")).collect()]
        combined = combined.drop(*drop)
        present_targets = [t for t in present_targets if t not in drop]
    num_targets = [t for t in present_targets if t in schema.numeric_columns(combined)]
    corr = profile.rank_correlations(profile.target_correlations(combined, num_targets, feats)) \
        if num_targets else spark.createDataFrame([], "target string, column_name string, corr double, rank int")
    return Combined(combined, feats, present_targets, corr, thin)
