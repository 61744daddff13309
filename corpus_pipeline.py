"""A corpus pipeline: quality rules, near-duplicates, decontamination, tokens.

Each stage works on all that the one before kept; its result is written as
Parquet into the shared folder and read again. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timefuse.llm import host_rules, simhash, tiling
from timefuse.llm.common import written
from timefuse.llm.queries import encoded
from timefuse.tables import load


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected, with
    their own values in columns that are named like the verdict's."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in host_rules.ADDED}
    judged = host_rules.with_verdicts(spark, docs.withColumnsRenamed(own))
    return judged.filter("kept").select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash.keep_one(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reproduce no benchmark item."""
    return tiling.clean(spark, docs, load(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of their decoding."""
    return encoded(docs)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup),
          ("decontamination", decontaminate), ("byte_bpe", tokenize)]

#: SQL cannot express token ids or string tiling; tests hold the rows against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(spark, docs, name)
    return docs
