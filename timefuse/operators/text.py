"""TF-IDF of a text column (E1), fitted once and applied to any rows, long form.

Tokens: lower-cased runs of two or more word characters (letters, digits,
underscore). Weight: raw count x (ln((1 + n) / (1 + df)) + 1), then L2
normalised per row. The result stays long - (id, term, weight) - and is
never pivoted into one column per word, so its width does not grow with the
vocabulary.

A row's terms are counted inside the row (its tokens sorted, then the places
where one ends), so a text is tokenised once, where it is read, and neither the
text nor its tokens are shuffled. The fitted vocabulary is a table ``term, idf``
that can be stored as a version in shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, join_side, written
from ..sources.models import TableLog

# Fixed value: the token rule (two or more word characters, Unicode aware).
TOKEN_REGEX = r"[\p{L}\p{N}_]{2,}"


def token_array(text_col: str):
    """The tokens of a text as one array (lower case, in text order)."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TOKEN_REGEX), 0)


def counted_terms(text_col: str):
    """The distinct terms of a text with their counts: an array of (term, tf)."""
    def let(value, body):
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def runs(t):
        n = F.size(t)
        return let(F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | (F.get(t, i) != F.get(t, i + 1))),
                   lambda ends: F.transform(ends, lambda e, k: F.struct(
                       F.get(t, e).alias("term"), (e - F.coalesce(F.get(ends, k - 1), F.lit(-1))).cast("bigint").alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return let(F.sort_array(token_array(text_col)), lambda t: F.when(F.size(t) > 0, runs(t)).otherwise(none))


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, terms``: each row's distinct terms with their counts."""
    return df.select(id_col, counted_terms(text_col).alias("terms"))


def idf_table(counts: DataFrame) -> DataFrame:
    """``term, idf`` of counted rows (``term_counts``); one aggregate, hot terms are combined before its shuffle."""
    n = counts.count()
    per_row = counts.select(F.explode(F.transform("terms", lambda t: t["term"])).alias("term"))
    return per_row.groupBy("term").agg(F.count(F.lit(1)).alias("df")) \
        .select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, id_col: str, idf: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``id_col, term, weight`` of counted rows by a written vocabulary; terms
    that it does not have count for nothing. A vocabulary of bounded bytes is
    broadcast: then the counted rows move once, by id, as the norm needs them,
    and still one row a document. A larger one is joined by shuffle (AQE splits
    hot terms)."""
    right, small = join_side(idf, broadcast_bytes)
    if small:
        counts = counts.repartition(id_col)
    w = counts.select(id_col, F.explode("terms").alias("t")).select(id_col, "t.term", "t.tf") \
        .join(right, "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", (F.col("w") / norm).alias("weight"))


def tfidf_fit(df: DataFrame, text_col: str, path: str | None = None) -> DataFrame:
    """The vocabulary ``term, idf`` of a text column, written; with ``path`` as
    the next version there (``tfidf_vocabulary`` reads it back)."""
    spark = df.sparkSession
    idf = idf_table(written(spark, df.select(counted_terms(text_col).alias("terms")), "term-counts"))
    return written(spark, idf, "idf") if path is None else TableLog(spark, path).publish(idf)


def tfidf_vocabulary(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A stored vocabulary, the newest by default; None if there is none."""
    return TableLog(spark, path).load(version)


def tfidf_transform(df: DataFrame, id_col: str, text_col: str, idf: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """E1 for rows of any kind, new ones too, by a fitted vocabulary: ``id_col, term, weight``."""
    return weights(term_counts(df, id_col, text_col), id_col, idf, broadcast_bytes)


def tfidf(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Fit and transform of the same rows, from one written table of their
    term counts; each row is one document and ``id_col`` names it."""
    spark = df.sparkSession
    counts = written(spark, term_counts(df, id_col, text_col), "term-counts")
    return weights(counts, id_col, written(spark, idf_table(counts), "idf"))
