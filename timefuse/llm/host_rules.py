"""Quality rules with host verdicts, in built-in functions only.

Base rules are array expressions over each whole text. Failures are counted per
host, the host's failure rate is shrunk with a beta prior fitted to all hosts
by moments, and the verdict of each host is joined back to its documents.

Defined results: null text counts as empty (and fails the base rules); a null
host is a host of its own; an empty table gives an empty result; repeated rows
are judged and counted one by one; columns of the input that carry the name of
a result column are replaced by it; ``with_verdicts`` keeps every other column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, let, text_or_empty, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: a host is rejected when its shrunk failure rate exceeds this
HOST_FAIL_RATE = 0.8
#: prior strength (in documents) where the hosts' rates give no estimate
DEFAULT_STRENGTH = 10.0
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: all columns that ``with_verdicts`` adds
ADDED = [*MEASURES, "base_failed", "host_rate", "host_rejected", "kept"]


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs at least twice, from the hash of each window start."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        same = F.filter(s, lambda e, j: (
            ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == e["h"]))
            | ((j < last) & (F.get(s, F.least(j + 1, last))["h"] == e["h"]))))
        return F.sort_array(F.transform(same, lambda e: e["i"]))

    first = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(
        let(pairs, starts), first,
        lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n")),
        lambda a: a["n"])


def _repeat_words(words: Column, n: Column) -> Column:
    def window_hash(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])

    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), window_hash)
    # most texts repeat no window: one hash set tells, and only the others are sorted
    repeat = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint"))
                 .otherwise(_covered(h)))
    return F.when(n > WINDOW, repeat).otherwise(F.lit(0).cast("bigint"))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the five measures of each whole text and ``base_failed``.

    Repeated windows are found by the 64-bit hash of the five words (a chance
    collision inside one text has probability n^2 / 2^65).
    """
    t = text_or_empty(text)
    trimmed = F.btrim(t, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    from_words = let(words, lambda w: F.struct(
        F.size(w).cast("bigint").alias("n"), _repeat_words(w, F.size(w)).alias("r")))
    dups = let(F.filter(F.split(t, "\n"), lambda x: F.translate(x, WHITE, "") != ""),
               lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = df.drop(*[c for c in [*MEASURES, "base_failed"] if c in df.columns]).withColumn("__w", from_words)
    out = out.withColumns({
        "n_words": F.col("__w.n"),
        "word_chars": F.length(F.translate(t, WHITE, "")).cast("bigint"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": dups.cast("bigint"),
        "n_repeat_words": F.col("__w.r"),
    }).drop("__w")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(judged: DataFrame, host: str = "source", max_rate: float = HOST_FAIL_RATE) -> DataFrame:
    """One row per host: documents, failures, the rate shrunk by the empirical
    beta prior, and ``host_rejected``.

    The prior's mean and strength come from the mean and variance of all hosts'
    raw rates (method of moments); where these give none (one host, or equal
    rates) the strength is ``DEFAULT_STRENGTH`` documents.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("bigint")).alias("failed"))
    rate = F.col("failed") / F.col("docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"))
    strength = F.when((F.col("v") > 0) & (F.col("m") * (1 - F.col("m")) > F.col("v")),
                      F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(DEFAULT_STRENGTH))
    prior = prior.select(F.struct((F.col("m") * strength).alias("alpha"), strength.alias("strength")).alias("p"))
    p = prior.scalar()
    shrunk = (F.col("failed") + p["alpha"]) / (F.col("docs") + p["strength"])
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", shrunk > max_rate)


def with_verdicts(spark: SparkSession, df: DataFrame, text: str = "text", host: str = "source",
                  extra: list[str] | None = None) -> DataFrame:
    """Measures, host verdict and ``kept`` of every row; ``extra`` names the
    input columns to carry (all by default).

    The measured rows are written once, so the host aggregate and the result
    do not compute them twice. The verdict table is written too, so its size is
    known when the join is planned: it is broadcast while small, and the rows do
    not move; beyond that both sides are shuffled and AQE splits a hot host.
    """
    carried = [c for c in (df.columns if extra is None else extra)]
    carried = [c for c in dict.fromkeys([*carried, host]) if c not in (*MEASURES, "base_failed")]
    judged = written(spark, measures(df, text).select(*carried, *MEASURES, "base_failed"), "measures")
    verdicts = written(spark, host_verdicts(judged, host).select(
        F.col("host").alias("__host"), "host_rate", "host_rejected"), "verdicts")
    out = judged.drop("host_rate", "host_rejected", "kept")
    out = out.join(verdicts, F.col(host).eqNullSafe(F.col("__host")), "left").drop("__host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
