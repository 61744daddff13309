"""Fitted vocabularies and category tables: fit once, apply to other rows, any number of values."""
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from timefuse import session
from timefuse.operators import encode, text
from timefuse.session import scratch_path


def by_hand(fit, rows):
    tokens = lambda t: re.findall(r"\w{2,}", (t or "").lower())
    df = Counter(w for _, t in fit for w in set(tokens(t)))
    out = {}
    for i, t in rows:
        w = {k: n * (math.log((1 + len(fit)) / (1 + df[k])) + 1) for k, n in Counter(tokens(t)).items() if k in df}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out |= {(i, k): v / norm for k, v in w.items()}
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "é9", "x", "gamma_1", "ÜBER", "the", "THE", "_", "zz"]
    return [(i, rng.choice([None, "", "a b c"]) if rng.random() < .1 else rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(1, 30))))
            for i in range(n)]


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_vocabulary_of_other_rows(spark, most):
    fit, new = corpus(1), [(100 + i, t) for i, t in corpus(2)] + [(500, "unseen words only"), (501, "alpha " * 5000)]
    make = lambda rows: spark.createDataFrame(rows, "id long, t string").withColumns({"term": F.lit("clash"), "tf": F.lit(1)}).repartition(4)
    idf = text.tfidf_fit(make(fit), "t")
    got = {(r.id, r.term): r.weight for r in text.tfidf_transform(make(new), "id", "t", idf, most).collect()}
    want = by_hand(fit, new)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    own = {(r.id, r.term): r.weight for r in text.tfidf(make(fit), "id", "t").collect()}
    assert own == pytest.approx(by_hand(fit, fit))


def test_stored_vocabularies(spark):
    path = scratch_path(spark, "voc")
    assert text.tfidf_vocabulary(spark, path) is None
    for n in (5, 20):
        text.tfidf_fit(spark.createDataFrame(corpus(3, n), "id long, t string"), "t", path)
    got = {r.term: r.idf for r in text.tfidf_vocabulary(spark, path).collect()}
    assert got == {r.term: r.idf for r in text.tfidf_fit(spark.createDataFrame(corpus(3, 20), "id long, t string"), "t").collect()}
    assert text.tfidf_vocabulary(spark, path, 0).count() <= len(got) and text.tfidf_vocabulary(spark, path, 7) is None


def test_counts_move_once_and_text_never(spark):
    df = spark.createDataFrame(corpus(4), "id long, t string")
    idf = text.tfidf_fit(df, "t")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = text.tfidf_transform(df, "id", "t", idf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("most", [0, 1 << 30])
def test_many_categories_without_collect(spark, most, monkeypatch):
    monkeypatch.setattr(encode, "fitted_categories", None)
    df = spark.range(60_000).select("id", F.expr("if(id % 3 = 0, null, if(id % 3 = 1, 'hot', concat('v', id)))").alias("c"))
    table = encode.category_table(df.where("id < 50000"), "c")
    got = encode.category_codes(df, "c", "code", table, most).agg(
        F.count(F.when(F.col("c").isNull() & (F.col("code") == -1), 1)).alias("nulls"),
        F.count_distinct(F.when(F.col("code") >= 0, F.col("code"))).alias("codes"), F.count(F.when(F.col("code") == 0, 1)).alias("hot"),
        F.count(F.when(F.col("c").isNotNull() & (F.col("code") == -1), 1)).alias("unfitted")).first()
    assert (got.nulls, got.codes, got.hot, got.unfitted) == (20_000, 16_667, 20_000, 3334)
    hot = encode.one_hot_sparse(df, "c", table, "m", drop_first=True, broadcast_bytes=most)
    assert hot.where(F.size("m") > 0).count() == 16_666 and hot.where("m is null").count() == 0
    order = [r.value for r in table.orderBy("code").limit(3).collect()]
    assert order == sorted(order) and [r.code for r in table.orderBy("code").limit(3).collect()] == [0, 1, 2]


def test_dummies_are_bounded(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    assert len(encode.fitted_categories(df, "c", most=50)) == 50
    with pytest.raises(ValueError, match="one_hot_sparse"):
        encode.fitted_categories(df, "c", most=49)


def test_bytes_are_measured(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("é"), 1000).alias("t"), F.array(F.lit("abc")).alias("a"))
    assert 200_000 < session.table_bytes(df) < 220_000
    assert session.table_bytes(df.limit(0)) == 0
    assert not session.join_side(df, 100_000)[1] and session.join_side(df, 300_000)[1]
