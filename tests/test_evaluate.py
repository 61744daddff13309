"""AUC per class and target, RMSE and R2, against pairs counted one by one."""
import random

import pytest

from timefuse.operators import evaluate


def pair_auc(rows, positive):
    p = [s for y, s in rows if y == positive]
    n = [s for y, s in rows if y != positive]
    return sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n)) if p and n else None


def table(spark, seed=0, n=120):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        data.append((rng.choice(["u", "v", "w", None]), rng.choice([0, 1, 2, 10, None]), rng.choice([0, 1]), 7, rng.random(),
                     rng.choice([None, float("nan"), *map(float, range(8))]), rng.choice([0.5, 1.5, rng.random()])))
    return data, spark.createDataFrame(data, "t string, k int, b int, one int, y double, s double, q double")


@pytest.mark.parametrize("seed", range(3))
def test_every_class_against_the_others(spark, seed):
    data, df = table(spark, seed)
    got = {(r.target, r["class"]): (r.auc, r.n_pos, r.n_neg) for r in evaluate.class_aucs(df, {"t": "s", "k": "q", "one": "s"}).collect()}
    for target, at, score in (("t", 0, 5), ("k", 1, 6), ("one", 3, 5)):
        rows = [(r[at], r[score]) for r in data if r[at] is not None and r[score] is not None and r[score] == r[score]]
        for c in {y for y, _ in rows}:
            auc, pos, neg = got.pop((target, str(c)))
            assert auc == (None if pair_auc(rows, c) is None else pytest.approx(pair_auc(rows, c)))
            assert pos == sum(y == c for y, _ in rows) and neg == len(rows) - pos
    assert not got


def test_targets_against_their_own_scores(spark):
    data, df = table(spark, 4)
    got = {r.target: (r.n_classes, r.auc) for r in evaluate.target_aucs(df, {"b": "q", "k": "q", "one": "s"}).collect()}
    kq = [(r[1], r[6]) for r in data if r[1] is not None]
    assert got["b"] == (2, pytest.approx(pair_auc([(r[2], r[6]) for r in data], 1)))
    assert got["k"] == (4, pytest.approx(sum(pair_auc(kq, c) for c in (0, 1, 2, 10)) / 4))
    assert got["one"] == (1, None)
    ovr = evaluate.roc_auc_ovr(df, "k", "q").first().auc
    assert ovr == pytest.approx(got["k"][1])


def test_two_classes_take_the_larger_by_number(spark):
    df = spark.createDataFrame([(2, 1.0), (10, 2.0), (10, 3.0), (2, 0.0)], "y int, s double")
    assert evaluate.target_aucs(df, {"y": "s"}).first().auc == 1.0


def test_errors_of_continuous_targets(spark):
    data, df = table(spark, 6)
    r = {x.target: x for x in evaluate.evaluate_model(df, {"y": "q", "k": "q", "t": "s", "one": "s"}, ["t"]).collect()}
    pairs = [(x[4], x[6]) for x in data]
    mean = sum(y for y, _ in pairs) / len(pairs)
    sse = sum((y - p) ** 2 for y, p in pairs)
    assert r["y"].rmse == pytest.approx((sse / len(pairs)) ** .5)
    assert r["y"].r2 == pytest.approx(1 - sse / sum((y - mean) ** 2 for y, _ in pairs))
    assert r["one"].r2 is None and r["y"].auc is None and r["t"].rmse is None and r["t"].n_classes == 3


def test_empty_input(spark):
    _, df = table(spark)
    none = df.limit(0)
    assert [tuple(x) for x in evaluate.target_aucs(none, {"b": "q"}).collect()] == [("b", 0, None)]
    assert evaluate.roc_auc(none, "b", "q").first().auc is None
    assert evaluate.roc_auc_ovr(none, "b", "q").first().auc is None
    assert evaluate.evaluate_model(none, {"b": "q"}, ["b"]).first().rmse is None
