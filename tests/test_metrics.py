import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import rows_of
from tillcast.operators import importance, metrics
from tillcast.operators.folds import stratified_folds


def scored(spark, scores, labels, folds=None):
    rows = [(i, y, f, float(s)) for i, (s, y, f) in enumerate(zip(scores, labels, folds or [0] * len(labels)))]
    return spark.createDataFrame(rows, "customer_id bigint, label int, fold int, probability double")


def brute(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    if not pos or not neg:
        return None
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    assert metrics.auc(scored(spark, [0.5, 0.5, 0.9, 0.1], [1, 0, 1, 0])).first()["auc"] == 0.875


cases = st.lists(st.tuples(st.integers(0, 12), st.booleans()), min_size=1, max_size=60)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(cases)
def test_auc_equals_pair_count(spark, data):
    scores, labels = [s / 7 for s, _ in data], [int(y) for _, y in data]
    want = brute(scores, labels)
    got = metrics.auc(scored(spark, scores, labels)).first()["auc"]
    moved = metrics.auc(scored(spark, [math.exp(5 * s) for s in scores], labels)).first()["auc"]
    assert got == moved == pytest.approx(want) if want is not None else got is None


def test_auc_over_many_ranges_and_folds(spark):
    n = 2000
    scores = [((i * 7919) % 1500) / 1500 for i in range(n)]
    labels = [int((i * 31) % 7 < 2) for i in range(n)]
    folds = [i % 3 for i in range(n)]
    df = scored(spark, scores, labels, folds)
    assert metrics.auc(df).first()["auc"] == pytest.approx(brute(scores, labels))
    per_fold = {
        f: brute([s for s, g in zip(scores, folds) if g == f], [y for y, g in zip(labels, folds) if g == f])
        for f in range(3)
    }
    for row in metrics.auc(df, by=["fold"]).collect():
        assert row["auc"] == pytest.approx(per_fold[row["fold"]])
    both = metrics.mean_fold_auc(df).first()
    assert both["mean_auc"] == pytest.approx(sum(per_fold.values()) / 3)
    assert both["oof_auc"] == pytest.approx(brute(scores, labels))


def test_threshold_is_strict(spark):
    df = scored(spark, [0.5, 0.6, 0.7], [1, 1, 0])
    assert rows_of(metrics.threshold_metrics(df)) == [(1, 1, 1, 0.5, 0.5, 0.5)]
    assert rows_of(metrics.threshold_metrics(df, threshold=0.9), "precision", "recall", "f1") == [
        (0.0, 0.0, 0.0)
    ]


def test_auc_of_many_ties_and_small_ranges(spark):
    scores = [0.5] * 990 + [i / 1000 for i in range(100)]
    labels = [i % 3 == 0 for i in range(990)] + [i % 2 for i in range(100)]
    table = scored(spark, scores, [int(x) for x in labels])
    one = metrics.auc(table).first()["auc"]
    assert abs(metrics.auc(table, pieces=7).first()["auc"] - one) < 1e-12


def test_blend_keeps_a_customer_that_one_member_lacks(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.5)], "customer_id long, probability double")
    got = metrics.blend({"a": (a, 0.4), "b": (a.limit(0).union(a.where("customer_id = 1")), 0.6)})
    assert rows_of(got) == [(1, 0.5), (2, None)]


def test_blend_matches_by_key(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "customer_id int, probability double")
    b = spark.createDataFrame([(2, 0.9), (1, 0.5)], "customer_id int, probability double")
    got = dict(rows_of(metrics.blend({"a": (a, 0.4), "b": (b, 0.6)})))
    assert got == pytest.approx({1: 0.34, 2: 0.62})


def test_folds_are_balanced_and_reproducible(spark):
    df = spark.createDataFrame([(i, int(i < 23)) for i in range(100)], "customer_id int, label int")
    folds = stratified_folds(df, 10, seed=3)
    for label in (0, 1):
        sizes = [r["count"] for r in folds.where(f"label = {label}").groupBy("fold").count().collect()]
        assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1
    assert rows_of(folds) == rows_of(stratified_folds(df.repartition(7), 10, seed=3))
    assert rows_of(folds) != rows_of(stratified_folds(df, 10, seed=4))


def test_importance_table(spark):
    rows = [(f"f{i:02d}", k, float(i + k)) for i in range(30) for k in range(2)]
    df = spark.createDataFrame(rows, "feature string, fold int, importance double")
    table = importance.ranked(importance.mean_importance(df), 20).collect()
    assert len(table) == 20 and table[0]["feature"] == "f29"
    total = sum(i + 0.5 for i in range(30))
    assert table[1]["cumulative_importance"] == pytest.approx((29.5 + 28.5) / total)
    assert importance.in_all_folds(df).select("feature").distinct().count() == 29
