import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from helpers import log_of, rows_of
from tillcast.__main__ import main
from tillcast.plans import features as sets
from tillcast.plans import jobs
from tillcast.operators.metrics import auc
from tillcast.plans.training import FOLDS_AT_ONCE, assemble, best_round, boosted_trees, few_tasks, fit, out_of_fold
from tillcast.plans.training import models_at_once, naive_bayes, random_forest, score
from tillcast.session import materialise, settings, shared_folder
from tillcast.sources import log, sinks
from tillcast.sources.starschema import ORDER

QUICK = {"forest": (random_forest(3, 3), 0.4), "trees": (boosted_trees(2, 2), 0.6)}


@pytest.fixture(scope="module")
def data(spark, lines):
    return jobs.prepare_month(lines, "2001-07", "mode", threshold=200000)


def test_out_of_fold(spark, data):
    train, test = data.folds(2), data.vectors(data.test)
    got = out_of_fold(train, test, data.features, boosted_trees(2, 2, early_stop=0.01), 2)
    assert rows_of(got.oof, "customer_id") == rows_of(data.train, "customer_id")
    assert rows_of(got.test, "customer_id") == rows_of(data.test, "customer_id")
    both = got.oof.select("probability").union(got.test.select("probability"))
    assert both.where("probability not between 0 and 1").count() == 0
    assert got.importance.count() == 2 * len(data.features)


def test_score_month_covers_the_keys(spark, lines):
    keys = spark.createDataFrame([(1,), (2,), (10**9,)], "customer_id bigint")
    got = jobs.score_month(
        lines, "2001-07", "nunique", QUICK, folds=2, keys=keys, threshold=200000
    )
    scores = dict(rows_of(got))
    assert scores[10**9] is None and 0 <= scores[1] <= 1


def test_search_by_halving(spark, data):
    search = jobs.random_search(data, trials=5, trees=3, folds=2).collect()
    rungs = {}
    for r in search:
        rungs.setdefault(r["rung"], []).append(r)
    assert {k: (len(v), v[0]["trees"], v[0]["folds"]) for k, v in rungs.items()} == {
        0: (5, 2, 1), 1: (3, 3, 1), 2: (2, 3, 2),
    }
    for k, rows in rungs.items():
        kept = {r["trial"] for r in rows if r["kept"]}
        best = sorted(rows, key=lambda r: (-r["auc"], r["trial"]))[: len(kept)]
        assert kept == {r["trial"] for r in best}
        assert kept == ({r["trial"] for r in rungs[k + 1]} if k < 2 else kept) and all(0 <= r["auc"] <= 1 for r in rows)
    assert jobs.rung_plan(50, 20, 10) == [(50, 2, 1), (25, 4, 1), (13, 8, 2), (7, 16, 2), (4, 20, 3), (2, 20, 10)]


def test_search_scores_as_single_fits_do(spark, data):
    """The last rung's figure is the out-of-fold AUC of a training with these parameters."""
    search = jobs.random_search(data, trials=2, trees=2, folds=2, seed=3)
    row = search.where("kept").first()
    drawn = jobs.best_parameters(search)
    kinds = {"depth": int, "bins": int, "min_rows": int, "row_share": float, "step": float, "feature_share": str}
    learner = boosted_trees(trees=2, **{k: kinds[k](v) for k, v in drawn.items()})
    got = out_of_fold(data.folds(2, 3), data.vectors(data.test), data.features, learner, 2, 3)
    assert auc(got.oof).first()["auc"] == pytest.approx(row["auc"])


def test_selection(spark, data):
    assert len(jobs.select_univariate(data, n=1)) == 1
    names = jobs.select_features(data, n=1, learner=random_forest(2, 2), folds=2)
    assert len(names) == 1 and names[0] in data.features
    assert jobs.select_subset(data, n=2, folds=2).count() >= 1


def test_patience():
    assert best_round([5, 4, 3, 3.5, 2], 2) == (5, 5)
    assert best_round([5, 4, 3, 3.5, 3.4, 2], 2) == (3, 5)
    assert best_round([1, 1, 1, 0], 2) == (1, 3)
    assert best_round([2], 1) == (1, 1)


def test_models_are_cut_to_the_best_round(spark, data):
    train, test = data.folds(2), data.vectors(data.test)
    learner = boosted_trees(8, 2, step=0.9, patience=2)
    got = out_of_fold(train, test, data.features, learner, 2)
    rounds = got.rounds.collect()
    for k, model in enumerate(got.models):
        losses = [r["loss"] for r in sorted((r for r in rounds if r["fold"] == k), key=lambda r: r["round"])]
        best, last = best_round(losses, 2)
        assert model.getNumTrees == best and len(losses) == last
        # The same as fewer rounds from the start.
        short = fit(boosted_trees(best, 2, step=0.9), train.where(f"fold <> {k}"), 0)
        valid = train.where(f"fold = {k}")
        one, two = (rows_of(score(valid, m, "p"), "customer_id", "p") for m in (model, short))
        assert one == two


def test_categories_are_split_as_sets(spark):
    """Codes whose classes alternate: one split by a set tells them apart, thresholds would not."""
    rows = [(i, int(i % 8 in (1, 4, 6)), float(i % 8), float(i % 3)) for i in range(160)]
    frame = spark.createDataFrame(rows, "customer_id long, label int, code double, x double")
    names, counts = ["code", "x"], {"code": 8}
    vectors = materialise(assemble(frame, names, counts))
    model = fit(boosted_trees(1, 1, row_share=1.0, feature_share="all"), vectors, 0)
    assert "feature 0 in {" in model.toDebugString
    assert score(vectors, model, "p").where("label <> cast(p > 0.5 as int)").count() == 0
    many = fit(boosted_trees(1, 2, bins=4), vectors, 0)
    assert many.getOrDefault("maxBins") == 9
    odd = spark.createDataFrame([(1, 0, 99.0, 1.0), (2, 0, None, 1.0), (3, 0, 1.5, 1.0)], frame.schema)
    found = assemble(odd, names, counts).collect()
    assert [r["features"][0] for r in found] == [8.0, 8.0, 8.0]
    assert score(assemble(odd, names, counts), model, "p").count() == 3


def test_search_leaves_no_files(spark, data):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    jobs.random_search(data, trials=1, trees=2, folds=2).collect()
    assert set(os.listdir(folder)) == before


def test_unscored_labels_count_and_are_reported(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "customer_id int, label int")
    scores = spark.createDataFrame([(2, 0.1), (1, 0.8)], "customer_id int, probability double")
    assert rows_of(jobs.evaluate(labels, scores), "auc", "recall", "unscored") == [(0.5, 0.5, 1)]


def test_evaluate_matches_by_customer(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "customer_id int, label int")
    scores = spark.createDataFrame([(2, 0.1), (1, 0.8)], "customer_id int, probability double")
    assert rows_of(jobs.evaluate(labels, scores)) == [(1.0, 1.0, 1.0, 1.0, 0)]


def test_evaluate_files(spark, tmp_path):
    write_csv(spark.createDataFrame([(1, 1), (2, 0)], "customer_id int, label int"), str(tmp_path / "l"))
    scores = spark.createDataFrame([(2, 0.1), (1, 0.8)], "customer_id int, probability double")
    sinks.write_predictions(scores, str(tmp_path / "s"))
    got = jobs.evaluate_files(spark, str(tmp_path / "l"), str(tmp_path / "s"))
    assert rows_of(got, "auc") == [(1.0,)]


def write_csv(df, path):
    df.write.option("header", True).csv(path)


def test_csv_log_round_trip(spark, tmp_path):
    rows = [(1, "2011-01-05 10:30", 5.5, "C1", "85123A", 2, 2.75), (2, "2011-02-01", -1, "2", "M", 1, 1)]
    write_csv(log_of(spark, rows), str(tmp_path / "a.csv"))
    for path in (str(tmp_path / "a.csv"), str(tmp_path / "*.csv")):
        got = log.read_transactions(spark, path)
        assert dict(got.dtypes)["order_date"] == "timestamp_ntz"
        assert rows_of(got, "order_id", "quantity", "total") == [("2", 1, -1.0), ("C1", 2, 5.5)]
    sinks.write_transactions(got, str(tmp_path / "log"))
    assert rows_of(log.read_transactions_parquet(spark, str(tmp_path / "log"))) == rows_of(got)


def test_text_dates(spark):
    raw = spark.createDataFrame([("2011-01-05 10:30:00",)], "order_date string")
    assert log.parse_dates(raw).select(F.minute("order_date")).first()[0] == 30


def test_command_line(spark, lines, tmp_path):
    text = lines.select(
        F.col("order_id").cast("string").alias("order_id"), F.col("product_id").cast("string").alias("product_id"),
        "quantity", "order_date", "price", "customer_id", "total", F.lit("x").alias("country"),
    )
    write_csv(text, str(tmp_path / "train.csv"))
    write_csv(lines.select("customer_id").distinct(), str(tmp_path / "keys.csv"))
    out = str(tmp_path / "out")
    main(["score", "--log", str(tmp_path / "train.csv"), "--out", out, "--ym", "2001-07", "--features", "base",
          "--threshold", "200000", "--folds", "2", "--single", "--keys", str(tmp_path / "keys.csv")])
    assert os.path.isdir(out)
    assert log.read_scores(spark, out).count() == lines.select("customer_id").distinct().count()


def test_csv_and_parquet_give_the_same_features(spark, lines, tmp_path):
    write_csv(lines.select("order_id", "product_id", "quantity", "order_date", "price", "customer_id", "total"),
              str(tmp_path / "train.csv"))
    from_csv = sets.base(log.read_transactions(spark, str(tmp_path / "train.csv")), ["2001-07"], 200000)
    names = ["customer_id", "label", "quantity-sum", "price-max", "total-count"]
    assert rows_of(from_csv, *names) == rows_of(sets.base(lines, ["2001-07"], 200000), *names)


def test_small_searches_run_in_few_tasks(spark, data, monkeypatch):
    """The rows of a small search are one task each pass, however many files they are in."""
    train = data.folds(2).repartition(5)
    few, at_once = few_tasks(train, len(data.features))
    assert few.rdd.getNumPartitions() == 1 and at_once > FOLDS_AT_ONCE
    assert rows_of(few, "customer_id") == rows_of(train, "customer_id")
    size = -(-train.count() * len(data.features) // 3)
    monkeypatch.setattr("tillcast.plans.training.VALUES_OF_A_TASK", size)
    few, at_once = few_tasks(train, len(data.features))
    assert few.rdd.getNumPartitions() == 3 and at_once == FOLDS_AT_ONCE


def test_large_models_are_not_all_fitted_at_once(spark, data, monkeypatch):
    """As many tables of rows are kept in memory as there are fits at a time."""
    train, test = data.folds(3), data.vectors(data.test)
    assert models_at_once(train, len(data.features)) == FOLDS_AT_ONCE
    monkeypatch.setattr("tillcast.plans.training.VALUES_OF_A_TASK", 1)
    assert models_at_once(train, len(data.features)) == 2
    running, most, lock = [0], [0], threading.Lock()

    def slow(*args):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.5)
        try:
            return fit(*args)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr("tillcast.plans.training.fit", slow)
    out_of_fold(train, test, data.features, naive_bayes(), 3)
    assert most[0] == 2


def test_wide_features_run_as_compiled_code(spark, lines, monkeypatch):
    """The hundreds of aggregates of the full set are compiled; the session's settings come back."""
    limit, seen, write = spark.conf.get("spark.sql.codegen.maxFields"), [], jobs.materialise

    def written(df):
        with settings(spark, spark__sql__adaptive__enabled="false"):
            seen.append(df.select("*")._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(jobs, "materialise", written)
    jobs.prepare_month(lines, "2001-07", "full", threshold=200000, order=ORDER, block=0)
    wide = [line for line in seen[0].splitlines() if "HashAggregate(keys=[customer_id" in line and "ObjectHash" not in line]
    assert wide and all("*(" in line for line in wide)
    assert spark.conf.get("spark.sql.codegen.maxFields") == limit
