"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import replace

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from oracles import sql  # noqa: E402
from tillcast.functions import months  # noqa: E402
from tillcast.functions.stats import agg_dict  # noqa: E402
from tillcast.operators import explore, importance, metrics, prepare, selection  # noqa: E402
from tillcast.operators.folds import stratified_folds  # noqa: E402
from tillcast.operators.labels import exceeds, generate_label, label_balance, label_months  # noqa: E402
from tillcast.operators.running import Blocks, blocks, rolling_mean, running, sample_share  # noqa: E402
from tillcast.plans import features as sets  # noqa: E402
from tillcast.plans import jobs  # noqa: E402
from tillcast.plans.training import boosted_trees, fit, naive_bayes, out_of_fold  # noqa: E402
from tillcast.schema import with_customer  # noqa: E402
from tillcast.session import materialise, new_path, small_table  # noqa: E402
from tillcast.sources.log import malformed_transactions, read_keys, read_labels  # noqa: E402
from tillcast.sources.log import read_scores, read_transactions  # noqa: E402
from tillcast.sources.sinks import write_predictions  # noqa: E402
from tillcast.sources.starschema import ORDER, event_log, read_table, transactions  # noqa: E402

TRAIN, TARGET, THRESHOLD = sql.TRAIN, sql.TARGET, sql.THRESHOLD
MONTHS = [TRAIN, TARGET]
LINE_KEYS = ["order_id", "line_no", "product_id", "supplier_id"]
FOLDS = 10


def tidy(df: DataFrame) -> DataFrame:
    """Round the statistics whose last digits depend on the order of addition."""

    def digits(name: str) -> int | None:
        if "-std" in name:
            return 2
        return 4 if "-skew" in name and name != "mean-skew" else None

    return df.select(
        *[
            F.col(f"`{c}`") if digits(c) is None else F.round(f"`{c}`", digits(c)).alias(c)
            for c in df.columns
        ]
    )


def doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in names else c for c in df.columns])


def time_block(spark: SparkSession, sf_dir: str, *keys: str) -> Blocks:
    """How running sums are cut, from a sample drawn before the lines are joined."""
    share = sample_share()
    sample = transactions(spark, sf_dir, price=False, share=share)
    return blocks(sample, keys or list(sets.CUMSUMS), sampled=share)


def feature_set(name: str, ordered: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = transactions(spark, sf_dir, price=name not in ("nunique", "mode"))
        options = {"order": ORDER, "block": time_block(spark, sf_dir)} if ordered else {}
        return tidy(sets.build(name, lines, MONTHS, threshold=THRESHOLD, **options))

    return run


def q_generate_label(spark, sf_dir):
    return generate_label(transactions(spark, sf_dir, price=False), TARGET, THRESHOLD)


def q_label_balance(spark, sf_dir):
    return label_balance(generate_label(transactions(spark, sf_dir, price=False), TARGET, THRESHOLD))


def q_month_bucket(spark, sf_dir):
    return transactions(spark, sf_dir, price=False).select(
        *LINE_KEYS,
        months.bucket("order_date").alias("year_month"),
        F.month("order_date").alias("month"),
        months.epoch_seconds("order_date").cast("double").alias("order_ts"),
    ).withColumn("previous_month", months.shift_bucket("year_month", -1))


def q_tenure_months(spark, sf_dir):
    first = with_customer(event_log(spark, sf_dir)).groupBy("customer_id").agg(
        F.min("order_date").alias("first_date")
    )
    return first.select(
        "customer_id", months.whole_months("first_date", "2025-06").cast("int").alias("months")
    )


def q_split_train_test(spark, sf_dir):
    lines = with_customer(transactions(spark, sf_dir, price=False))
    sides = [
        lines.where(months.before("order_date", m)).withColumn("year_month", F.lit(m))
        for m in MONTHS
    ]
    return (
        sides[0]
        .unionByName(sides[1])
        .groupBy("customer_id", "year_month")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("total").cast("double").alias("total"))
    )


def q_latest_month_lines(spark, sf_dir):
    lines = transactions(spark, sf_dir, price=False).where(months.within("order_date", TARGET, TARGET))
    return doubles(lines.select(*LINE_KEYS, "customer_id", "total"), "total")


def q_month_range_lines(spark, sf_dir):
    lines = transactions(spark, sf_dir, price=False).where(months.within("order_date", "2000-11", "2001-01"))
    return doubles(lines.select(*LINE_KEYS, "customer_id", "total"), "total")


def running_by(key: str):
    def run(spark, sf_dir):
        names = sets.CUMSUMS[key]
        block = time_block(spark, sf_dir, key)
        lines = running(transactions(spark, sf_dir), key, ORDER, sums=names, block=block)
        return doubles(lines.select(*LINE_KEYS, *names), *names)

    return run


def q_order_diff(spark, sf_dir):
    lines = sets.with_differences(transactions(spark, sf_dir), ORDER, time_block(spark, sf_dir, "customer_id"))
    return doubles(lines.select(*LINE_KEYS, *sets.DIFFS), *sets.DIFFS)


def q_generated_columns(spark, sf_dir):
    lines = transactions(spark, sf_dir).where(months.before("order_date", TARGET))
    block = time_block(spark, sf_dir)
    out = sets.with_month_columns(sets.with_all_columns(lines, TARGET, ORDER, block))
    numbers = [*sets.CUMSUM_COLUMNS, *sets.DIFFS, "mean"]
    return doubles(out.select(*LINE_KEYS, "month", "year_month", *numbers), *numbers)


def q_rolling_3_month(spark, sf_dir):
    series = explore.dense_series(transactions(spark, sf_dir, price=False), measures=["total"])
    smooth = rolling_mean(series, ["customer_id"], "period", "total", "smooth")
    return smooth.select("customer_id", "period", F.round("smooth", 4).alias("smooth"))


def q_mean_monthly_spend(spark, sf_dir):
    lines = transactions(spark, sf_dir, price=False).where(months.before("order_date", TARGET))
    return sets.mean_monthly_spend(lines, TARGET)


def q_trend(spark, sf_dir):
    return tidy(sets.trend(transactions(spark, sf_dir), MONTHS))


def q_season(spark, sf_dir):
    return tidy(sets.season(transactions(spark, sf_dir), MONTHS))


def q_season_independent(spark, sf_dir):
    return tidy(sets.season(transactions(spark, sf_dir), MONTHS, chain="independent"))


def q_group_statistics(spark, sf_dir):
    stats = agg_dict(
        transactions(spark, sf_dir, price=False),
        ["product_id"],
        {
            "quantity": ["mean", "max", "sum", "mode", "first", "last"],
            "total": ["min", "std", "skew"],
            "customer_id": ["nunique", "count"],
        },
        ORDER,
    )
    return tidy(stats)


def q_label_encode(spark, sf_dir):
    modes = materialise(
        sets.mode_months(transactions(spark, sf_dir, price=False), MONTHS, THRESHOLD)
    )
    train, test = sets.split(modes, TARGET)
    train, test = prepare.label_encode(train, test, ["year_month-mode"])
    return train.unionByName(test)


def q_median_impute(spark, sf_dir):
    lines = transactions(spark, sf_dir)
    labels = label_months(lines, MONTHS, THRESHOLD).drop("total")
    rows = labels.join(sets.season(lines, MONTHS), ["customer_id", "year_month"], "left")
    rows = materialise(rows)
    train, test = sets.split(rows, TARGET)
    train, test = prepare.median_impute(train, test, sets.SEASON_NAMES)
    return tidy(train.unionByName(test))


def q_high_corr_cols(spark, sf_dir):
    base = materialise(sets.base(transactions(spark, sf_dir), [TARGET], THRESHOLD))
    return prepare.high_correlation(base, 0.9, sets.feature_names(base))


def q_correlations_full(spark, sf_dir):
    rows = feature_set("full", ordered=True)(spark, sf_dir).where(F.col("year_month") == TARGET)
    found = prepare.correlations(materialise(rows), sets.feature_names(rows))
    return found.where("r IS NOT NULL").select("first", "second", F.round("r", 6).alias("r"))


def q_approx_nunique(spark, sf_dir):
    """Exact distinct counts next to whether the approximate ones are within 3 %."""
    lines = transactions(spark, sf_dir, price=False)
    near = sets.approx_nunique(lines, MONTHS, back=(None, 6))
    out = None
    for suffix, back in (("", None), ("-6", 6)):
        for m in MONTHS:
            past = lines.where(months.before("order_date", m))
            if back:
                past = past.where(F.col("order_date") >= months.month_start(months.shift(m, -back)))
            exact = agg_dict(with_customer(past), ["customer_id"], {"order_id": ["nunique"], "product_id": ["nunique"]})
            part = exact.select(
                "customer_id", F.lit(m).alias("year_month"), F.lit(suffix).alias("window"),
                *[F.col(f"`{c}-nunique`").alias(c) for c in ("order_id", "product_id")],
            )
            out = part if out is None else out.unionByName(part)
    exact = near.select("customer_id", "year_month")
    for suffix in ("", "-6"):
        part = out.where(F.col("window") == suffix).select(
            "customer_id", "year_month",
            *[F.col(c).alias(f"{c}-nunique{suffix}") for c in ("order_id", "product_id")],
        )
        exact = exact.join(part, ["customer_id", "year_month"], "left")
    both = exact.join(near, ["customer_id", "year_month"])
    columns = []
    for suffix in ("", "-6"):
        for c in ("order_id", "product_id"):
            n = F.coalesce(F.col(f"`{c}-nunique{suffix}`"), F.lit(0.0))
            off = F.abs(F.col(f"`{c}-approx_nunique{suffix}`") - n)
            columns += [n.alias(f"{c}-nunique{suffix}"), (off <= 0.03 * n).alias(f"{c}-close{suffix}")]
    return both.select("customer_id", "year_month", *columns)


CATEGORIES, NUMBERS = ["country", "ym", "product_id"], ["quantity", "price", "total"]


def q_report_associations(spark, sf_dir):
    lines = transactions(spark, sf_dir, country=True)
    wide = materialise(lines.select("country", months.bucket("order_date").alias("ym"), "product_id", *NUMBERS))
    found = explore.associations(wide, CATEGORIES, NUMBERS)
    return found.withColumn("strength", F.round("strength", 6))


def q_multi_month_train(spark, sf_dir):
    rows = jobs.multi_month_training(
        transactions(spark, sf_dir), "base", ["2001-03", "2001-05", "2001-06"], threshold=THRESHOLD
    )
    return tidy(rows)


def q_densified_series(spark, sf_dir):
    return explore.dense_series(transactions(spark, sf_dir))


def q_top5_customers_series(spark, sf_dir):
    lines = transactions(spark, sf_dir, price=False)
    first = explore.first_keys(lines, "customer_id", 5)
    series = explore.dense_series(lines, measures=["total"], customers=first)
    return series.withColumnRenamed("period", "per_month")


def q_first_customer_lines(spark, sf_dir):
    lines = explore.lines_of_first_customer(transactions(spark, sf_dir, price=False))
    return doubles(lines.select(*LINE_KEYS, "customer_id", "total"), "total")


def q_null_counts(spark, sf_dir):
    lines = transactions(spark, sf_dir, description=True, country=True)
    return explore.null_counts(lines.select(*PROFILE_COLUMNS, "description", "country"))


def q_cardinalities(spark, sf_dir):
    lines = transactions(spark, sf_dir, description=True, country=True)
    return explore.cardinalities(
        lines, ["customer_id", "order_id", "product_id", "description", "country"]
    )


def q_extremes(spark, sf_dir):
    lines = transactions(spark, sf_dir)
    wanted = ["order_date", "quantity", "price", "total"]
    found = explore.extremes(lines, wanted)
    numbers = [f"{c}_{e}" for c in wanted[1:] for e in ("min", "max")]
    return doubles(found, *numbers)


PROFILE_COLUMNS = ["order_id", "product_id", "quantity", "price", "customer_id", "total"]


def q_profile(spark, sf_dir):
    table = explore.profile(transactions(spark, sf_dir).select(*PROFILE_COLUMNS))
    rounded = {"mean": 4, "std": 2, "p25": 6, "p50": 6, "p75": 6}
    return table.select(
        *[F.round(c, rounded[c]).alias(c) if c in rounded else c for c in table.columns]
    )


def q_histogram(spark, sf_dir):
    return explore.histogram(transactions(spark, sf_dir, price=False), "quantity", 10)


def q_id_pattern_split(spark, sf_dir):
    return explore.id_pattern_split(transactions(spark, sf_dir, price=False))


def q_ids_per_pattern(spark, sf_dir):
    return explore.ids_per_pattern(transactions(spark, sf_dir, price=False))


def scored(spark, sf_dir) -> DataFrame:
    """Two scores with ties, made of the customers' history, next to label and fold."""
    lines = with_customer(transactions(spark, sf_dir, price=False))
    earlier, inside = months.before("order_date", TARGET), months.within("order_date", TARGET, TARGET)
    spent = F.coalesce(F.sum(F.when(inside, F.col("total"))).cast("double"), F.lit(0.0))
    # One pass over the lines, written once: folds and maxima read it again.
    customers = materialise(
        lines.groupBy("customer_id")
        .agg(
            F.count_if(earlier).alias("known"),
            exceeds(spent, THRESHOLD).alias("label"),
            F.sum(F.when(earlier, F.col("total"))).cast("double").alias("t"),
            F.sum(F.when(earlier, F.col("quantity"))).cast("double").alias("n"),
        )
        .where("known > 0")
    )
    best = customers.agg(F.max("t").alias("t"), F.max("n").alias("n")).first()

    def share(c: str):
        return F.floor(F.col(c) / best[c] * 100).cast("double") / 100

    scores = stratified_folds(customers).select(
        "customer_id", "label", "fold", share("t").alias("probability"), share("n").alias("second")
    )
    # Written once: the metrics pass over it more than once.
    return materialise(scores)


def q_stratified_folds(spark, sf_dir):
    labels = generate_label(transactions(spark, sf_dir, price=False), TARGET, THRESHOLD)
    return stratified_folds(labels).select("customer_id", "label", "fold")


def q_auc_exact(spark, sf_dir):
    return metrics.auc(scored(spark, sf_dir)).withColumn("auc", F.round("auc", 8))


def q_auc_by_fold(spark, sf_dir):
    per_fold = metrics.auc(scored(spark, sf_dir), by=["fold"])
    return per_fold.withColumn("auc", F.round("auc", 8))


def q_score_histogram(spark, sf_dir):
    return explore.histogram(scored(spark, sf_dir), "probability", 20, 0.0, 1.0)


def q_mean_fold_auc(spark, sf_dir):
    found = metrics.mean_fold_auc(scored(spark, sf_dir))
    return found.select(*[F.round(c, 8).alias(c) for c in ("mean_auc", "oof_auc")])


def q_threshold_metrics(spark, sf_dir):
    return metrics.threshold_metrics(scored(spark, sf_dir))


def q_blend_scores(spark, sf_dir):
    both = scored(spark, sf_dir)
    mixed = metrics.blend(
        {
            "a": (both.select("customer_id", "probability"), 0.4),
            "b": (both.select("customer_id", F.col("second").alias("probability")), 0.6),
        }
    )
    return mixed.withColumn("probability", F.round("probability", 8))


def q_importance_table(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("feature")
    )
    per_fold = (
        transactions(spark, sf_dir, price=False)
        .join(part, "product_id")
        .groupBy("feature", (F.col("customer_id") % 5).cast("int").alias("fold"))
        .agg(F.sum("quantity").cast("double").alias("importance"))
    )
    kept = importance.in_all_folds(per_fold)
    table = importance.ranked(importance.mean_importance(kept), 10)
    return table.select(*[c if c == "feature" else F.round(c, 8).alias(c) for c in table.columns])


def prepared(spark, sf_dir, name: str = "base", **options) -> jobs.Prepared:
    return jobs.prepare_month(
        transactions(spark, sf_dir), TARGET, name, threshold=THRESHOLD, **options
    )


def q_cumsum_split(spark, sf_dir):
    """Running sums of products in blocks of thirty days, whatever the size of the log."""
    lines, names = transactions(spark, sf_dir), sets.CUMSUMS["product_id"]
    split = running(lines, "product_id", ORDER, sums=names, block=30 * 24 * 3600)
    return doubles(split.select(*LINE_KEYS, *names), *names)


def q_running_blocks(spark, sf_dir):
    """All running columns in blocks of a year: sums by three keys, and differences."""
    year = replace(time_block(spark, sf_dir), seconds=365 * 24 * 3600, every=True)
    lines = sets.with_running_values(transactions(spark, sf_dir), ORDER, year, written=True)
    numbers = [*sets.CUMSUM_COLUMNS, *sets.DIFFS]
    return doubles(lines.select(*LINE_KEYS, *numbers), *numbers)


CSV_COLUMNS = ["order_id", "product_id", "quantity", "order_date", "price", "customer_id", "total"]


def csv_log(spark, sf_dir) -> tuple[str, DataFrame]:
    """The log in two folders of CSV files, whose columns stand in different orders; the pattern of both.

    Every hundredth order is in words where its quantity should be.
    """
    folder = new_path(spark)
    lines = transactions(spark, sf_dir).select(*CSV_COLUMNS)
    words = F.when(F.col("order_id") % 100 == 7, "many").otherwise(F.col("quantity").cast("string"))
    for name, rest, columns in (("a", 0, CSV_COLUMNS), ("b", 1, CSV_COLUMNS[::-1])):
        half = lines.where(F.col("order_id") % 2 == rest).withColumn("quantity", words)
        half.select(*columns).write.option("header", True).csv(f"{folder}/{name}")
    return f"{folder}/*", lines


def q_csv_glob(spark, sf_dir):
    path, _ = csv_log(spark, sf_dir)
    lines = read_transactions(spark, path, malformed="aside")
    seconds = months.epoch_seconds("order_date").cast("double").alias("order_date")
    return doubles(lines.withColumn("order_date", seconds), "price", "total").select(*CSV_COLUMNS)


def q_csv_malformed(spark, sf_dir):
    path, _ = csv_log(spark, sf_dir)
    order = F.element_at(F.split("record", ","), -1).cast("long").alias("order_id")
    wrong = malformed_transactions(spark, path)
    return wrong.groupBy(order, "reason").agg(
        F.count(F.lit(1)).alias("lines"), (F.min("line") > 1).alias("below_header")
    )


def q_csv_round_trip(spark, sf_dir):
    """Labels, keys and scores written as CSV and read again; score files are in customer order."""
    folder = new_path(spark)
    labels = generate_label(transactions(spark, sf_dir, price=False), TARGET, THRESHOLD)
    labels = materialise(labels)
    labels.select("label", "customer_id").write.option("header", True).csv(f"{folder}/labels")
    labels.select("customer_id").write.option("header", True).csv(f"{folder}/keys")
    most = labels.agg(F.max("total")).scalar()
    write_predictions(labels.withColumn("probability", F.col("total") / most), f"{folder}/scores")
    files = spark.read.option("header", True).csv(f"{folder}/scores").select(
        F.col("customer_id").cast("long").alias("customer_id"),
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("row"),
    )
    before = F.lag("customer_id", 1, -1).over(Window.partitionBy("file").orderBy("row"))
    ordered = files.select("customer_id", (before < F.col("customer_id")).alias("in_order"))
    return (
        read_keys(spark, f"{folder}/keys")
        .join(read_labels(spark, f"{folder}/labels"), "customer_id")
        .join(read_scores(spark, f"{folder}/scores"), "customer_id")
        .join(ordered, "customer_id")
        .withColumn("probability", F.round("probability", 8))
    )


def q_score_head(spark, sf_dir):
    """The first rows of a score file by score."""
    folder = new_path(spark)
    labels = materialise(generate_label(transactions(spark, sf_dir, price=False), TARGET, THRESHOLD))
    most = labels.agg(F.max("total")).scalar()
    write_predictions(labels.withColumn("probability", F.col("total") / most), folder)
    head = explore.ordered_head(read_scores(spark, folder), [F.desc("probability"), "customer_id"], 20)
    return head.withColumn("probability", F.round("probability", 8))


def q_dense_series_events(spark, sf_dir):
    return explore.dense_series(event_log(spark, sf_dir), measures=["total"])


def q_auc_tied(spark, sf_dir):
    tied = scored(spark, sf_dir).withColumn(
        "probability", (F.col("probability") >= 0.5).cast("int") / F.lit(2.0)
    )
    return metrics.auc(tied, pieces=64).withColumn("auc", F.round("auc", 8))


def q_evaluate_partial(spark, sf_dir):
    both = scored(spark, sf_dir)
    found = both.where("second >= 0.2").select("customer_id", "probability")
    got = jobs.evaluate(both.select("customer_id", "label"), found, threshold=0.3)
    return got.withColumn("auc", F.round("auc", 8))


def out_of_fold_of(spark, sf_dir, learner, name: str = "nunique"):
    data = prepared(spark, sf_dir, name)
    return out_of_fold(data.folds(FOLDS), data.vectors(data.test), data.features, learner, FOLDS)


def q_oof_naive_bayes(spark, sf_dir):
    oof = out_of_fold_of(spark, sf_dir, naive_bayes()).oof
    return oof.withColumn("probability", F.round("probability", 6))


SUBSET = 6


def train_rows(spark, sf_dir) -> DataFrame:
    """The train month's rows of the base set with their folds, nulls as they are."""
    rows = sets.build("base", transactions(spark, sf_dir), MONTHS, threshold=THRESHOLD)
    return materialise(stratified_folds(tidy(rows.where(F.col("year_month") == TRAIN)), FOLDS))


def q_univariate_f(spark, sf_dir):
    rows = train_rows(spark, sf_dir)
    found = selection.f_statistics(rows, [c for c in sets.feature_names(rows) if c != "fold"])
    return found.withColumn("f", F.round("f", 4))


def q_select_subset(spark, sf_dir):
    rows = train_rows(spark, sf_dir)
    names = [c for c in sets.feature_names(rows) if c != "fold"]
    found = selection.forward_selection(rows, names, SUBSET)
    return found.withColumn("balanced_accuracy", F.round("balanced_accuracy", 8))


def q_oof_early_stopping(spark, sf_dir):
    oof = out_of_fold_of(spark, sf_dir, boosted_trees(early_stop=0.01)).oof
    valid = F.col("probability").between(0.0, 1.0).alias("valid")
    return oof.select("customer_id", "label", "fold", valid)


def q_oof_predictions(spark, sf_dir):
    data = prepared(spark, sf_dir)
    return out_of_fold(data.folds(FOLDS), data.vectors(data.test), data.features, boosted_trees(), FOLDS).oof


PATIENCE = 3


def q_early_stopping_rounds(spark, sf_dir):
    """What the table of rounds says of each fold: where the wait ended, and which round was kept."""
    found = out_of_fold_of(spark, sf_dir, boosted_trees(trees=15, depth=3, step=0.4, patience=PATIENCE))
    kept = [(k, m.getNumTrees) for k, m in enumerate(found.models)]
    trees = small_table(spark, kept, "fold int, trees int")
    rounds = found.rounds.withColumn("least", F.min("loss").over(Window.partitionBy("fold")))
    ended = (F.col("last") == F.least(F.col("best") + PATIENCE, F.lit(15))).alias("ended_by_patience")
    return (
        rounds.groupBy("fold", "best", "last")
        .agg(
            (F.count(F.lit(1)) == F.col("last")).alias("all_rounds_listed"),
            (F.min(F.when(F.col("loss") == F.col("least"), F.col("round"))) == F.col("best")).alias("best_is_least"),
        )
        .join(trees, "fold")
        .select("fold", "all_rounds_listed", "best_is_least", ended, (F.col("trees") == F.col("best")).alias("model_is_cut"))
    )


def q_categorical_splits(spark, sf_dir):
    """How trees on the most frequent months split each feature: calendar months are a set."""
    data = prepared(spark, sf_dir, "mode")
    model = fit(boosted_trees(trees=5), materialise(data.vectors(data.train)), 0)
    text = model.toDebugString
    rows = [
        (c, data.categories.get(c, 0), f"feature {i} in {{" in text, f"feature {i} <= " in text)
        for i, c in enumerate(data.features)
    ]
    return small_table(spark, rows, "feature string, categories long, in_sets boolean, by_threshold boolean")


def q_score_naive_bayes(spark, sf_dir):
    """Target month, scored by the mean of the folds' models."""
    found = out_of_fold_of(spark, sf_dir, naive_bayes()).test
    return found.withColumn("probability", F.round("probability", 6))


def q_backtest_naive_bayes(spark, sf_dir):
    got = jobs.backtest(
        transactions(spark, sf_dir), TARGET, "nunique", THRESHOLD, {"bayes": (naive_bayes(), 1.0)}, FOLDS
    )
    return got.select(*[c if c == "unscored" else F.round(c, 6).alias(c) for c in got.columns])


def q_backtest(spark, sf_dir):
    return jobs.backtest(
        transactions(spark, sf_dir), TARGET, "diff", THRESHOLD,
        folds=FOLDS, order=ORDER,
    )


TRIALS = 50


def q_random_search(spark, sf_dir):
    """Fifty draws: how many are left at each rung, and that none kept is worse than one that goes."""
    found = jobs.random_search(prepared(spark, sf_dir, "diff"), trials=TRIALS, folds=FOLDS)
    worst, best = F.min(F.when(F.col("kept"), F.col("auc"))), F.max(F.when(~F.col("kept"), F.col("auc")))
    return found.groupBy("rung").agg(
        F.count(F.lit(1)).alias("trials"),
        F.count_if("kept").alias("kept"),
        F.max("trees").cast("long").alias("trees"),
        F.max("folds").cast("long").alias("folds"),
        F.coalesce(worst >= best, F.lit(True)).alias("better_go_on"),
    )


def q_select_top_features(spark, sf_dir):
    names = jobs.select_features(prepared(spark, sf_dir), n=10, folds=FOLDS)
    ranked = [(i + 1, c) for i, c in enumerate(names)]
    return small_table(spark, ranked, "rank int, feature string")


def q_score_month(spark, sf_dir):
    return jobs.score_month(
        transactions(spark, sf_dir), TARGET, "full", folds=FOLDS, threshold=THRESHOLD, order=ORDER,
        block=time_block(spark, sf_dir),
    )


def entry(spark: SparkSession) -> DataFrame:
    """Base features and labels of the train and the target month."""
    return feature_set("base")(spark, "/root/testdata/sf0.001")


def own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "generate_label": q_generate_label,
        "label_balance": q_label_balance,
        "base_features": feature_set("base"),
        "month_bucket": q_month_bucket,
        "tenure_months": q_tenure_months,
        "split_train_test": q_split_train_test,
        "latest_month_lines": q_latest_month_lines,
        "month_range_lines": q_month_range_lines,
        "cumsum_customer": running_by("customer_id"),
        "cumsum_product": running_by("product_id"),
        "cumsum_order": running_by("order_id"),
        "order_diff": q_order_diff,
        "generated_columns": q_generated_columns,
        "rolling_3_month": q_rolling_3_month,
        "cumsum_features": feature_set("cumsum", ordered=True),
        "nunique_features": feature_set("nunique"),
        "mode_features": feature_set("mode"),
        "diff_features": feature_set("diff", ordered=True),
        "mean_monthly_spend": q_mean_monthly_spend,
        "trend_features": q_trend,
        "season_features": q_season,
        "season_independent": q_season_independent,
        "full_features": feature_set("full", ordered=True),
        "group_statistics": q_group_statistics,
        "label_encode": q_label_encode,
        "median_impute": q_median_impute,
        "high_corr_cols": q_high_corr_cols,
        "correlations_full": q_correlations_full,
        "approx_nunique": q_approx_nunique,
        "report_associations": q_report_associations,
        "multi_month_train": q_multi_month_train,
        "densified_series": q_densified_series,
        "top5_customers_series": q_top5_customers_series,
        "first_customer_lines": q_first_customer_lines,
        "null_counts": q_null_counts,
        "cardinalities": q_cardinalities,
        "extremes": q_extremes,
        "profile": q_profile,
        "histogram": q_histogram,
        "id_pattern_split": q_id_pattern_split,
        "ids_per_pattern": q_ids_per_pattern,
        "stratified_folds": q_stratified_folds,
        "auc_exact": q_auc_exact,
        "auc_by_fold": q_auc_by_fold,
        "mean_fold_auc": q_mean_fold_auc,
        "score_histogram": q_score_histogram,
        "threshold_metrics": q_threshold_metrics,
        "blend_scores": q_blend_scores,
        "importance_table": q_importance_table,
        "cumsum_split": q_cumsum_split,
        "running_blocks": q_running_blocks,
        "csv_glob": q_csv_glob,
        "csv_malformed": q_csv_malformed,
        "csv_round_trip": q_csv_round_trip,
        "score_head": q_score_head,
        "dense_series_events": q_dense_series_events,
        "auc_tied": q_auc_tied,
        "evaluate_partial": q_evaluate_partial,
        "oof_naive_bayes": q_oof_naive_bayes,
        "univariate_f": q_univariate_f,
        "select_subset": q_select_subset,
        "oof_early_stopping": q_oof_early_stopping,
        "early_stopping_rounds": q_early_stopping_rounds,
        "categorical_splits": q_categorical_splits,
        "score_naive_bayes": q_score_naive_bayes,
        "backtest_naive_bayes": q_backtest_naive_bayes,
        "oof_predictions": q_oof_predictions,
        "backtest": q_backtest,
        "random_search": q_random_search,
        "select_top_features": q_select_top_features,
        "score_month": q_score_month,
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return own_queries() | training_text()[0]


def training_text() -> tuple[dict, dict]:
    """Queries and SQL of the training-text operators, where these are installed."""
    queries, oracles = {}, {}
    try:
        from tillcast.llm.queries import QUERIES, SQL

        queries |= QUERIES
        oracles |= SQL
    except ModuleNotFoundError as e:
        if not (e.name or "").startswith("tillcast.llm"):
            raise
    try:
        import corpus_pipeline

        queries["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            oracles["pipeline"] = corpus_pipeline.ORACLE_SQL
    except ModuleNotFoundError as e:
        if e.name != "corpus_pipeline" and not (e.name or "").startswith("tillcast.llm"):
            raise
    return queries, oracles


def oracle_sql() -> dict[str, str]:
    return own_sql() | training_text()[1]


def own_sql() -> dict[str, str]:
    log, s = f"WITH {sql.LOG} ", sql.SCORED
    keys = sql.LINE_KEYS
    month_lines = f"{log}SELECT {keys}, customer_id, CAST(total AS DOUBLE) AS total FROM log WHERE "
    mode = (
        "SELECT product_id, quantity, ROW_NUMBER() OVER (PARTITION BY product_id "
        "ORDER BY COUNT(*) DESC, quantity) AS rn FROM log GROUP BY product_id, quantity"
    )
    ends = (
        f"SELECT DISTINCT product_id, FIRST_VALUE(quantity) OVER w AS f, LAST_VALUE(quantity) OVER w "
        f"AS l FROM log WINDOW w AS (PARTITION BY product_id ORDER BY {sql.ORD} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    )
    grouped = ", ".join(
        f'{sql.stat(c, x)} AS "{c}-{x}"'
        for c, x in [
            ("quantity", "mean"), ("quantity", "max"), ("quantity", "sum"),
            ("total", "min"), ("total", "std"), ("total", "skew"), ("customer_id", "count"),
        ]
    )
    digits = "regexp_matches(substr(CAST(product_id AS VARCHAR), 1, 5), '^[0-9]+$')"
    cards = ["customer_id", "order_id", "product_id", "description", "country"]
    wide_log = (
        f"{log}, wide AS (SELECT log.*, p_name AS description, n_name AS country FROM log "
        "LEFT JOIN part ON product_id = p_partkey LEFT JOIN customer ON customer_id = c_custkey "
        "LEFT JOIN nation ON c_nationkey = n_nationkey) "
    )
    return {
        "generate_label": log + sql.label(TARGET),
        "label_balance": f"{log}SELECT label, COUNT(*) AS customers FROM ({sql.label(TARGET)}) GROUP BY label",
        "base_features": sql.base(),
        "month_bucket": (
            f"{log}SELECT {keys}, ym AS year_month, CAST(month(order_date) AS INT) AS month, "
            "CAST(epoch(order_date) AS DOUBLE) AS order_ts, "
            "strftime(order_date - INTERVAL 1 MONTH, '%Y-%m') AS previous_month FROM log"
        ),
        "tenure_months": (
            f"SELECT user_id AS customer_id, CAST({sql.tenure('MIN(ts)', '2025-06')} AS INT) AS months "
            "FROM events WHERE user_id IS NOT NULL GROUP BY user_id"
        ),
        "split_train_test": log + " UNION ALL ".join(
            f"SELECT customer_id, '{m}' AS year_month, COUNT(*) AS lines, "
            f"CAST(SUM(total) AS DOUBLE) AS total FROM log WHERE {sql.before(m)} GROUP BY customer_id"
            for m in MONTHS
        ),
        "latest_month_lines": f"{month_lines} ym = '{TARGET}'",
        "month_range_lines": f"{month_lines} ym >= '2000-11' AND ym <= '2001-01'",
        "cumsum_customer": sql.running_lines("customer_id"),
        "cumsum_product": sql.running_lines("product_id"),
        "cumsum_order": sql.running_lines("order_id"),
        "order_diff": sql.order_diff(),
        "generated_columns": sql.generated_columns(),
        "rolling_3_month": (
            f"{sql.DENSE} SELECT customer_id, period, ROUND(CASE WHEN COUNT(*) OVER w = 3 "
            "THEN AVG(total) OVER w END, 4) AS smooth FROM dense WINDOW w AS "
            "(PARTITION BY customer_id ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
        ),
        "cumsum_features": sql.cumsum(),
        "nunique_features": sql.nunique(),
        "mode_features": sql.mode(),
        "diff_features": sql.diff(),
        "mean_monthly_spend": log + sql.mean_spend_of(sql.before(TARGET)),
        "trend_features": sql.trend(),
        "season_features": sql.season(),
        "season_independent": sql.season_independent(),
        "full_features": sql.full(),
        "group_statistics": (
            f'{log}SELECT g.*, m.quantity AS "quantity-mode", e.f AS "quantity-first", '
            f'e.l AS "quantity-last" FROM (SELECT product_id, {grouped}, '
            'CAST(COUNT(DISTINCT customer_id) AS DOUBLE) AS "customer_id-nunique" FROM (SELECT *, '
            "AVG(CAST(total AS DOUBLE)) OVER (PARTITION BY product_id) AS mu_total FROM log) "
            f"GROUP BY product_id) g JOIN ({mode}) m ON m.product_id = g.product_id AND rn = 1 "
            f"JOIN ({ends}) e ON e.product_id = g.product_id"
        ),
        "label_encode": sql.label_encode(),
        "median_impute": sql.median_impute(),
        "correlations_full": sql.correlations_full(),
        "approx_nunique": sql.approx_nunique(),
        "report_associations": wide_log + sql.associations(CATEGORIES, NUMBERS),
        "high_corr_cols": sql.high_corr(),
        "multi_month_train": sql.multi_month(),
        "densified_series": f"{sql.DENSE} SELECT * FROM dense",
        "top5_customers_series": (
            f"{sql.DENSE} SELECT customer_id, period AS per_month, total FROM dense "
            f"WHERE customer_id IN {sql.FIRST5}"
        ),
        "first_customer_lines": f"{month_lines} customer_id = (SELECT MIN(customer_id) FROM log)",
        "null_counts": wide_log + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS nulls FROM wide"
            for c in [*PROFILE_COLUMNS, "description", "country"]
        ),
        "cardinalities": wide_log + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) + MAX(CAST({c} IS NULL AS BIGINT)) "
            "AS values FROM wide"
            for c in cards
        ),
        "extremes": (
            f"{log}SELECT MIN(order_date) AS order_date_min, MAX(order_date) AS order_date_max, "
            + ", ".join(
                f"CAST({e}({c}) AS DOUBLE) AS {c}_{e.lower()}"
                for c in ("quantity", "price", "total")
                for e in ("MIN", "MAX")
            )
            + " FROM log"
        ),
        "profile": sql.profile(PROFILE_COLUMNS, PROFILE_COLUMNS),
        "histogram": (
            f"{log}, r AS (SELECT CAST(MIN(quantity) AS DOUBLE) AS lo, "
            "CAST(MAX(quantity) AS DOUBLE) AS hi FROM log), c AS (SELECT CAST(LEAST(FLOOR((quantity - lo) / "
            "((hi - lo) / 10)), 9) AS BIGINT) AS bin, COUNT(*) AS n FROM log, r GROUP BY 1) SELECT bin, "
            "lo + bin * ((hi - lo) / 10) AS lower, lo + (bin + 1) * ((hi - lo) / 10) AS upper, "
            "COALESCE(n, 0) AS rows FROM (SELECT UNNEST(range(10)) AS bin) LEFT JOIN c USING (bin), r"
        ),
        "id_pattern_split": f"{log}SELECT DISTINCT product_id, {digits} AS in_pattern FROM log",
        "ids_per_pattern": (
            f"{log}SELECT {digits} AS in_pattern, COUNT(DISTINCT product_id) AS ids FROM log GROUP BY 1"
        ),
        "stratified_folds": f"{s} SELECT customer_id, label, fold FROM folded",
        "auc_exact": f"{s} {sql.auc()}",
        "auc_by_fold": f"{s} {sql.auc('fold')}",
        "mean_fold_auc": (
            f"{s}, a AS ({sql.auc()}), f AS ({sql.auc('fold', digits=None)}) SELECT "
            "ROUND((SELECT AVG(auc) FROM f), 8) AS mean_auc, auc AS oof_auc FROM a"
        ),
        # Keys split over many tasks give what a window gives.
        "cumsum_split": sql.running_lines("product_id"),
        "running_blocks": sql.running_blocks(),
        "csv_glob": (
            f"{log}SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(product_id AS VARCHAR) AS product_id, "
            "quantity, CAST(epoch(order_date) AS DOUBLE) AS order_date, CAST(price AS DOUBLE) AS price, "
            "customer_id, CAST(total AS DOUBLE) AS total FROM log WHERE order_id % 100 <> 7"
        ),
        "csv_malformed": (
            f"{log}SELECT order_id, 'quantity' AS reason, COUNT(*) AS lines, TRUE AS below_header "
            "FROM log WHERE order_id % 100 = 7 GROUP BY order_id"
        ),
        "csv_round_trip": (
            f"{log}SELECT customer_id, label, ROUND(total / MAX(total) OVER (), 8) AS probability, "
            f"TRUE AS in_order FROM ({sql.label(TARGET)})"
        ),
        "score_head": (
            f"{log}SELECT customer_id, ROUND(total / MAX(total) OVER (), 8) AS probability "
            f"FROM ({sql.label(TARGET)}) ORDER BY total DESC, customer_id LIMIT 20"
        ),
        "dense_series_events": sql.dense_events(),
        "auc_tied": (
            f"{s}, tied AS (SELECT label, CAST(probability >= 0.5 AS INT) / 2.0::DOUBLE AS probability "
            f"FROM scored) {sql.auc().replace('FROM scored', 'FROM tied')}"
        ),
        "evaluate_partial": (
            f"{s}, given AS (SELECT label, CASE WHEN second >= 0.2 THEN probability END AS p FROM scored), "
            "e AS (SELECT label, COALESCE(p, 0.0::DOUBLE) AS probability FROM given), c AS (SELECT "
            "SUM(CAST(label = 1 AND probability > 0.3 AS INT)) AS tp, "
            "SUM(CAST(label = 0 AND probability > 0.3 AS INT)) AS fp, "
            "SUM(CAST(label = 1 AND NOT probability > 0.3 AS INT)) AS fn FROM e), "
            f"a AS ({sql.auc().replace('FROM scored', 'FROM e')}) SELECT auc, "
            "COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0) AS precision, "
            "COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0) AS recall, "
            "COALESCE(2 * CAST(tp AS DOUBLE) / NULLIF(2 * tp + fp + fn, 0), 0) AS f1, "
            "(SELECT COUNT(*) FROM given WHERE p IS NULL) AS unscored FROM c, a"
        ),
        "early_stopping_rounds": (
            "SELECT CAST(UNNEST(range(10)) AS INT) AS fold, TRUE AS all_rounds_listed, TRUE AS best_is_least, "
            "TRUE AS ended_by_patience, TRUE AS model_is_cut"
        ),
        "categorical_splits": (
            f"SELECT 'year_month-mode' AS feature, COUNT(DISTINCT \"year_month-mode\") AS categories, "
            f"TRUE AS in_sets, FALSE AS by_threshold FROM ({sql.mode()}) "
            "UNION ALL SELECT 'month-mode', 0, FALSE, TRUE"
        ),
        "random_search": (
            "SELECT * FROM (VALUES "
            + ", ".join(
                f"(CAST({i} AS INT), {n}::BIGINT, {after}::BIGINT, {trees}::BIGINT, {folds}::BIGINT, TRUE)"
                for i, ((n, trees, folds), after) in enumerate(zip(sql.RUNGS, [r[0] for r in sql.RUNGS[1:]] + [1]))
            )
            + ") AS t(rung, trials, kept, trees, folds, better_go_on)"
        ),
        "score_naive_bayes": sql.score_naive_bayes(),
        "backtest_naive_bayes": sql.backtest_naive_bayes(),
        "oof_naive_bayes": sql.naive_bayes(),
        "univariate_f": sql.univariate_f(),
        "select_subset": sql.select_subset(SUBSET),
        "oof_early_stopping": (
            f"SELECT customer_id, label, CAST((ROW_NUMBER() OVER (PARTITION BY label ORDER BY "
            f"md5('0|' || CAST(customer_id AS VARCHAR)), customer_id) - 1) % {FOLDS} AS INT) AS fold, "
            f"TRUE AS valid FROM ({sql.nunique()}) WHERE year_month = '{TRAIN}'"
        ),
        "score_histogram": (
            f"{s}, c AS (SELECT CAST(LEAST(FLOOR(probability / (1.0::DOUBLE / 20)), 19) AS BIGINT) AS bin, "
            "COUNT(*) AS n FROM scored GROUP BY 1) SELECT bin, bin * (1.0::DOUBLE / 20) AS lower, "
            "(bin + 1) * (1.0::DOUBLE / 20) AS upper, COALESCE(n, 0) AS rows "
            "FROM (SELECT UNNEST(range(20)) AS bin) LEFT JOIN c USING (bin)"
        ),
        "threshold_metrics": (
            f"{s}, c AS (SELECT SUM(CAST(label = 1 AND probability > 0.5 AS INT)) AS tp, "
            "SUM(CAST(label = 0 AND probability > 0.5 AS INT)) AS fp, "
            "SUM(CAST(label = 1 AND NOT probability > 0.5 AS INT)) AS fn FROM scored) "
            "SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, "
            "COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0) AS precision, "
            "COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0) AS recall, "
            "COALESCE(2 * CAST(tp AS DOUBLE) / NULLIF(2 * tp + fp + fn, 0), 0) AS f1 FROM c"
        ),
        "blend_scores": (
            f"{s} SELECT customer_id, ROUND(probability * 0.4::DOUBLE + second * 0.6::DOUBLE, 8) "
            "AS probability FROM scored"
        ),
        "importance_table": (
            f"{log}, per AS (SELECT p_brand AS feature, CAST(customer_id % 5 AS INT) AS fold, "
            "CAST(SUM(quantity) AS DOUBLE) AS v FROM log JOIN part ON product_id = p_partkey "
            "GROUP BY 1, 2), "
            "i AS (SELECT feature, AVG(v) AS importance FROM per WHERE v > 0 GROUP BY feature "
            "HAVING COUNT(*) = (SELECT COUNT(DISTINCT fold) FROM per)) SELECT feature, "
            "ROUND(importance, 8) AS importance, "
            "ROUND(importance / SUM(importance) OVER (), 8) AS importance_normalized, "
            "ROUND(SUM(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) "
            "/ SUM(importance) OVER (), 8) AS cumulative_importance FROM i "
            "ORDER BY importance DESC, feature LIMIT 10"
        ),
    }
