"""Jobs: score a month, back-test a month, search parameters, select features."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.operators.folds import stratified_folds
from tillcast.operators.importance import mean_importance, top_features
from tillcast.operators.labels import TOTAL_THRESHOLD, generate_label
from tillcast.operators.metrics import auc, blend, threshold_metrics
from tillcast.operators.prepare import category_counts, high_correlation_columns, preprocess, text_columns
from tillcast.operators.selection import best_single, forward_selection
from tillcast.plans import features as sets
from tillcast.plans.training import (
    FoldResult,
    Learner,
    assemble,
    boosted_trees,
    few_tasks,
    fit,
    fold_vectors,
    out_of_fold,
    random_forest,
    score,
)
from tillcast.session import materialise, scratch, settings, small_table
from tillcast.sources.log import read_labels, read_scores

# Shares of the two members of the blend.
BLEND_WEIGHTS = (0.4, 0.6)
# Fields of a row up to which the code of the features is compiled; Spark's own limit is 100.
COMPILED_FIELDS = "1000"


@dataclass
class Prepared:
    """Numeric train and test rows of a feature set, and how many codes its text features have."""

    train: DataFrame
    test: DataFrame
    features: list[str]
    categories: dict[str, int] = field(default_factory=dict)

    def vectors(self, rows: DataFrame) -> DataFrame:
        return assemble(rows, self.features, self.categories)

    def folds(self, folds: int, seed: int = 0) -> DataFrame:
        return fold_vectors(self.train, self.features, folds, seed, self.categories)


def prepare_month(lines: DataFrame, year_month: str, feature_set: str, **options) -> Prepared:
    """Features of the month before the target and of the target, encoded and imputed.

    The features are written once: the medians, the folds and every model read them.
    """
    previous = sets.months.shift(year_month, -1)
    # Rows of hundreds of aggregates and features are worth compiled code too.
    with settings(lines.sparkSession, spark__sql__codegen__maxFields=COMPILED_FIELDS):
        both = materialise(sets.build(feature_set, lines, [previous, year_month], **options))
    train, test = sets.split(both, year_month)
    names = sets.feature_names(both)
    texts = text_columns(both, names)
    train, test = preprocess(train, test, names)
    return Prepared(train, test, names, category_counts([train, test], texts))


def score_month(
    lines: DataFrame,
    year_month: str,
    feature_set: str = "full",
    learners: Mapping[str, tuple[Learner, float]] | None = None,
    folds: int = 10,
    seed: int = 0,
    keys: DataFrame | None = None,
    **options,
) -> DataFrame:
    """``customer_id, probability`` of the target month from a blend of models.

    ``keys`` limits and completes the output: every key gets a row, with a null
    probability for a customer without history.
    """
    data = prepare_month(lines, year_month, feature_set, **options)
    scores, _ = train_and_blend(data, learners, folds, seed)
    return keys.join(scores, "customer_id", "left") if keys is not None else scores


def default_learners(ensemble: bool = True) -> dict[str, tuple[Learner, float]]:
    if not ensemble:
        return {"trees": (boosted_trees(), 1.0)}
    return {
        "forest": (random_forest(), BLEND_WEIGHTS[0]),
        "trees": (boosted_trees(), BLEND_WEIGHTS[1]),
    }


def train_and_blend(
    data: Prepared,
    learners: Mapping[str, tuple[Learner, float]] | None = None,
    folds: int = 10,
    seed: int = 0,
) -> tuple[DataFrame, dict[str, FoldResult]]:
    learners = learners or default_learners()
    train = data.folds(folds, seed)
    test = materialise(data.vectors(data.test))
    results = {
        name: out_of_fold(train, test, data.features, learner, folds, seed)
        for name, (learner, _) in learners.items()
    }
    if len(results) == 1:
        (result,) = results.values()
        return result.test, results
    weights = {name: weight for name, (_, weight) in learners.items()}
    return blend({n: (r.test, weights[n]) for n, r in results.items()}), results


def evaluate(labels: DataFrame, scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """AUC, precision, recall and F1 of scores, matched to labels by customer.

    A label without a score counts as probability 0; ``unscored`` says how many there are.
    """
    scores = scores.select("customer_id", F.col("probability").alias("_found"))
    scored = materialise(
        labels.select("customer_id", "label")
        .join(scores, "customer_id", "left")
        .withColumn("probability", F.coalesce("_found", F.lit(0.0)))
    )
    unscored = scored.agg(F.count_if(F.col("_found").isNull())).scalar()
    return threshold_metrics(scored, threshold=threshold).select(
        auc(scored).select("auc").scalar().alias("auc"),
        "precision",
        "recall",
        "f1",
        unscored.alias("unscored"),
    )


def evaluate_files(spark: SparkSession, label_path: str, score_path: str) -> DataFrame:
    return evaluate(read_labels(spark, label_path), read_scores(spark, score_path))


def backtest(
    lines: DataFrame,
    year_month: str,
    feature_set: str = "diff",
    threshold: float = TOTAL_THRESHOLD,
    learners: Mapping[str, tuple[Learner, float]] | None = None,
    folds: int = 10,
    seed: int = 0,
    **options,
) -> DataFrame:
    """Score a month whose purchases are known and compare with its labels."""
    data = prepare_month(lines, year_month, feature_set, threshold=threshold, **options)
    scores, _ = train_and_blend(data, learners or default_learners(False), folds, seed)
    return evaluate(generate_label(lines, year_month, threshold), scores)


def draw_parameters(rng: random.Random) -> dict:
    return {
        "depth": rng.randint(2, 8),
        "bins": rng.choice([32, 64, 128]),
        "min_rows": rng.randint(1, 40),
        "feature_share": f"{rng.uniform(0.4, 1.0):.3f}",
        "row_share": round(rng.uniform(0.4, 1.0), 3),
        "step": round(10 ** rng.uniform(-2.0, -0.5), 4),
    }


def rung_plan(trials: int, trees: int, folds: int) -> list[tuple[int, int, int]]:
    """(trials, trees, folds) of each rung: half as many trials, twice as many trees, and a fold
    more in every second rung; the last two trials or fewer have all trees and folds."""
    plan, rung = [], 0
    while trials > 2:
        plan.append((trials, min(trees, 2 << rung), min(folds, 1 + rung // 2)))
        trials, rung = (trials + 1) // 2, rung + 1
    return [*plan, (trials, trees, folds)]


def random_search(
    data: Prepared, trials: int = 50, trees: int = 20, folds: int = 10, seed: int = 0
) -> DataFrame:
    """Seeded random draws of the tree parameters by successive halving.

    All trials of a rung are trained on few trees and scored on few folds, in one pass over the
    rows of these folds, and the better half goes on to the next rung, with more of both.
    One row per trial and rung: rung, trial, parameters, trees, folds, auc out of fold, kept.
    Ties go to the earlier draw.
    """
    rng, rows = random.Random(seed), []
    spark = data.train.sparkSession
    drawn = [draw_parameters(rng) for _ in range(trials)]
    alive = list(range(trials))
    plan = rung_plan(trials, trees, folds)
    # The result is in the driver's hands: nothing written for it needs to stay.
    with scratch(spark):
        train, at_once = few_tasks(data.folds(folds, seed), len(data.features))
        for rung, (_, rounds, used) in enumerate(plan):
            jobs = [(trial, k) for trial in alive for k in range(used)]

            def fitted(job: tuple[int, int], rounds: int = rounds):
                trial, k = job
                return fit(boosted_trees(trees=rounds, **drawn[trial]), train.where(F.col("fold") != k), seed)

            with ThreadPool(at_once) as pool:
                models = dict(zip(jobs, pool.map(fitted, jobs)))
            with scratch(spark):
                scored = materialise(_trial_scores(train, models, alive, used))
                found = {r["trial"]: float(r["auc"] or 0.0) for r in auc(scored, by=["trial"]).collect()}
            order = sorted(alive, key=lambda t: (-found[t], t))
            kept = order[: plan[rung + 1][0]] if rung + 1 < len(plan) else order[:1]
            for t in alive:
                values = [str(drawn[t][k]) for k in sorted(drawn[t])]
                rows.append((rung, t, *values, rounds, used, found[t], t in kept))
            alive = kept
    names = sorted(draw_parameters(random.Random(0)))
    schema = "rung int, trial int, " + ", ".join(f"{n} string" for n in names)
    schema += ", trees int, folds int, auc double, kept boolean"
    return small_table(spark, rows, schema).orderBy(F.desc("rung"), F.desc("auc"), "trial")


def _trial_scores(train: DataFrame, models: dict, trials: Sequence[int], folds: int) -> DataFrame:
    """``trial, label, probability`` of the rows of the first folds, each fold scored in one pass."""
    out = None
    for k in range(folds):
        rows = train.where(F.col("fold") == k)
        for t in trials:
            rows = score(rows, models[t, k], f"p{t}")
        each = F.array(*[F.struct(F.lit(t).alias("trial"), F.col(f"p{t}").alias("probability")) for t in trials])
        part = rows.select("label", F.inline(each))
        out = part if out is None else out.unionByName(part)
    return out


def best_parameters(search: DataFrame) -> dict[str, str]:
    """The draw that the last rung keeps."""
    row = search.where("kept").orderBy(F.desc("rung")).first().asDict()
    return {k: row[k] for k in draw_parameters(random.Random(0))}


def select_features(
    data: Prepared,
    n: int = 50,
    threshold: float | None = 0.9,
    learner: Learner | None = None,
    folds: int = 3,
    seed: int = 0,
) -> list[str]:
    """The ``n`` most important features, after dropping highly correlated ones."""
    names = list(data.features)
    if threshold is not None:
        dropped = set(high_correlation_columns(data.train, threshold, names))
        names = [c for c in names if c not in dropped]
    train = fold_vectors(data.train, names, folds, seed, data.categories)
    result = out_of_fold(
        train, train.drop("fold").limit(0), names, learner or random_forest(), folds, seed
    )
    return top_features(mean_importance(result.importance), n)


def select_univariate(data: Prepared, n: int = 50) -> list[str]:
    """The ``n`` features that tell the classes apart best one by one (ANOVA F-test)."""
    return best_single(data.train, data.features, n)


def select_subset(data: Prepared, n: int = 10, folds: int = 10, seed: int = 0) -> DataFrame:
    """Features that naive Bayes does best with out of fold, added one at a time."""
    train = materialise(stratified_folds(data.train, folds, seed))
    return forward_selection(train, data.features, n)


def multi_month_training(
    lines: DataFrame, feature_set: str, year_months: Sequence[str], **options
) -> DataFrame:
    """Training rows of several months, appended; one pass over the lines."""
    return sets.build(feature_set, lines, year_months, **options)
