"""Feature selection from sufficient statistics: one by one, and as a growing subset.

One pass gives count, mean and variance of every feature by fold and class. The F-test is a
formula of these. So is a Gaussian naive Bayes model of any subset: its score is the sum of one
term for each feature, so a row's terms, from the statistics of the other folds, are computed
once, and a candidate subset is scored by a sum, with no model fitted again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.session import materialise, scratch, small_table

# Least variance of a feature in a class.
FLOOR = 1e-9


def _long(rows: DataFrame, features: Sequence[str], *carry: str) -> DataFrame:
    """``carry, position, value``: a row for each feature, nulls included."""
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    return rows.select(*carry, F.posexplode(values).alias("position", "value"))


def _statistics(rows: DataFrame, features: Sequence[str], *by: str) -> DataFrame:
    """``by, position, n, mean, variance`` of the values that are set."""
    return (
        _long(rows, features, *by)
        .groupBy(*by, "position")
        .agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))
    )


def f_statistics(rows: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """``feature, f``: variance between the classes over variance inside them, per feature.

    Null where no value varies inside its class, or a feature has values in one class only.
    """
    groups = _statistics(rows, features, label).where("n > 0")
    total = groups.groupBy("position").agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("classes"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre"),
    )
    away = F.col("mean") - F.col("centre")
    sums = (
        groups.join(total, "position")
        .groupBy("position", "rows", "classes")
        .agg(
            F.sum(F.col("n") * away * away).alias("between"),
            F.sum(F.col("n") * F.col("variance")).alias("inside"),
        )
    )
    names = F.array(*[F.lit(c) for c in features])
    between = F.try_divide(F.col("between"), F.col("classes") - 1)
    inside = F.try_divide(F.col("inside"), F.col("rows") - F.col("classes"))
    return sums.select(F.get(names, F.col("position")).alias("feature"), F.try_divide(between, inside).alias("f"))


def best_single(rows: DataFrame, features: Sequence[str], n: int = 50) -> list[str]:
    """The ``n`` features of the greatest F, in the order of F; ties go to the earlier one."""
    found = {r["feature"]: r["f"] for r in f_statistics(rows, features).where("f IS NOT NULL").collect()}
    return sorted(found, key=lambda c: (-found[c], list(features).index(c)))[:n]


def _without(groups: list, fold: int) -> dict:
    """Mean and variance by (class, position) of all folds but one."""
    rest, sums = [g for g in groups if g["fold"] != fold], {}
    for g in rest:
        n, s = sums.get((g["label"], g["position"]), (0, 0.0))
        sums[g["label"], g["position"]] = n + g["n"], s + g["n"] * (g["mean"] or 0.0)
    squares = dict.fromkeys(sums, 0.0)
    for g in rest:
        n, s = sums[g["label"], g["position"]]
        if g["n"]:
            squares[g["label"], g["position"]] += g["n"] * (g["variance"] + (g["mean"] - s / n) ** 2)
    return {k: (s / n, max(FLOOR, squares[k] / n)) for k, (n, s) in sums.items() if n}


def log_odds_terms(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """``label, prior, terms`` of each row: what each feature adds to the log odds of class 1,
    by a Gaussian naive Bayes model of the other folds. A value that is null, or of a feature
    that one class lacks there, adds nothing.

    The statistics that reach the driver are of a row for each fold, class and feature.
    """
    groups = _statistics(train, features, "fold", "label").collect()
    sizes = {(r["fold"], r["label"]): r["count"] for r in train.groupBy("fold", "label").count().collect()}
    table = []
    for fold in sorted({f for f, _ in sizes}):
        known = _without(groups, fold)
        counts = [sum(n for (f, label), n in sizes.items() if f != fold and label == c) for c in (0, 1)]
        prior = math.log(counts[1] / counts[0]) if all(counts) else 0.0
        both = [i if all((c, i) in known for c in (0, 1)) else None for i in range(len(features))]
        cells = [[None if i is None else known[c, i][k] for i in both] for c in (0, 1) for k in (0, 1)]
        table.append((fold, prior, *cells))
    kinds = "fold int, prior double, m0 array<double>, v0 array<double>, m1 array<double>, v1 array<double>"
    # A row for each fold.
    model = F.broadcast(small_table(train.sparkSession, table, kinds))
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("x")

    def distance(x, i, c: int):
        away = x - F.get(f"m{c}", i)
        return F.log(F.get(f"v{c}", i)) + away * away / F.get(f"v{c}", i)

    terms = F.transform("x", lambda x, i: F.coalesce((distance(x, i, 0) - distance(x, i, 1)) / 2, F.lit(0.0)))
    rows = train.select("label", F.col("fold").cast("int").alias("fold"), values).join(model, "fold")
    return rows.select("label", "prior", terms.alias("terms"))


def forward_selection(train: DataFrame, features: Sequence[str], n: int = 10) -> DataFrame:
    """``step, feature, balanced_accuracy`` of a subset that grows by the best feature each time.

    A subset's figure is the mean of the two classes' shares that naive Bayes models of it put
    right out of fold. Of equal candidates the earlier one is taken, and the subset stops growing
    when none is better. A step is one aggregate over the rows' terms for all candidates.
    """
    spark, chosen, steps = train.sparkSession, [], []
    with scratch(spark):
        rows = materialise(log_odds_terms(train, features))
        counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        zero, one = counts.get(0, 0), counts.get(1, 0)
        best = -1
        while len(chosen) < min(n, len(features)):
            base = F.col("prior")
            for i in chosen:
                base = base + F.get("terms", F.lit(i))
            said = base + F.col("term") > 0
            found = (
                rows.select("label", "prior", "terms", F.posexplode("terms").alias("position", "term"))
                .where(~F.col("position").isin(chosen) if chosen else F.lit(True))
                .groupBy("position")
                .agg(
                    F.count_if((F.col("label") == 1) & said).alias("right_one"),
                    F.count_if((F.col("label") == 0) & ~said).alias("right_zero"),
                )
                .collect()
            )
            # Whole numbers, so that equal subsets are equal.
            scored = [(r["right_one"] * zero + r["right_zero"] * one, -r["position"]) for r in found]
            if not scored or max(scored)[0] <= best:
                break
            best, position = max(scored)
            chosen.append(-position)
            share = best / (2 * zero * one) if zero and one else 0.0
            steps.append((len(chosen), features[-position], share))
    return small_table(spark, steps, "step int, feature string, balanced_accuracy double")
