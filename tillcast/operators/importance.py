"""Feature importance tables; their size is the number of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_importance(per_fold: DataFrame) -> DataFrame:
    """Mean over the folds of ``feature, fold, importance`` rows."""
    return per_fold.groupBy("feature").agg(F.avg("importance").alias("importance"))


def in_all_folds(per_fold: DataFrame) -> DataFrame:
    """Only the features that every fold used, as an inner join of the folds keeps them."""
    folds = per_fold.select("fold").distinct().agg(F.count(F.lit(1)).alias("n"))
    used = per_fold.where(F.col("importance") > 0)
    kept = used.groupBy("feature").agg(F.count_distinct("fold").alias("_n"))
    kept = kept.where(F.col("_n") == folds.scalar()).select("feature")
    return used.join(kept, "feature", "left_semi")


def ranked(importance: DataFrame, n: int = 20) -> DataFrame:
    """Top ``n`` features with normalised and cumulative importance."""
    everything = Window.partitionBy()
    best_first = Window.orderBy(F.desc("importance"), "feature").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    share = F.try_divide(F.col("importance"), F.sum("importance").over(everything))
    return (
        importance.withColumn("importance_normalized", share)
        .withColumn("cumulative_importance", F.sum("importance_normalized").over(best_first))
        .orderBy(F.desc("importance"), "feature")
        .limit(n)
    )


def top_features(importance: DataFrame, n: int) -> list[str]:
    rows = importance.orderBy(F.desc("importance"), "feature").limit(n).collect()
    return [r["feature"] for r in rows]
