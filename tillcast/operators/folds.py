"""Stratified, shuffled, seeded folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: leading hex digits of the hash that make up a bucket.
BUCKET_DIGITS = 3


def stratified_folds(
    rows: DataFrame,
    folds: int = 10,
    seed: int = 0,
    key: str = "customer_id",
    label: str = "label",
) -> DataFrame:
    """Add ``fold``: each class is dealt out in hash order, so its sizes differ by one at most.

    The rank within a class is the start of the row's hash bucket plus the rank in
    the bucket; no task sorts a whole class.
    """
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    hashed = rows.withColumn("_hash", mixed).withColumn(
        "_bucket", F.substring("_hash", 1, BUCKET_DIGITS)
    )
    before = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per class and bucket: 4096 rows for each label value.
    starts = (
        hashed.groupBy(label, "_bucket")
        .count()
        .select(label, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    in_bucket = Window.partitionBy(label, "_bucket").orderBy("_hash", key)
    rank = F.col("_start") + F.row_number().over(in_bucket) - 1
    return (
        hashed.join(F.broadcast(starts), [label, "_bucket"])
        .withColumn("fold", (rank % folds).cast("int"))
        .select(*[f"`{c}`" for c in rows.columns], "fold")
    )
