"""Arrow batches of bounded bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 16 << 20


def bounded(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on the session cuts Arrow batches at ``most`` bytes, or at its own lower limit.

    Rows alone do not bound a batch of texts. A row of more bytes is a batch of its own. The
    setting is read when a plan runs, which for a returned table is after the call.
    """
    now = spark.conf.get(_SETTING).rstrip("bB")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(_SETTING, str(most))


def keyed(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a key in one partition, next to each other; ``order`` begins with the key."""
    return rows.repartition(order[0]).sortWithinPartitions(*order)
