"""Outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_predictions(scores: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write ``customer_id, probability`` as a folder of files, in the order of customers."""
    scores.select("customer_id", "probability").orderBy("customer_id").write.mode("overwrite").option(
        "header", True
    ).format(fmt).save(path)


def write_transactions(lines: DataFrame, path: str) -> None:
    """Write a log as Parquet in date order, so that month filters skip most files' row groups."""
    lines.repartitionByRange("order_date").sortWithinPartitions("order_date").write.mode(
        "overwrite"
    ).parquet(path)
