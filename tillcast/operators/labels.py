"""Monthly purchase labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions import months
from tillcast.schema import with_customer

TOTAL_THRESHOLD = 300


def label_months(
    lines: DataFrame, year_months: Sequence[str], threshold: float = TOTAL_THRESHOLD
) -> DataFrame:
    """Label rows ``customer_id, year_month, total, label`` for several months.

    A month's rows are the customers with any line before it; the label says
    whether their spend within it exceeds the threshold. One aggregation of the
    lines serves all months, without a join.
    """
    year_months = sorted(year_months)
    spend = [
        F.coalesce(
            F.sum(F.when(months.within("order_date", m, m), F.col("total"))).cast("double"),
            F.lit(0.0),
        ).alias(f"spend_{i}")
        for i, m in enumerate(year_months)
    ]
    customers = (
        with_customer(lines)
        .where(months.before("order_date", months.shift(year_months[-1], 1)))
        .groupBy("customer_id")
        .agg(F.min("order_date").alias("first_date"), *spend)
    )
    rows = [
        F.struct(
            F.lit(m).alias("year_month"),
            months.before("first_date", m).alias("known"),
            F.col(f"spend_{i}").alias("total"),
        )
        for i, m in enumerate(year_months)
    ]
    return (
        customers.select("customer_id", F.inline(F.array(*rows)))
        .where("known")
        .select("customer_id", "year_month", "total", exceeds("total", threshold).alias("label"))
    )


def exceeds(column: str | Column, threshold: float) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return (value > F.lit(threshold)).cast("int")


def generate_label(
    lines: DataFrame, year_month: str, threshold: float = TOTAL_THRESHOLD
) -> DataFrame:
    return label_months(lines, [year_month], threshold)


def label_balance(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("customers"))
