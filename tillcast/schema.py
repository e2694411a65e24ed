"""The transaction log: one row per order line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("order_date", T.TimestampNTZType()),
        T.StructField("price", T.DecimalType(18, 4)),
        T.StructField("customer_id", T.LongType()),
        T.StructField("country", T.StringType()),
        T.StructField("total", T.DecimalType(18, 4)),
    ]
)

MEASURES = ["quantity", "price", "total"]

# Purchase order of the lines of a log without line numbers. Rows that tie on
# every column are equal, so their order among themselves does not matter.
LOG_ORDER = [
    "order_date",
    "order_id",
    "product_id",
    "quantity",
    "price",
    "total",
    "country",
    "description",
]


def with_customer(lines: DataFrame) -> DataFrame:
    """Lines with a customer: what groups by customer skips the others."""
    return lines.where(F.col("customer_id").isNotNull())


def clean(lines: DataFrame) -> DataFrame:
    """Turn NaN into null: Spark's aggregates skip nulls but not NaN."""
    floats = {f.name for f in lines.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return lines.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c)
            for c in lines.columns
        ]
    )
