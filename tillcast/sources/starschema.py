"""Transaction log view of an order / line-item star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tells all lines apart: order and line number alone do not.
ORDER = [
    "order_date",
    "order_id",
    "line_no",
    "product_id",
    "supplier_id",
    "quantity",
    "line_gross",
]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def transactions(
    spark: SparkSession,
    folder: str,
    price: bool = True,
    description: bool = False,
    country: bool = False,
    share: float = 1.0,
) -> DataFrame:
    """Order lines as a transaction log, with the columns of ``ORDER`` kept.

    Ids keep their integer type, so that a window by order reuses the
    partitioning of the join by order. The other tables are joined on demand and
    without a hint: Spark broadcasts one only while it is small. ``share`` below one draws a
    sample of the lines, before any join.
    """
    line = read_table(spark, folder, "lineitem")
    if share < 1.0:
        line = line.sample(share, seed=0)
    head = read_table(spark, folder, "orders")
    log = line
    if price or description:
        part = read_table(spark, folder, "part")
        log = log.join(part, line.l_partkey == part.p_partkey, "left")
    # Last, so that its partitioning is the one that is left.
    log = log.join(head, line.l_orderkey == head.o_orderkey)
    if country:
        customer = read_table(spark, folder, "customer")
        nation = read_table(spark, folder, "nation")
        log = log.join(customer, head.o_custkey == customer.c_custkey, "left").join(
            nation, customer.c_nationkey == nation.n_nationkey, "left"
        )
    discount = F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    columns = [
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_custkey").alias("customer_id"),
        (F.col("l_extendedprice").cast("decimal(12,2)") * discount)
        .cast("decimal(18,4)")
        .alias("total"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_extendedprice").alias("line_gross"),
    ]
    if price:
        columns.append(F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    if description:
        columns.append(F.col("p_name").alias("description"))
    if country:
        columns.append(F.col("n_name").alias("country"))
    return log.select(*columns)


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream as a second log, with times inside the day."""
    return read_table(spark, folder, "events").select(
        F.col("user_id").alias("customer_id"),
        F.col("ts").alias("order_date"),
        F.col("event_id").alias("order_id"),
        F.col("event_type").alias("product_id"),
        F.lit(1).cast("bigint").alias("quantity"),
        F.col("value").cast("decimal(18,4)").alias("price"),
        F.col("value").cast("decimal(18,4)").alias("total"),
    )
