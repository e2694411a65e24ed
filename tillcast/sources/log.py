"""CSV and Parquet inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.schema import LOG_SCHEMA, clean
from tillcast.sources import csv_files

KEY_SCHEMA = T.StructType([T.StructField("customer_id", T.LongType())])
LABEL_SCHEMA = T.StructType([*KEY_SCHEMA, T.StructField("label", T.IntegerType())])
SCORE_SCHEMA = T.StructType([*KEY_SCHEMA, T.StructField("probability", T.DoubleType())])


def read_transactions(spark: SparkSession, path: str, malformed: str = "fail") -> DataFrame:
    """Transaction log from CSV files with headers; ``path`` may be a pattern.

    Each file's columns are taken by the names in its own header. Price and total are decimals
    of four places, so that sums do not depend on the order of addition. ``NaN`` and blanks are
    null. A line of another number of fields, or with a value that is not of its column's type
    or has further places, is an error; with ``malformed='aside'`` such lines are left out, and
    ``malformed_transactions`` gives them.
    """
    return csv_files.read(spark, path, LOG_SCHEMA, malformed)


def malformed_transactions(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, reason, record`` of the lines that ``read_transactions`` leaves out."""
    return csv_files.malformed_lines(spark, path, LOG_SCHEMA)


def read_transactions_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The same log after ``write_transactions``."""
    return clean(spark.read.parquet(path))


def parse_dates(raw: DataFrame, column: str = "order_date") -> DataFrame:
    """Turn a text date column into a naive timestamp."""
    return raw.withColumn(column, F.to_timestamp_ntz(F.col(column)))


def _whole(spark: SparkSession, path: str, fields: T.StructType) -> DataFrame:
    found = csv_files.read(spark, path, fields)
    if missing := [f.name for f in fields if f.name not in found.columns]:
        raise ValueError(f"no file of {path} has a column {missing[0]}")
    return found


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """Customers to score, from a submission template."""
    return _whole(spark, path, KEY_SCHEMA)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path, LABEL_SCHEMA)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path, SCORE_SCHEMA)
