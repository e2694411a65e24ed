"""CSV files under one pattern, read by the names in their own headers.

Files whose headers agree are read together, and the groups are united by column name, so neither
the order of the columns nor a column that some files lack moves a value. A line is malformed if
its number of fields is not that of its header, or if a value is not of its column's type.
"""

from __future__ import annotations

import csv
from multiprocessing.pool import ThreadPool

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Headers read at the same time; each takes the first bytes of a file.
AT_ONCE = 32
_RAW, _REASON = "_record", "_reason"


def _first_line(spark: SparkSession, file: str) -> str | None:
    hadoop = spark._jvm.org.apache.hadoop
    path, conf = hadoop.fs.Path(file), spark._jsc.hadoopConfiguration()
    stream: JavaObject = path.getFileSystem(conf).open(path)
    try:
        codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        if codec is not None:
            stream = codec.createInputStream(stream)
        java = spark._jvm.java.io
        return java.BufferedReader(java.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files under ``path`` by their first line; files without any line are left out."""
    files = spark.read.text(path).inputFiles()
    with ThreadPool(AT_ONCE) as pool:
        lines = pool.map(lambda file: _first_line(spark, file), files)
    found: dict[str, list[str]] = {}
    for file, line in zip(files, lines):
        if line:
            found.setdefault(line, []).append(file)
    return found


def _names(header: str) -> list[str]:
    names = [name.strip() for name in next(csv.reader([header.removeprefix("﻿")]))]
    if len(set(names)) < len(names):
        raise ValueError(f"a column name is repeated in the header {header!r}")
    return names


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a line: a condition on a plain column is moved down and
    repeats its expression wherever the condition names it, one on a generated column is not."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _read_as(text: Column, kind: T.DataType) -> Column:
    """``known``, the text without blanks and NaN, and ``exact``, the number or time it says."""
    known = F.when(~F.lower(F.trim(text)).isin("nan", ""), F.trim(text))
    # Whole numbers may come as 7.0; digits beyond a decimal's places do not fit.
    number = isinstance(kind, (T.IntegralType, T.DecimalType))
    return F.struct(known.isNotNull().alias("known"), known.try_cast("decimal(38,18)" if number else kind).alias("exact"))


def _typed(found: Column, kind: T.DataType) -> tuple[Column, Column]:
    """A value of ``_read_as`` as ``kind``, and whether it is no such value."""
    exact = found["exact"]
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        value = exact.try_cast(kind)
        return value, found["known"] & (value.isNull() | (exact != value))
    return exact, found["known"] & exact.isNull()


def _lines(spark: SparkSession, path: str, fields: T.StructType) -> DataFrame:
    """Every data line: the typed columns that a header has, _record, _reason, file, block and row."""
    groups = headers(spark, path)
    out = None
    for header, files in groups.items():
        names = _names(header)
        # A pattern of one header is read as it stands; file names are listed only where needed.
        text = spark.read.text(path if len(groups) == 1 else files)
        parsed = text.select(
            F.col("value"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).where((F.col("value") != header) & (F.trim("value") != ""))
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW}
        parsed = _once(parsed, at=F.from_csv("value", _ddl([*names, _RAW]), options))
        own = [f for f in fields if f.name in names]
        typed = [f for f in own if not isinstance(f.dataType, T.StringType)]
        if typed:
            parsed = _once(parsed, **{f"_{fields.names.index(f.name)}": _read_as(F.col("at")[f.name], f.dataType) for f in typed})
        reasons = [F.when(F.col("at")[_RAW].isNotNull(), F.lit("number of fields"))]
        columns = []
        for f in own:
            if f not in typed:
                columns.append(F.col("at")[f.name].alias(f.name))
                continue
            value, wrong = _typed(F.col(f"_{fields.names.index(f.name)}"), f.dataType)
            columns.append(value.alias(f.name))
            reasons.append(F.when(wrong, F.lit(f.name)))
        part = parsed.select(
            *columns, F.col("value").alias(_RAW), F.coalesce(*reasons).alias(_REASON), "file", "block", "row"
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        kinds = [*fields, *[T.StructField(n, T.StringType()) for n in (_RAW, _REASON, "file")]]
        kinds += [T.StructField(n, T.LongType()) for n in ("block", "row")]
        out = spark.createDataFrame([], T.StructType(kinds))
    return out


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)


def read(spark: SparkSession, path: str, fields: T.StructType, malformed: str = "fail") -> DataFrame:
    """The columns of ``fields`` that any file has, by name.

    A malformed line is an error that names file and line, or with ``malformed='aside'`` left
    to ``malformed_lines``. A line that repeats its file's header, and a blank one, is no data.
    """
    if malformed not in ("fail", "aside"):
        raise ValueError("malformed is 'fail' or 'aside'")
    lines = _lines(spark, path, fields)
    good = F.col(_REASON).isNull()
    if malformed == "fail":
        message = F.concat(F.lit("malformed "), F.col(_REASON), F.lit(" in "), "file", F.lit(": "), F.col(_RAW))
        good = F.when(good, True).otherwise(F.raise_error(message).cast("boolean"))
    return lines.where(good).select(*[f.name for f in fields if f.name in lines.columns])


def malformed_lines(spark: SparkSession, path: str, fields: T.StructType) -> DataFrame:
    """``file, line, reason, record`` of the malformed lines; a header is line 1.

    A line's number is its place in its block of the file, after the lines of the blocks before;
    those are counted in a second pass over the files, a row for each block.
    """
    wrong = _lines(spark, path, fields).where(F.col(_REASON).isNotNull())
    text = spark.read.text([f for files in headers(spark, path).values() for f in files])
    numbered = text.select(
        F.col("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    blocks = numbered.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("lines"))
    # As many rows as the file has blocks.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.sum("lines").over(before)
    starts = blocks.select("file", "block", "first", F.coalesce(earlier, F.lit(0)).alias("before"))
    # Lines are found again by their text: equal lines of a file are malformed alike.
    records = wrong.select("file", F.col(_RAW).alias("value"), F.col(_REASON).alias("reason")).distinct()
    return (
        numbered.join(records, ["file", "value"])
        .join(starts, ["file", "block"])
        .select(
            "file",
            (F.col("before") + F.col("row") - F.col("first") + 1).alias("line"),
            "reason",
            F.col("value").alias("record"),
        )
    )

