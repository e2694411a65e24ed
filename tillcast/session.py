"""Session set-up and lineage cutting."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Folders of written tables, by the scope that removes them; the first is the session's own.
_written: list[list[str]] = [[]]


def get_session(app: str = "tillcast", master: str | None = None, **conf: str) -> SparkSession:
    """A session for local runs and tests; a cluster brings its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # Merging period arrays is much work for few bytes: keep the cores busy.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a plain local master, where one machine does all the work, may do without it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tillcast-")
        # Known to the context from here on: the setting itself is fixed once a session runs.
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder; what is written there goes as ``materialise`` says."""
    path = f"{shared_folder(spark)}/tillcast-{uuid.uuid4().hex}"
    _written[-1].append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and go on from the files.

    The result no longer depends on the executors that computed it, and later
    passes read only the columns they need. The files go when the innermost
    ``scratch`` block ends, or else with the session.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what is materialised in the block, once its results have been computed."""
    _written.append([])
    try:
        yield
    finally:
        _remove(spark, _written.pop())


def handed_on(df: DataFrame) -> DataFrame:
    """As ``materialise``, but what was shuffled for ``df`` leaves the disk once it is written.

    For long tables that are read once or twice: the files are as small as is cheap.
    """
    path = new_path(df.sparkSession)
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session inside the block, ``__`` for a dot; what they were comes back after it."""
    values = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    files = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        where = files(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


@atexit.register
def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _written[0]:
        with contextlib.suppress(Exception):  # the session may be gone by now
            _remove(spark, _written[0])


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A table of few rows from the driver, handed over as Arrow, without Python workers."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = zip(*rows) if rows else [[] for _ in schema]
    table = pa.table({f.name: list(c) for f, c in zip(schema, columns)})
    return spark.createDataFrame(table, schema)
