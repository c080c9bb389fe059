"""Where intermediate tables go, and how wide a stage should be."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}
_made: dict[str, list[str]] = {}
_inside: ContextVar[tuple[list[str], ...]] = ContextVar("inside", default=())

# Rows per Arrow batch where a row is a whole file or a whole prompt.  Spark's
# own default of 10,000 such rows would be gigabytes in one Python worker.
TEXT_ROWS_PER_BATCH = 256
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
WRITERS_SETTING = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, int | str]) -> Iterator[None]:
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def text_batches(spark: SparkSession):
    """Small Arrow batches for the jobs that start inside."""
    return _settings(spark, {BATCH_SETTING: TEXT_ROWS_PER_BATCH})


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    that has no such setting gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="sourcemine-")
    return _local_scratch[app]


def new_scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/sourcemine/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    for paths in _inside.get():
        paths.append(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> int:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables that this application has made so far, and
    only those.  Results that are still read from them must be written before."""
    return _delete(spark, _made.pop(spark.sparkContext.applicationId, []))


@contextmanager
def passing(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Delete the intermediate tables that are made inside, but those with a label of
    ``kept``, from which the result is read.  What ran before or beside is not touched."""
    paths: list[str] = []
    _inside.set((*_inside.get(), paths))
    try:
        yield
    finally:
        _inside.set(_inside.get()[:-1])
    gone = [path for path in paths if path.rsplit("/", 1)[1].rsplit("-", 1)[0] not in kept]
    _delete(spark, gone)
    own = _made.get(spark.sparkContext.applicationId, [])
    for path in gone:
        if path in own:
            own.remove(path)


def write_table(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """Write a table that belongs to one job and read it back.

    A second attempt replaces the first.  ``by`` is a column of a few values
    that readers choose from: each value gets files of its own, written side
    by side, without the sort that a partitioned write would otherwise add.
    """
    spark = df.sparkSession
    writer = df.write.mode("overwrite")
    with text_batches(spark), _settings(spark, {WRITERS_SETTING: 8 if by else 0}):
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``write_table`` to the scratch folder.

    The costly stage before it then runs once however many readers follow,
    lost executors do not bring it back, readers prune columns, and the
    planner knows the real size when it picks a join.
    """
    return write_table(df, new_scratch_path(df.sparkSession, label), by)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a CPU-heavy stage at least one partition per core.

    An input that is wide already is left alone.  A narrow one is only ever
    split further, so no partition grows, however large the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if partition_count(df) >= cores else df.repartition(cores, *keys)


def partition_count(df: DataFrame) -> int:
    """Partitions of the plan as written.  Adaptive execution would have to run
    the shuffles below to answer, so a copy is planned without it."""
    with _settings(df.sparkSession, {"spark.sql.adaptive.enabled": "false"}):
        return df.select("*").rdd.getNumPartitions()
