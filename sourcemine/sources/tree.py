"""Folder trees: a listing by levels, then contents, both spread over all tasks.

Spark's own file sources leave out names that start with ``_`` or ``.`` and
empty files, all of which count here.  The folder has to be visible to every
executor.  A corpus that is a table already needs none of this.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sourcemine import fixed_values as fixed
from sourcemine import schemas
from sourcemine.storage import new_scratch_path

LIST_FLUSH_ROWS = 10_000
READ_FLUSH_BYTES = 16 << 20
BYTES_PER_READ_TASK = 64 << 20


def _shown(name: bytes) -> str:
    return name.decode("utf-8", "backslashreplace")


def _holds(directory: bytes, name: str) -> bool:
    return os.path.isfile(os.path.join(directory, name.encode()))


def _is_environment(directory: bytes) -> bool:
    return _holds(directory, fixed.ENV_CONFIG) and any(
        _holds(directory, interpreter) for interpreter in fixed.ENV_INTERPRETERS
    )


def _is(check, **options) -> bool:
    try:
        return check(**options)
    except OSError:
        return False


def _size(entry: os.DirEntry) -> int:
    try:
        return entry.stat().st_size
    except OSError:
        return 0


def _list_directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subdirectories and sources of each directory; an unreadable one is passed over."""
    schema = to_arrow_schema(schemas.TREE_LISTING)
    suffix = fixed.PYTHON_SUFFIX.encode()
    rows: list[dict] = []
    for batch in batches:
        for directory in batch.column(0).to_pylist():
            try:
                entries = os.scandir(directory)
            except OSError:
                continue
            with entries:
                for entry in entries:
                    is_dir = _is(entry.is_dir)
                    if is_dir:
                        wanted = not entry.is_symlink() and not _is_environment(entry.path)
                    else:
                        wanted = entry.name.endswith(suffix) and _is(entry.is_file)
                    if not wanted:
                        continue
                    rows.append(
                        {
                            "raw": entry.path,
                            "path": _shown(entry.path),
                            "dir": _shown(directory),
                            "name": _shown(entry.name),
                            "is_dir": is_dir,
                            "size": 0 if is_dir else _size(entry),
                        }
                    )
                    if len(rows) >= LIST_FLUSH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Source files below ``root``; environments are never entered, links not followed.

    Each level of the tree is one job whose directories are dealt out over the
    tasks, so a subtree that holds most of the files is not one task's work.
    """
    target = new_scratch_path(spark, "tree")
    cores = spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(bytearray(os.fsencode(root)),)], "raw binary")
    width, levels = 1, []
    while width:
        levels.append(f"{target}/level={len(levels)}")
        (
            frontier.repartition(min(width, 4 * cores), "raw")
            .mapInArrow(_list_directories, schemas.TREE_LISTING)
            .write.parquet(levels[-1])
        )
        below = spark.read.schema(schemas.TREE_LISTING).parquet(levels[-1]).filter("is_dir")
        frontier = below.select("raw")
        width = frontier.count()
    listing = spark.read.schema(schemas.TREE_LISTING).parquet(*levels)
    return listing.filter(~F.col("is_dir")).drop("is_dir")


def _read_files(repo: str):
    schema = to_arrow_schema(schemas.SOURCE_FILES_RAW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                row = {"repo": repo, "path": _shown(raw), "content": None, "error": None}
                try:
                    with open(raw, "rb") as file:
                        row["content"] = file.read()
                except FileNotFoundError:
                    continue
                except OSError as problem:
                    row["error"] = f"{type(problem).__name__}: {problem.strerror}"
                rows.append(row)
                held += len(row["content"] or b"") + 64
                if held >= READ_FLUSH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Undecoded source files of a tree.  Tasks are sized by the listed bytes."""
    listing = list_tree(spark, root)
    total = listing.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // BYTES_PER_READ_TASK))
    repo = os.path.basename(os.path.normpath(root))
    return (
        listing.select("raw")
        .repartition(tasks, "raw")
        .mapInArrow(_read_files(repo), schemas.SOURCE_FILES_RAW)
    )
