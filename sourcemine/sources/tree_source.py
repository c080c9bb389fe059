"""``spark.read.format("source_tree").load(folder)``: a folder tree as a data source.

Columns are ``repo, path, content, error``.  With a schema of ``repo`` and ``path`` alone,
``spark.read.schema("repo string, path string")``, no file is opened.  Partitions are
planned from directories: the upper levels are listed until there are enough of them,
the rest is listed in the tasks.  Option ``partitions``: how many to aim at (default 64).
Environments are never entered, links not followed, unreadable directories passed over.
The folder has to be visible to every executor.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sourcemine import fixed_values as fixed
from sourcemine import schemas
from sourcemine.sources.tree import READ_FLUSH_BYTES, _is, _is_environment, _shown

PARTITIONS = 64
FLUSH_ROWS = 4096


@dataclass
class Directories(InputPartition):
    """Directories of one task: of some their own files, of others all below them."""

    own: list[bytes]
    below: list[bytes]


def entries(directory: bytes) -> tuple[list[bytes], list[bytes]]:
    """Source files and directories to enter."""
    files, directories = [], []
    try:
        found = os.scandir(directory)
    except OSError:
        return files, directories
    with found:
        for entry in found:
            if _is(entry.is_dir):
                if not entry.is_symlink() and not _is_environment(entry.path):
                    directories.append(entry.path)
            elif entry.name.endswith(fixed.PYTHON_SUFFIX.encode()) and _is(entry.is_file):
                files.append(entry.path)
    return files, directories


class TreeReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        if "path" not in options:
            raise ValueError("source_tree needs a path")
        self.root = os.fsencode(options["path"].removeprefix("file://"))
        self.wanted = int(options.get("partitions", PARTITIONS))
        self.schema = schema

    def partitions(self) -> list[Directories]:
        own, below = [], [self.root]
        # Level by level, so that a chain of single directories is passed.
        while below and len(below) < self.wanted:
            own += below
            below = [d for directory in below for d in entries(directory)[1]]
        n = max(1, min(self.wanted, len(own) + len(below)))
        return [Directories(own[i::n], below[i::n]) for i in range(n)]

    def _paths(self, partition: Directories) -> Iterator[bytes]:
        for directory in partition.own:
            yield from entries(directory)[0]
        waiting = list(partition.below)
        while waiting:
            files, directories = entries(waiting.pop())
            yield from files
            waiting += directories

    def read(self, partition: Directories) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        opened = {"content", "error"} & set(schema.names)
        repo = _shown(os.path.basename(os.path.normpath(self.root)))
        rows, held = [], 0
        for raw in self._paths(partition):
            row = {"repo": repo, "path": _shown(raw), "content": None, "error": None}
            if opened:
                try:
                    with open(raw, "rb") as file:
                        row["content"] = file.read()
                except FileNotFoundError:
                    continue
                except OSError as problem:
                    row["error"] = f"{type(problem).__name__}: {problem.strerror}"
            rows.append({name: row[name] for name in schema.names})
            held += len(row["content"] or b"")
            if held >= READ_FLUSH_BYTES or len(rows) >= FLUSH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> StructType:
        return schemas.SOURCE_FILES_RAW

    def reader(self, schema: StructType) -> TreeReader:
        unknown = set(schema.names) - set(schemas.SOURCE_FILES_RAW.names)
        if unknown:
            raise ValueError(f"source_tree has no {', '.join(sorted(unknown))}")
        return TreeReader(dict(self.options), schema)


def register_source_tree(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)
