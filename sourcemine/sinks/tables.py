"""Result tables and the export of harness files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

EXPORTED = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def append_failures(failures: DataFrame, path: str) -> None:
    """Add to the failure report, which outlives a run; one folder per run."""
    failures.write.mode("append").partitionBy("run_id").parquet(path)


def replace_runs(rows: DataFrame, path: str) -> None:
    """Put runs into a table of all runs, one partition for each ``run_id``: those that
    ``rows`` has are replaced whole, all others stay as they are."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").parquet(path)


def _write_files(root: str):
    schema = to_arrow_schema(EXPORTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                folder = os.path.join(root, row["run_id"], row["name"])
                target = os.path.join(folder, row["file_name"])
                result = {"run_id": row["run_id"], "name": row["name"], "file_path": target, "error": None}
                partial = os.path.join(folder, f".{uuid.uuid4().hex}")
                try:
                    if not os.path.abspath(target).startswith(os.path.join(os.path.abspath(root), "")):
                        raise OSError("outside the export folder")
                    os.makedirs(folder, exist_ok=True)
                    with open(partial, "w", encoding="utf-8") as file:
                        file.write(row["code"] or "")
                    os.replace(partial, target)
                except OSError as problem:
                    result["error"] = str(problem)
                done.append(result)
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    return run


def export_files(harnesses: DataFrame, root: str) -> DataFrame:
    """One file per harness in a folder that executors share, and a row on each.

    A file appears whole or not at all and a repeated task writes the same
    bytes again, so lost executors do no harm.  A target outside ``root`` is an
    error of its row.  Lazy: write the result.
    """
    return harnesses.select("run_id", "name", "file_name", F.col("code")).mapInArrow(
        _write_files(root), EXPORTED
    )
