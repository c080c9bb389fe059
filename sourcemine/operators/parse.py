"""Python sources to definitions: one Arrow stage, one parse per file, no shuffle."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sourcemine import schemas
from sourcemine.functions import text as text_rules
from sourcemine.operators.measures import LineFacts, measure

# A batch goes back to the JVM once it holds this much text, so the memory of a
# worker follows the largest file and not the number of rows in a batch.
FLUSH_CHARS = 8 << 20

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


class _Segments:
    """Cuts the text of a node out of its file; columns count UTF-8 bytes."""

    def __init__(self, text: str):
        self.lines = text.split("\n")

    def cut(self, node: ast.stmt) -> str:
        first = self.lines[node.lineno - 1].encode()
        if node.lineno == node.end_lineno:
            return first[node.col_offset : node.end_col_offset].decode()
        last = self.lines[node.end_lineno - 1].encode()[: node.end_col_offset]
        middle = self.lines[node.lineno : node.end_lineno - 1]
        return "\n".join([first[node.col_offset :].decode(), *middle, last.decode()])


def parse_source(text: str, with_counts: bool = False) -> list[dict]:
    """Top-level functions and classes of one file, in source order."""
    tree = ast.parse(text)
    segments = _Segments(text)
    facts, facts_error = None, None
    if with_counts:
        try:
            facts = LineFacts(text)
        except Exception as error:  # noqa: BLE001 - an unmeasured unit is kept, not lost
            facts_error = f"{type(error).__name__}: {error}"
    units = []
    last: dict[tuple[str, str], dict] = {}
    for node in tree.body:
        if not isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            continue
        code = segments.cut(node)
        if not code:
            continue
        is_class = isinstance(node, ast.ClassDef)
        members = [item for item in node.body if isinstance(item, _FUNCTIONS)] if is_class else []
        counts, counts_error = None, facts_error
        if facts is not None:
            try:
                counts = measure(node, facts)
            except Exception as error:  # noqa: BLE001
                counts_error = f"{type(error).__name__}: {error}"
        unit = {
            "kind": "class" if is_class else "function",
            "name": node.name,
            "line": node.lineno,
            "is_last": False,
            "code": code,
            "methods": [{"name": item.name, "line": item.lineno} for item in members],
            "method_code": [segments.cut(item) for item in members],
            "counts": counts,
            "counts_error": counts_error,
        }
        units.append(unit)
        last[unit["kind"], unit["name"]] = unit
    for unit in last.values():
        unit["is_last"] = True
    return units


def _parse_batches(with_counts: bool):
    schema = to_arrow_schema(schemas.PARSED_FILES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warnings.simplefilter("ignore")
        rows: list[dict] = []
        held = 0
        for batch in batches:
            repo, path, content, failed = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                error, units = failed[i].as_py(), []
                text = content[i].as_py()
                if error is None and text is None:
                    error = "no content"
                if error is None:
                    try:
                        units = parse_source(text, with_counts)
                    except Exception as problem:  # noqa: BLE001 - a bad file fails alone
                        error = f"{type(problem).__name__}: {problem}"
                rows.append(
                    {
                        "repo": repo[i].as_py(),
                        "path": path[i].as_py(),
                        "error": error,
                        "units": units,
                    }
                )
                held += sum(len(unit["code"]) for unit in units) + 64
                if held >= FLUSH_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def parse_files(files: DataFrame, with_counts: bool = False) -> DataFrame:
    """One row per file with its definitions, or with the reason why it has none.

    ``files`` has ``repo, path, content`` and, from the decode step, ``error``.
    ``with_counts`` adds what the maintainability score needs.
    """
    error = F.col("error") if "error" in files.columns else F.lit(None)
    return files.select(
        F.coalesce("repo", F.lit("")).alias("repo"),
        "path",
        text_rules.normalize_newlines(F.col("content")).alias("content"),
        error.cast("string").alias("error"),
    ).mapInArrow(_parse_batches(with_counts), schemas.PARSED_FILES)
