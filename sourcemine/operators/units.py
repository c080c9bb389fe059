"""Tables over parsed files: definitions, methods, errors and counts.

All of a file's definitions leave the parser in one row, so everything that
concerns a single file is a narrow expression here: nothing in this module
shuffles but the one-row totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code_units(parsed: DataFrame) -> DataFrame:
    """One row per definition, every definition of a repeated name included.

    A file without definitions keeps one row without a ``kind``; ``pos`` is 0
    once per file.  The table thus holds all that one parse found.
    """
    return parsed.select("repo", "path", "error", F.posexplode_outer("units").alias("pos", "unit")).select(
        "repo", "path", "error", F.coalesce("pos", F.lit(0)).alias("pos"), "unit.*"
    )


def last_units(units: DataFrame) -> DataFrame:
    """Last definition of a name in its file; an earlier class goes with its methods."""
    return units.filter("is_last")


def functions(units: DataFrame) -> DataFrame:
    return units.filter(F.col("kind") == "function").select(
        "repo", "path", "name", "line", "code", "is_last", "counts", "counts_error"
    )


def methods(units: DataFrame) -> DataFrame:
    """One row per method of a class, in source order, repeated names included."""
    return (
        units.filter(F.col("kind") == "class")
        .select(
            "repo",
            "path",
            F.col("name").alias("class_name"),
            F.col("line").alias("class_line"),
            F.col("code").alias("class_code"),
            F.posexplode(F.arrays_zip("methods", "method_code")).alias("pos", "item"),
        )
        .select(
            "repo",
            "path",
            "class_name",
            "class_line",
            "class_code",
            "pos",
            F.col("item.methods.name").alias("method"),
            F.concat_ws(".", "class_name", "item.methods.name").alias("name"),
            F.col("item.methods.line").alias("line"),
            F.col("item.method_code").alias("code"),
        )
    )


def parse_errors(files: DataFrame) -> DataFrame:
    """Of parsed files or of ``code_units``: a failed file has one row in both."""
    return files.filter(F.col("error").isNotNull()).select("repo", "path", "error")


def _last_of(kind: str):
    return F.filter("units", lambda unit: unit["is_last"] & (unit["kind"] == kind))


def units_per_file(parsed: DataFrame) -> DataFrame:
    """Distinct function and class names of each file that parsed."""
    return parsed.filter(F.col("error").isNull()).select(
        "repo",
        "path",
        F.size(_last_of("function")).alias("n_functions"),
        F.size(_last_of("class")).alias("n_classes"),
    )


def discovery_summary(units: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of totals over ``code_units`` and the candidates made of them."""
    names = ["files_scanned", "files_failed", "functions_found", "methods_found", "candidates"]
    of_files = [F.col("pos") == 0, F.col("error").isNotNull(), *[F.lit(False)] * 3]
    of_candidates = [
        *[F.lit(False)] * 2,
        F.col("kind") == "function",
        F.col("kind") == "method",
        F.lit(True),
    ]

    def totals(rows: DataFrame, flags: list) -> DataFrame:
        return rows.agg(*[F.count_if(flag).alias(name) for flag, name in zip(flags, names)])

    both = totals(units, of_files).union(totals(candidates, of_candidates))
    return both.agg(*[F.sum(name).alias(name) for name in names])


def target_count() -> Column:
    """Functions and methods that a unit brings into the run, before names meet."""
    found = F.when(F.col("kind") == "function", F.lit(1)).otherwise(F.size("methods"))
    return F.when(F.col("is_last"), found).otherwise(0)


def count_targets(units: DataFrame) -> int:
    """Functions and methods in a table of units, from its key columns alone."""
    return units.agg(F.coalesce(F.sum(target_count()), F.lit(0))).first()[0]
