"""Virtual environments in a listing, and files below them.

A listing has ``path`` and, when it covers several trees, ``repo``; trees with
the same relative paths then stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcemine import fixed_values as fixed
from sourcemine.functions import text as text_rules
from sourcemine.operators.key_filter import without_keys
from sourcemine.storage import materialize


def python_files(listing: DataFrame) -> DataFrame:
    """Rows whose path has the (case-sensitive) source suffix, with name and parent."""
    return (
        listing.filter(F.col("path").endswith(fixed.PYTHON_SUFFIX))
        .withColumn("name", text_rules.base_name(F.col("path")))
        .withColumn("dir", text_rules.parent_dir(F.col("path")))
    )


def _tree_key(df: DataFrame) -> list[str]:
    return ["repo"] if "repo" in df.columns else []


def environment_roots(listing: DataFrame, scan_root: str | None = None) -> DataFrame:
    """Directories with a config file and an interpreter.  The scan root is never one.

    One scan of the listing: only marker files pass the suffix filter, and the
    map side keeps two flags a directory, so nothing else is shuffled.
    """
    keys = _tree_key(listing)
    markers = [fixed.ENV_CONFIG, *fixed.ENV_INTERPRETERS]
    found = F.coalesce(*[F.when(F.col("path").endswith("/" + m), F.lit(m)) for m in markers])
    holder = F.substring(F.col("path"), F.lit(1), F.length("path") - F.length("marker") - 1)
    is_config = F.col("marker") == fixed.ENV_CONFIG
    roots = (
        listing.select(*keys, "path", found.alias("marker"))
        .filter("marker IS NOT NULL")
        .groupBy(*keys, holder.alias("dir"))
        .agg(F.bool_or(is_config).alias("config"), F.bool_or(~is_config).alias("interpreter"))
        .filter("config AND interpreter")
        .select(*keys, "dir")
    )
    return roots if scan_root is None else roots.filter(F.col("dir") != scan_root.rstrip("/"))


def prune_environments(files: DataFrame, roots: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Drop every file below an environment.

    Ancestors are taken of distinct directories, not of files, and directories are
    decided on paths alone.  The roots are written first, so the planner knows their
    size and broadcasts them when small; otherwise adaptive execution splits the
    partition of a directory that is above, or around, very many others.  The files
    themselves only pass a filter: their texts are not moved (``without_keys``).
    ``paths`` may hold the paths of ``files`` where those are cheaper to read.
    """
    keys = _tree_key(files)
    known = materialize(roots, "environment-roots").withColumnRenamed("dir", "above")
    located = files.withColumn("dir", text_rules.parent_dir(F.col("path")))
    named = files if paths is None else paths
    directories = named.select(*keys, text_rules.parent_dir(F.col("path")).alias("dir")).distinct()
    directories = materialize(directories, "directories")
    pruned = (
        directories.withColumn("above", F.explode(text_rules.ancestor_dirs(F.col("dir"))))
        .join(known, [*keys, "above"], "left_semi")
        .select(*keys, "dir")
        .distinct()
        .withColumn("drop", F.lit(True))
    )
    decided = directories.join(pruned, [*keys, "dir"], "left").withColumn("drop", F.coalesce("drop", F.lit(False)))
    return without_keys(located, materialize(decided, "decided-dirs"), [*keys, "dir"])
