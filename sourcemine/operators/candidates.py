"""Candidates: one row per ``(repo, name)``, the last file in path order wins.

Input is the table of last definitions per file, after the score filter when
that is on, so that a unit which the filter dropped never overwrites another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcemine.operators.key_filter import without_keys
from sourcemine.storage import materialize

COLUMNS = ("repo", "name", "kind", "path", "line", "method", "class_code", "code")


def function_candidates(units: DataFrame) -> DataFrame:
    """One pass: the map side keeps one row per name before anything is shuffled,
    so a name that fills a third of the table reaches its reducer as a row per task."""
    return (
        units.filter(F.col("kind") == "function")
        .groupBy("repo", "name")
        .agg(F.max(F.struct("path", "line", "code")).alias("winner"))
        .select(
            "repo",
            "name",
            F.lit("function").alias("kind"),
            "winner.path",
            "winner.line",
            F.lit(None).cast("string").alias("method"),
            F.lit(None).cast("string").alias("class_code"),
            "winner.code",
        )
    )


def late_function_candidates(units: DataFrame) -> DataFrame:
    """The same over materialized ``units``: keys decide, and the texts of those that
    lose are filtered out where they lie.  A text is neither aggregated nor sorted."""
    functions = units.filter(F.col("kind") == "function")
    keys = functions.select("repo", "path", "name")
    last = keys.groupBy("repo", "name").agg(F.max("path").alias("last"))
    same = [F.col(f"k.{key}").eqNullSafe(F.col(f"l.{key}")) for key in ("repo", "name")]
    decided = keys.alias("k").join(last.alias("l"), same).select("k.*", (F.col("path") != F.col("last")).alias("drop"))
    kept = without_keys(functions, materialize(decided, "decided-functions"), ["repo", "path", "name"])
    return kept.select(
        "repo",
        "name",
        "kind",
        "path",
        "line",
        F.lit(None).cast("string").alias("method"),
        F.lit(None).cast("string").alias("class_code"),
        "code",
    )


def method_winners(units: DataFrame) -> DataFrame:
    """Keys only: which class of which file supplies each ``Class.method``."""
    keys = (
        units.filter(F.col("kind") == "class")
        .select("repo", "path", "name", F.col("line").alias("class_line"), F.posexplode("methods").alias("pos", "m"))
        .select(
            "repo",
            F.concat_ws(".", "name", "m.name").alias("name"),
            F.struct("path", F.col("m.line").alias("line"), "class_line", "pos").alias("place"),
        )
    )
    return (
        keys.groupBy("repo", "name").agg(F.max("place").alias("place")).select("repo", "name", "place.*")
    )


def wanted_classes(units: DataFrame) -> DataFrame:
    """Classes that supply a method, one row each: ``repo, path, class_line, class_code,
    method_code`` and ``wanted``, their methods (``name, line, pos``) among the candidates.

    However many methods a class supplies, its text moves once."""
    wanted = (
        method_winners(units)
        .groupBy("repo", "path", "class_line")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "name", "line"))).alias("wanted"))
    )
    classes = units.filter(F.col("kind") == "class").select(
        "repo",
        "path",
        F.col("line").alias("class_line"),
        F.col("code").alias("class_code"),
        "method_code",
    )
    return classes.join(wanted, ["repo", "path", "class_line"])


def method_candidates(units: DataFrame) -> DataFrame:
    """Two passes over a materialized ``units``: keys decide, then texts are fetched.

    A class text belongs to every method of the class.  Deduplicating rows that
    carry it would shuffle it once per method; here it moves once per class and
    meets its methods behind the last shuffle.
    """
    return (
        wanted_classes(units)
        .select("*", F.explode("wanted").alias("one"))
        .select(
            "repo",
            F.col("one.name").alias("name"),
            F.lit("method").alias("kind"),
            "path",
            F.col("one.line").alias("line"),
            F.substring_index("one.name", ".", -1).alias("method"),
            "class_code",
            F.get("method_code", F.col("one.pos")).alias("code"),
        )
    )


def union_candidates(functions: DataFrame, methods: DataFrame) -> DataFrame:
    """Both tables; on a shared key the right side wins.  Keys decide, so the
    texts of the right side are not moved at all."""
    taken = methods.select(F.col("repo").alias("_repo"), F.col("name").alias("_name"))
    same = F.col("repo").eqNullSafe(F.col("_repo")) & F.col("name").eqNullSafe(F.col("_name"))
    left = functions.select(*COLUMNS).join(taken, same, "left_anti")
    return left.unionByName(methods.select(*COLUMNS))
