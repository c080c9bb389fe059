"""Sources to candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcemine.functions.score import keep_hard_units
from sourcemine.operators import candidates as cand
from sourcemine.operators.environments import environment_roots, prune_environments, python_files
from sourcemine.operators.parse import parse_files
from sourcemine.operators.units import code_units, last_units
from sourcemine.sources.files import decode
from sourcemine.sources.tree import read_tree
from sourcemine.storage import materialize, spread


def source_files(files: DataFrame, scan_root: str | None = None) -> DataFrame:
    """The scan over a table of all files ``repo, path, content``: source suffix,
    nothing below a virtual environment, bytes decoded.

    Environments are found and pruned on paths alone, which are written first: a table
    that reads or decodes its files anew for each query does so twice, for the paths
    and for the texts.  Texts are not moved.
    """
    listing = materialize(files.select("repo", "path"), "listing")
    roots = environment_roots(listing, scan_root)
    kept = prune_environments(python_files(files), roots, python_files(listing)).select(*files.columns)
    return decode(kept) if dict(files.dtypes)["content"] == "binary" else kept


def tree_files(spark: SparkSession, root: str) -> DataFrame:
    """The same for a folder: its listing never enters an environment, so each source
    is opened once."""
    return decode(read_tree(spark, root))


def scored_units(units: DataFrame, smell: bool) -> DataFrame:
    """Last definition per file first, then the score filter on functions and whole classes."""
    units = last_units(units)
    return keep_hard_units(units) if smell else units


def parsed_units(files: DataFrame, smell: bool) -> DataFrame:
    return code_units(parse_files(spread(files, "path"), with_counts=smell))


def retrieve_function_candidates(files: DataFrame, smell: bool = False) -> DataFrame:
    """Parse and deduplicate in one pass."""
    return cand.function_candidates(scored_units(parsed_units(files, smell), smell))


def retrieve_method_candidates(files: DataFrame, smell: bool = False) -> DataFrame:
    """The classes are written once: keys and texts are read from there separately."""
    classes = scored_units(parsed_units(files, smell), smell).filter("kind = 'class'")
    return cand.method_candidates(materialize(classes, "classes"))


def retrieve_candidates(units: DataFrame) -> DataFrame:
    """Functions and methods of a materialized table of (scored) units.

    A method name has a dot and a function name has none, so the two key sets
    cannot meet and the union needs no shuffle of its own."""
    return cand.late_function_candidates(units).unionByName(cand.method_candidates(units))


def candidate_texts(units: DataFrame, waves: int = 1) -> DataFrame:
    """Candidates with their texts, one row for each function and each class and wave:
    ``repo, path, line, kind, code, method_code, wave, wanted`` (``name, line, pos`` of the
    candidates in it).  A class text is stored once a wave, however many methods it supplies.
    """

    def wave(name: Column) -> Column:
        return F.pmod(F.xxhash64("repo", name), F.lit(waves)).cast("int")

    functions = cand.late_function_candidates(units).select(
        "repo",
        "path",
        "line",
        "kind",
        "code",
        F.lit(None).cast("array<string>").alias("method_code"),
        F.array(F.struct(F.lit(-1).alias("pos"), "name", "line")).alias("wanted"),
        F.array(wave(F.col("name"))).alias("waves"),
    )
    classes = cand.wanted_classes(units).select(
        "repo",
        "path",
        F.col("class_line").alias("line"),
        F.lit("method").alias("kind"),
        F.col("class_code").alias("code"),
        "method_code",
        "wanted",
        F.array_distinct(F.transform("wanted", lambda one: wave(one["name"]))).alias("waves"),
    )
    each = functions.unionByName(classes).withColumn("wave", F.explode("waves")).drop("waves")
    mine = F.filter("wanted", lambda one: wave(one["name"]) == F.col("wave"))
    return each.withColumn("wanted", mine)


def candidates_of(texts: DataFrame) -> DataFrame:
    """One row a candidate, a projection of ``candidate_texts``."""
    is_method = F.col("kind") == "method"
    return texts.select("*", F.explode("wanted").alias("one")).select(
        "repo",
        F.col("one.name").alias("name"),
        "kind",
        "path",
        F.col("one.line").alias("line"),
        F.col("line").alias("text_line"),
        F.when(is_method, F.substring_index("one.name", ".", -1)).alias("method"),
        F.when(is_method, F.col("code")).alias("class_code"),
        F.when(is_method, F.get("method_code", F.col("one.pos"))).otherwise(F.col("code")).alias("code"),
        "wave",
    )
