"""Documents to packed training sequences: five stages, each a table in and out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcemine.llm import mixing, near_copies, packing, quality, toxicity
from sourcemine.llm.common import stored
from sourcemine.llm.queries import table
from sourcemine.packaging import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _beside(docs: DataFrame) -> DataFrame:
    """The rows as one column beside their text, so that no column that a stage adds
    takes the place of one that came in."""
    return docs.select(F.struct("*").alias("doc"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(_beside(docs), network).where("predicted = 0").select("doc.*")


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality.ledger(_beside(docs)).where(quality.kept()).select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return near_copies.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a sequence: its ids and the documents that they come from."""
    ship_package(spark)
    return packing.sequences_of(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_bad),
    ("near-dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

# A trained network and a linear program have no SQL; tests hold the stages
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
