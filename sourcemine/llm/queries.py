"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcemine.llm import (
    chat,
    collocations,
    hard_negatives,
    html_extract,
    mixing,
    neighbours,
    packing,
    quality,
    sharding,
    simhash,
    token_files,
    topk,
    toxicity,
)
from sourcemine.llm.common import stored, unsigned_crc32

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if name == "labels":
        return spark.read.parquet(path).select("doc_id", F.col("toxic").cast("int"))
    return spark.read.schema(SCHEMAS[name]).parquet(path)


@query
def op3_quality_ledger(spark, sf_dir):
    rows = quality.stored_ledger(table(spark, sf_dir, "documents"), ["doc_id"])
    base = quality.POLICIES["v1"]
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(base).cast("long")) != 0).alias("base_failed"),
        quality.kept().alias("kept"),
        "fail_bits",
    )


@query
def op4_best_fit_packing(spark, sf_dir):
    rows = packing.pieces(table(spark, sf_dir, "documents"))
    placed, plan = packing.planned(rows)
    return placed.withColumn("sequences_at_least", F.lit(plan.at_least).cast("long"))


@query
def op5_mix_sources(spark, sf_dir):
    rows = mixing.copies(mixing.measured(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


@query
def op7_simhash_near_dedup(spark, sf_dir):
    rows = simhash.near_groups(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op9_toxicity_gru(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, network).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


@query
def op1_token_files(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"))


@query
def op2_label_propagation_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        unsigned_crc32(F.col("text")).alias("text_crc32"),
        F.unhex(F.sha2("text", 256)).alias("key"),
    )
    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    return sharding.sharded(rows).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op6_html_min_cut(spark, sf_dir):
    return html_extract.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op8_chat_prefix_targets(spark, sf_dir):
    trap = r"\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(trap).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").unionByName(added)
    return chat.digests(chat.formatted(turns))


@query
def op10_norm_sorted_top_k(spark, sf_dir):
    return topk.top_k(spark, table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


@query
def op11_quality_neighbours(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").cast("int"))
    return neighbours.scored(docs, neighbours.fit(docs, labels)).select(
        "doc_id", neighbours.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


@query
def op12_hard_negatives(spark, sf_dir):
    schema = "vec_id bigint, embedding array<float>, label int"
    rows = spark.read.schema(schema).parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.withColumn("label", moved), "vec_id % 100 = 0")


@query
def op13_phrase_collocations(spark, sf_dir):
    return collocations.mined(table(spark, sf_dir, "documents").select("text", "lang"))
