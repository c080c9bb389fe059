"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

A size is the words of a text (null: 0).  Sources, in code point order with
null last, weigh 5, 2, 1 and so on again, and share all words; a source's target
stops at ``EPOCHS`` times its size, and what that leaves is shared out again by
weight until no source is above.  A source at ``e`` epochs gives every document
``floor(e)`` times; for the rest its documents are taken once more in the order
of a seeded hash while their sum stays within what is missing, and a few more,
one of a size class, largest first, fill the gap to the nearest.  No document is cut, and none
comes more than ``EPOCHS`` times.

Documents without words take no share; they come as often as the whole epochs
say, and once more where the hash order takes them.  Repeated rows count each.
An empty table gives an empty mix.  Reruns over the same rows agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourcemine.llm.common import DENSE, n_words, numbered, ranged, stored

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 11


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, weight, target`` from rows of ``source, size``.

    The level of words a unit of weight only rises from round to round, so a
    round needs one number from the one before and collects one row.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(sums, [F.col("source").asc_nulls_last()], "sources", name="rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(ranked.select("source", "source_size", weight.alias("weight")), "weights")
    level, clamped = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") > epochs * F.col("source_size")
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, epochs * F.col("source_size")).otherwise(0)).alias("held"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("free"),
            F.count_if(full).alias("n"),
        ).first()
        if row["n"] == clamped or not row["free"]:
            break
        clamped, level = row["n"], (row["all"] - row["held"]) / row["free"]
    target = F.least(F.lit(level) * F.col("weight"), (epochs * F.col("source_size")).cast("double"))
    return sources.withColumn("target", target)


def copies(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """How often each row is taken.  ``rows``: ``row`` (unique), ``doc_id``,
    ``source``, ``size``, stored; they come back with ``source_size``,
    ``target`` and ``copies``."""
    goals = targets(rows.select("source", "size"))
    drawn = rows.withColumn("_draw", F.xxhash64(F.lit(seed), "doc_id", "size"))
    placed = ranged(drawn, [F.col("source").asc_nulls_last(), F.col("_draw"), F.col("row")], "draws")
    # One row for each range and source: everything a range needs to know.
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("part", "source").agg(F.sum("size").alias("n"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    goals = goals.select(F.col("source").alias("_source"), "source_size", "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    known = stored(
        ranges.join(goals, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("whole", F.least(whole, F.lit(EPOCHS)).cast("long"))
        .withColumn("need", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
        .select(F.col("part").alias("_part"), "_source", "before", "source_size", "target", "whole", "need"),
        "goals",
    )
    same = (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source"))
    so_far = Window.partitionBy("part", "source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.withColumn("_sum", F.sum("size").over(so_far)).join(known, same)
    counted = counted.withColumn("_end", F.col("before") + F.col("_sum"))
    counted = counted.withColumn("_more", (F.col("_end") <= F.col("need")) & (F.col("whole") < EPOCHS))
    counted = stored(counted.drop("_sum", "_part", "_source"), "drawn")
    # What each source still misses, again by range, so that no key is hot.
    reached = counted.groupBy("part", "source").agg(
        F.max(F.when(F.col("_more"), F.col("_end")).otherwise(0)).alias("got"), F.max("need").alias("need")
    )
    all_of = Window.partitionBy("source")
    gaps = reached.select(
        F.col("part").alias("_part"), F.col("source").alias("_source"), (F.col("need") - F.max("got").over(all_of)).alias("_gap")
    )
    # One document of each size class, at most four classes an octave, fills the
    # gap from the largest down.
    octave = F.floor(4 * F.log2("size"))
    open_ = counted.where(~F.col("_more") & (F.col("whole") < EPOCHS) & (F.col("size") > 0))
    fillers = (
        open_.join(gaps, same)
        .where(F.col("size") < 2 * F.col("_gap"))
        .groupBy("source", octave.alias("class"))
        .agg(F.min(F.struct("_draw", "row", "size")).alias("best"), F.max("_gap").alias("gap"))
        .groupBy("source")
        .agg(F.collect_list(F.struct(F.col("best.size").alias("size"), F.col("best.row").alias("row"))).alias("some"), F.max("gap").alias("gap"))
    )
    take = "struct(a.gap - x.size AS gap, array_append(a.rows, x.row) AS rows)"
    fits = f"(a, x) -> IF(x.size <= a.gap, {take}, a)"
    start = "struct(gap AS gap, CAST(array() AS array<bigint>) AS rows)"
    filled = f"aggregate(reverse(array_sort(some)), {start}, {fits})"
    # At last the smallest that overshoots by less than what is missing.
    nearer = f"(a, x) -> IF(NOT array_contains(a.rows, x.row) AND x.size < 2 * a.gap, {take}, a)"
    filled = F.expr(f"aggregate(array_sort(some), {filled}, {nearer}).rows")
    nearest = fillers.select(F.explode(filled).alias("row"), F.lit(1).alias("_one"))
    times = F.col("whole") + F.col("_more").cast("long") + F.coalesce("_one", F.lit(0))
    return counted.join(nearest, "row", "left").select(
        *rows.columns, "source_size", "target", times.alias("copies")
    )


def measured(docs: DataFrame) -> DataFrame:
    """The narrow rows of documents, stored: text is read once and left behind."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    key = "_row"
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()), "mix", DENSE)
    sizes = stored(
        rows.select(F.col(key).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size")), "sizes"
    )
    times = copies(sizes, seed).select(F.col("row").alias(key), "copies").where("copies > 0")
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return rows.join(times, key).withColumn("_again", again).select(*docs.columns)
