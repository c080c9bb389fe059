"""Helpers of the operators: stored tables, row numbers, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourcemine.storage import new_scratch_path, text_batches

#: White space between words: blank, tab, newline, vertical tab, form feed, return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Codec of stored tables that hold the texts or ids of the whole corpus.
DENSE = "zstd"


def stored(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write to the shared scratch folder and read back: later readers and lost
    executors start from the files, not from the work before them."""
    path = new_scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_from_texts(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """``stored`` for a stage that hands whole texts to Python: small batches
    bound what a task holds at once on both sides."""
    with text_batches(df.sparkSession):
        return stored(df, label, codec)


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def unsigned_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, that of no bytes (0) for null."""
    return F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")


def ranged(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """Store the rows in one global order, dealt out by ranges, with the place:
    ``part`` counts the ranges upwards and ``at`` the rows inside one.

    The order should end with a column that differs inside a hot key, so that
    the ranges stay even.
    """
    place = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", place)
    return (
        stored(ordered, label)
        .withColumn("part", F.shiftright("_at", 33).cast("int"))
        .withColumn("at", F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_at")
    )


def numbered(
    df: DataFrame, order: list[Column], label: str, within: list[str] | None = None, name: str = "row"
) -> DataFrame:
    """Number rows from 0 without a gap in a global order, ``within`` the values
    of some leading columns of that order if given.

    No task sees more than its range: only one count per range and value is
    summed up over ranges.
    """
    within = within or []
    placed = ranged(df, order, label)
    first = "_first"
    counts = placed.groupBy("part", *within).agg(
        F.count("*").alias("n"), F.min("at").alias(first)
    )
    before = Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "part",
        *[F.col(c).alias(f"_w_{c}") for c in within],
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col(first)).alias("_start"),
    )
    on = [F.col("l.part") == F.col("r.part")]
    on += [F.col(f"l.{c}").eqNullSafe(F.col(f"r._w_{c}")) for c in within]
    # A row for each range, and one more for each value that begins inside it.
    joined = placed.alias("l").join(
        F.broadcast(starts.alias("r")) if not within else starts.alias("r"), on
    )
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns], (F.col("at") + F.col("_start")).alias(name)
    )
