"""Dropping rows by key without moving them.

An anti join shuffles both sides once the smaller one is too large to broadcast; with
whole texts on the other side that is the most expensive thing a plan can do.  Here
the decision is taken on keys alone, and the wide rows only pass a filter: the dropped
keys as a Bloom filter, then the kept keys that it would drop by mistake as a second
one, then the dropped keys which that would keep, and so on.  Each level is a small
share of the one two before, so a few levels decide every key (a filter cascade).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemine.storage import materialize

BITS_PER_KEY = 16
MOST_BITS = 1 << 27  # of one level, 16 MB: the driver's share, however many keys there are
LEVELS = 8


def fits_broadcast(stored: DataFrame) -> bool:
    """Whether Spark's size of a stored table is below its broadcast threshold."""
    bound = stored.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= bound


def key_hash(keys: list[str]) -> Column:
    """Nulls do not change a hash by themselves, so it also tells where they are."""
    return F.xxhash64(*keys, *[F.col(key).isNull() for key in keys])


def _places(h: Column, bits: int) -> list[Column]:
    return [F.pmod(h, F.lit(bits)), F.pmod(F.xxhash64(h), F.lit(bits))]


def _field(keys: DataFrame, count: int) -> tuple[Column, int]:
    """The bits of one level as a scalar, and how many they are.  Spark brings them
    together, 64 in a row, before at most ``MOST_BITS`` of them reach the driver."""
    bits = min(MOST_BITS, max(1 << 10, 1 << (BITS_PER_KEY * count - 1).bit_length()))
    words = (
        keys.select(F.explode(F.array(*_places(F.col("h"), bits))).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("set"))
        .toArrow()
    )
    field = np.zeros(bits // 64, np.int64)
    field[words["word"].to_numpy()] = words["set"].to_numpy()
    one = keys.sparkSession.createDataFrame([(bytearray(field.tobytes()),)], "field binary")
    return materialize(one, "key-field").scalar(), bits


def _holds(field: Column, bits: int, h: Column) -> Column:
    """Whether a level has both bits of a key.  The field is a constant of the plan;
    as a column it would be copied into every row."""
    found = F.lit(True)
    for at in _places(h, bits):
        one = F.substring(field, F.floor(at / 8).cast("int") + 1, F.lit(1))
        byte = F.conv(F.hex(one), 16, 10).cast("int")
        found &= F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return found


def without_keys(rows: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """The ``rows`` whose key is not marked in ``decided`` (``keys`` and a boolean
    ``drop``, stored, one row for every key that ``rows`` has; nulls equal nulls).

    A small set of dropped keys is broadcast.  A larger one becomes a cascade of
    filters of bounded size, and rows stay where they are.  Keys that ``LEVELS`` of
    them could not tell apart (two keys of one hash, or far more keys than bits) are
    joined, and only their rows move.
    """
    same = [F.col(f"_r.{key}").eqNullSafe(F.col(f"_d.{key}")) for key in keys]

    def joined(some: DataFrame, dropped: DataFrame) -> DataFrame:
        return some.alias("_r").join(dropped.alias("_d"), same, "left_anti")

    dropped = materialize(decided.where("drop").select(*keys), "dropped-keys")
    if fits_broadcast(dropped):
        return joined(rows, F.broadcast(dropped))
    hashed = decided.select(key_hash(keys).alias("h"), "drop")
    sides = [hashed.where("drop").select("h"), hashed.where("NOT drop").select("h")]
    levels: list[tuple[Column, int]] = []
    own, count = sides[0], sides[0].count()
    while count and len(levels) < LEVELS:
        levels.append(_field(own, count))
        # Of the other side, what this level takes for its own.
        other = sides[len(levels) % 2].where(_holds(*levels[-1], F.col("h")))
        sides[len(levels) % 2] = own = materialize(other, "key-level")
        count = own.count()
    h = key_hash(keys)
    # From the last level upwards: in it, and not in what corrects it.
    inside = [_holds(*level, h) for level in levels]
    drop = F.lit(False)
    for held in reversed(inside):
        drop = held & ~drop
    if not count:
        return rows.where(~drop)
    undecided = F.lit(True)
    for held in inside:
        undecided &= held
    return rows.where(~undecided & ~drop).unionByName(joined(rows.where(undecided), dropped))
