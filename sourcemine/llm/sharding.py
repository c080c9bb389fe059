"""Shards by balanced label propagation, in DataFrame functions only.

Documents that share a link key are linked.  Documents of one key are alike to the
propagation, so it works on counts, ``(key, shard, n)``, and never moves the table:

1. Linked documents start spread over the shards by a hash of their row.
2. In a round every key that lies in several shards looks where its documents are
   and names the shard with most of them that has room for the rest, or another one
   with room for all; the join of counts and goals is what asks to move.  Requests
   are dealt by a hash that changes from round to round into ``BUCKETS``; their sums,
   at most ``shards ** 2 * BUCKETS`` numbers, decide which buckets each shard admits
   without going over its quota, an even part and ``ROOM``.  A key's requests share a
   bucket, so groups come in whole.
3. Rounds end when no key asks, ``PATIENCE`` rounds in a row admit nobody, or after
   ``ROUNDS`` of them.  Whatever is left then, ``_level`` moves the fewest documents
   that bring every shard to an even part at most, group after group, so that it cuts
   one at most for each shard that gives or takes, and documents without a link fill the rest: the counts of any two shards
   differ by one at most (law ``rows``) however the rounds went.
4. Rows are numbered inside their key once and given out by the counts.

A key with more documents than an even part fills as many shards as it can on its own
and takes part in the rounds with the rest; there are fewer such keys than shards.
A null key links nothing.  Repeated rows are placed each.  Columns called ``shard`` or
``slot`` are replaced, all others but ``key`` are kept.  With no rows there are no shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourcemine.llm.common import numbered, ranged, stored

SHARDS = 16
ROUNDS = 10
ROOM = 0.25  # share of an even part that rounds may fill beyond it
PATIENCE = 2  # rounds that admit nobody before the rounds end
BUCKETS = 128


def _by_shard(values: list, shard: str | Column = "shard", kind: str = "long") -> Column:
    column = F.col(shard) if isinstance(shard, str) else shard
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), column + 1)


def _loads(state: DataFrame, fixed: list[int]) -> list[int]:
    """Documents of each shard: one number a shard reaches the driver."""
    found = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) + f for s, f in enumerate(fixed)]


def asking(state: DataFrame, loads: list[int], most: int, number: int) -> DataFrame:
    """The counts with the ``goal`` of each (null: stays) and its ``bucket``.

    Nothing larger than the counts is read here: both sides of the join are.
    """
    room = [most - n for n in loads]
    # Shards with room for the rest first, then most documents; ties by a hash,
    # so that small groups do not all choose the same shard.
    size = F.sum("n").over(Window.partitionBy("key"))
    held = state.withColumn("size", size)
    rank = F.struct(
        (_by_shard(room) >= F.col("size") - F.col("n")).alias("fits"),
        F.col("n"),
        F.xxhash64("key", "shard").alias("tie"),
        F.col("shard"),
    )
    chosen = held.groupBy("key").agg(
        F.max(rank).alias("best"), F.max("size").alias("size"), F.count("*").alias("held_by")
    )
    # Where none of its shards has room for all of a group, one that has takes it.
    rooms = ", ".join(f"{n}L" for n in room)
    chosen = chosen.where("held_by > 1").withColumn(
        "open", F.expr(f"filter(sequence(0, {len(room) - 1}), s -> element_at(array({rooms}), s + 1) >= size)")
    )
    pick = F.pmod(F.xxhash64("key", F.lit(number)), F.greatest(F.size("open"), F.lit(1))).cast("int")
    other = F.try_element_at("open", pick + 1)
    goal = F.when(F.col("best.fits"), F.col("best.shard")).otherwise(F.coalesce(other, "best.shard"))
    goals = chosen.select("key", goal.alias("goal"))
    bucket = F.pmod(F.xxhash64("key", F.lit(number), F.lit("turn")), F.lit(BUCKETS)).cast("int")
    return (
        state.join(goals, "key", "left")
        .withColumn("goal", F.when(F.col("goal") != F.col("shard"), F.col("goal")))
        .withColumn("bucket", bucket)
    )


def admitted(asks: np.ndarray, loads: list[int], most: int) -> np.ndarray:
    """Which buckets each goal admits, from the documents that ask to go from a shard
    to a goal in a bucket: no shard that admits any holds more than ``most`` after."""
    shards = len(loads)
    taken = asks.sum(axis=0) > 0

    def after(taken: np.ndarray) -> np.ndarray:
        moved = asks * taken
        return np.array(loads) + moved.sum(axis=(0, 2)) - moved.sum(axis=(1, 2))

    while True:
        held = after(taken)
        over = [g for g in range(shards) if held[g] > most and taken[g].any()]
        if not over:
            break
        for g in over:
            own = np.flatnonzero(taken[g])
            sums = np.cumsum(asks[:, g, own[::-1]].sum(axis=0))
            taken[g, own[::-1][: int(np.searchsorted(sums, held[g] - most)) + 1]] = False
    held = after(taken)
    for g in range(shards):  # what fits the room left, bucket by bucket
        for b in np.flatnonzero(~taken[g] & (asks[:, g].sum(axis=0) > 0)):
            into = asks[:, g, b].sum()
            if held[g] + into <= most:
                taken[g, b] = True
                held[g] += into
                held -= asks[:, g, b]
    return taken


def propagated(state: DataFrame, fixed: list[int], most: int) -> DataFrame:
    """The counts after the rounds; ``fixed`` documents of each shard stay where they are."""
    waited = 0
    shards = len(fixed)
    for number in range(ROUNDS):
        loads = _loads(state, fixed)
        labelled = stored(asking(state, loads, most, number), "asking")
        asks = np.zeros((shards, shards, BUCKETS), np.int64)
        sums = labelled.where("goal IS NOT NULL").groupBy("shard", "goal", "bucket").agg(F.sum("n").alias("n"))
        for r in sums.collect():
            asks[r["shard"], r["goal"], r["bucket"]] = r["n"]
        if not asks.any():
            break
        taken = admitted(asks, loads, most)
        waited = 0 if taken.any() else waited + 1
        if waited >= PATIENCE:
            break
        masks = ["".join("1" if t else "0" for t in own) for own in taken]
        goes = F.substr(_by_shard(masks, "goal", "string"), F.col("bucket") + 1, F.lit(1)) == "1"
        goes = F.col("goal").isNotNull() & goes
        moved = labelled.withColumn("shard", F.when(goes, F.col("goal")).otherwise(F.col("shard")))
        # By key alone: the aggregates and the join of the next round need no other shuffle.
        state = stored(moved.repartition("key").groupBy("key", "shard").agg(F.sum("n").alias("n")), "counts")
    return state


def _running(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``before``: the sum of ``n`` over the rows of a shard that come earlier in an
    order that begins with ``shard``.  No task sees more than its range."""
    placed = ranged(df, order, label)
    inside = Window.partitionBy("part", "shard").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("part", "shard").agg(F.sum("n").alias("_sum"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", "shard", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    within = placed.withColumn("_before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    joined = within.join(starts, ["part", "shard"])
    return joined.select(*df.columns, (F.col("_before") + F.col("_start")).alias("before"))


def _level(state: DataFrame, loads: list[int], even: list[int]) -> DataFrame:
    """Move the fewest linked documents that leave no shard above its even part."""
    above = [max(0, n - e) for n, e in zip(loads, even)]
    below = [max(0, e - n) for n, e in zip(loads, even)]
    if not any(above):
        return state
    queue = _running(state, [F.col("shard"), F.xxhash64("key"), F.col("key")], "surplus")
    going = F.greatest(F.lit(0), F.least(F.col("n"), _by_shard(above) - F.col("before")))
    # The shards that give come one after the other, so do those that take.
    starts = [sum(above[:s]) for s in range(len(above))]
    begin = F.col("before") + _by_shard(starts)
    takers = [(s, sum(below[:s]), sum(below[: s + 1])) for s in range(len(below)) if below[s]]
    parts = F.array(
        F.struct(F.col("shard").alias("shard"), (F.col("n") - F.col("going")).alias("n")),
        *[
            F.struct(
                F.lit(s).alias("shard"),
                (F.least(begin + F.col("going"), F.lit(end)) - F.greatest(begin, F.lit(start))).alias("n"),
            )
            for s, start, end in takers
        ],
    )
    dealt = queue.withColumn("going", going).select("key", F.explode(parts).alias("part")).select("key", "part.*")
    return stored(dealt.where("n > 0").groupBy("key", "shard").agg(F.sum("n").alias("n")), "even")


def cut_keys(placed: DataFrame) -> DataFrame:
    """Keys of ``key, shard`` whose rows lie in several shards, with their size."""
    found = placed.where("key IS NOT NULL").groupBy("key").agg(
        F.count("*").alias("size"), F.min("shard").alias("low"), F.max("shard").alias("high")
    )
    return found.where("low < high").select("key", "size")


def sharded(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` and ``slot`` to stored rows that hold ``row`` (unique) and
    ``key`` (null: no link)."""
    n = rows.count()
    most = n // shards
    groups = rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    groups = stored(groups, "groups")
    marked = stored(rows.select("row", "key").join(groups, "key", "left"), "marked")
    linked = marked.where("size IS NOT NULL").select("row", "key", "size")

    # Keys above an even part, fewer than there are shards: whole shards first.
    ahead = Window.orderBy(F.col("size").desc(), "key")
    large = groups.where(F.col("size") > most).withColumn("shards", F.floor(F.col("size") / max(1, most)))
    large = large.withColumn("end", F.sum("shards").over(ahead))
    at = large.agg(F.max("end")).first()[0] if most else 0
    at = at or 0
    fixed = [most * (s < at) for s in range(shards)]
    free = list(range(at, shards)) or list(range(shards))
    spread = _by_shard(free, F.pmod(F.xxhash64("row"), F.lit(len(free))).cast("int"), "int")
    fits = linked.where(F.col("size") <= most) if at else linked
    state = fits.groupBy("key", spread.alias("shard")).agg(F.count("*").alias("n"))
    if at:
        start = _by_shard(free, F.pmod(F.xxhash64("key"), F.lit(len(free))).cast("int"), "int")
        rest = large.select("key", start.alias("shard"), (F.col("size") % most).alias("n"))
        state = state.unionByName(rest.where("n > 0"))
    state = propagated(stored(state, "counts"), fixed, most + int(ROOM * most) + 1)

    loads = _loads(state, fixed)
    fullest = sorted(range(shards), key=lambda s: -loads[s])[: n % shards]  # they keep the odd rows
    even = [most + (s in fullest) for s in range(shards)]
    state = _level(state, loads, even)
    loads = _loads(state, fixed)
    if at:
        run = F.explode(F.expr("sequence(`end` - shards, `end` - 1)"))
        own = large.select("key", run.alias("at"), F.lit(most).cast("long").alias("n"))
        own = own.select("key", F.col("at").cast("int").alias("shard"), "n")
        state = state.unionByName(own).groupBy("key", "shard").agg(F.sum("n").alias("n"))

    # Rows of a key take its counts in turn, and stand together in each shard.
    state = _running(stored(state, "given"), [F.col("shard"), F.xxhash64("key"), F.col("key")], "places")
    earlier = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    given = state.withColumn("low", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    given = stored(given.withColumnRenamed("key", "of"), "given-out")
    inside = numbered(linked.select("row", "key"), [F.col("key"), F.col("row")], "linked", ["key"], "at_key")
    here = (F.col("key") == F.col("of")) & (F.col("at_key") >= F.col("low")) & (F.col("at_key") < F.col("low") + F.col("n"))
    together = inside.join(given, here).select("row", "shard", (F.col("before") + F.col("at_key") - F.col("low")).alias("slot"))
    # All others fill up, shard after shard.
    single = numbered(marked.where("size IS NULL").select("row"), [F.col("row")], "single", name="turn")
    open_ = [e - f for e, f in zip(even, loads)]
    goal, filled, begin = F.lit(None).cast("int"), 0, []
    for s in range(shards):
        begin.append(loads[s] - filled)
        filled += open_[s]
        goal = F.coalesce(goal, F.when(F.col("turn") < filled, F.lit(s)))
    single = single.withColumn("shard", goal).select("row", "shard", (F.col("turn") + _by_shard(begin)).alias("slot"))
    placed = together.unionByName(single)
    kept = rows.drop("key", "shard", "slot")
    return kept.join(placed, "row")
