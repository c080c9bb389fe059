"""Connected components by large and small star steps, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcemine.llm.common import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over pairs (u > v): each node's neighbours are tied to the least
    of them; ``small`` looks at lesser neighbours only, else at greater ones."""
    both = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, "u")
    if small:
        pairs = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    else:
        pairs = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pairs.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(u, root)`` for every node that has a lesser one in its component, from
    edges ``(u, v)`` of longs; roots themselves are left out.

    Each step pre-aggregates by node, so a node with very many edges reaches
    its reducer as one row a task, and its join partition can be split.  Every
    round is stored.  The loop ends when a round changes nothing.
    """
    pairs = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    state = stored(pairs.distinct(), "components")
    for _ in range(most_rounds):
        # Done when every node has one edge and no root is itself tied further:
        # then the pairs are stars already.
        count = state.groupBy("u").count().where("count > 1").limit(1)
        chained = state.join(state.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1)
        if count.isEmpty() and chained.isEmpty():
            return state.select("u", F.col("v").alias("root"))
        state = stored(_star(_star(state, small=False), small=True), "components")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
