"""Maintainability index as native column expressions.

The index is that of Coleman, Ash, Lowther and Oman (IEEE Computer 27(8),
1994), with Halstead's volume and McCabe's complexity, rescaled to 0..100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemine.fixed_values import MAINTAINABILITY_THRESHOLD


def halstead_volume(counts: Column) -> Column:
    length = counts["n_operators"] + counts["n_operands"]
    vocabulary = counts["u_operators"] + counts["u_operands"]
    return F.when(vocabulary > 0, length * F.log2(vocabulary.cast("double"))).otherwise(F.lit(0.0))


def maintainability(
    volume: Column, complexity: Column, lines: Column, comment_pct: Column
) -> Column:
    raw = (
        F.lit(171.0)
        - 5.2 * F.log(volume)
        - 0.23 * complexity
        - 16.2 * F.log(lines.cast("double"))
        + 50.0 * F.sin(F.sqrt(2.46 * F.radians(comment_pct)))
    )
    scaled = F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw * 100.0 / 171.0))
    return F.when((volume <= 0) | (lines <= 0), F.lit(100.0)).otherwise(scaled)


def unit_score(counts: Column) -> Column:
    return maintainability(
        halstead_volume(counts), counts["complexity"], counts["sloc"], counts["comment_pct"]
    )


def is_hard_to_maintain(
    score: Column, failed: Column, threshold: float = MAINTAINABILITY_THRESHOLD
) -> Column:
    """Keep low scores and units whose measuring failed; drop units without a score."""
    return failed | F.coalesce(score < threshold, F.lit(False))


def keep_hard_units(units: DataFrame, threshold: float = MAINTAINABILITY_THRESHOLD) -> DataFrame:
    """Score filter over functions and whole classes."""
    return units.filter(
        is_hard_to_maintain(
            unit_score(F.col("counts")), F.col("counts_error").isNotNull(), threshold
        )
    )
