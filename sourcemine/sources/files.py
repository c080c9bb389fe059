"""Bytes to text, natively."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcemine.functions import text as text_rules


def decode(raw: DataFrame) -> DataFrame:
    """UTF-8 with newline translation.  A file that is not UTF-8 keeps its row with
    a null content and an error, so that the run goes on without it."""
    text = F.col("content").cast("string")
    valid = F.coalesce(F.is_valid_utf8(text), F.lit(False))
    failed = F.when(~valid & F.col("content").isNotNull(), F.lit("not valid UTF-8"))
    known = F.col("error") if "error" in raw.columns else F.lit(None).cast("string")
    return raw.select(
        "repo",
        "path",
        F.when(valid, text_rules.normalize_newlines(text)).alias("content"),
        F.coalesce(known, failed).alias("error"),
    )
