"""Answers to accepted harnesses and to failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemine import fixed_values as fixed
from sourcemine.functions import text as text_rules
from sourcemine.operators.completion import TIMED_OUT


def with_block(answers: DataFrame) -> DataFrame:
    """Adds ``block``, the code of the text column ``response``."""
    return answers.withColumn("block", text_rules.code_blocks(F.col("response")))


def accepted(answers: DataFrame) -> DataFrame:
    """Every answer with a non-empty block."""
    return (
        with_block(answers)
        .filter(F.col("block") != "")
        .select(
            "run_id",
            "name",
            text_rules.harness_file_name(F.col("name")).alias("file_name"),
            F.col("block").alias("code"),
        )
    )


def failure_message(name: Column, response: Column) -> Column:
    empty = F.coalesce(response, F.lit("")) == ""
    return F.when(empty, text_rules.format_columns(fixed.MESSAGE_EMPTY, name=name)).otherwise(
        text_rules.format_columns(fixed.MESSAGE_NO_BLOCK, name=name)
    )


def not_exported(exported: DataFrame, ts: Column) -> DataFrame:
    """Failures of the file export."""
    message = text_rules.format_columns(
        fixed.MESSAGE_UNEXPECTED, name=F.col("name"), error=F.col("error")
    )
    return exported.filter(F.col("error").isNotNull()).select(
        "run_id",
        ts.alias("ts"),
        F.lit(fixed.CONTEXT_GENERATION).alias("context"),
        "name",
        message.alias("error_msg"),
    )


def rejected(answers: DataFrame, ts: Column) -> DataFrame:
    """Every other answer, with the reason.  ``error`` of a call, if that column is
    there, tells one that was given up."""
    given_up = F.col("error").startswith(TIMED_OUT) if "error" in answers.columns else F.lit(False)
    given_up = F.coalesce(given_up, F.lit(False))
    error = F.col("error") if "error" in answers.columns else F.lit("")
    late = text_rules.format_columns(fixed.MESSAGE_THREAD, name=F.col("name"), error=error)
    return (
        with_block(answers)
        .filter(F.col("block") == "")
        .select(
            "run_id",
            ts.alias("ts"),
            F.when(given_up, F.lit(fixed.CONTEXT_THREADING)).otherwise(F.lit(fixed.CONTEXT_GENERATION)).alias("context"),
            "name",
            F.when(given_up, late).otherwise(failure_message(F.col("name"), F.col("response"))).alias("error_msg"),
        )
    )


def outcome_rows(harnesses: DataFrame, failures: DataFrame) -> DataFrame:
    """Accepted files and failures as one table: ``run_id, name, file_name, code,
    context, error_msg``; the first two of those are null for a failure, the last two
    for a file."""
    return harnesses.select("run_id", "name", "file_name", "code").unionByName(
        failures.select("run_id", "name", "context", "error_msg"), allowMissingColumns=True
    )
