"""The whole run: sources to accepted harnesses and failures."""

from __future__ import annotations

import platform
from collections.abc import Mapping
from contextlib import suppress
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sourcemine import fixed_values as fixed
from sourcemine import schemas
from sourcemine.functions import text as text_rules
from sourcemine.operators import outcomes
from sourcemine.operators.completion import (
    ClientFactory,
    call_settings,
    complete,
    with_prompt_sha,
    with_request_sha,
)
from sourcemine.operators.prompts import docs_text, lookup_template, render_prompts
from sourcemine.operators.units import target_count
from sourcemine.plans.discovery import (
    candidate_texts,
    candidates_of,
    parsed_units,
    scored_units,
    tree_files,
)
from sourcemine.plans.discovery import source_files as scanned
from sourcemine.sinks.tables import append_failures, export_files, replace_runs
from sourcemine.storage import materialize, text_batches, write_table

TOTALS = ("files_scanned", "files_failed", "functions_found", "methods_found", "candidates", "harnesses", "failures")
METHODS_PER_ROW = 32  # that a class text travels with to the tasks that call


@dataclass(frozen=True)
class RunResult:
    """Tables of a finished run; all of them are on disk."""

    units: DataFrame
    candidates: DataFrame
    completions: DataFrame
    harnesses: DataFrame
    failures: DataFrame
    totals: DataFrame


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """Answers of an earlier attempt at the same job, if it got that far."""
    try:
        return spark.read.schema(schemas.COMPLETIONS).parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def _write_texts(units: DataFrame, path: str, waves: int) -> DataFrame:
    """Texts of candidates in one folder per wave; a name belongs to a wave by its hash."""
    texts = candidate_texts(units, waves)
    if waves > 1:
        # Full files per folder: tasks are regrouped by wave, large waves split.
        texts = texts.hint("rebalance", "wave")
    texts.write.mode("overwrite").partitionBy("wave").parquet(path)
    return units.sparkSession.read.schema(texts.schema).parquet(path)


def _only(texts: DataFrame, missing: DataFrame) -> DataFrame:
    """The texts of some candidates: a text meets all of its missing ones at once."""
    keys = ["repo", "path", "kind", "line", "wave"]
    wanted = missing.groupBy("repo", "path", "kind", F.col("text_line").alias("line"), "wave").agg(
        F.collect_set("name").alias("names")
    )
    known = texts.join(wanted, keys)
    return known.withColumn("wanted", F.expr("filter(wanted, one -> array_contains(names, one.name))")).drop("names")


def _dealt(texts: DataFrame, workers: int) -> DataFrame:
    """Texts over the tasks that call, a class of many methods in slices of them."""
    starts = F.sequence(F.lit(0), F.size("wanted") - 1, F.lit(METHODS_PER_ROW))
    slices = F.transform(starts, lambda at: F.slice("wanted", at + 1, METHODS_PER_ROW))
    cut = texts.withColumn("wanted", F.explode(slices))
    return cut.repartition(workers, "repo", F.col("wanted")[0]["name"])


def _complete_missing(
    texts: DataFrame,
    candidates: DataFrame,
    count: int,
    path: str,
    calls_per_job: int,
    workers: int,
    prompt: dict,
    settings: dict,
    **options,
) -> tuple[DataFrame, int]:
    """Answers to all candidates and the number of this attempt.

    A restarted job asks only for what it lacks: requests without an answer under
    the same prompt, model, temperature and parameters.  A call that failed is
    no answer and is made again.

    Each job of some waves is one committed append: a lost executor repeats the
    calls of its tasks, a lost driver those of one job.  The waves were planned
    before names were deduplicated, so several may fit into one job.  Prompts
    are rendered behind the last shuffle, and the lookup of known answers
    compares digests only.
    """
    spark = candidates.sparkSession
    keys = ["repo", "name", "request_sha"]
    requests = with_request_sha(candidates, settings)
    earlier = _stored(spark, path)
    attempt = 1
    if earlier is not None:
        attempt += earlier.agg(F.max("attempt")).first()[0] or 0
        known = earlier.filter("error IS NULL").select(*keys).distinct()
        # What is missing is found once and stored by wave, not once a job.
        missing = materialize(requests.join(known, keys, "left_anti"), "missing")
        count = missing.count()
        texts = materialize(_only(texts, missing), "missing-texts", by="wave")
    jobs = max(1, -(-count // calls_per_job))
    for job in range(jobs):
        asked = candidates_of(_dealt(texts.filter(F.col("wave") % jobs == job), workers))
        with text_batches(spark):
            answers = complete(render_prompts(asked, **prompt), attempt=attempt, **options)
            answers.write.mode("append").parquet(path)
    answers = spark.read.schema(schemas.COMPLETIONS).parquet(path)
    # One row a request: its answer, or the failure of this attempt.  Answers to
    # requests that have changed since do not count.
    answers = answers.filter(F.col("error").isNull() | (F.col("attempt") == attempt))
    return answers.join(requests.select(*keys), keys, "left_semi"), attempt


def _observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """Counts that are taken while the table is written, without a scan of their own."""
    seen = Observation()
    return df.observe(seen, *[F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in counts.items()]), seen


def _report(spark: SparkSession, output: str, job: str, at: Column, context: str, message: str, error: Exception) -> None:
    """A failure that is not one of a candidate; a report that fails hides nothing."""
    first = str(error).strip().split("\n")[0]
    row = spark.range(0, 1, 1, 1).select(
        F.lit(job).alias("run_id"),
        at.alias("ts"),
        F.lit(context).alias("context"),
        F.lit(None).cast("string").alias("name"),
        F.lit(message.replace("{error}", first)).alias("error_msg"),
    )
    with suppress(Exception):
        append_failures(row, f"{output}/fatal")


def run(
    spark: SparkSession,
    source_files: DataFrame | str,
    templates: DataFrame,
    docs: DataFrame,
    docs_block: str,
    prompt_id: str,
    client_factory: ClientFactory,
    model: str,
    output: str,
    job: str,
    smell: bool = False,
    workers: int | None = None,
    calls_per_task: int = 1000,
    params: Mapping[str, str] | None = None,
    ts: datetime | None = None,
    scan_root: str | None = None,
    calls_in_flight: int = 1,
    export: str | None = None,
    time_limit: float | None = None,
) -> RunResult:
    """Everything below ``output/<table>/job=<job>``; the same job can be run again.

    ``source_files`` is a folder that all executors share, whose sources are opened once,
    or a table that has ``repo, path, content`` and optionally ``error``; a path
    is there once per ``repo``.  The table may hold all files of a tree: only
    sources outside virtual environments count, and bytes are decoded.  An
    environment at ``scan_root`` itself is no reason to leave files out.  Each ``repo`` is one tree with its own names and
    its own run label, made of the last part of its name.  ``workers`` is the number
    of tasks that call, each from ``calls_in_flight`` threads.  ``export`` is a shared
    folder for the accepted files; one that cannot be saved is a failure.  ``time_limit``
    is that of a call, in seconds.  ``totals`` is one row on this attempt: settings,
    files, units, candidates, outcomes.  ``output/outcomes`` holds the outcomes of all
    runs by ``run_id``, of which an attempt replaces its own.  Whatever ends a run is
    reported in ``output/fatal``.  The tables returned are those of this attempt: read them
    before the same job runs again.
    """
    at = F.lit((ts or datetime.now(timezone.utc)).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    try:
        return _run(
            spark, source_files, templates, docs, docs_block, prompt_id, client_factory, model.strip(), output, job,
            smell, workers or spark.sparkContext.defaultParallelism, calls_per_task, params, at, scan_root,
            calls_in_flight, export, time_limit,
        )
    except Exception as error:
        _report(spark, output, job, at, fixed.CONTEXT_ORCHESTRATION, fixed.MESSAGE_FATAL, error)
        raise


def _run(
    spark, source_files, templates, docs, docs_block, prompt_id, client_factory, model, output, job,
    smell, workers, calls_per_task, params, at, scan_root, calls_in_flight, export, time_limit,
) -> RunResult:
    def place(table: str) -> str:
        return f"{output}/{table}/job={job}"

    settings = lookup_template(templates, prompt_id)
    told = call_settings(model, settings["temperature"], params)
    prompt = {"template": F.lit(settings["template"]), "docs": docs_text(docs, docs_block)}

    files = tree_files(spark, source_files) if isinstance(source_files, str) else scanned(source_files, scan_root)
    parsed, of_units = _observed(
        parsed_units(files, smell),
        files_scanned=F.count_if(F.col("pos") == 0),
        files_failed=F.count_if(F.col("error").isNotNull()),
        targets=F.sum(target_count()),
    )
    try:
        units = write_table(parsed, place("units"), by="kind")
    except Exception as error:
        for message in (fixed.MESSAGE_FUNCTIONS, fixed.MESSAGE_CLASSES):
            _report(spark, output, job, at, fixed.CONTEXT_PARSER, message, error)
        raise
    calls_per_job = workers * calls_per_task
    # Before names meet and scores are applied, so at least as many as are needed.
    waves = max(1, -(-of_units.get["targets"] // calls_per_job))
    texts = _write_texts(scored_units(units, smell), place("texts"), waves)
    keyed = with_prompt_sha(render_prompts(candidates_of(texts), **prompt)).drop("prompt", "code", "class_code")
    keyed, of_candidates = _observed(
        keyed,
        functions_found=F.count_if(F.col("kind") == "function"),
        methods_found=F.count_if(F.col("kind") == "method"),
        candidates=F.count(F.lit(1)),
    )
    candidates = write_table(keyed, place("candidates"))
    completions, attempt = _complete_missing(
        texts,
        candidates,
        of_candidates.get["candidates"],
        place("completions"),
        calls_per_job,
        workers,
        prompt,
        told,
        client_factory=client_factory,
        temperature=settings["temperature"],
        model=model,
        params=params,
        calls_in_flight=calls_in_flight,
        as_finished=True,
        time_limit=time_limit,
    )
    answers = completions.select(
        text_rules.run_label(text_rules.base_name(F.col("repo")), F.lit(model), at).alias("run_id"),
        "name",
        text_rules.first_choice(F.col("choices")).alias("response"),
        "error",
    )
    good, of_harnesses = _observed(outcomes.accepted(answers), harnesses=F.count(F.lit(1)))
    harnesses = write_table(good, place("harnesses"))
    failed = outcomes.rejected(answers, at)
    if export:
        exported = write_table(export_files(harnesses, export), place("exports"))
        failed = failed.unionByName(outcomes.not_exported(exported, at))
    failed, of_failures = _observed(failed, failures=F.count(F.lit(1)))
    failures = write_table(failed, f"{place('failures')}/attempt={attempt}")
    replace_runs(outcomes.outcome_rows(harnesses, failures), f"{output}/outcomes")
    counts = of_units.get | of_candidates.get | of_harnesses.get | of_failures.get
    # Which syntax counts as an error depends on the parser's version.
    totals = write_table(
        spark.range(0, 1, 1, 1).select(
            at.alias("ts"),
            F.lit(prompt_id).alias("prompt_id"),
            F.lit(model).alias("model"),
            F.lit(settings["temperature"]).alias("temperature"),
            F.lit(smell).alias("smell"),
            F.lit(platform.python_version()).alias("python_version"),
            F.lit(attempt).alias("attempt"),
            *[F.lit(counts[name]).cast("long").alias(name) for name in TOTALS],
        ),
        f"{place('runs')}/attempt={attempt}",
    )
    return RunResult(units, candidates, completions, harnesses, failures, totals)
