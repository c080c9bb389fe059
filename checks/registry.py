"""Driver queries: each reads whole tables and returns plain columns."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from sourcemine import fixed_values as fixed
from sourcemine.functions import score, text
from sourcemine.operators import candidates as cand
from sourcemine.operators import environments, outcomes, prompts, units
from sourcemine.operators.completion import complete, offline_client, shaky_client, steady_client
from sourcemine.operators.parse import parse_files
from sourcemine.functions.table import register_python_units
from sourcemine.plans import discovery, harness_run
from sourcemine.sources.files import decode
from sourcemine.storage import materialize, new_scratch_path, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# The columns in use; a stated schema saves the job that would infer it.
SCHEMAS = {
    "part": "p_partkey bigint, p_size int",
    "orders": "o_orderkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double",
    "documents": "doc_id bigint, text string, source string",
    "pages": "page_id bigint, url string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# inputs


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.lit("repo").alias("repo"),
        F.expr(fx.PATH).alias("path"),
        F.expr(fx.CONTENT).alias("content"),
    )


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_files(spread(source_files(spark, sf_dir), "path"))


def all_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.code_units(parsed(spark, sf_dir))


def stored_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(units.last_units(all_units(spark, sf_dir)), "units", by="kind")


def measured_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(
        F.lit("m").alias("repo"),
        F.expr("concat('/m/', cast(p_partkey as string), '.py')").alias("path"),
        F.expr(fx.MEASURED_CONTENT).alias("content"),
    )
    return units.last_units(
        units.code_units(parse_files(spread(files, "path"), with_counts=True))
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = F.array(
        *[F.when(F.expr(condition), F.expr(fx.sql_text(path))) for condition, path in fx.LISTING]
    )
    return table(spark, sf_dir, "part").select(F.explode(F.array_compact(paths)).alias("path"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        *[F.expr(sql).alias(name) for name, sql in fx.CATALOGUE.items()]
    )


def _documents(rows: DataFrame, key: str, body: F.Column) -> DataFrame:
    """Neighbouring rows as the two documents of a block."""
    slot = F.col(key) % len(fixed.DOC_KEYS)
    doc_key = F.when(slot == 0, F.lit(fixed.DOC_KEYS[0])).otherwise(F.lit(fixed.DOC_KEYS[1]))
    return prompts.with_titles(
        rows.select(
            (F.col(key) - slot).cast("string").alias("block"),
            doc_key.alias("doc_key"),
            body.alias("body"),
        )
    )


def benchmark_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2024-01-02 15:04:05").cast("timestamp")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        text.run_label(F.col("role"), F.lit(" m/x:1 "), at).alias("run_id"),
        F.expr(fx.ANSWER_NAME).alias("name"),
        F.expr(fx.ANSWER).alias("response"),
    )


def rendered(spark: SparkSession, sf_dir: str, candidates: DataFrame) -> DataFrame:
    settings = prompts.lookup_template(catalogue(spark, sf_dir), "item_1")
    docs = prompts.docs_text(benchmark_docs(spark, sf_dir), "0")
    return prompts.render_prompts(candidates, F.lit(settings["template"]), docs)


# sources


@query
def src_scan(spark, sf_dir):
    paths = table(spark, sf_dir, "part").select(F.expr(fx.SCAN_PATH).alias("path"))
    return environments.python_files(paths).select("path", "name", "dir")


@query
def src_decode(spark, sf_dir):
    content = F.encode(F.expr(fx.CONTENT), "UTF-8")
    raw = table(spark, sf_dir, "part").select(
        F.lit("repo").alias("repo"),
        F.expr(fx.PATH).alias("path"),
        F.when(F.col("p_partkey") % 11 == 0, F.concat(content, F.unhex(F.lit("FFFE"))))
        .otherwise(content)
        .alias("content"),
    )
    return decode(raw).select(
        "path",
        F.col("error").isNull().cast("int").alias("valid"),
        F.coalesce("content", F.lit("")).alias("content"),
    )


@query
def venv_roots(spark, sf_dir):
    return environments.environment_roots(listing(spark, sf_dir), "/tree")


@query
def venv_prune(spark, sf_dir):
    rows = listing(spark, sf_dir)
    roots = environments.environment_roots(rows, "/tree")
    return environments.prune_environments(environments.python_files(rows), roots).select("path")


@query
def tree_candidates(spark, sf_dir):
    """Raw bytes of all files of a tree to candidates."""
    files = listing(spark, sf_dir).select(
        F.lit("tree").alias("repo"), "path", F.encode(F.expr(fx.TREE_CONTENT), "UTF-8").alias("text")
    )
    broken = F.when(F.expr(fx.TREE_BROKEN), F.concat("text", F.unhex(F.lit("FFFE")))).otherwise(F.col("text"))
    files = files.select("repo", "path", broken.alias("content"))
    found = discovery.retrieve_function_candidates(discovery.source_files(files, "/tree"))
    return found.select("name", "path", "line", "code")


# parsing


@query
def fn_units(spark, sf_dir):
    return units.functions(all_units(spark, sf_dir)).select("path", "name", "line", "code")


@query
def method_units(spark, sf_dir):
    return units.methods(all_units(spark, sf_dir)).select(
        "path", "class_name", "class_line", "name", "line", "code"
    )


@query
def class_methods(spark, sf_dir):
    return units.methods(all_units(spark, sf_dir)).select(
        "path", "class_name", "class_line", "pos", "method", "line"
    )


@query
def parse_errors(spark, sf_dir):
    return units.parse_errors(parsed(spark, sf_dir)).select(
        "path", F.substring_index("error", ":", 1).alias("error_type")
    )


@query
def units_per_file(spark, sf_dir):
    return units.units_per_file(parsed(spark, sf_dir)).drop("repo")


@query
def discovery_summary(spark, sf_dir):
    stored = materialize(all_units(spark, sf_dir), "units", by="kind")
    found = discovery.retrieve_candidates(units.last_units(stored))
    return units.discovery_summary(stored, found)


@query
def fn_last_in_file(spark, sf_dir):
    return units.last_units(all_units(spark, sf_dir)).select("path", "kind", "name", "line", "code")


# candidates


@query
def candidate_dedup(spark, sf_dir):
    found = cand.late_function_candidates(stored_units(spark, sf_dir))
    return found.select("name", "path", "line", "code")


@query
def smell_candidates(spark, sf_dir):
    """Files whose names meet: one that the score drops never overwrites another."""
    files = table(spark, sf_dir, "part").select(
        F.lit("m").alias("repo"),
        F.expr("concat('/m/', cast(p_partkey as string), '.py')").alias("path"),
        F.expr(fx.SMELL_CONTENT).alias("content"),
    )
    stored = materialize(discovery.parsed_units(files, smell=True), "units", by="kind")
    found = discovery.retrieve_candidates(discovery.scored_units(stored, smell=True))
    return found.select("name", "kind", "path", "line")


@query
def candidate_union(spark, sf_dir):
    stored = stored_units(spark, sf_dir)
    return cand.union_candidates(
        cand.function_candidates(stored), cand.method_candidates(stored)
    ).select("name", "kind", "path", "line", "code")


@query
def method_focus(spark, sf_dir):
    target = prompts.target_text(
        F.lit("method"), F.col("code"), F.col("class_code"), F.col("method")
    )
    return units.methods(units.last_units(all_units(spark, sf_dir))).select(
        "path", "name", "line", target.alias("target")
    )


# score


@query
def mi_score(spark, sf_dir):
    lines = F.floor("l_quantity").cast("int") - 1
    volume = F.col("l_extendedprice") * (F.col("l_linenumber") - 1)
    mi = score.maintainability(volume, F.col("l_linenumber"), lines, F.col("l_discount") * 100)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(mi, 6).alias("mi")
    )


@query
def mi_counts(spark, sf_dir):
    return measured_units(spark, sf_dir).select(
        "path",
        "name",
        "counts.n_operators",
        "counts.n_operands",
        "counts.u_operators",
        "counts.u_operands",
        "counts.complexity",
        "counts.sloc",
        F.round("counts.comment_pct", 6).alias("comment_pct"),
    )


@query
def mi_filter(spark, sf_dir):
    kept = score.keep_hard_units(measured_units(spark, sf_dir)).filter("kind = 'function'")
    return kept.select("path", "name", F.round(score.unit_score(F.col("counts")), 6).alias("mi"))


@query
def mi_filter_class(spark, sf_dir):
    kept = score.keep_hard_units(measured_units(spark, sf_dir)).filter("kind = 'class'")
    mi = F.round(score.unit_score(F.col("counts")), 6)
    return kept.select("path", "name", mi.alias("mi"), F.explode("methods").alias("m")).select(
        "path", F.concat_ws(".", "name", "m.name").alias("name"), "mi"
    )


# prompts


@query
def template_lookup(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("item_"), (F.col("o_orderkey") % 50).cast("string")).alias("prompt_id"),
    )
    return prompts.resolve_templates(requests, catalogue(spark, sf_dir)).select(
        "o_orderkey", "prompt_id", "temperature", "template", F.col("found").cast("int").alias("found")
    )


@query
def docs_block(spark, sf_dir):
    body = F.when(F.col("doc_id") % 7 != 3, F.expr(fx.MARKDOWN))
    return prompts.docs_blocks(_documents(spread(table(spark, sf_dir, "documents"), "doc_id"), "doc_id", body))


@query
def prompt_render(spark, sf_dir):
    found = discovery.retrieve_candidates(stored_units(spark, sf_dir))
    return rendered(spark, sf_dir, found).select("name", "kind", "prompt")


@query
def fn_candidates(spark, sf_dir):
    found = discovery.retrieve_function_candidates(source_files(spark, sf_dir))
    return rendered(spark, sf_dir, found).select("name", "prompt")


@query
def method_candidates(spark, sf_dir):
    found = discovery.retrieve_method_candidates(source_files(spark, sf_dir))
    return rendered(spark, sf_dir, found).select("name", "prompt")


# text


@query
def md_clean(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", text.clean_markdown(F.expr(fx.MARKDOWN)).alias("cleaned")
    )


@query
def url_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", text.clean_url(F.expr(fx.URL)).alias("clean_url")
    )


@query
def url_stem(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", text.url_stem(F.expr(fx.URL)).alias("stem")
    )


@query
def kv_map(spark, sf_dir):
    given = F.split(F.regexp_replace("url", "^[^?]*[?]?", ""), "&")
    more = F.array(
        F.lit("bad"),
        F.concat(F.lit("k="), F.col("page_id").cast("string")),
        *[F.lit(option) for option in ("=e", "x=y=z", "k=", "page=last")],
    )
    return table(spark, sf_dir, "pages").select(
        "page_id", F.explode(text.options_map(F.concat(given, more)))
    )


@query
def run_id(spark, sf_dir):
    ts = F.expr("timestampadd(SECOND, o_orderkey * 37, o_orderdate)")
    model = F.concat(F.lit(" gem/"), F.col("o_orderstatus"), F.lit(":1\n"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.run_label(F.col("o_orderpriority"), model, ts).alias("run_id")
    )


@query
def code_blocks(spark, sf_dir):
    return outcomes.with_block(answers(spark, sf_dir)).select("conv_id", "turn", "block")


@query
def first_choice(spark, sf_dir):
    choices = F.expr(
        "case (conv_id + turn) % 4"
        " when 0 then array()"
        " when 1 then array(cast(null as struct<message:struct<content:string>>))"
        " when 2 then array(named_struct('message', named_struct('content', text)))"
        " else array(named_struct('message', named_struct('content', role)),"
        " named_struct('message', named_struct('content', text))) end"
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.first_choice(choices).alias("response")
    )


# answers


@query
def completions(spark, sf_dir):
    found = discovery.retrieve_candidates(stored_units(spark, sf_dir))
    asked = rendered(spark, sf_dir, found)
    return complete(asked, offline_client, 0.1).select(
        "name", text.first_choice(F.col("choices")).alias("response"), "error"
    )


@query
def harness_rows(spark, sf_dir):
    return outcomes.accepted(answers(spark, sf_dir))


@query
def failure_rows(spark, sf_dir):
    at = F.lit("2024-01-02 15:04:05").cast("timestamp")
    failed = outcomes.rejected(answers(spark, sf_dir), at)
    entry = text.failure_entry(F.col("ts"), F.col("context"), F.col("error_msg"))
    return failed.select("run_id", "context", "name", "error_msg", entry.alias("entry"))


def whole_run(spark: SparkSession, sf_dir: str, **changed) -> harness_run.RunResult:
    return harness_run.run(
        spark,
        source_files(spark, sf_dir),
        templates=catalogue(spark, sf_dir),
        docs=benchmark_docs(spark, sf_dir),
        docs_block="0",
        prompt_id="item_1",
        **{
            "client_factory": offline_client,
            "model": "offline/none",
            "output": new_scratch_path(spark, "run"),
            "job": "check",
            "ts": datetime(2024, 1, 2, 15, 4, 5),
            **changed,
        },
    )


@query
def harness_run_outcomes(spark, sf_dir):
    result = whole_run(spark, sf_dir)
    empty = F.col("error_msg").startswith(fixed.MESSAGE_EMPTY.split("{")[0])
    failed = result.failures.select(
        "name",
        F.when(empty, F.lit("empty")).otherwise(F.lit("no block")).alias("outcome"),
        F.lit("").alias("code"),
    )
    return result.harnesses.select("name", F.lit("saved").alias("outcome"), "code").union(failed)


@query
def harness_rerun_outcomes(spark, sf_dir):
    """One job three times: two attempts meet outages, the second and third ask another model."""
    output = new_scratch_path(spark, "rerun")
    for model, client in (("first/one", shaky_client), ("second/one", shaky_client), ("second/one", steady_client)):
        result = whole_run(spark, sf_dir, output=output, model=model, client_factory=client)
    return result.harnesses.select("run_id", "name", "code")


@query
def runs_table(spark, sf_dir):
    """The table of all runs after two jobs and a second attempt at the first, which
    asks another model that answers everything."""
    output = new_scratch_path(spark, "runs")
    late = datetime(2024, 1, 3, 15, 4, 5)
    for job, model, client, ts in (
        ("one", "a/b", offline_client, None),
        ("two", "a/b", offline_client, late),
        ("one", "a/b", steady_client, None),
    ):
        options = {"ts": ts} if ts else {}
        whole_run(
            spark, sf_dir, output=output, job=job, model=model, client_factory=client, calls_in_flight=4, **options,
            params={"client": client.__name__},
        )
    return spark.read.parquet(f"{output}/outcomes").select(
        "run_id", "name", F.coalesce("code", F.lit("")).alias("code"), F.col("error_msg").isNotNull().cast("int").alias("failed")
    )


@query
def sql_units(spark, sf_dir):
    """Functions and methods of files by a table function, in SQL alone."""
    register_python_units(spark)
    source_files(spark, sf_dir).createOrReplaceTempView("sourcemine_files")
    return spark.sql(
        """
        SELECT path, kind, class_name, name, line, code
        FROM sourcemine_files f, LATERAL python_units(f.content) u
        """
    )


@query
def run_totals(spark, sf_dir):
    names = ["files_scanned", "files_failed", "functions_found", "methods_found", "candidates", "harnesses", "failures"]
    return whole_run(spark, sf_dir).totals.select(*names)
