"""Prompts, answers, and the whole run."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sourcemine import fixed_values as fixed
from sourcemine import schemas
from sourcemine.operators import outcomes, prompts
from sourcemine.operators.completion import complete, offline_client, steady_client
from sourcemine.plans.harness_run import run
from sourcemine.sinks.tables import export_files
from sourcemine.storage import new_scratch_path

AT = datetime(2024, 1, 2, 15, 4, 5)


@pytest.fixture
def templates(spark):
    return spark.createDataFrame(
        [
            ("base", "0.3", "d", "Task:\n{{CODE}}\n--\n{{DOCS}}", "m", 1.0),
            ("blind", "0.2", "d", "No code here. {{DOCS}}", "m", 1.0),
        ],
        "prompt_id string, temperature string, description string, template string, model string, top_p double",
    )


@pytest.fixture
def docs(spark):
    rows = [
        ("b", key, f"TITLE {i}", "intro", f"see [x](https://a/b) [y](./c)\n\n\n\nbody {i}")
        for i, key in enumerate(fixed.DOC_KEYS)
    ]
    return spark.createDataFrame(rows, schemas.REFERENCE_DOCS)


def banner(i):
    return f"\n==== START OF TITLE {i} ====\n\nintro\n\nsee  [y](./c)\n\nbody {i}\n\n==== END OF TITLE {i} ====\n"


def test_template_lookup(templates):
    row = prompts.lookup_template(templates, "base")
    assert (row["temperature"], row["template"]) == (0.3, "Task:\n{{CODE}}\n--\n{{DOCS}}")
    with pytest.raises(KeyError):
        prompts.lookup_template(templates, "none")


def test_resolve_templates_marks_unknown_ids(spark, templates):
    asked = spark.createDataFrame([(1, "base"), (2, "none")], "run int, prompt_id string")
    rows = prompts.resolve_templates(asked, templates).orderBy("run").collect()
    assert [(r["found"], r["temperature"]) for r in rows] == [(True, 0.3), (False, None)]


def test_docs_block(spark, docs):
    def block(df):
        return df.first()["docs"]

    assert block(prompts.docs_blocks(docs)) == f"{banner(0)}\n\n{banner(1)}"
    assert block(prompts.docs_blocks(docs.filter("doc_key = 'hooking'"))) == f"\n\n{banner(1)}"
    failed = docs.withColumn("body", F.when(F.col("doc_key") == "hooking", F.col("body")))
    assert block(prompts.docs_blocks(failed)) == f"\n\n{banner(1)}"
    none = spark.range(1).select(prompts.docs_text(docs, "unknown").alias("docs"))
    assert block(none) == "\n\n"


def rendered(spark, code, template, docs="DOC"):
    df = spark.createDataFrame([(code,)], "code string")
    return df.select(prompts.render(F.lit(template), F.col("code"), F.lit(docs))).first()[0]


def test_replacement_is_literal_and_in_sequence(spark):
    assert rendered(spark, "a {{DOCS}} $1 \\x", "{{CODE}}|{{CODE}}|{{DOCS}}") == (
        "a DOC $1 \\x|a DOC $1 \\x|DOC"
    )
    assert rendered(spark, "x", "{{CODE}}", docs="{{CODE}}") == "x"
    assert rendered(spark, "x", "none {{DOCS}}", docs="{{CODE}}") == "none {{CODE}}"
    assert rendered(spark, "hidden", "no token") == "no token"


def test_method_target(spark):
    target = prompts.target_text(F.lit("method"), F.lit("def m(self): pass"), F.lit("class C: ..."), F.lit("m"))
    assert spark.range(1).select(target).first()[0] == (
        "\n\nclass C: ...\n\n**FUZZING FOCUS**\nMethod Name: m\nMethod Body:\ndef m(self): pass"
    )


def test_outcomes_split_every_answer_once(spark):
    answers = spark.createDataFrame(
        [
            ("r", "ok", "```py\nx\n```"),
            ("r", "two_empty", "```\n``` ```\n```"),
            ("r", "one_empty", "```\n```"),
            ("r", "prose", "sorry"),
            ("r", "blank", ""),
            ("r", "null", None),
        ],
        "run_id string, name string, response string",
    )
    good = {r["name"]: r["code"] for r in outcomes.accepted(answers).collect()}
    bad = {r["name"]: r["error_msg"] for r in outcomes.rejected(answers, F.lit(AT)).collect()}
    assert good == {"ok": "x\n", "two_empty": "\n\n"}
    assert bad == {
        "one_empty": "No code block found in LLM response for: one_empty",
        "prose": "No code block found in LLM response for: prose",
        "blank": "Empty response from LLM for candidate: blank",
        "null": "Empty response from LLM for candidate: null",
    }


SOURCES = {
    f"p{i:03}.py": f"def f{i}(x):\n    return x + {i}\n\nclass C{i % 9}:\n    def m{i % 4}(self):\n        return {i}\n"
    for i in range(60)
}


def counting_client(log_dir, fail=None):
    """Leaves one file per call, so that calls can be counted across workers."""

    def factory():
        import os
        import uuid

        answer = offline_client()

        def call(prompt, **settings):
            with open(os.path.join(log_dir, uuid.uuid4().hex), "w") as file:
                file.write(f"{settings['model']} {settings['temperature']} {settings['num_retries']} {settings.get('k')}")
            if fail and fail in prompt:
                raise RuntimeError("down")
            return answer(prompt)

        return call

    return factory


def start(spark, files, templates, docs, output, factory, sources=SOURCES, **options):
    settings = {"prompt_id": "base", "job": "j1", "ts": AT, "model": "offline/none", **options}
    return run(
        spark, files(sources), templates, docs, "b", client_factory=factory, output=output, **settings,
    )


def test_whole_run(spark, files, templates, docs, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    result = start(spark, files, templates, docs, new_scratch_path(spark, "t"), counting_client(str(log)), params={"k": "v"})
    names = [r["name"] for r in result.candidates.collect()]
    assert len(names) == len(set(names)) == 60 + 36
    good = {r["name"] for r in result.harnesses.collect()}
    bad = {r["name"] for r in result.failures.collect()}
    assert good | bad == set(names) and not good & bad and good and bad
    calls = list(log.iterdir())
    assert len(calls) == len(names)
    assert calls[0].read_text() == "offline/none 0.3 5 v"
    row = result.harnesses.first()
    assert row["run_id"] == "fuzzing(repo)using(offline.noneon(01-02-24_03-04-05pm)"
    assert re.fullmatch("# [0-9a-f]{64}\n", row["code"])


def test_second_attempt_asks_only_what_failed(spark, files, templates, docs, tmp_path):
    log, output = tmp_path / "calls", new_scratch_path(spark, "t")
    log.mkdir()
    first = start(spark, files, templates, docs, output, counting_client(str(log)))
    before = sorted(first.harnesses.collect())
    asked = len(list(log.iterdir()))
    failed = first.completions.filter("error is not null").count()
    second = start(spark, files, templates, docs, output, counting_client(str(log)))
    assert sorted(second.harnesses.collect()) == before
    again = len(list(log.iterdir()))
    assert failed and again == asked + failed
    assert second.completions.count() == asked
    changed = {**SOURCES, "p000.py": "def f0(x):\n    return None\n"}
    third = start(spark, files, templates, docs, output, counting_client(str(log)), sources=changed)
    # Only f0 is new; C0.m0 is supplied by p036.py both before and after.
    assert len(list(log.iterdir())) - again in (failed, failed + 1)
    assert third.harnesses.count() + third.failures.count() == third.candidates.count() == asked


def test_answers_belong_to_their_settings(spark, files, templates, docs):
    output = new_scratch_path(spark, "t")

    def client(model, temperature):
        def answer(prompt, **settings):
            assert (settings["model"], settings["temperature"]) == (model, temperature)
            return [f"```\n# {model} {temperature} {settings.get('k')}\n```"]

        return lambda: answer

    def down():
        def answer(prompt, **settings):
            raise ConnectionError("down")

        return answer

    def codes(result):
        assert result.failures.count() == 0
        return {r["code"].strip() for r in result.harnesses.collect()}

    assert start(spark, files, templates, docs, output, down).harnesses.count() == 0
    first = start(spark, files, templates, docs, output, client("A/one", 0.3), model=" A/one ")
    assert codes(first) == {"# A/one 0.3 None"}
    second = start(spark, files, templates, docs, output, client("B/two", 0.3), model="B/two")
    assert codes(second) == {"# B/two 0.3 None"}
    third = start(spark, files, templates, docs, output, client("B/two", 0.3), model="B/two", params={"k": "v"})
    assert codes(third) == {"# B/two 0.3 v"}
    warmer = templates.withColumn("temperature", F.lit(0.9))
    fourth = start(spark, files, warmer, docs, output, client("B/two", 0.9), model="B/two")
    assert codes(fourth) == {"# B/two 0.9 None"}
    with pytest.raises(ValueError, match="params may not set model"):
        start(spark, files, templates, docs, output, down, params={"model": "x"})
    with pytest.raises(KeyError, match="has no temperature"):
        start(spark, files, templates.withColumn("temperature", F.lit(None).cast("double")), docs, output, down)


def test_waves_give_the_same_answers(spark, files, templates, docs):
    one = start(spark, files, templates, docs, new_scratch_path(spark, "t"), offline_client)
    many = start(
        spark, files, templates, docs, new_scratch_path(spark, "t"), offline_client, workers=3, calls_per_task=7
    )
    assert many.candidates.select("wave").distinct().count() > 2
    assert sorted(one.harnesses.collect()) == sorted(many.harnesses.collect())
    assert sorted(one.failures.drop("ts").collect()) == sorted(many.failures.drop("ts").collect())


def test_restart_after_a_lost_run_keeps_what_was_answered(spark, files, templates, docs, tmp_path):
    log, output = tmp_path / "calls", new_scratch_path(spark, "t")
    log.mkdir()
    path = str(log)
    inner = counting_client(path)

    def breaking():
        import os

        if len(os.listdir(path)) > 40:
            raise SystemError("no client on this machine")
        return inner()

    options = {"workers": 3, "calls_per_task": 7}
    with pytest.raises(Exception, match="no client on this machine"):
        start(spark, files, templates, docs, output, breaking, **options)
    kept = spark.read.parquet(f"{output}/completions/job=j1").where("error is null").count()
    assert kept > 0
    before = len(list(log.iterdir()))
    result = start(spark, files, templates, docs, output, inner, **options)
    assert len(list(log.iterdir())) - before == 96 - kept
    assert result.harnesses.count() + result.failures.count() == 96
    clean = start(spark, files, templates, docs, new_scratch_path(spark, "t"), offline_client)
    assert sorted(result.harnesses.collect()) == sorted(clean.harnesses.collect())


def test_a_failing_call_fails_alone(spark, files, templates, docs, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    result = start(
        spark, files, templates, docs, new_scratch_path(spark, "t"), counting_client(str(log), fail="def f7(")
    )
    failed = result.completions.filter("error like 'RuntimeError%'").collect()
    assert [r["name"] for r in failed] == ["f7"]
    message = result.failures.filter("name = 'f7'").first()
    assert (message["context"], message["error_msg"]) == (
        "Generation", "Empty response from LLM for candidate: f7",
    )


def test_template_without_the_code_token_never_shows_code(spark, files, templates, docs):
    result = start(spark, files, templates, docs, new_scratch_path(spark, "t"), offline_client, prompt_id="blind")
    assert result.candidates.select("prompt_sha").distinct().count() == 1


def test_unknown_template_is_fatal_and_reported(spark, files, templates, docs):
    output = new_scratch_path(spark, "t")
    with pytest.raises(KeyError):
        start(spark, files, templates, docs, output, offline_client, prompt_id="none")
    report = spark.read.parquet(f"{output}/fatal").collect()
    assert [(r["context"], r["run_id"]) for r in report] == [("Orchestration", "j1")]
    assert report[0]["error_msg"].startswith("Fatal coordination error: ")


def test_no_candidates_end_the_run_quietly(spark, files, templates, docs):
    result = start(
        spark, files, templates, docs, new_scratch_path(spark, "t"), offline_client, sources={"a.py": "x = 1\n"}
    )
    assert result.candidates.count() == result.harnesses.count() == result.failures.count() == 0


def test_score_filter_in_a_run(spark, files, templates, docs):
    hard = "def {}(x, y):\n" + "    if x > 1 and y < x + 1:\n        y = y * x\n" * 40 + "    return y\n"
    sources = {
        "a.py": hard.format("kept") + "def easy(x):\n    return x\n",
        "b.py": "def kept(x):\n    return x\n" + hard.format("late"),
    }
    result = start(spark, files, templates, docs, new_scratch_path(spark, "t"), offline_client, sources=sources, smell=True)
    # The easy ``kept`` of b.py is dropped and does not replace the one of a.py.
    assert {(r["name"], r["path"]) for r in result.candidates.collect()} == {("kept", "a.py"), ("late", "b.py")}
    easy = start(spark, files, templates, docs, new_scratch_path(spark, "t"), offline_client, smell=True)
    assert easy.candidates.count() == 0


def test_export_and_totals_of_a_run(spark, files, templates, docs, tmp_path):
    log, root = tmp_path / "calls", tmp_path / "out"
    log.mkdir()
    sources = {"a.py": "def f(): pass\ndef g(): pass\n", "b.py": "def (\n", "c.py": f"def {'n' * 300}(): pass\n"}
    output = new_scratch_path(spark, "t")
    result = start(spark, files, templates, docs, output, steady_client, sources=sources, export=str(root))
    label = "fuzzing(repo)using(offline.noneon(01-02-24_03-04-05pm)"
    assert {p.parent.name for p in (root / label).rglob("*.py")} == {"f", "g"}
    failed = result.failures.collect()
    assert [r["name"] for r in failed] == ["n" * 300]
    assert failed[0]["error_msg"].startswith("Unexpected error processing ")
    row = result.totals.first().asDict()
    names = ["attempt", "files_scanned", "files_failed", "functions_found", "methods_found", "candidates", "harnesses", "failures"]
    assert [row[n] for n in names] == [1, 3, 1, 3, 0, 3, 3, 1]
    again = start(spark, files, templates, docs, output, steady_client, sources=sources, export=str(root))
    assert again.totals.first()["attempt"] == 2
    # The report of the first attempt is still there.
    report = spark.read.parquet(f"{output}/failures/job=j1")
    assert {r["attempt"] for r in report.collect()} == {1, 2}


def test_calls_in_flight_keep_order_and_bound(spark, tmp_path):
    log = str(tmp_path)

    def factory():
        import os
        import threading
        import time

        lock, now, most = threading.Lock(), [0], [0]

        def call(prompt, **settings):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
                open(os.path.join(log, f"{most[0]}"), "w").close()
            time.sleep(0.02)
            with lock:
                now[0] -= 1
            if prompt == "7":
                raise RuntimeError("down")
            return [prompt]

        return call

    asked = spark.range(0, 150, 1, 1).selectExpr("'r' repo", "cast(id as string) name", "cast(id as string) prompt")
    rows = complete(asked, factory, 0.1, calls_in_flight=5).collect()
    assert [r["name"] for r in rows] == [str(i) for i in range(150)]
    assert [r["name"] for r in rows if r["error"]] == ["7"]
    assert all(r["choices"][0]["message"]["content"] == r["name"] for r in rows if not r["error"])
    assert max(int(p.name) for p in tmp_path.iterdir()) == 5


def test_many_trees_in_one_run(spark, files, templates, docs):
    sources = {(repo, "a.py"): f"def f(): return '{repo}'\n" for repo in ("one", "two", "three")}
    result = start(spark, files, templates, docs, new_scratch_path(spark, "t"), offline_client, sources=sources)
    runs = {r["run_id"] for r in result.harnesses.unionByName(result.failures, True).collect()}
    assert {run.split("(")[1].split(")")[0] for run in runs} == {"one", "two", "three"}


def test_a_run_over_all_files_of_a_tree(spark, files, templates, docs):
    body = "def {}(): pass\r\n"
    sources = {
        "/t/a.py": body.format("a"),
        "/t/README.txt": body.format("readme"),
        "/t/venv/pyvenv.cfg": "",
        "/t/venv/bin/python": "",
        "/t/venv/lib/dep.py": body.format("dep"),
        "/t/venv2/b.py": body.format("b"),
    }
    raw = files(sources).withColumn("content", F.encode("content", "UTF-8"))
    result = start(spark, lambda _: raw, templates, docs, new_scratch_path(spark, "t"), offline_client)
    assert {r["name"] for r in result.candidates.collect()} == {"a", "b"}


def test_export_stays_in_its_folder(spark, tmp_path):
    rows = [("..", "out", "x.py", "1"), ("run", "../../out", "x.py", "1"), ("run", "in", "x.py", "1")]
    df = spark.createDataFrame(rows, "run_id string, name string, file_name string, code string")
    root = tmp_path / "root"
    done = {r["name"]: r["error"] for r in export_files(df, str(root)).collect()}
    assert done == {"out": "outside the export folder", "../../out": "outside the export folder", "in": None}
    assert [p.name for p in tmp_path.iterdir()] == ["root"]


def test_client_is_built_once_per_partition(spark, tmp_path):
    log = str(tmp_path)

    def factory():
        import os
        import uuid

        open(os.path.join(log, uuid.uuid4().hex), "w").close()
        return lambda prompt, **settings: [prompt, "second"]

    asked = spark.range(200).selectExpr("'r' repo", "cast(id as string) name", "cast(id as string) prompt").repartition(4)
    rows = complete(asked, factory, 0.1).collect()
    assert len(list(tmp_path.iterdir())) == 4
    assert all(r["choices"][0]["message"]["content"] == r["name"] for r in rows)
    assert len(rows) == 200


def test_export_writes_one_file_per_harness(spark, tmp_path):
    rows = [("run(a)", "f", "x_((f)).py", "é = 1\n"), ("run(a)", "C.m", "x_((C.m)).py", None), ("run(a)", "n" * 300, "x.py", "y")]
    df = spark.createDataFrame(rows, "run_id string, name string, file_name string, code string")
    done = {r["name"]: r["error"] for r in export_files(df, str(tmp_path)).collect()}
    assert (tmp_path / "run(a)" / "f" / "x_((f)).py").read_text(encoding="utf-8") == "é = 1\n"
    assert (tmp_path / "run(a)" / "C.m" / "x_((C.m)).py").read_text() == ""
    assert done["f"] is None and done["C.m"] is None
    assert "too long" in done["n" * 300]
    assert len([p for p in tmp_path.rglob("*") if p.is_file()]) == 2
    failed = outcomes.not_exported(export_files(df, str(tmp_path)), F.lit(AT)).collect()
    assert [r["name"] for r in failed] == ["n" * 300]
    assert failed[0]["error_msg"].startswith(f"Unexpected error processing {'n' * 300}: ")


def test_unstorable_answers_fail_alone(spark):
    answers = {"0": ["\ud800"], "1": [7], "2": 7, "3": None, "4": ["fine"], "5": [None]}
    asked = spark.range(6).selectExpr("'r' repo", "cast(id as string) name", "cast(id as string) prompt")
    rows = complete(asked, lambda: lambda prompt, **settings: answers[prompt], 0.1).collect()
    got = {r["name"]: (r["error"] or "").split(":")[0] for r in rows}
    assert got == {"0": "UnicodeEncodeError", "1": "TypeError", "2": "TypeError", "3": "TypeError", "4": "", "5": ""}


def test_candidates_hold_no_text_and_a_folder_is_read_once(spark, templates, docs, tmp_path):
    folder = tmp_path / "repo"
    (folder / "venv" / "bin").mkdir(parents=True)
    for name, text in {"a.py": "def f(): pass\n", "venv/pyvenv.cfg": "", "venv/bin/python": "", "venv/x.py": "def g(): pass\n"}.items():
        (folder / name).write_text(text)
    result = run(
        spark, str(folder), templates, docs, "b", prompt_id="base", client_factory=steady_client, model="m",
        output=new_scratch_path(spark, "t"), job="j", ts=AT, calls_in_flight=2, time_limit=60,
    )
    assert [r["name"] for r in result.harnesses.collect()] == ["f"]
    assert not {"code", "class_code", "prompt"} & set(result.candidates.columns)


def test_a_scan_that_fails_is_reported(spark, files, templates, docs):
    output = new_scratch_path(spark, "t")
    broken = files(SOURCES).withColumn("content", F.raise_error(F.lit("no such disk")))
    with pytest.raises(Exception, match="no such disk"):
        start(spark, lambda _: broken, templates, docs, output, offline_client)
    report = {(r["context"], r["error_msg"][:40]) for r in spark.read.parquet(f"{output}/fatal").collect()}
    assert {c for c, _ in report} == {"Parser", "Orchestration"} and len(report) == 3


def test_all_runs_are_in_one_table(spark, files, templates, docs):
    output = new_scratch_path(spark, "t")
    sources = {"a.py": "def f(): pass\ndef g(): pass\n"}
    for model in ("one", "two"):
        start(spark, files, templates, docs, output, offline_client, sources=sources, model=model, job=model)
    start(spark, files, templates, docs, output, steady_client, sources=sources, model="one", job="one", params={"k": "2"})
    rows = spark.read.parquet(f"{output}/outcomes").collect()
    assert len(rows) == 4 and len({r["run_id"] for r in rows}) == 2
    assert {r["code"][:5] for r in rows if "using(one" in r["run_id"]} == {"# one"}
    totals = spark.read.parquet(f"{output}/runs/job=one").collect()
    assert sorted(r["attempt"] for r in totals) == [1, 2]
