"""The folder tree as a data source, the table function, runs in one table, time limits."""

import builtins
import os
import time

import pytest
from pyspark.sql import functions as F

from sourcemine.functions.table import register_python_units
from sourcemine.operators.completion import complete
from sourcemine.operators.outcomes import rejected
from sourcemine.sinks.tables import replace_runs
from sourcemine.sources import tree_source
from sourcemine.sources.tree import read_tree
from sourcemine.storage import new_scratch_path


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "work"
    for i in range(30):
        path = root / f"p{i % 4}" / f"q{i % 7}" / f"_m{i}.py"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"x = {i}\n" if i else "")
    (root / "p0" / "bad.py").write_bytes(b"\xff\xfe")
    (root / "p0" / "note.txt").write_text("no")
    for name in ("venv/pyvenv.cfg", "venv/bin/python", "venv/lib/dep.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("")
    os.symlink(root / "p1", root / "link")
    return root


@pytest.mark.parametrize("partitions", [1, 5, 1000])
def test_source_equals_the_reader_by_levels(spark, folder, partitions):
    tree_source.register_source_tree(spark)
    got = spark.read.format("source_tree").option("partitions", partitions).load(str(folder))
    want = read_tree(spark, str(folder))
    assert got.columns == want.columns
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert got.count() == 31


def test_paths_open_no_file(spark, folder, monkeypatch):
    tree_source.register_source_tree(spark)
    paths = spark.read.format("source_tree").schema("repo string, path string").load(str(folder))
    want = {(r["repo"], r["path"]) for r in read_tree(spark, str(folder)).collect()}
    assert {tuple(r) for r in paths.collect()} == want
    opened = []
    plain = builtins.open
    monkeypatch.setattr(builtins, "open", lambda *a, **k: (opened.append(a[0]), plain(*a, **k))[1])
    for names, times in (("repo string, path string", 0), ("path string, content binary", 31)):
        schema = spark.createDataFrame([], names).schema
        opened.clear()
        reader = tree_source.TreeReader({"path": str(folder)}, schema)
        parts = reader.partitions()
        assert sum(b.num_rows for p in parts for b in reader.read(p)) == 31
        assert len([x for x in opened if str(x).find("work") >= 0 or b"work" in os.fsencode(x)]) == times


def test_unknown_columns_are_refused(spark, folder):
    tree_source.register_source_tree(spark)
    with pytest.raises(Exception, match="source_tree has no owner"):
        spark.read.format("source_tree").schema("owner string").load(str(folder)).collect()


def test_table_function_in_sql(spark):
    register_python_units(spark)
    rows = [("a", "def f(): pass\r\nclass C:\n    def m(self): pass\n    x = 1\n"), ("b", "def ("), ("c", None), ("d", "")]
    spark.createDataFrame(rows, "path string, content string").createOrReplaceTempView("some_files")
    got = spark.sql("SELECT path, u.* FROM some_files f, LATERAL python_units(f.content) u").collect()
    assert sorted(map(tuple, got)) == [
        ("a", "function", None, "f", 1, "def f(): pass"),
        ("a", "method", "C", "C.m", 3, "def m(self): pass"),
    ]
    with pytest.raises(Exception, match="takes the text of a source"):
        spark.sql("SELECT * FROM python_units(7)").collect()


def test_runs_replace_their_own_partition(spark):
    path = new_scratch_path(spark, "runs")

    def rows(*values):
        return spark.createDataFrame(list(values), "run_id string, name string, code string")

    replace_runs(rows(("a", "x", "1"), ("a", "y", "1"), ("b(2)/c", "x", "1")), path)
    replace_runs(rows(("a", "x", "2")), path)
    got = spark.read.parquet(path).select("run_id", "name", "code").collect()
    assert sorted(map(tuple, got)) == [("a", "x", "2"), ("b(2)/c", "x", "1")]


def test_one_hung_call_fails_alone_and_others_come_first(spark):
    def factory():
        def call(prompt, **settings):
            time.sleep(60 if prompt == "0" else 0.01)
            return [prompt]

        return call

    asked = spark.range(0, 100, 1, 1).selectExpr("'r' repo", "cast(id as string) name", "cast(id as string) prompt")
    start = time.monotonic()
    rows = complete(asked, factory, 0.1, calls_in_flight=3, as_finished=True, time_limit=3.0).collect()
    assert time.monotonic() - start < 40
    assert sorted(int(r["name"]) for r in rows) == list(range(100))
    assert rows[0]["name"] != "0" and rows[-1]["name"] == "0"
    assert [r["name"] for r in rows if r["error"]] == ["0"] and rows[-1]["error"].startswith("TimeoutError")
    answers = spark.createDataFrame(rows).select(F.lit("run").alias("run_id"), "name", F.lit("").alias("response"), "error")
    late = rejected(answers, F.current_timestamp()).where("name = '0'").first()
    assert late["context"] == "Threading" and late["error_msg"].startswith("Thread execution failed for 0: TimeoutError")


def test_a_limit_keeps_the_order_of_rows(spark):
    def factory():
        def call(prompt, **settings):
            time.sleep(60 if prompt == "2" else 0.0)
            return [prompt]

        return call

    asked = spark.range(0, 10, 1, 1).selectExpr("'r' repo", "cast(id as string) name", "cast(id as string) prompt")
    rows = complete(asked, factory, 0.1, calls_in_flight=2, time_limit=1.0).collect()
    assert [r["name"] for r in rows] == [str(i) for i in range(10)]
    assert [r["name"] for r in rows if r["error"]] == ["2"]
