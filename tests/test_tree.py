"""Folder trees and listings."""

import os

import pytest
from pyspark.sql import functions as F

from sourcemine.operators import environments as env
from sourcemine.operators.units import code_units
from sourcemine.operators.parse import parse_files
from sourcemine.sources.files import decode
from sourcemine.sources.tree import list_tree, read_tree


def make(root, files):
    for path, content in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content.encode() if isinstance(content, str) else content)


TREE = {
    "top.py": "def top(): pass\n",
    "pkg/__init__.py": "def init(): pass\n",
    "pkg/_p.py": "def private(): pass\n",
    "pkg/a.py": "def a(): pass\n",
    "pkg/U.PY": "def upper(): pass\n",
    "pkg/empty.py": "",
    "pkg/notes.txt": "def no(): pass\n",
    ".hid/b.py": "def b(): pass\n",
    "_priv/c.py": "def c(): pass\n",
    "venv/pyvenv.cfg": "",
    "venv/bin/python": "",
    "venv/lib/v.py": "def v(): pass\n",
    "env2/pyvenv.cfg": "",
    "env2/x.py": "def x(): pass\n",
    "win/pyvenv.cfg": "",
    "win/Scripts/python.exe": "",
    "win/y.py": "def y(): pass\n",
    "nocfg/bin/python": "",
    "nocfg/z.py": "def z(): pass\n",
}
KEPT = {
    "top.py", "pkg/__init__.py", "pkg/_p.py", "pkg/a.py", "pkg/empty.py", ".hid/b.py", "_priv/c.py", "env2/x.py", "nocfg/z.py",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "project"
    make(root, TREE)
    (root / "dir.py").mkdir()
    make(root, {"dir.py/inside.py": "def inside(): pass\n"})
    os.symlink(root / "pkg", root / "link")
    os.symlink(root / "pkg" / "a.py", root / "alias.py")
    os.symlink(root / "gone", root / "broken.py")
    return root


def expected():
    return KEPT | {"dir.py/inside.py", "alias.py"}


def relative(root, rows):
    return {os.path.relpath(row["path"], root) for row in rows}


def test_listing_keeps_hidden_and_empty_files_and_skips_environments(spark, tree):
    rows = list_tree(spark, str(tree)).collect()
    assert relative(tree, rows) == expected()
    assert len(rows) == len(expected())


def test_scan_root_is_never_an_environment(spark, tree):
    rows = list_tree(spark, str(tree / "venv")).collect()
    assert relative(tree, rows) == {"venv/lib/v.py"}


def test_missing_root_gives_nothing(spark, tmp_path):
    assert list_tree(spark, str(tmp_path / "nowhere")).count() == 0


def test_walk_agrees_with_the_table_rules(spark, tree):
    paths = [os.path.join(folder, name) for folder, _, names in os.walk(tree) for name in names]
    listing = spark.createDataFrame([(p,) for p in paths], "path string")
    roots = env.environment_roots(listing, str(tree))
    assert {os.path.basename(r["dir"]) for r in roots.collect()} == {"venv", "win"}
    kept = env.prune_environments(env.python_files(listing), roots)
    assert relative(tree, kept.collect()) == expected() | {"broken.py"}


def test_root_with_environment_files_keeps_its_own_sources(spark):
    paths = ["/r/pyvenv.cfg", "/r/bin/python", "/r/a.py", "/r/lib/b.py"]
    listing = spark.createDataFrame([(p,) for p in paths], "path string")
    assert env.environment_roots(listing, "/r/").count() == 0
    assert env.environment_roots(listing).count() == 1


def test_prefix_of_a_name_is_not_an_ancestor(spark):
    paths = ["/t/env/pyvenv.cfg", "/t/env/bin/python", "/t/env/a.py", "/t/env2/b.py", "/t/environment.py"]
    listing = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = env.prune_environments(env.python_files(listing), env.environment_roots(listing, "/t"))
    assert {r["path"] for r in kept.collect()} == {"/t/env2/b.py", "/t/environment.py"}


def test_trees_with_equal_paths_stay_apart(spark):
    rows = [("one", "v/pyvenv.cfg"), ("one", "v/bin/python"), ("one", "v/a.py"), ("two", "v/a.py"), ("two", "v/pyvenv.cfg")]
    listing = spark.createDataFrame(rows, "repo string, path string")
    kept = env.prune_environments(env.python_files(listing), env.environment_roots(listing))
    assert [(r["repo"], r["path"]) for r in kept.collect()] == [("two", "v/a.py")]


def test_tree_to_units(spark, tree):
    raw = read_tree(spark, str(tree))
    assert {r["repo"] for r in raw.select("repo").distinct().collect()} == {"project"}
    found = code_units(parse_files(decode(raw))).filter("kind = 'function'")
    assert sorted(r["name"] for r in found.collect()) == sorted(
        ["top", "init", "private", "a", "a", "b", "c", "x", "z", "inside"]
    )


def test_wide_and_deep_tree(spark, tmp_path):
    files = {f"w/f{i}.py": f"def w{i}(): pass\n" for i in range(300)}
    files.update({"/".join(["d"] * depth) + "/m.py": "x = 1\n" for depth in range(1, 12)})
    make(tmp_path, files)
    rows = list_tree(spark, str(tmp_path))
    assert rows.count() == len(files)
    assert rows.agg(F.sum("size")).first()[0] == sum(len(t) for t in files.values())


def test_hot_directory_is_split_when_nothing_is_small(spark):
    """A third of the files in one directory, broadcast ruled out."""
    paths = [f"/t/hot/f{i}.py" for i in range(4000)] + [f"/t/d{i}/f.py" for i in range(8000)]
    for i in range(0, 8000, 5):
        paths += [f"/t/d{i}/pyvenv.cfg", f"/t/d{i}/bin/python", f"/t/d{i}/lib/g.py"]
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        listing = spark.createDataFrame([(p,) for p in paths], "path string").repartition(16)
        roots = env.environment_roots(listing, "/t")
        kept = env.prune_environments(env.python_files(listing), roots)
        rows = kept.collect()
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(rows) == 4000 + 8000 - 1600
    assert "SortMergeJoin(skew=true)" in plan


def test_names_that_are_not_text(spark, tmp_path):
    folder = os.path.join(os.fsencode(tmp_path), b"d\xff")
    os.mkdir(folder)
    for name in (b"a\xfe.py", b"b.py"):
        with open(os.path.join(folder, name), "wb") as file:
            file.write(b"def f(): pass\n")
    raw = read_tree(spark, str(tmp_path)).collect()
    assert sorted(r["path"].split("/d", 1)[1] for r in raw) == ["\\xff/a\\xfe.py", "\\xff/b.py"]
    assert {bytes(r["content"]) for r in raw} == {b"def f(): pass\n"}
