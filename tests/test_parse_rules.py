"""What counts as a definition, and which of several definitions stays."""

import ast
import random
import sysconfig
from pathlib import Path

from pyspark.sql import functions as F

from sourcemine.operators import units as u
from sourcemine.operators.parse import parse_files, parse_source
from sourcemine.sources.files import decode


def units_of(files, texts):
    return u.code_units(parse_files(files(texts)))


def names(df):
    return sorted(row["name"] for row in df.collect())


def test_only_direct_children_of_the_module_count(files):
    text = """
if True:
    def in_if(): pass
try:
    class InTry:
        def m(self): pass
except Exception:
    pass
for i in range(2):
    def in_for(): pass
f = lambda x: x
def top():
    def inner(): pass
    class Local:
        def m(self): pass
class Top:
    class Inner:
        def hidden(self): pass
    if True:
        def conditional(self): pass
    async def method(self): pass
"""
    found = units_of(files, {"a.py": text}).filter("kind is not null")
    assert names(found) == ["Top", "top"]
    assert names(u.methods(found)) == ["Top.method"]


def test_text_starts_at_the_keyword_and_keeps_later_indents(files):
    text = "@deco\n@other(1)\ndef f(a,\n      b):\n    return 1\n\nclass C:\n    @property\n    def m(self):\n        return 2\n"
    found = units_of(files, {"a.py": text})
    rows = {row["name"]: row for row in found.collect()}
    assert rows["f"]["code"] == "def f(a,\n      b):\n    return 1"
    assert rows["f"]["line"] == 3
    method = u.methods(found).first()
    assert method["code"] == "def m(self):\n        return 2"
    assert method["line"] == 9


def test_bad_files_have_no_units_and_do_not_stop_the_run(spark):
    raw = spark.createDataFrame(
        [
            ("r", "syntax.py", b"def good(): pass\ndef (\n", None),
            ("r", "nul.py", b"def f(): pass\x00\n", None),
            ("r", "bom.py", b"\xef\xbb\xbfdef f(): pass\n", None),
            ("r", "latin.py", b"# caf\xe9\ndef f(): pass\n", None),
            ("r", "surrogate.py", b"x = '\xed\xa0\x80'\ndef f(): pass\n", None),
            ("r", "overlong.py", b"x = '\xc0\x80'\ndef f(): pass\n", None),
            ("r", "denied.py", None, "PermissionError: denied"),
            ("r", "deep.py", b"x = " + b"(" * 500 + b"1" + b")" * 500, None),
            ("r", "empty.py", b"", None),
            ("r", "fine.py", "def ok():\n    return 'é'\n".encode(), None),
        ],
        "repo string, path string, content binary, error string",
    )
    parsed = parse_files(decode(raw))
    assert names(u.code_units(parsed).filter("kind is not null")) == ["ok"]
    failed = {row["path"]: row["error"] for row in u.parse_errors(parsed).collect()}
    assert set(failed) == {
        "syntax.py", "nul.py", "bom.py", "latin.py", "surrogate.py", "overlong.py", "denied.py", "deep.py",
    }
    assert failed["denied.py"] == "PermissionError: denied"
    assert failed["latin.py"] == "not valid UTF-8"
    assert parsed.count() == 10


def test_newlines_are_translated(files):
    found = units_of(files, {"a.py": "def f():\r\n    x = 1\r    return x\r\n"})
    assert found.first()["code"] == "def f():\n    x = 1\n    return x"


def test_last_definition_in_a_file_wins(files):
    text = "def f(): return 1\nclass f:\n    def a(self): pass\nclass f:\n    pass\ndef f(): return 2\n"
    last = u.last_units(units_of(files, {"a.py": text}))
    rows = sorted((r["kind"], r["line"], r["code"]) for r in last.collect())
    assert rows == [("class", 4, "class f:\n    pass"), ("function", 6, "def f(): return 2")]
    assert u.methods(last).count() == 0


def test_methods_keep_source_order_and_duplicates(files):
    text = "class C:\n    @property\n    def v(self): return 1\n    def a(self): pass\n    @v.setter\n    def v(self, x): pass\n"
    rows = u.methods(units_of(files, {"a.py": text})).orderBy("pos").collect()
    assert [(r["pos"], r["method"], r["line"]) for r in rows] == [(0, "v", 3), (1, "a", 4), (2, "v", 6)]


def test_counts_per_file_are_of_distinct_names(files):
    parsed = parse_files(
        files({"a.py": "def f(): pass\ndef f(): pass\nclass C: pass\n", "b.py": "x = 1\n", "c.py": "def ("})
    )
    rows = {r["path"]: (r["n_functions"], r["n_classes"]) for r in u.units_per_file(parsed).collect()}
    assert rows == {"a.py": (1, 1), "b.py": (0, 0)}


def test_text_of_units_equals_the_interpreters_own_segments():
    """Brute force over the standard library: whole files, every top-level definition."""
    folder = Path(sysconfig.get_paths()["stdlib"])
    paths = sorted(folder.glob("*.py"))
    random.Random(7).shuffle(paths)
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    seen = 0
    for path in paths:
        text = path.read_text(encoding="utf-8")
        nodes = [n for n in ast.parse(text).body if isinstance(n, kinds)]
        units = parse_source(text)
        assert [x["code"] for x in units] == [ast.get_source_segment(text, n) for n in nodes]
        for unit, node in zip(units, nodes):
            members = [n for n in getattr(node, "body", []) if isinstance(n, kinds[:2])]
            if unit["kind"] == "class":
                assert unit["method_code"] == [ast.get_source_segment(text, n) for n in members]
        seen += len(units)
    assert seen > 300


def test_columns_of_segments_count_bytes():
    text = "class C:\n    é = 'ü'; x = 1\n    def m(self): return 'ß'\n\nif 1: pass\ndef f(a='ä'): return 'ö'  # ü\n"
    units = parse_source(text)
    assert units[0]["method_code"] == ["def m(self): return 'ß'"]
    assert units[1]["code"] == "def f(a='ä'): return 'ö'"


def test_partitioning_does_not_change_the_result(files):
    texts = {f"p{i}.py": f"def f{i % 5}(): return {i}\nclass C{i % 3}:\n    def m(self): return {i}\n" for i in range(60)}
    base = files(texts)
    one = u.code_units(parse_files(base.coalesce(1))).orderBy("path", "pos").collect()
    many = u.code_units(parse_files(base.repartition(13, F.rand(3)))).orderBy("path", "pos").collect()
    assert one == many
