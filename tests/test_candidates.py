"""Which candidates survive across files, with and without the score filter."""

from pyspark.sql import functions as F

from sourcemine.operators import candidates as cand
from sourcemine.operators import units as u
from sourcemine.operators.parse import parse_files, parse_source
from sourcemine.plans import discovery
from sourcemine.storage import materialize

HARD = "def {name}(x, y):\n" + "".join(
    f"    if x > {i} and y < x + {i}:\n        y = y * x - {i}\n" for i in range(40)
) + "    return y\n"
EASY = "def {name}(x, y):\n    return x\n"


def stored(files, texts, smell=False):
    units = discovery.parsed_units(files(texts), smell)
    return materialize(discovery.scored_units(units, smell), "test-units", by="kind")


def winners(df):
    return {row["name"]: row["path"] for row in df.collect()}


def test_last_path_in_binary_order_wins(files):
    units = stored(
        files,
        {
            "b.py": "def f(): return 'b'\n",
            "a.py": "def f(): return 'a'\n",
            "B.py": "def f(): return 'B'\n",
            "é.py": "def g(): return 1\n",
            "z.py": "def g(): return 2\n",
        },
    )
    assert winners(cand.function_candidates(units)) == {"f": "b.py", "g": "é.py"}


def test_later_class_without_the_method_keeps_the_earlier_one(files):
    units = stored(
        files,
        {
            "a.py": "class C:\n    def m(self): return 1\n    def n(self): return 1\n",
            "b.py": "class C:\n    def m(self): return 2\n",
            "c.py": "class C:\n    size = 3\n",
        },
    )
    found = cand.method_candidates(units)
    assert winners(found) == {"C.m": "b.py", "C.n": "a.py"}
    row = found.filter("name = 'C.n'").first()
    assert row["class_code"] == "class C:\n    def m(self): return 1\n    def n(self): return 1"
    assert (row["method"], row["code"]) == ("n", "def n(self): return 1")


def test_class_overwritten_in_its_own_file_takes_its_methods_along(files):
    units = stored(
        files,
        {"a.py": "class C:\n    def m(self): return 1\n", "b.py": "class C:\n    def m(self): return 2\nclass C:\n    pass\n"},
    )
    assert winners(cand.method_candidates(units)) == {"C.m": "a.py"}


def test_last_method_of_a_name_in_a_class_wins(files):
    units = stored(files, {"a.py": "class C:\n    def v(self): return 1\n    def v(self, x): self.x = x\n"})
    assert cand.method_candidates(units).first()["code"] == "def v(self, x): self.x = x"


def test_trees_do_not_share_names(files):
    units = stored(files, {("one", "a.py"): "def f(): return 1\n", ("two", "b.py"): "def f(): return 2\n"})
    rows = cand.function_candidates(units).collect()
    assert sorted((r["repo"], r["path"]) for r in rows) == [("one", "a.py"), ("two", "b.py")]


def test_tree_without_a_name_keeps_its_candidates(files):
    units = stored(files, {(None, "a.py"): "class C:\n    def m(self): pass\ndef f(): pass\n"})
    assert winners(discovery.retrieve_candidates(units)) == {"f": "a.py", "C.m": "a.py"}


def test_filtered_unit_never_overwrites(files):
    texts = {"a.py": HARD.format(name="f"), "b.py": EASY.format(name="f")}
    assert winners(cand.function_candidates(stored(files, texts))) == {"f": "b.py"}
    assert winners(cand.function_candidates(stored(files, texts, smell=True))) == {"f": "a.py"}


def test_overwrite_in_a_file_comes_before_the_score_filter(files):
    texts = {"a.py": HARD.format(name="f") + EASY.format(name="f")}
    assert winners(cand.function_candidates(stored(files, texts, smell=True))) == {}


def _class(name, method):
    return f"class {name}:\n" + "".join("    " + line + "\n" for line in method.splitlines())


def test_class_is_scored_as_a_whole(files):
    hard = _class("C", HARD.format(name="m") + EASY.format(name="n"))
    easy = _class("D", EASY.format(name="m"))
    units = stored(files, {"a.py": hard, "b.py": easy}, smell=True)
    assert winners(cand.method_candidates(units)) == {"C.m": "a.py", "C.n": "a.py"}


def test_unmeasured_units_are_kept(spark, files):
    units = discovery.parsed_units(files({"a.py": EASY.format(name="f")}), True)
    assert discovery.scored_units(units, True).count() == 0
    failed = units.withColumn("counts", F.lit(None).cast(units.schema["counts"].dataType))
    assert discovery.scored_units(failed, True).count() == 0
    failed = failed.withColumn("counts_error", F.lit("RecursionError: deep"))
    assert discovery.scored_units(failed, True).count() == 1


def test_union_prefers_the_right_side(files):
    units = stored(files, {"a.py": "def f(): return 1\nclass C:\n    def m(self): pass\n"})
    functions = cand.function_candidates(units)
    other = functions.withColumn("code", F.lit("other"))
    both = cand.union_candidates(functions, other)
    assert [(r["name"], r["code"]) for r in both.collect()] == [("f", "other")]
    whole = cand.union_candidates(functions, cand.method_candidates(units))
    assert winners(whole) == winners(discovery.retrieve_candidates(units)) == {"f": "a.py", "C.m": "a.py"}


def test_union_sorts_no_texts(files):
    units = stored(files, {"a.py": "def f(): return 1\nclass C:\n    def m(self): pass\n"})
    functions = units.filter("kind = 'function'").selectExpr(
        "repo", "name", "kind", "path", "line", "null method", "null class_code", "code"
    )
    plan = cand.union_candidates(functions, functions)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Aggregate" not in plan


def test_brute_force_over_a_skewed_tree(files):
    """A third of all files define the same function and the same class."""
    texts = {}
    for i in range(240):
        name, cls = ("main", "Meta") if i % 3 == 0 else (f"f{i % 31}", f"C{i % 17}")
        methods = "".join(f"    def m{(i * k) % 7}(self): return {i * k}\n" for k in range(1, 4))
        texts[f"d{i % 11}/m{i:03}.py"] = f"def {name}(): return {i}\nclass {cls}:\n{methods}"
    functions, methods = {}, {}
    for path in sorted(texts, key=str.encode):
        for unit in parse_source(texts[path]):
            if not unit["is_last"]:
                continue
            if unit["kind"] == "function":
                functions[unit["name"]] = unit["code"]
            for key, code in zip(unit["methods"], unit["method_code"]):
                methods[f"{unit['name']}.{key['name']}"] = (unit["code"], code)
    base = files(texts)
    got = {r["name"]: r["code"] for r in discovery.retrieve_function_candidates(base).collect()}
    assert got == functions
    rows = discovery.retrieve_method_candidates(base.repartition(7)).collect()
    assert {r["name"]: (r["class_code"], r["code"]) for r in rows} == methods
    assert len(rows) == len(methods)


def test_candidate_names_are_unique(files):
    texts = {f"{i}.py": "def f(): pass\nclass C:\n    def f(self): pass\n    def f(self): pass\n" for i in range(9)}
    found = discovery.retrieve_candidates(stored(files, texts))
    assert found.count() == found.select("repo", "name").distinct().count() == 2


def test_function_plan_combines_before_the_shuffle_and_parses_once(files):
    plan = discovery.retrieve_function_candidates(files({"a.py": "def f(): pass\n"}))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1
    assert "partial_max" in text


def test_method_keys_do_not_read_texts(files):
    units = stored(files, {"a.py": "class C:\n    def m(self): pass\n"})
    text = cand.method_winners(units)._jdf.queryExecution().executedPlan().toString()
    scan = text[text.index("ReadSchema") :]
    assert "code" not in scan.split("struct<", 1)[1].split("\n")[0]


def test_parse_errors_and_totals(files):
    texts = {"a.py": "def f(): pass\n", "b.py": "def (", "c.py": "x = 1\n", "d.py": "class C:\n    def m(self): pass\n"}
    units = materialize(u.code_units(parse_files(files(texts))), "test-units", by="kind")
    found = discovery.retrieve_candidates(u.last_units(units))
    assert u.discovery_summary(units, found).first().asDict() == {
        "files_scanned": 4,
        "files_failed": 1,
        "functions_found": 1,
        "methods_found": 1,
        "candidates": 2,
    }
    assert [r["path"] for r in u.parse_errors(units).collect()] == ["b.py"]
