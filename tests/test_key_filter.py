"""Dropping rows by key: every way gives what an anti join gives."""

import pytest
from pyspark.sql import functions as F

from sourcemine.operators import candidates as cand
from sourcemine.operators import environments, key_filter
from sourcemine.storage import _settings, materialize

NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1"}


def table(spark, n=4000):
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("r"), F.col("id") % 3)).alias("repo"),
        F.when(F.col("id") % 501 > 0, F.concat(F.lit("d"), F.col("id"))).alias("dir"),
        F.repeat(F.lit("text "), 20).alias("content"),
        (F.col("id") % 5 == 0).alias("drop"),
    )
    return materialize(rows, "filter-test")


def shuffled(df):
    """What the shuffles of a plan carry, by their output columns."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    below = re.findall(r"Exchange hashpartitioning[^\n]*\n([^\n]*)", plan)
    return [line for line in below if "content" in line or "code" in line], plan


@pytest.mark.parametrize("how", ["broadcast", "cascade", "few bits"])
def test_equals_an_anti_join(spark, monkeypatch, how):
    rows = table(spark)
    decided = rows.groupBy("repo", "dir").agg(F.bool_or("drop").alias("drop"))
    decided = materialize(decided, "decided")
    same = F.col("r.repo").eqNullSafe(F.col("d.repo")) & F.col("r.dir").eqNullSafe(F.col("d.dir"))
    want = sorted(
        rows.alias("r").join(decided.where("drop").alias("d"), same, "left_anti").select("repo", "dir").collect(), key=str
    )
    if how == "few bits":  # too few to tell keys apart: the rest is joined
        monkeypatch.setattr(key_filter, "MOST_BITS", 1 << 10)
        monkeypatch.setattr(key_filter, "LEVELS", 2)
    with _settings(spark, {} if how == "broadcast" else NO_BROADCAST):
        got = key_filter.without_keys(rows.drop("drop"), decided, ["repo", "dir"])
        assert sorted(got.select("repo", "dir").collect(), key=str) == want
        assert got.columns == ["repo", "dir", "content"]
        if how == "cascade":
            assert "Exchange hashpartitioning" not in shuffled(got)[1]


def test_no_key_is_dropped_or_all_are(spark):
    rows = table(spark, 50)
    keys = rows.select("repo", "dir").distinct()
    with _settings(spark, NO_BROADCAST):
        for drop, n in ((True, 0), (False, 50)):
            decided = materialize(keys.withColumn("drop", F.lit(drop)), "decided")
            assert key_filter.without_keys(rows, decided, ["repo", "dir"]).count() == n
        none = materialize(keys.limit(0).withColumn("drop", F.lit(True)), "decided")
        assert key_filter.without_keys(rows.limit(0), none, ["repo", "dir"]).count() == 0


def test_pruning_moves_no_text(spark):
    paths = [f"/t/e{i}/{name}" for i in range(40) for name in ("pyvenv.cfg", "bin/python", "lib/x.py", "lib/a/y.py")]
    paths += [f"/t/p{i}/m.py" for i in range(400)]
    rows = spark.createDataFrame([("t", p, "x" * 50) for p in paths], "repo string, path string, content string")
    files = materialize(environments.python_files(rows), "prune-test")
    roots = environments.environment_roots(rows, "/t")
    with _settings(spark, NO_BROADCAST):
        kept = environments.prune_environments(files, roots)
        moved, plan = shuffled(kept)
        assert "Exchange hashpartitioning" not in plan and not moved
        assert {r["path"] for r in kept.collect()} == {f"/t/p{i}/m.py" for i in range(400)}


def test_late_functions_equal_early_ones_and_sort_no_text(spark, files):
    from sourcemine.plans import discovery

    texts = {f"d{i}.py": f"def main(): return {i}\ndef f{i % 7}(): return {i}\n" for i in range(60)}
    units = materialize(discovery.scored_units(discovery.parsed_units(files(texts), False), False), "late", by="kind")
    want = sorted(cand.function_candidates(units).collect())
    assert sorted(cand.late_function_candidates(units).collect()) == want
    with _settings(spark, NO_BROADCAST):
        late = cand.late_function_candidates(units)
        plan = late._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "Exchange" not in plan
        assert sorted(late.collect()) == want


def test_a_class_text_is_there_once_and_candidates_hold_none(spark, files):
    from sourcemine.plans import discovery

    body = "".join(f"    def m{i}(self): return {i}\n" for i in range(300))
    texts = {"a.py": f"class C:\n{body}", "b.py": "class C:\n    def m7(self): return 'b'\ndef f(): pass\n"}
    units = materialize(discovery.scored_units(discovery.parsed_units(files(texts), False), False), "once", by="kind")
    whole = discovery.candidate_texts(units)
    assert sorted(r["path"] for r in whole.where("kind = 'method'").collect()) == ["a.py", "b.py"]
    found = {r["name"]: r for r in discovery.candidates_of(whole).collect()}
    assert len(found) == 301 and found["C.m7"]["path"] == "b.py" and found["C.m8"]["code"] == "def m8(self): return 8"
    assert found["C.m8"]["class_code"] == f"class C:\n{body}".rstrip("\n") and found["f"]["class_code"] is None
    waved = discovery.candidate_texts(units, waves=4)
    assert sum(len(r["wanted"]) for r in waved.collect()) == 301
    assert waved.where("path = 'a.py'").count() == 4
