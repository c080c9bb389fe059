"""The maintainability index and its counts."""

import ast
import io
import math
import random
import sysconfig
import tokenize
from pathlib import Path

from pyspark.sql import functions as F

from sourcemine.functions import score
from sourcemine.operators.measures import LineFacts, _without_comments, measure
from sourcemine.operators.parse import parse_source


def counts(text):
    return measure(ast.parse(text).body[0], LineFacts(text))


def test_counts_by_hand():
    text = '''def f(a, b):
    """Two
    lines."""
    # a comment
    if a > 1 and b:          # another
        a += b * 2
    for x in [y for y in a if y]:
        while x:
            x = -x
        else:
            pass
    try:
        g = 1 if a else 2
    except ValueError:
        assert not b

    return "#"
'''
    # operators: > and += * - not; operands: a 1 | (a > 1) b | a (b * 2) | b 2 | x | b
    assert counts(text) == {
        "n_operators": 6,
        "n_operands": 10,
        "u_operators": 6,
        "u_operands": 7,
        # if, and, for, comprehension with one condition (2), while with else (2), except, if-else, assert
        "complexity": 1 + 1 + 1 + 1 + 2 + 2 + 1 + 1 + 1,
        # def, if, +=, for, while, -x, else, pass, try, g, except, assert, return
        "sloc": 13,
        "comment_pct": 100.0 * 4 / 13,
    }


def test_match_and_closures():
    text = "def f(x):\n    def g(y): return y\n    match x:\n        case 1: pass\n        case _: pass\n"
    assert counts(text)["complexity"] == 2 + 1


def test_class_adds_up_its_methods():
    text = "class C:\n    def a(self):\n        if self: pass\n    def b(self): pass\n"
    assert counts(text)["complexity"] == 3


def test_formula_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [
        (i, rng.choice([0.0, -1.0, rng.uniform(0.1, 9000.0)]), rng.randint(0, 90), rng.randint(0, 400), rng.uniform(0, 300))
        for i in range(3000)
    ]

    def brute(v, g, n, c):
        if v <= 0 or n <= 0:
            return 100.0
        raw = 171 - 5.2 * math.log(v) - 0.23 * g - 16.2 * math.log(n) + 50 * math.sin(math.sqrt(2.46 * math.radians(c)))
        return min(100.0, max(0.0, raw * 100 / 171))

    df = spark.createDataFrame(rows, "i int, v double, g int, n int, c double")
    got = {
        r["i"]: r["mi"]
        for r in df.select("i", score.maintainability(F.col("v"), F.col("g"), F.col("n"), F.col("c")).alias("mi")).collect()
    }
    assert all(abs(got[i] - brute(*row)) < 1e-9 for i, *row in rows)


def test_threshold_is_strict_and_missing_scores_drop(spark):
    df = spark.createDataFrame(
        [(64.999, False), (65.0, False), (None, False), (None, True), (99.0, True)], "mi double, failed boolean"
    )
    rows = df.select(score.is_hard_to_maintain(F.col("mi"), F.col("failed"))).collect()
    assert [r[0] for r in rows] == [True, False, False, True, True]


def _cut_by_tokens(text):
    lines = text.split("\n")
    for token in tokenize.generate_tokens(io.StringIO(text).readline):
        if token.type == tokenize.COMMENT:
            lines[token.start[0] - 1] = lines[token.start[0] - 1][: token.start[1]]
    return "\n".join(lines)


def test_comments_equal_the_tokenizers_over_the_standard_library():
    paths = sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))
    random.Random(11).shuffle(paths)
    for path in paths:
        text = path.read_text(encoding="utf-8")
        assert _without_comments(text) == _cut_by_tokens(text), path


def test_counts_are_those_of_the_units_own_text():
    text = (
        "@d(1 + 2)\ndef f(x):\n    return x  # done\n\n"
        "class A:\n    @p(3 * 4)\n    def m(self):\n        'doc'  # said\n"
    )
    f, a = parse_source(text, with_counts=True)
    assert (f["counts"]["n_operators"], f["counts"]["n_operands"], f["counts"]["comment_pct"]) == (0, 0, 0.0)
    assert a["counts"]["n_operators"] == 1
    for unit in (f, a):
        assert parse_source(unit["code"], with_counts=True)[0]["counts"] == unit["counts"]


def test_counts_of_own_texts_over_the_standard_library():
    for path in sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py")):
        for unit in parse_source(path.read_text(encoding="utf-8"), with_counts=True):
            own = parse_source(unit["code"], with_counts=True)[0]
            assert own["counts"] == unit["counts"], (path, unit["name"])


def test_comment_signs_in_strings():
    text = "a = '#'  # one\nb = \"\"\"x # y\n# z \\\"\"\" # w\n\"\"\"  # two\nc = f'{a[\'#\']}'  # three\nd = '\\'#'\n# four\n"
    assert _without_comments(text) == _cut_by_tokens(text)
