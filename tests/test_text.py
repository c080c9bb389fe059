"""Column rules against the interpreter's own functions, many strings per Spark job."""

import random
import re
from datetime import datetime
from pathlib import PurePosixPath
from urllib.parse import urlparse

from pyspark.sql import functions as F

from sourcemine.functions import text


def apply(spark, values, rule):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").repartition(8)
    rows = df.select("i", rule(F.col("v")).alias("o")).collect()
    return [row["o"] for row in sorted(rows)]


def mixed(seed, pieces, count, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, longest))) for _ in range(count)]


def test_code_blocks_equal_brute_force(spark):
    pieces = ["```", "```", "```", "\n", "\n", " ", "\t", "python", "c++", "a-b", "_", "é", "²", "\u00a0", "\u2028", "\x85", "\r", "x = 1", "`", "``", "title=x", "```python\n", "```é²\u00a0\n", "\n```"]
    values = mixed(1, pieces, 6000, 18) + ["", None]
    opener = re.compile(r"```[\w+-]*\s*\n(.*?)```", re.DOTALL)
    expected = ["\n\n".join(opener.findall(v)) if v else "" for v in values]
    assert apply(spark, values, text.code_blocks) == expected
    assert sum(bool(e) for e in expected) > 300


def test_code_blocks_edges(spark):
    cases = {
        "```python\n\n    x = 1\n```": "    x = 1\n",
        "```\na```\n```\nb```": "a\n\nb",
        "```py\n```": "",
        "```\n``` and ```\n```": "\n\n",
        "```python\nunclosed": "",
        "```python title=x\nlost```\nkept```": "kept",
        "no fence": "",
    }
    assert apply(spark, list(cases), text.code_blocks) == list(cases.values())


def test_whole_long_answers_are_read(spark):
    body = "x = 1\n" * 200_000
    assert apply(spark, [f"{body}```python\n{body}```"], text.code_blocks) == [body]


def test_markdown_equals_brute_force(spark):
    pieces = ["![", "[", "](", ")", "]", "(", "http://a.b", "https://x", "./rel", "\n", "\n\n", "\n", "text", " ", "\r", "\u2028"]
    values = mixed(2, pieces, 4000, 16)

    def brute(value):
        value = re.sub(r"!\[.*?\]\(.*?\)", "", value)
        value = re.sub(r"\[.*?\]\(https?://.*?\)", "", value)
        return re.sub("\n{3,}", "\n\n", value)

    expected = [brute(v) for v in values]
    assert apply(spark, values, text.clean_markdown) == expected
    assert sum(e != v for e, v in zip(expected, values)) > 300


def test_urls_equal_the_interpreter(spark):
    pieces = ["http", "HTTPS", "ftp", "git", ":", "://", "/", "//", ".", "..", "a", "b.tar", ".gz", "host", "@", "?", "#", ";p=1", "ü", " ", "x y", "1", "+", "-", "\t"]
    values = mixed(3, pieces, 4000, 9) + [
        "https://h/a/b.tar.gz/?x=1#f", "https://h", "https://h/.git", "git@host:a/b.git", "", "https://h/a.", "http://[::1]/a",
    ]
    clean, stem = [], []
    for value in values:
        parts = urlparse(value)
        clean.append(f"{parts.scheme}://{parts.netloc}{parts.path}")
        stem.append(PurePosixPath(parts.path).stem)
    assert apply(spark, values, text.clean_url) == clean
    assert apply(spark, values, text.url_stem) == stem


def test_lone_bracket_in_the_host_gives_null(spark):
    assert apply(spark, ["http://[a/b"], text.clean_url) == [None]


def test_options(spark):
    df = spark.createDataFrame(
        [(["a=1", "b=x=y", "bad", "a=2", "=e", "k="],), ([],), (["none"],)], "o array<string>"
    )
    rows = [r["m"] for r in df.select(text.options_map(F.col("o")).alias("m")).collect()]
    assert rows == [{"a": "2", "b": "x=y", "": "e", "k": ""}, {}, {}]


def test_options_equal_brute_force(spark):
    rng = random.Random(4)
    lists = [["".join(rng.choice("ab==\n.") for _ in range(rng.randint(0, 5))) for _ in range(6)] for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, o array<string>")
    got = {r["i"]: r["m"] for r in df.select("i", text.options_map(F.col("o")).alias("m")).collect()}
    for i, options in enumerate(lists):
        assert got[i] == dict(o.split("=", 1) for o in options if "=" in o)


def test_strip_equals_the_interpreter(spark):
    values = mixed(5, [" ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "a", "b c", "\u200b"], 1000, 7)
    assert apply(spark, values, text.strip) == [v.strip() for v in values]


def test_first_choice(spark):
    rows = spark.sql(
        "select * from values (1, array(named_struct('message', named_struct('content', 'a')),"
        " named_struct('message', named_struct('content', 'b')))),"
        " (2, array()), (3, cast(null as array<struct<message:struct<content:string>>>)),"
        " (4, array(named_struct('message', named_struct('content', cast(null as string)))))"
        " as t(i, c)"
    )
    got = [r["o"] for r in rows.orderBy("i").select(text.first_choice(F.col("c")).alias("o")).collect()]
    assert got == ["a", None, None, None]


def test_labels(spark):
    at = datetime(2024, 1, 2, 15, 4, 5)
    row = spark.range(1).select(
        text.run_label(F.lit("src"), F.lit(" gemini/x:1\n"), F.lit(at)).alias("run"),
        text.harness_file_name(F.lit("C.m")).alias("file"),
        text.failure_entry(F.lit(at), F.lit("Generation"), F.lit("why")).alias("entry"),
    ).first()
    when = at.strftime("%m-%d-%y_%I-%M-%S%p").lower()
    assert row["run"] == f"fuzzing(src)using(gemini.x.1on({when})"
    assert row["file"] == "atheris_harness_for_((C.m)).py"
    assert row["entry"] == "[2024-01-02 15:04:05] [Generation]\nwhy\n" + "-" * 40 + "\n"


def test_paths(spark):
    df = spark.createDataFrame([("/a/b/c.py",), ("c.py",), ("/c.py",)], "p string")
    rows = df.select(
        text.base_name(F.col("p")), text.parent_dir(F.col("p")), text.ancestor_dirs(text.parent_dir(F.col("p")))
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("c.py", "/a/b", ["", "/a", "/a/b"]),
        ("c.py", "", [""]),
        ("c.py", "", [""]),
    ]
