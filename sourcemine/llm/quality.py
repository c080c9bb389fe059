"""Quality rules as a ledger: every rule is evaluated once, its failure is a bit.

The ledger holds the measurements and one ``fail_bits`` number for each row.
A policy is a version and a mask of the rules that count; applying one is
``fail_bits & mask = 0``, and what a rule costs a policy follows from counts of
equal ``fail_bits``, so neither reads a text again.

Null and empty texts have no words and fail the rule on few words.  Rows come
out as they went in, repeated ones included.  Measurement columns of the input
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemine.llm.common import stored

SYMBOLS = "#*$%&|<>"
RUN = 8  # words in a window of the repetition rule
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts"]

#: Rule, by its bit: true where a text fails.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_runs", "100 * n_repeat_words > 30 * n_words"),
    ("short_or_long_words", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines AND n_dup_lines >= 3"),
    ("capitals", "2 * n_upper > word_chars AND n_words >= 20"),
    ("shouts", "4 * n_shouts > n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Policies by version; a later one never changes an earlier one.
POLICIES: dict[str, int] = {
    "v1": BIT["few_words"] | BIT["repeated_runs"],
    "v2": BIT["few_words"] | BIT["repeated_runs"] | BIT["symbols"] | BIT["capitals"],
    "v3": sum(BIT.values()),
}
CURRENT = "v3"

_WHITE = " \t\n\v\f\r"
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of ``RUN`` words that occur twice or more.

    Hashes of windows only tell whether a repetition is possible; then equal
    windows are told apart exactly, by ranks of ever longer runs.
    """
    n = len(words) - RUN + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
    mixed = np.zeros(n, dtype=np.int64)
    with np.errstate(over="ignore"):
        for k in range(RUN):
            mixed = mixed * np.int64(6364136223846793005) + codes[k : k + n]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    numbers: dict[bytes, int] = {}
    rank = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words))
    step = 1
    while step < RUN:
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        step *= 2
    again = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + RUN, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * len(MEASURES)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # cuts at the six ASCII white spaces and nothing else
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, _WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        int(_UPPER[np.frombuffer(data, np.uint8)].sum()),
        data.count(b"!!"),
    )


def fail_bits() -> Column:
    """One number of all failed rules, from the measurements."""
    return F.expr(" + ".join(f"IF({rule}, {1 << i}L, 0L)" for i, (_, rule) in enumerate(RULES)))


def ledger(docs: DataFrame) -> DataFrame:
    """Add the measurements and ``fail_bits``; only the text goes to Python."""

    @F.arrow_udf(", ".join(f"{name} bigint" for name in MEASURES))
    def measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = np.array([measure(text) for text in texts.to_pylist()], dtype=np.int64)
            rows = rows.reshape(-1, len(MEASURES))
            yield pa.StructArray.from_arrays([pa.array(x) for x in rows.T], MEASURES)

    mark = "_measured"
    return (
        docs.drop(*MEASURES, "fail_bits", mark)
        .withColumn(mark, measures("text"))
        .select("*", f"{mark}.*")
        .drop(mark)
        .withColumn("fail_bits", fail_bits())
    )


def stored_ledger(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger as a table: ``keys``, measurements and bits, written once.  Policies
    and ablations read it and neither the texts nor the rules again."""
    return stored(ledger(docs.select(*keys, "text")).drop("text"), "ledger")


def kept(version: str = CURRENT) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0


def ablations(rows: DataFrame, policies: dict[str, int] = POLICIES) -> DataFrame:
    """For each policy and rule of its mask: rows that fail the rule, rows that
    only this rule rejects, and rows the policy keeps with and without it."""
    spark = rows.sparkSession
    counts = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    pairs = [
        (version, name, mask, BIT[name])
        for version, mask in policies.items()
        for name, _ in RULES
        if mask & BIT[name]
    ]
    masks = spark.createDataFrame(pairs, "version string, rule string, mask bigint, bit bigint")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    # Both sides are bounded by the number of rules, not by the rows.
    found = counts.withColumn("one", F.lit(1)).join(F.broadcast(masks.withColumn("one", F.lit(1))), "one")
    summed = {
        "n_failed": F.col("fail_bits").bitwiseAND(F.col("bit")) != 0,
        "n_only": hit == F.col("bit"),
        "n_kept": hit == 0,
        "n_kept_without": hit.bitwiseAND(F.bitwise_not("bit")) == 0,
    }
    return found.groupBy("version", "rule").agg(
        *[F.sum(F.when(test, F.col("n")).otherwise(0)).alias(name) for name, test in summed.items()]
    )
