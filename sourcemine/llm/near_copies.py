"""One document of each group of near copies: five-word shingles, similarity 0.8 or more.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z to a-z, a shingle is ``SHINGLE`` of them
(fewer words: the whole sequence), and the similarity of two texts is the Jaccard
index of their sets of shingles.

Candidates come from 64-bit SimHash fingerprints: one of the whole set, linked at
``simhash.DISTANCE`` bits by the Gray-ordered index, and ``TABLES`` of a small sample of
the set, its ``SAMPLE`` least shingles by a seeded hash, which must be equal.  Two texts
of similarity 0.8 share a sample fingerprint with probability
``1 - (1 - 0.8 ** 3) ** 8 = 0.997``.  Texts that share a fingerprint meet in a bucket.

Texts that share a bucket are compared by their rare shingles.  The shingles of a set
stand in ascending order of how many sets have them, and only the first of them are
filed: two sets of similarity 0.8 share one of these, early enough in both, and parities
of their shingles in ``BITS`` places differ in few, three conditions that lose no pair.
Of each filed shingle first all texts meet the one that has it earliest (the hub, the
text that a group has in common), and every such pair is checked on the whole sets;
then meet those pairs whose texts are not in one group yet.  So a large group of copies
gives one link a text and a shingle and not all pairs, one of texts that are not alike
gives next to none, and no similar pair of two groups is left out.

Checked links make the groups; of each the row with the least id stays (null last), of
equal ids the first row.  Texts without a word are copies of each other.  Repeated rows
are copies.  All columns come back as they were, whatever their names.

Texts never move.  Which rows are asked for is known by row number, 64 of them in one
word of bits; the words are broadcast up to ``MOST_WORDS``, and joined beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemine.llm import simhash
from sourcemine.llm.common import DENSE, stored, stored_from_texts
from sourcemine.llm.components import components
from sourcemine.storage import passing

SHINGLE, SIMILAR = 5, (4, 5)  # words, and 4 / 5 as whole numbers
TABLES, SAMPLE = 8, 3
BITS = 512
MOST_WORDS = 1 << 22  # of 64 rows each
CACHED_WORDS = 300_000
SEED = 42

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _seed(number: int, factor: int) -> np.uint64:
    return _U((number + 1) * factor & ((1 << 64) - 1))


class Words(dict):
    """Hashes of words met so far, a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = digest = xxhash.xxh64_intdigest(word, SEED)
        return digest


def shingles(text: str | None, known: Words) -> np.ndarray:
    """The set of hashed shingles of a whole text, ascending; none without a word."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(known.__getitem__, words), _U, len(words))
    size = min(SHINGLE, len(h))
    mixed = np.full(len(h) - size + 1, size, _U)
    for i in range(size):
        mixed = _mixed(mixed * _U(0x9E3779B97F4A7C15) + h[i : i + len(mixed)])
    return np.unique(mixed)


def majority(hashes: np.ndarray) -> int:
    """SimHash of a set: a bit is 1 if it is in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def marks(text: str | None, known: Words) -> tuple[int, int, int, int, list[int]]:
    """Two sums and the size of the set, which name it; its fingerprint and those of its
    samples."""
    found = shingles(text, known)
    if not len(found):
        return 0, 0, 0, 0, []
    own = _mixed(found)
    names = [int(x.sum(dtype=_U).view(np.int64)) for x in (found, own)]
    samples = []
    for t in range(TABLES):
        keys = _mixed(own ^ _seed(t, 0xD6E8FEB86659FD93))
        k = min(SAMPLE, len(keys))
        samples.append(majority(np.partition(keys, k - 1)[:k]))
    return *names, len(found), majority(found), samples


_MARKS = "d1 bigint, d2 bigint, n bigint, whole bigint, samples array<bigint>"


def _marks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    known = Words()
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    names = [part.split()[0] for part in _MARKS.split(", ")]
    for texts in batches:
        columns = list(zip(*(marks(text.as_py(), known) for text in texts))) or [()] * 5
        yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def parities(found: np.ndarray) -> list[int]:
    """Whether the number of shingles at each of ``BITS`` places is odd."""
    odd = np.bincount((_mixed(found) % _U(BITS)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64).tolist()


_SET = "set array<bigint>, odd array<bigint>"


def _shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    known, kind = Words(), pa.list_(pa.int64())
    for texts in batches:
        found = [shingles(text.as_py(), known) for text in texts]
        columns = [x.view(np.int64) for x in found], [parities(x) for x in found]
        yield pa.StructArray.from_arrays([pa.array(c, kind) for c in columns], ["set", "odd"])


def _words(rows: DataFrame, key: str) -> DataFrame:
    """``word, bits`` of the row numbers in a column, 64 to a word."""
    bit = F.expr(f"shiftleft(1L, CAST({key} & 63 AS INT))")
    return rows.groupBy(F.shiftright(key, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _asked(rows: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """The rows whose number is in ``words`` (stored).  They stay where they are, unless
    the words are too many for a broadcast."""
    few = words.count() <= MOST_WORDS
    met = rows.join(F.broadcast(words) if few else words, F.shiftright(key, 6) == F.col("word"))
    return met.where(F.expr(f"shiftright(bits, CAST({key} & 63 AS INT)) & 1 = 1")).drop("word", "bits")


def _alike(common: Column, n: Column) -> Column:
    """Whether so many common shingles of ``n`` in both sets together are enough."""
    least, of = SIMILAR
    return of * common >= least * (n - common)


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(u, v)``, stored, that are similar, by their whole sets, of which only
    those that are asked for travel."""
    for name, own in (("u", "a"), ("v", "b")):
        words = stored(_words(pairs, name), "words")
        pairs = pairs.join(_asked(sets, "class", words).select(F.col("class").alias(name), F.col("set").alias(own)), name)
    common = F.size(F.array_intersect("a", "b"))
    return pairs.where(_alike(common, F.size("a") + F.size("b"))).select("u", "v")


def buckets(classes: DataFrame) -> DataFrame:
    """``bucket, class`` of all texts that share a fingerprint with another one."""
    sample = classes.select("class", F.posexplode("samples").alias("table", "code"))
    whole = classes.where("n > 0").select("class", F.col("whole").alias("code"))
    roots = components(simhash.links(whole.select("code").distinct()))
    near = whole.join(roots.withColumnRenamed("u", "code"), "code", "left")
    found = sample.select(F.xxhash64("table", "code").alias("bucket"), "class").union(
        near.select(F.xxhash64(F.lit(-1), F.coalesce("root", "code")).alias("bucket"), "class")
    )
    found = stored(found, "buckets")
    shared = found.groupBy("bucket").agg(F.count("*").alias("of")).where("of > 1").select("bucket")
    return stored(found.join(shared, "bucket"), "shared-buckets")


def filed(sets: DataFrame) -> DataFrame:
    """``shingle, class, n, most, w0, w1`` and so on: the first shingles of each set of
    ``n``, with how many are ``most`` left from there on, and the parities.

    Shingles that no other set has come first and need no row.
    """
    least, of = SIMILAR
    each = sets.select("class", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("of")).where("of > 1")
    ranked = F.array_sort(F.collect_list(F.struct("of", "shingle")))
    known = each.join(often, "shingle").groupBy("class", "n").agg(ranked.alias("known"))
    first = F.expr(f"n * {of - least} div {of} + 1 - (n - size(known))").cast("int")
    shown = F.posexplode(F.slice("known", F.lit(1), F.greatest(first, F.lit(0)))).alias("at", "entry")
    bits = [F.col("odd")[k].alias(f"w{k}") for k in range(BITS // 64)]
    rows = known.select("class", "n", F.size("known").alias("of"), shown)
    return rows.join(sets.select("class", *bits), "class").select(
        F.col("entry.shingle").alias("shingle"), "class", "n", (F.col("of") - F.col("at")).alias("most"), *[f"w{k}" for k in range(BITS // 64)]
    )


def _may_be_alike(a: str, b: str) -> Column:
    """No pair of filed rows that meet at their first common shingle fails this."""
    least, of = SIMILAR
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{a}.w{k}").bitwiseXOR(F.col(f"{b}.w{k}"))) for k in range(BITS // 64)])
    return _alike(F.least(f"{a}.most", f"{b}.most"), both) & ((of + least) * differ <= (of - least) * both)


def links(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Checked links ``(u, v)`` of ``classes`` that make the groups; ``rows``: ``row, doc.text``."""
    asked = stored(_words(buckets(classes), "class"), "words")
    texts = _asked(rows.select("row", "doc.text"), "row", asked)
    sets = texts.select(F.col("row").alias("class"), F.arrow_udf(_SET)(_shingles)("text").alias("s"))
    sets = stored_from_texts(sets.select("class", "s.*"), "sets")
    shown = stored(filed(sets), "filed")

    def checked(pairs: DataFrame) -> DataFrame:
        ordered = pairs.select(F.greatest("a.class", "b.class").alias("u"), F.least("a.class", "b.class").alias("v"))
        return stored(_checked(stored(ordered.distinct(), "pairs"), sets), "links")

    own = F.struct((F.col("n") - F.col("most")).alias("place"), *[c for c in shown.columns if c != "shingle"])
    hubs = shown.groupBy("shingle").agg(F.min(own).alias("hub")).select("shingle", "hub.*")
    met = shown.alias("a").join(hubs.alias("b"), "shingle").where((F.col("a.class") != F.col("b.class")) & _may_be_alike("a", "b"))
    found = checked(met)
    roots = components(found).select(F.col("u").alias("class"), "root")
    named = stored(shown.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")), "named")
    apart = (F.col("a.class") > F.col("b.class")) & (F.col("a.root") != F.col("b.root"))
    return found.union(checked(named.alias("a").join(named.alias("b"), "shingle").where(apart & _may_be_alike("a", "b"))))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay.  See the head of the module."""
    rows = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"))
    rows = stored_from_texts(rows.select("*", F.arrow_udf(_MARKS)(_marks)("doc.text").alias("m")), "marked", DENSE)
    with passing(docs.sparkSession, "stay"):  # of all that finds them only the rows are left
        stay = stored(_words(_staying(rows), "row"), "stay")
    return _asked(rows, "row", stay).select("doc.*")


def _staying(rows: DataFrame) -> DataFrame:
    """``row`` of the documents that stay."""
    # Equal sets are one class, named by a row that stands for it.
    first = F.min(F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), "row"))
    classes = rows.groupBy("m.d1", "m.d2", "m.n").agg(
        F.min("row").alias("class"),
        first.alias("first"),
        *[F.first(f"m.{name}").alias(name) for name in ("whole", "samples")],
    )
    classes = stored(classes, "classes")
    roots = components(links(classes, rows)).withColumnRenamed("u", "class")
    named = classes.select("class", "first").join(roots, "class", "left")
    stay = named.groupBy(F.coalesce("root", "class").alias("root")).agg(F.min("first").alias("first"))
    return stay.select(F.col("first.row").alias("row"))
