"""Quality of whole texts: votes of the nearest labelled texts in a latent-semantic
space, by exact cosines.

A text becomes two bags of terms, each hashed to a fixed number of rows:

* the pairs of neighbouring words by their shape (``Aa``, ``A!!``, ``a|``, digits as
  ``0``, runs of letters as one), marked where the second word repeats the first;
* the words themselves, without case and outer punctuation.

A term weighs the root of its share of the bag times its rarity, ``log(1 + N / n)``,
where the counts come from one pass over **all** documents, summed by Spark: at
most ``ROWS`` numbers reach the driver.  The space is spanned by the leading
right singular vectors of the labelled rows (a seeded range finder with power
steps).  At most ``FIT_DOCUMENTS`` labelled rows, in the order of a hash of their id,
are the neighbours to choose from: that bound keeps the broadcast the same at
every size of the corpus.  Every document is multiplied with all of them, block by
block, and its ``K`` nearest vote for their label with weight ``max(0, cosine) **
SHARPNESS``, times the inverse frequency of the label, so that a rare label counts
as much as a common one.

Null and empty texts hold no term: they, and texts that have no neighbour at a
positive cosine, get the share of label 1 that all labels weighed the same would
give, one half.  Without any labelled row every score is 1 (nothing speaks against
a text); labels of one kind give that label.  Rows come out as they went in, repeated
ones included; other columns are kept, but one called ``score`` or ``predicted`` is
replaced.  A null id is not held out and carries no label.  Several labels of one id
count as their lowest, several texts of one id as the first in order.  Nearest rows
that tie are taken in the order of their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemine.llm.common import stored_from_texts

SHAPE_ROWS, WORD_ROWS = 1 << 12, 1 << 13
ROWS = SHAPE_ROWS + WORD_ROWS
SHAPE_WEIGHT, WORD_WEIGHT = 1.0, 0.35
DIMENSIONS = 64
FIT_DOCUMENTS = 3_000
K, SHARPNESS = 15, 8
THRESHOLD = 0.3
TEXTS_PER_BLOCK = 256
SEED = 11

PART_BYTES = 1 << 19

_BLANK = np.zeros(256, bool)
_BLANK[[0x09, 0x0B, 0x0C, 0x0D, 0x20]] = True
#: Letters by case, digits; all else stands for itself.
_SHAPE = np.arange(1, 257, dtype=np.uint32)
_SHAPE[[*range(0x61, 0x7B), *range(0x80, 0x100)]], _SHAPE[0x41:0x5B], _SHAPE[0x30:0x3A] = 0x62, 0x42, 0x31
_RUNS = np.isin(_SHAPE, (0x62, 0x42, 0x31))
#: Letters without case and digits; all else does not count.
_BARE = np.where(_RUNS, np.arange(1, 257), 0).astype(np.uint32)
_BARE[0x41:0x5B] += 0x20
_FACTOR = np.uint32(0x01000193)

Bag = tuple[np.ndarray, np.ndarray]


def _hashed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each run of values; position counts."""
    lengths = np.diff(np.append(starts, len(values)))
    power = np.cumprod(np.full(int(lengths.max()), _FACTOR), dtype=np.uint32)
    at = np.arange(len(values)) - np.repeat(starts, lengths)
    sums = np.add.reduceat(values * power[at], starts, dtype=np.uint32)
    return (sums ^ (sums >> np.uint32(15))) * np.uint32(0x9E3779B1)


def _rows(data: bytes, begins: np.ndarray, goes_on: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of word pairs and words with the text of each, for texts that begin at
    ``begins``.  If the first text ``goes_on``, its first word was counted before."""
    raw = np.frombuffer(data, np.uint8)
    solid = ~_BLANK[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    places = np.flatnonzero(first)
    none = np.zeros(0, np.int64)
    if not len(places):
        return none, none, none, none
    owner = np.searchsorted(begins, places, side="right") - 1
    raw, first = raw[solid], first[solid]
    starts = np.flatnonzero(first)
    words = _hashed(raw.astype(np.uint32) + 1, starts)
    bare = _hashed(_BARE[raw], starts)
    has_bare = np.add.reduceat(_BARE[raw] > 0, starts, dtype=np.int64) > 0
    shape = _SHAPE[raw]
    kept = np.ones(len(raw), bool)  # a run of one kind of letters counts once
    kept[1:] = (shape[1:] != shape[:-1]) | ~_RUNS[raw[1:]] | first[1:]
    shapes = _hashed(shape[kept], np.flatnonzero(first[kept]))
    inner = np.zeros(len(owner), bool)
    inner[1:] = owner[1:] == owner[:-1]
    pairs = shapes * np.uint32(0x85EBCA6B)
    before = np.flatnonzero(inner)
    pairs[before] += shapes[before - 1]
    pairs[before] += (words[before] == words[before - 1]) * np.uint32(0xC2B2AE35)
    pairs = ((pairs ^ (pairs >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> np.uint32(8)
    skip = int(goes_on)
    bare_rows = SHAPE_ROWS + (bare[skip:] >> np.uint32(8)) % np.uint32(WORD_ROWS)
    has_bare = has_bare[skip:]
    return pairs[skip:] % np.uint32(SHAPE_ROWS), owner[skip:], bare_rows[has_bare], owner[skip:][has_bare]


def _parts(texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray, int, bool]]:
    """Whole texts together up to ``PART_BYTES``; a longer one in parts cut between
    words, each of which begins with the last word before it."""
    waiting, begins, size, first = [], [], 0, 0
    for number, text in enumerate(texts):
        # A break is a word of its own; ``split`` takes the other blanks only.
        data = (text or "").encode("utf-8", "surrogatepass").replace(b"\n", b" \x01 ")
        if waiting and size + len(data) > PART_BYTES:
            yield b" ".join(waiting), np.array(begins), first, False
            waiting, begins, size = [], [], 0
        if len(data) <= PART_BYTES:
            first = first if waiting else number
            begins.append(size)
            waiting.append(data)
            size += len(data) + 1
            continue
        at, carried = 0, b""
        while at < len(data):
            cut = data.rfind(b" ", at + 1, at + PART_BYTES) if len(data) - at > PART_BYTES else len(data)
            if cut < 0:  # a word longer than a part stays whole
                cut = data.find(b" ", at + PART_BYTES)
                cut = len(data) if cut < 0 else cut
            part = data[at:cut]
            yield carried + b" " + part, np.zeros(1, np.int64), number, bool(carried)
            carried = (part.rsplit(None, 1) or [carried])[-1]
            at = cut
    if waiting:
        yield b" ".join(waiting), np.array(begins), first, False


def bags(texts: list[str | None]) -> list[Bag]:
    """Rows of each whole text's terms, ascending, with the root of each one's share
    of its family."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for data, begins, first, goes_on in _parts(texts):
        pairs, of_pairs, bare, of_bare = _rows(data, begins, goes_on)
        keys = np.concatenate([(of_pairs + first) * ROWS + pairs, (of_bare + first) * ROWS + bare])
        found.append(np.unique(keys, return_counts=True))
    if len(found) > 1:  # parts of one text meet again
        keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([n for _, n in found]))
    else:
        keys, counts = found[0] if found else (np.zeros(0, np.int64),) * 2
    owner, rows = np.divmod(keys, ROWS)
    family = 2 * owner + (rows >= SHAPE_ROWS)
    share = np.sqrt(counts / np.bincount(family, counts)[family]).astype(np.float32) if len(keys) else np.zeros(0, np.float32)
    cuts = np.searchsorted(owner, np.arange(1, len(texts)))
    return list(zip(np.split(rows.astype(np.int32), cuts), np.split(share, cuts))) if texts else []


@dataclass
class Space:
    """Labelled vectors and the way into their space; at most ``FIT_DOCUMENTS`` rows."""

    rarity: np.ndarray  # by row, with the weight of the family
    axes: np.ndarray  # rows x dimensions
    vectors: np.ndarray  # labelled, unit length or zero
    labels: np.ndarray
    votes: np.ndarray  # weight of each labelled row by its label

    def project(self, found: list[Bag]) -> np.ndarray:
        out = np.zeros((len(found), self.axes.shape[1]), np.float32)
        for i, (rows, shares) in enumerate(found):
            if len(rows):
                weighed = weigh(rows, shares, self.rarity)
                out[i] = weighed @ self.axes[rows]
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, lengths, out=out, where=lengths > 0)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """Scores of unit vectors against all labelled ones."""
        if not len(self.labels):
            return np.ones(len(vectors))
        if self.labels.min() == self.labels.max():
            return np.full(len(vectors), float(self.labels[0]))
        cosines = vectors @ self.vectors.T
        k = min(K, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(cosines, near, axis=1).min(axis=1, keepdims=True)
        for i in np.flatnonzero((cosines >= least).sum(axis=1) > k):
            near[i] = np.argsort(-cosines[i], kind="stable")[:k]  # ties: the first rows
        close = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64)
        weight = close**SHARPNESS * self.votes[near]
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1), 0.5)


def weigh(rows: np.ndarray, shares: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Shares by rarity; each family is brought to its own length first."""
    weighed = shares * rarity[rows]
    cut = int(np.searchsorted(rows, SHAPE_ROWS))
    for part, weight in ((weighed[:cut], SHAPE_WEIGHT), (weighed[cut:], WORD_WEIGHT)):
        length = float(np.linalg.norm(part))
        if length > 0:
            part *= weight / length
    return weighed


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: checksum of the id as text, remainder 0 by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def rarity(docs: DataFrame) -> np.ndarray:
    """Rarity of each row over all documents that hold a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(ROWS + 1, np.int64)
        for batch in batches:
            for rows, _ in bags(batch.column(0).to_pylist()):
                seen[rows] += 1
                seen[ROWS] += len(rows) > 0
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["at", "n"])

    counts = docs.select("text").mapInArrow(count, "at bigint, n bigint")
    seen = np.zeros(ROWS + 1)
    # Stored first, so that the small batches hold for the pass over the texts.
    for r in stored_from_texts(counts.groupBy("at").agg(F.sum("n").alias("n")), "rarity").collect():
        seen[r["at"]] = r["n"]
    return np.log1p(seen[ROWS] / np.maximum(seen[:ROWS], 1)).astype(np.float32)


def axes(x: np.ndarray, dimensions: int, seed: int = SEED) -> np.ndarray:
    """Leading right singular vectors of ``x`` as columns."""
    wide = min(dimensions + 16, *x.shape)
    y = np.random.default_rng(seed).standard_normal((x.shape[1], wide)).astype(x.dtype)
    for _ in range(4):
        y = np.linalg.qr(x.T @ (x @ np.linalg.qr(y)[0]))[0]
    return np.ascontiguousarray((y @ np.linalg.svd(x @ y, full_matrices=False)[2].T)[:, :dimensions])


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> Space:
    """The space of the bounded sample of labelled rows (``doc_id, quality``)."""
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = bags(batch.column(2).to_pylist())
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([r.tobytes() for r, _ in found], pa.binary()),
                pa.array([s.tobytes() for _, s in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "rows", "shares"])

    chosen = (
        docs.select("doc_id", "text")
        .join(F.broadcast(ids), "doc_id")  # at most `most` rows of two numbers
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
        .select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    )
    schema = "doc_id bigint, quality int, rows binary, shares binary"
    fitted = stored_from_texts(chosen.mapInArrow(labelled, schema), "labelled").orderBy("doc_id").collect()
    found = [(np.frombuffer(r.rows, np.int32), np.frombuffer(r.shares, np.float32)) for r in fitted]
    y = np.array([int(r.quality > 0) for r in fitted], np.float64)
    rare = rarity(docs)
    if not len(y) or y.min() == y.max():
        nothing = np.zeros((ROWS, 1), np.float32)
        return Space(rare, nothing, np.zeros((len(y), 1), np.float32), y, np.ones(len(y)))
    x = np.zeros((len(found), ROWS), np.float32)
    for i, (rows, shares) in enumerate(found):
        x[i, rows] = weigh(rows, shares, rare)
    space = Space(rare, axes(x, DIMENSIONS), np.zeros((0, 0)), y, np.where(y > 0, 1 / y.sum(), 1 / (1 - y).sum()))
    space.vectors = space.project(found)
    return space


def scored(docs: DataFrame, space: Space) -> DataFrame:
    """Add ``score`` and ``predicted``; only the text goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    @F.arrow_udf("double")
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        space = shared.value
        for texts in batches:
            scores = [np.zeros(0)]
            for at in range(0, len(texts), TEXTS_PER_BLOCK):
                block = bags(texts[at : at + TEXTS_PER_BLOCK].to_pylist())
                scores.append(space.vote(space.project(block)))
            yield pa.array(np.concatenate(scores), pa.float64())

    return docs.withColumn("score", quality("text")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
