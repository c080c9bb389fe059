"""Phrase collocations: exact counts of word n-grams in counting quotient filters.

Everything is by language (null: ``und``).  ASCII capitals become small, texts split
at ``[.,;:!?\\x0A-\\x0D]`` into pieces and pieces into words ``[^\\x20\\x09]+``.

1. **Words.**  A task turns texts of one language into a chunk: words numbered as
   they come, and the text as these numbers, 0 between pieces.  Spark deals the words
   of chunks out to buckets by a hash; a bucket sums their counts up, numbers those
   with ``least`` occurrences and sends each chunk one list of its numbers, which a
   join on the chunk brings back into the texts.  No dictionary is broadcast, and no
   join has a row for each chunk and word.  Other words become breaks: no candidate
   holds one.
2. **Grams**, one length after the other.  The numbers of a gram, ``bits`` wide each,
   are packed, and the packed number goes through an invertible permutation.  Its high
   bits are the quotient, all others the remainder, so a filter loses nothing: it holds
   a unary list of how many entries each quotient has, the remainders in order, and
   counters of one byte with an overflow list.  A task counts into one sorted filter
   and sends it off in segments by the leading bits of the quotient; a segment's filters
   are merged, and entries with ``least`` occurrences are turned back into numbers.
3. **Pruning.**  Both parts of a gram that lack one word must be frequent.  A Bloom
   filter of the frequent grams of the length before, at most ``BLOOM_BITS`` bits
   whatever the corpus, tells what need not be counted; a false answer of it costs
   work only.
4. **Scores** are joins of frequent grams with the counts of their parts, in decimals
   of 38 digits.

Null and empty texts hold no word.  Equal rows count each.  Columns other than
``text`` and ``lang`` are not read.  An empty table gives no row.  A text longer than a
slice is worked in slices cut between pieces; a piece is never cut, so the longest
piece bounds what a task holds.  Word numbers have at most 32 bits: more frequent
words than that end the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourcemine.llm.common import stored, stored_from_texts
from sourcemine.storage import BATCH_SETTING, _settings

LONGEST, LEAST, SHARE, SCALE, TOP = 5, 100, 100, 1000, 2000
SLICE_BYTES = 1 << 20
CHUNK_WORDS = 3_000_000  # of all languages that a task has open
FILTER_ENTRIES = 1 << 20  # of one task, before it sends them on
SEGMENT_ENTRIES = 1 << 21  # expected at most in a segment, over all tasks
BLOOM_BITS = 26
CHUNKS_PER_ARROW_BATCH = 2
LEAST_BUCKETS, BUCKET_WORDS = 64, 1 << 18  # of words; expected in a bucket, over all chunks

_SMALL = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\v\f\r\t", b"abcdefghijklmnopqrstuvwxyz......... "
)
_U = np.uint64


# -- words ---------------------------------------------------------------------


class Numbers(dict):
    """Words numbered from 1 as they come; a break is 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Chunk:
    """Texts of one language as numbers of words."""

    def __init__(self):
        self.numbers, self.parts, self.size = Numbers(), [], 0

    def add(self, data: bytes) -> None:
        words = data.replace(b".", b" . ").split()
        if words:
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
            self.parts.append(np.zeros(1, np.uint32))
            self.size += len(words) + 1

    def row(self, lang: str) -> dict:
        tokens = np.concatenate(self.parts)
        counts = np.bincount(tokens, minlength=len(self.numbers))[1:]
        return {"lang": lang, "tokens": tokens.tobytes(), "words": list(self.numbers)[1:], "counts": counts}


def slices(text: bytes) -> Iterator[bytes]:
    """A whole text in slices, cut between pieces; ``.`` ends a piece."""
    data = text.translate(_SMALL)
    at = 0
    while len(data) - at > SLICE_BYTES:
        cut = data.find(b".", at + SLICE_BYTES)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


def chunks_of(docs: DataFrame) -> DataFrame:
    """``chunk, lang, tokens, words, counts``; a chunk has one language."""
    kinds = [pa.string(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(["lang", "tokens", "words", "counts"], kinds)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Chunk] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for data in slices(text.as_py()):
                    chunk = open_.setdefault(lang, Chunk())
                    chunk.add(data)
                    # However many languages there are, a task holds few words.
                    if sum(c.size for c in open_.values()) >= CHUNK_WORDS:
                        fullest = max(open_, key=lambda k: open_[k].size)
                        yield pa.RecordBatch.from_pylist([open_.pop(fullest).row(fullest)], schema)
        for lang, chunk in open_.items():
            if chunk.size:
                yield pa.RecordBatch.from_pylist([chunk.row(lang)], schema)

    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )
    found = texts.mapInArrow(build, "lang string, tokens binary, words array<binary>, counts array<bigint>")
    return stored_from_texts(found.withColumn("chunk", F.monotonically_increasing_id()), "chunks")


class Places(dict):
    """Words of one language, numbered as they come on from those of all languages."""

    def __init__(self, all_words: list[bytes]):
        self.all_words = all_words

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.all_words)
        self.all_words.append(word)
        return number


def dealt(chunks: DataFrame, buckets: int) -> DataFrame:
    """``bucket, lang, chunk, locals, words, counts``: the words of each chunk, dealt
    out by a hash, with their numbers in the chunk; one row a bucket and chunk."""
    import xxhash

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for chunk, lang, own, counts in zip(*(batch.column(i) for i in range(4))):
                own, counts = own.values, counts.values
                bucket = np.fromiter((digest(w) % buckets for w in own.to_pylist()), np.int64, len(own))
                order = np.argsort(bucket, kind="stable")
                met, starts = np.unique(bucket[order], return_index=True)
                offsets = pa.array([*starts, len(order)], pa.int32())
                columns = [pa.array(met), pa.array([lang.as_py()] * len(met), pa.string())]
                columns.append(pa.array([chunk.as_py()] * len(met), pa.int64()))
                for values in (pa.array(order + 1), own.take(pa.array(order)), counts.take(pa.array(order))):
                    columns.append(pa.ListArray.from_arrays(offsets, values))
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "lang", "chunk", "locals", "words", "counts"])

    kinds = "bucket bigint, lang string, chunk bigint, locals array<bigint>, words array<binary>, counts array<bigint>"
    with_words = chunks.where(F.size("words") > 0).select("chunk", "lang", "words", "counts")
    return with_words.mapInArrow(deal, kinds)


def frequent_words(chunks: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``id, lang, word, f`` of frequent words, numbers from 1 on without a gap; and
    ``chunk, locals, ids``: where they stand in their chunks, a row a bucket.

    A word of all chunks is in one bucket, where its counts are summed up and it gets
    its number; what is sent back is a list for each chunk, not a row for each word."""

    def settle(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_words: list[bytes] = []
        known: dict[str, Places] = {}
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            columns = (batch.column(c) for c in ("lang", "chunk", "locals", "words", "counts"))
            for lang, chunk, own, words, counts in zip(*columns):
                places = known.setdefault(lang.as_py(), Places(all_words))
                at = np.fromiter(map(places.__getitem__, words.as_py()), np.int64, len(words))
                held.append((chunk.as_py(), own.values.to_numpy().astype(np.uint32), at, counts.values.to_numpy().copy()))
        totals = np.zeros(len(all_words), np.int64)
        for _, _, at, counts in held:
            totals[at] += counts  # a chunk has a word once
        often = totals >= least
        number = np.cumsum(often) - 1
        rows = []
        for lang, places in known.items():
            at = np.fromiter(places.values(), np.int64, len(places))
            at = at[often[at]]
            if len(at):
                rows.append((None, lang, None, number[at], [all_words[i] for i in at], totals[at]))
        for chunk, own, at, _ in held:
            kept = often[at]
            if kept.any():
                rows.append((chunk, None, own[kept].astype(np.int64), number[at[kept]], None, None))
        longs = pa.list_(pa.int64())
        types = [pa.int64(), pa.string(), longs, longs, pa.list_(pa.binary()), longs]
        for k in range(0, len(rows), 256):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows[k : k + 256]), types)]
            bucket = pa.array([key[0].as_py()] * len(columns[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([bucket, *columns], ["bucket", "chunk", "lang", "locals", "numbers", "words", "f"])

    pairs = chunks.agg(F.sum(F.size("words"))).first()[0] or 0
    kinds = (
        "bucket bigint, chunk bigint, lang string, locals array<bigint>, numbers array<bigint>, "
        "words array<binary>, f array<bigint>"
    )
    buckets = max(LEAST_BUCKETS, pairs // BUCKET_WORDS)
    settled = stored_from_texts(dealt(chunks, buckets).groupBy("bucket").applyInArrow(settle, kinds), "settled-words")
    named = settled.where("chunk IS NULL")
    sizes = named.groupBy("bucket").agg(F.sum(F.size("words")).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(
        sizes.select("bucket", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias("start")), "word-starts"
    )
    words = named.join(starts, "bucket").select(
        "lang", "start", F.explode(F.arrays_zip("numbers", "words", "f")).alias("w")
    )
    words = words.select((F.col("start") + F.col("w.numbers")).alias("id"), "lang", F.col("w.words").alias("word"), "w.f")
    ids = F.transform("numbers", lambda x: x + F.col("start"))
    places = settled.where("chunk IS NOT NULL").join(starts, "bucket").select("chunk", "locals", ids.alias("ids"))
    return stored(words, "numbered-words"), places


def encoded(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """``ids`` of each chunk: global numbers of frequent words, 0 for breaks."""
    tables = places.groupBy("chunk").agg(F.collect_list(F.struct("locals", "ids")).alias("parts"))
    tables = tables.select("chunk", F.flatten("parts.locals").alias("locals"), F.flatten("parts.ids").alias("ids"))

    def translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = np.frombuffer(batch.column(0)[i].as_py(), np.uint32)
                table = np.zeros(int(tokens.max()) + 1, np.uint32)
                table[batch.column(1)[i].values.to_numpy()] = batch.column(2)[i].values.to_numpy()
                ids = table[tokens]
                kept = ids > 0  # of breaks that follow each other the first stays
                kept[1:] |= ids[:-1] > 0
                yield pa.RecordBatch.from_arrays([pa.array([ids[kept].tobytes()], pa.binary())], ["ids"])

    joined = chunks.select("chunk", "tokens").join(tables, "chunk").select("tokens", "locals", "ids")
    with _settings(chunks.sparkSession, {BATCH_SETTING: CHUNKS_PER_ARROW_BATCH}):
        return stored(joined.mapInArrow(translate, "ids binary"), "encoded")


# -- filters -------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """A well spread function of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def gram_hash(grams: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(grams[0]), 0x51ED270B, _U)
    for ids in grams:
        h = mixed(h * _U(0x9E3779B97F4A7C15) + ids.astype(_U))
    return h


@dataclass(frozen=True)
class Shape:
    """Grams of ``n`` numbers of ``bits`` bits (32 at most), and their permutation.

    The first two numbers make the lane that is permuted, the next two and the
    fifth the lanes that steer it and are kept as they are.
    """

    n: int
    bits: int

    _FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

    @property
    def wide(self) -> int:
        return 2 * self.bits

    def _mask(self) -> np.uint64:
        return _U((1 << self.wide) - 1)

    def _fold(self, x: np.ndarray) -> np.ndarray:
        return x ^ (x >> _U((self.wide + 1) // 2))  # its own inverse

    def _steer(self, lanes: list[np.ndarray]) -> np.ndarray | np.uint64:
        h = _U(0)
        for lane in lanes:
            h = mixed(lane + h * _U(0x9E3779B97F4A7C15) + _U(1))
        return h & self._mask()

    def pack(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """Lanes of permuted grams, one array for each two numbers."""
        b, ids = _U(self.bits), [x.astype(_U) for x in ids]
        lanes = [(ids[i] << b) | ids[i + 1] if i + 1 < self.n else ids[i] for i in range(0, self.n, 2)]
        x = lanes[0] ^ self._steer(lanes[1:])
        for factor in self._FACTORS:
            x = (self._fold(x) * _U(factor)) & self._mask()
        return [self._fold(x), *lanes[1:]]

    def unpack(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        x = self._fold(lanes[0])
        for factor in reversed(self._FACTORS):
            x = self._fold((x * _U(pow(factor, -1, 1 << self.wide))) & self._mask())
        lanes = [x ^ self._steer(lanes[1:]), *lanes[1:]]
        low = _U((1 << self.bits) - 1)
        out = []
        for at, lane in enumerate(lanes):
            out += [lane >> _U(self.bits), lane & low] if 2 * at + 1 < self.n else [lane]
        return out

    def lane_bits(self) -> list[int]:
        return [self.wide if at + 1 < self.n else self.bits for at in range(0, self.n, 2)]


@dataclass
class Filter:
    """Permuted grams in order, with their counters."""

    lanes: list[np.ndarray]
    counts: np.ndarray

    @classmethod
    def of(cls, lanes: list[np.ndarray], counts: np.ndarray) -> "Filter":
        """Sorted, equal entries summed up."""
        if not len(counts):
            return cls(lanes, counts)
        order = np.lexsort(lanes[::-1])
        lanes = [lane[order] for lane in lanes]
        new = np.ones(len(order), bool)
        new[1:] = np.any([lane[1:] != lane[:-1] for lane in lanes], axis=0)
        starts = np.flatnonzero(new)
        return cls([lane[starts] for lane in lanes], np.add.reduceat(counts[order], starts))

    @classmethod
    def merged(cls, filters: list["Filter"]) -> "Filter":
        lanes = [np.concatenate(part) for part in zip(*(f.lanes for f in filters))]
        return cls.of(lanes, np.concatenate([f.counts for f in filters]))

    def segments(self, shape: Shape, split: int) -> Iterator[tuple[int, "Filter"]]:
        """Cut by the ``split`` leading bits of the quotient."""
        number = self.lanes[0] >> _U(shape.wide - split) if split else np.zeros_like(self.lanes[0])
        starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        for start, end in zip(starts, [*starts[1:], len(number)]):
            yield int(number[start]), Filter([x[start:end] for x in self.lanes], self.counts[start:end])

    def to_bytes(self, shape: Shape, split: int) -> bytes:
        """The stored form of one segment: how many entries it has and how many bits
        of quotient, entries by quotient in unary, remainders, counters."""
        n = len(self.counts)
        own = min(shape.wide - split, max(0, n.bit_length() - 1))
        rest = shape.wide - split - own
        quotient = ((self.lanes[0] >> _U(rest)) & _U((1 << own) - 1)).astype(np.int64) if own else np.zeros(n, np.int64)
        unary = np.zeros(n + (1 << own), np.uint8)
        unary[np.arange(n) + quotient] = 1
        parts = [np.array([n, own], np.int64).tobytes(), np.packbits(unary).tobytes()]
        for lane, bits in zip(self.lanes, [rest, *shape.lane_bits()[1:]]):
            raw = lane.astype("<u8").view(np.uint8).reshape(n, 8)[:, : -(-bits // 8)].copy()
            if bits % 8:
                raw[:, -1] &= (1 << (bits % 8)) - 1
            parts.append(raw.tobytes())
        parts.append(np.minimum(self.counts, 255).astype(np.uint8).tobytes())
        parts.append(self.counts[self.counts >= 255].astype(np.int64).tobytes())
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes, shape: Shape, split: int, segment: int) -> "Filter":
        n, own = (int(x) for x in np.frombuffer(data, np.int64, 2))
        rest, at = shape.wide - split - own, 16
        size = -(-(n + (1 << own)) // 8)
        unary = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n + (1 << own))
        at += size
        quotient = np.flatnonzero(unary) - np.arange(n)
        lanes = []
        for bits in [rest, *shape.lane_bits()[1:]]:
            width = -(-bits // 8)
            raw = np.zeros((n, 8), np.uint8)
            raw[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
            lanes.append(raw.view("<u8").ravel().astype(_U))
            at += n * width
        top = (_U(segment) << _U(own)) | quotient.astype(_U) if split else quotient.astype(_U)
        lanes[0] = (top << _U(rest)) | lanes[0] if rest < 64 else lanes[0]
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        counts[counts == 255] = np.frombuffer(data, np.int64, -1, at + n)
        return cls(lanes, counts)


@dataclass
class Bloom:
    """Which grams may be frequent: two bits of each in a field of fixed size."""

    bits: int
    words: np.ndarray

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in (h, h >> _U(32)):
            at = at & _U((1 << self.bits) - 1)
            found &= (self.words[at >> _U(6)] >> (at & _U(63))) & _U(1) > 0
        return found


def grams(ids: np.ndarray, n: int, bloom: Bloom | None) -> list[np.ndarray]:
    """The numbers of all windows of ``n`` words that may be frequent."""
    size = len(ids) - n + 1
    if size <= 0:
        return [ids[:0]] * n
    fits = np.ones(size, bool)
    for i in range(n):
        fits &= ids[i : i + size] > 0
    at = np.flatnonzero(fits)
    if bloom is not None and len(at):
        at = at[bloom.may_hold(gram_hash([ids[at + i] for i in range(n - 1)]))]
        at = at[bloom.may_hold(gram_hash([ids[at + i] for i in range(1, n)]))]
    return [ids[at + i] for i in range(n)]


def bloom_of(found: DataFrame, count: int) -> Bloom:
    """Of the frequent grams of one length; set bits are brought together by Spark,
    64 in a row, so at most ``2 ** (BLOOM_BITS - 6)`` numbers reach the driver."""
    bits = min(BLOOM_BITS, max(12, (16 * count).bit_length()))
    mask = (1 << bits) - 1
    place = F.explode(
        F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 32).bitwiseAND(mask))
    )
    fields = (
        found.select(place.alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("set"))
        .toArrow()
    )
    words = np.zeros(1 << (bits - 6), np.int64)
    words[fields["word"].to_numpy()] = fields["set"].to_numpy()
    return Bloom(bits, words.view(_U))


def counted(ids: DataFrame, shape: Shape, words: int, least: int, bloom: Bloom | None) -> DataFrame:
    """``gram`` (four bytes a number), ``f`` and ``hash`` of frequent grams of one length."""
    spark = ids.sparkSession
    split = min(shape.wide, 30, (words // SEGMENT_ENTRIES).bit_length())
    shared = spark.sparkContext.broadcast(bloom)

    def cut(whole: Filter) -> Iterator[pa.RecordBatch]:
        rows = [(number, part.to_bytes(shape, split)) for number, part in whole.segments(shape, split)]
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            columns = [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["segment", "filter"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, waiting, size = None, [], 0

        def summed() -> Filter:
            lanes = shape.pack([np.concatenate(part) for part in zip(*waiting)])
            new = Filter.of(lanes, np.ones(len(lanes[0]), np.int64))
            return new if whole is None else Filter.merged([whole, new])

        for batch in batches:
            for data in batch.column(0):
                found = grams(np.frombuffer(data.as_py(), np.uint32), shape.n, shared.value)
                waiting.append(found)
                size += len(found[0])
                if size >= FILTER_ENTRIES:
                    whole, waiting, size = summed(), [], 0
                    if len(whole.counts) >= FILTER_ENTRIES:
                        yield from cut(whole)
                        whole = None
        if size:
            whole = summed()
        if whole is not None:
            yield from cut(whole)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, whole, waiting, size = key[0].as_py(), None, [], 0
        for batch in batches:
            for data in batch.column("filter"):
                waiting.append(Filter.from_bytes(data.as_py(), shape, split, segment))
                size += len(waiting[-1].counts)
                if size >= FILTER_ENTRIES:
                    whole = Filter.merged([*([] if whole is None else [whole]), *waiting])
                    waiting, size = [], 0
        whole = Filter.merged([*([] if whole is None else [whole]), *waiting]) if waiting else whole
        often = whole.counts >= least
        ids = shape.unpack([lane[often] for lane in whole.lanes])
        raw = np.stack(ids, axis=1).astype(">u4")
        grams_ = pa.array([row.tobytes() for row in raw], pa.binary())
        columns = [grams_, pa.array(whole.counts[often]), pa.array(gram_hash(ids).view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["gram", "f", "hash"])

    filters = ids.mapInArrow(count, "segment bigint, filter binary")
    merged = filters.groupBy("segment").applyInArrow(merge, "gram binary, f bigint, hash bigint")
    with _settings(spark, {BATCH_SETTING: CHUNKS_PER_ARROW_BATCH}):
        return stored(merged, f"grams-{shape.n}")


# -- scores --------------------------------------------------------------------


def _size(gram: str | Column) -> Column:
    return (F.octet_length(gram) / 4).cast("int")


def cut_scores(found: DataFrame, counts: DataFrame, totals: DataFrame, scale: int) -> DataFrame:
    """The cut of least score of each gram: ``gram, lang, a, n, l, r, score``.

    ``found``: grams with ``f`` and ``lang``; ``counts``: all frequent words and grams.
    """
    cuts = found.select(
        "gram", "lang", F.col("f").alias("a"), F.explode(F.expr("sequence(1, octet_length(gram) div 4 - 1)")).alias("k")
    )
    cuts = cuts.withColumn("left", F.expr("substring(gram, 1, 4 * k)"))
    cuts = cuts.withColumn("right", F.expr("substring(gram, 4 * k + 1)"))
    left = counts.select(F.col("gram").alias("left"), F.col("f").alias("l"))
    right = counts.select(F.col("gram").alias("right"), F.col("f").alias("r"))
    wide = "CAST({} AS DECIMAL(19, 0))"
    product = f"CAST({scale} AS DECIMAL(9, 0)) * ({wide.format('a')} * {wide.format('n')})"
    score = F.expr(f"CAST({product} AS DECIMAL(38, 0)) div ({wide.format('l')} * {wide.format('r')})")
    scored = cuts.join(left, "left").join(right, "right").join(totals, "lang").withColumn("score", score)
    best = scored.groupBy("gram", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("gram", "lang", "a", "n", "cut.l", "cut.r", "cut.score")


def not_inside(found: DataFrame, share: int) -> DataFrame:
    """Grams that lie in no longer one with ``share`` percent of their count."""
    parts = F.expr(
        "flatten(transform(sequence(2, octet_length(gram) div 4 - 1), m -> "
        "transform(sequence(0, octet_length(gram) div 4 - m), i -> substring(gram, 4 * i + 1, 4 * m))))"
    )
    inside = (
        found.where(_size("gram") > 2)
        .select(F.explode(parts).alias("gram"), "f")
        .groupBy("gram")
        .agg(F.max("f").alias("longer"))
    )
    kept = F.coalesce(F.col("longer") * 100 < F.col("f") * share, F.lit(True))
    return found.join(inside, "gram", "left").where(kept).drop("longer")


def mined(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    share: int = SHARE,
    scale: int = SCALE,
    top: int = TOP,
) -> DataFrame:
    """Phrases of 2 to ``longest`` words that ``docs`` (``text, lang``) hold ``least``
    times or more: ``lang, rank, phrase, a, l, r, n, score``.  See the head of the module."""
    chunks = chunks_of(docs)
    words, places = frequent_words(chunks, least)
    totals = chunks.groupBy("lang").agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")
    )
    totals = stored(totals, "totals")
    facts = words.agg(F.max("id").alias("last"), F.sum("f").alias("f")).first()
    last = facts["last"] or 0
    if last >= 1 << 32:
        raise ValueError("more than 2 ** 32 frequent words")
    raw_id = F.unhex(F.lpad(F.hex("id"), 8, "0"))
    counts = words.select(raw_id.alias("gram"), "f")
    levels = []
    if last:
        ids = encoded(chunks, places)
        bloom = None
        for n in range(2, longest + 1):
            level = counted(ids, Shape(n, max(1, last.bit_length())), facts["f"], least, bloom)
            levels.append(level.select("gram", "f"))
            size = level.count()
            if n == longest or not size:
                break
            bloom = bloom_of(level, size)
    found = reduce(DataFrame.union, levels) if levels else counts.limit(0)
    first = words.select(raw_id.alias("first"), "lang")
    found = found.withColumn("first", F.expr("substring(gram, 1, 4)")).join(first, "first").drop("first")
    found = stored(found, "phrases")
    scores = cut_scores(not_inside(found, share), counts.union(found.select("gram", "f")), totals, scale)
    # Ties beyond the last place stay until the phrases are spelled out.
    by = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    ahead = stored(scores.withColumn("place", F.rank().over(by)).where(F.col("place") <= top).drop("place"), "ahead")
    each = ahead.select(
        "gram", F.posexplode(F.expr("transform(sequence(1, octet_length(gram), 4), i -> substring(gram, i, 4))")).alias("at", "one")
    )
    spelled = (
        each.join(words.select(raw_id.alias("one"), "word"), "one")
        .groupBy("gram")
        .agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("words"))
        .select("gram", F.array_join("words.word", " ").alias("phrase"))
    )
    by = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return (
        ahead.join(spelled, "gram")
        .withColumn("rank", F.row_number().over(by).cast("long"))
        .where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
