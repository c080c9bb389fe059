"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of lengths that fits one sequence.  The program
asks for the fewest configurations that cover the histogram of lengths.  It is
solved by multiplicative weights: a length's price is its share of a sequence
times a weight that falls as the length is covered ahead of the rest, and a
knapsack over the capacity finds the best configuration at those prices.  The
fractional answer is rounded down, single bins follow by their fractions, and a
best fit takes the pieces that are left.  The same prices, over the worth of the
best configuration, bound the program from below (``Plan.at_least``); while
the result is further than ``GAP`` above that bound, the program is solved again
with prices that move faster.

All of this sees only the histogram, whose size is bounded by the capacity, and
works on counts of equal lengths, the best fit included: bins that look the same are
one entry, and a length changes all of them but splits two at most.  So neither time
nor memory of the driver, nor the plan it broadcasts, grow with the corpus.  The plan
says for the k-th piece of a length where it goes, and Spark numbers the pieces of
each length.

A null or empty text is one piece that holds the end id alone.  Repeated rows
are packed each.  An empty table gives no sequences.  Only documents longer than
the capacity are cut; the first piece takes the remainder.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcemine.llm import tokens
from sourcemine.llm.common import DENSE, numbered, stored_from_texts

CAPACITY = 2048
END_ID = 0
ROUNDS = 1500
RATES = (0.1, 1.0, 8.0)  # how fast a price falls as a length is covered ahead of the rest
GAP = 0.002  # above the lower bound, relative, from which the next rate is tried
# What rounding may leave to the best fit, which needs short pieces to fill up with.
HELD_BINS, HELD_SHARES = 2_000, (0.0, 0.02, 0.15)
FILLS = (0.999, 0.97, 0.9, 0.0)  # least fill of configurations that are used in bulk


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def narrowed(ids: bytes) -> bytes:
    """Ids in 16 bits each where all of them fit, else as they are."""
    numbers = np.frombuffer(ids, "<u4")
    return numbers.astype("<u2").tobytes() if numbers.max() < 1 << 16 else ids


def pieces(
    docs: DataFrame, vocabulary: str = tokens.BYTE, capacity: int = CAPACITY, with_ids: bool = False, narrow: bool = False
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, ``narrow`` in 16 bits
    where they fit) of all texts."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        schema, names = f"{schema}, ids binary", [*names, "ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(vocabulary), END_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[] for _ in names]
            source = []
            for i, text in enumerate(batch.column(1)):
                ids = encoder.encode(text.as_py()) + end
                start = 0
                for k, length in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    source.append(i)
                    row = (k, start, length, zlib.crc32(part), narrowed(part) if narrow else part)
                    for column, value in zip(out[1:], row):
                        column.append(value)
                    start += length
            keys = batch.column(0).take(pa.array(source, pa.int64()))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            rest = [pa.array(x, t) for x, t in zip(out[1:], types)]
            yield pa.RecordBatch.from_arrays([keys, *rest], names)

    return docs.select("doc_id", "text").mapInArrow(encode, schema)


@dataclass
class Plan:
    """Placements by length and slot: slots from ``base`` on go ``each`` to a
    sequence, from sequence ``sequence`` on, at ``offset`` in it."""

    length: np.ndarray
    base: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int = 0
    at_least: int = 0

    def place(self, length: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (self.length << 44) + self.base
        at = np.searchsorted(key, (length << 44) + slot, side="right") - 1
        inside = slot - self.base[at]
        each = self.each[at]
        return self.sequence[at] + inside // each, self.offset[at] + inside % each * length


def best_configuration(price: np.ndarray) -> np.ndarray:
    """Knapsack by dynamic programming: lengths of the configuration with the
    highest sum of prices; ``price[l]`` is -inf where no piece is ``l`` long."""
    capacity = len(price) - 1
    worth = np.zeros(capacity + 1)  # from the right: worth[capacity - c] for capacity c
    last = np.zeros(capacity + 1, dtype=np.int64)
    sums = np.empty(capacity)
    for c in range(1, capacity + 1):
        at = capacity - c
        np.add(worth[at + 1 :], price[1 : c + 1], out=sums[:c])
        pick = int(sums[:c].argmax())
        if sums[pick] > worth[at + 1]:
            worth[at], last[c] = sums[pick], pick + 1
        else:
            worth[at] = worth[at + 1]
    found, c = [], capacity
    while c > 0:
        if last[c]:
            found.append(int(last[c]))
            c -= int(last[c])
        else:
            c -= 1
    return np.array(found)


def fractional(
    histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, rate: float = RATES[0]
) -> tuple[list[tuple[Counter, float]], float]:
    """Configurations and how often each is used, by multiplicative weights, and the
    best lower bound that the prices of any round gave."""
    lengths = np.array(sorted(histogram))
    need = np.array([histogram[int(x)] for x in lengths], dtype=float)
    bins = float((lengths * need).sum() / capacity)
    covered = np.zeros(len(lengths))
    place = {int(x): i for i, x in enumerate(lengths)}
    used: dict[tuple[tuple[int, int], ...], float] = {}
    done = bound = 0.0
    for _ in range(rounds):
        if done >= bins or not (covered < 1).any():
            break
        lead = covered - done / bins
        weight = np.where(covered < 1, np.exp(np.clip(-rate * lead, -8, 8)), 0)
        price = np.full(capacity + 1, -np.inf)
        open_ = weight > 0
        price[lengths[open_]] = lengths[open_] / capacity * weight[open_]
        found = Counter(best_configuration(price).tolist())
        # At prices over the worth of the best configuration none is worth more than 1.
        worth = sum(float(price[x]) * n for x, n in found.items())
        bound = max(bound, float((price[lengths[open_]] * need[open_]).sum()) / worth)
        at = np.array([place[x] for x in found])
        times = np.array(list(found.values()), dtype=float)
        times = np.minimum(times, need[at])
        # No length may be covered by more than it misses in one step.
        step = min(bins / 200, float((need[at] * (1 - covered[at]) / times).min()))
        step = max(step, bins / (4 * rounds))
        covered[at] += step * times / need[at]
        done += step
        key = tuple(sorted((x, int(t)) for x, t in zip(found, times)))
        used[key] = used.get(key, 0.0) + step
    return [(Counter(dict(key)), x) for key, x in used.items()], bound


def rounded(
    parts: list[tuple[Counter, float]], histogram: dict[int, int], capacity: int, fill: float, held: float
) -> tuple[Counter, dict[int, int]]:
    """Whole numbers of configurations that are full to ``fill`` at least, and the
    pieces they leave: ``held`` of the bins, ``HELD_BINS`` at most, and what is over."""
    left = dict(histogram)
    out: Counter = Counter()

    def use(configuration: Counter, times: int) -> None:
        times = min([times, *(left[x] // n for x, n in configuration.items())])
        if times > 0:
            for x, n in configuration.items():
                left[x] -= n * times
            out[tuple(sorted(configuration.items()))] += times

    parts = [p for p in parts if sum(n * k for n, k in p[0].items()) >= fill * capacity]
    total = sum(x for _, x in parts)
    share = max(0.0, 1 - min(HELD_BINS, held * total) / max(total, 1))
    for configuration, x in sorted(parts, key=lambda p: -p[1]):
        use(configuration, int(x * share))
    for configuration, x in sorted(parts, key=lambda p: int(p[1]) - p[1]):
        if sum(out.values()) < total * share:
            use(configuration, 1)
    return out, {x: n for x, n in left.items() if n}


def best_fit(left: dict[int, int], capacity: int) -> Counter:
    """Configurations for pieces taken one by one, longest first, each into the bin
    with the least room that holds it: worked for all pieces of a length at once.

    A bin that takes a piece has the least room of those that hold one more, so it
    takes as many as it can before the next bin does."""
    bins: dict[int, Counter] = {}  # by room: what such bins hold, and how many they are
    rooms: list[int] = []

    def put(room: int, held: tuple, times: int) -> None:
        if room not in bins:
            bins[room] = Counter()
            insort(rooms, room)
        bins[room][held] += times

    for x in sorted(left, reverse=True):
        n = left[x]
        changed = []
        for room in rooms[bisect_left(rooms, x) :]:
            each = room // x
            for held in list(bins[room]):
                for k in (each, n % each):  # the last bin may get fewer
                    times = min(bins[room][held], n // k) if k else 0
                    if times:
                        bins[room][held] -= times
                        n -= k * times
                        changed.append((room - k * x, (*held, (x, k)), times))
                    if n >= each:
                        break
                if not bins[room][held]:
                    del bins[room][held]
            if not bins[room]:
                del bins[room]
                rooms.remove(room)
            if not n:
                break
        each = capacity // x
        if n // each:
            changed.append((capacity - each * x, ((x, each),), n // each))
        if n % each:
            changed.append((capacity - n % each * x, ((x, n % each),), 1))
        for room, held, times in changed:
            put(room, held, times)
    out: Counter = Counter()
    for of in bins.values():
        for held, times in of.items():
            out[tuple(sorted(held))] += times
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """The plan for a histogram of lengths, 1 to ``capacity``."""
    full = histogram.get(capacity, 0)
    part = {x: n for x, n in histogram.items() if x < capacity}
    bound = float(sum(x * n for x, n in part.items()) / capacity)
    best: tuple[int, int, Counter] | None = None
    for rate in RATES if part else ():
        parts, priced = fractional(part, capacity, rounds, rate)
        bound = max(bound, priced)
        for fill in FILLS:
            for held in HELD_SHARES:
                found, rest = rounded(parts, part, capacity, fill, held)
                whole = found + best_fit(rest, capacity)
                # Fewest sequences, then most of them by configurations.
                result = (sum(whole.values()), -sum(found.values()))
                if best is None or result < best[:2]:
                    best = (*result, whole)
        if best[0] <= np.ceil(bound - 1e-6) * (1 + GAP):
            break
    used = best[2] if best else Counter()
    if full:
        used[((capacity, 1),)] += full
    taken: Counter = Counter()
    rows: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for configuration, times in used.items():
        offset = 0
        for x, each in sorted(configuration, reverse=True):
            rows.append((x, taken[x], each, sequence, offset))
            taken[x] += each * times
            offset += each * x
        sequence += times
    columns = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, n_sequences=sequence, at_least=full + int(np.ceil(bound - 1e-6)))


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces."""
    return planned(rows, capacity)[0]


def planned(rows: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, Plan]:
    """The packed pieces, and the plan with its number of sequences and lower bound."""
    spark = rows.sparkSession
    rows = stored_from_texts(rows.withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    histogram = rows.groupBy("length").count().collect()  # at most `capacity` rows
    plan = solve({r["length"]: r["count"] for r in histogram}, capacity)
    shared = spark.sparkContext.broadcast(plan)
    slots = numbered(
        rows, [F.col("length"), F.col("doc_id"), F.col("piece"), F.col("_piece")], "slots", ["length"], "slot"
    ).drop("_piece")
    kinds = [(f.name, f.dataType.simpleString()) for f in slots.drop("slot").schema]
    schema = ", ".join(f"`{name}` {kind}" for name, kind in [*kinds, ("sequence_id", "bigint"), ("offset", "bigint")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, slot = (batch.column(c).to_numpy() for c in ("length", "slot"))
            found = [pa.array(x) for x in shared.value.place(length, slot)]
            names = [name for name, _ in kinds]
            kept = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*kept, *found], [*names, "sequence_id", "offset"])

    return slots.mapInArrow(place, schema), plan


def sequences(rows: DataFrame) -> DataFrame:
    """The packed sequences themselves from placed pieces with ``ids``, narrow or not: a
    group holds at most one sequence of ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    wide = "regexp_replace(hex(p.ids), '(.{4})', '$10000')"  # two zero bytes behind every two
    digits = f"transform(parts, p -> IF(octet_length(p.ids) = 4 * p.length, hex(p.ids), {wide}))"
    whole = F.expr(f"unhex(array_join({digits}, ''))")
    return rows.groupBy("sequence_id").agg(ordered.alias("parts")).select(
        "sequence_id", whole.alias("ids"), F.expr("transform(parts, p -> struct(p.doc_id, p.piece, p.offset))").alias("members")
    )


def sequences_of(docs: DataFrame, vocabulary: str = tokens.BYTE, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences of all texts: ``sequence_id, ids`` (little-endian unsigned
    32-bit numbers) and ``members`` (``doc_id, piece, offset``), in which a document that
    is there twice stands twice.  Ids meet their places last, so they are not sorted, and
    they travel in 16 bits each where they fit."""
    whole = pieces(docs, vocabulary, capacity, with_ids=True, narrow=True)
    whole = stored_from_texts(whole.withColumn("_whole", F.monotonically_increasing_id()), "whole-pieces", DENSE)
    placed = packed(whole.drop("ids"), capacity).select("_whole", "sequence_id", "offset")
    return sequences(whole.select("_whole", "doc_id", "piece", "length", "ids").join(placed, "_whole"))
