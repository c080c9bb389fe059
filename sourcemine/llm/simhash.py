"""Near copies by 64-bit fingerprints at ``DISTANCE`` or fewer differing bits,
found in a hierarchical index over Gray-ordered fingerprints.

Equal fingerprints are joined first, with partial sums.  Two fingerprints at
distance 3 agree in one of four 16-bit blocks, so each is filed under its four
block values; a block value with more than ``BUCKET`` fingerprints is cut
further by blocks of its other bits, which loses no pair.  Each task sorts its
buckets by Gray rank and builds a tree: a node keeps the bits that all below it
share.  A search goes down level by level and adds up differing shared bits; a
group goes when the sum passes the distance, and a group whose remaining bits
cannot pass it is linked as one.  Only a spanning tree of the links leaves a
task, and Spark joins find the components.

Words: ``[^\\x20\\x09-\\x0D]+`` after A-Z to a-z; shingles of three words,
repeats included; fewer words make one shingle; no word (null, empty or white
texts) makes fingerprint 0.  Rows come out as they went in, repeated ones
included; a component is named by its least id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sourcemine.llm.common import stored
from sourcemine.llm.components import components

SHINGLE, DISTANCE, SEED = 3, 3, 42
BUCKET = 20_000  # fingerprints of one bucket before it is cut further
FANOUT = 8
FRONTIER = 400_000  # (search, node) pairs in hand at once
LEVELS = (64, 48, 36, 27)  # bits left to compare at each level of blocks


def fingerprint(text: str | None) -> int:
    """The fingerprint of one whole text, as an unsigned number."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -SHINGLE] + 1]).tolist()
    hashes = np.fromiter(
        [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())],
        dtype=np.uint64,
        count=len(starts),
    )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    over = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(over.view(np.uint64)[0])


@F.arrow_udf(LongType())
def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        found = np.array([fingerprint(text) for text in texts.to_pylist()], dtype=np.uint64)
        yield pa.array(found.view(np.int64))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of codes in Gray order: neighbours there differ in few bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each component of ``n`` nodes, from links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            return root


class GrayIndex:
    """Tree over codes that lie bucket by bucket in Gray order.

    Level 0 are groups of up to ``FANOUT`` codes of one bucket, each level above
    groups of as many nodes below; the last level has one node a bucket.
    """

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        self.codes = codes
        self.levels: list[dict[str, np.ndarray]] = []
        ones, zeros, owner = codes, ~codes, bucket
        low, high = np.arange(len(codes)), np.arange(1, len(codes) + 1)
        while True:
            new = np.concatenate([[True], owner[1:] != owner[:-1]])
            first = np.flatnonzero(new)
            inside = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
            start = np.flatnonzero(inside % FANOUT == 0)
            end = np.append(start[1:], len(owner))
            ones, zeros = np.bitwise_and.reduceat(ones, start), np.bitwise_and.reduceat(zeros, start)
            low, high, owner = low[start], high[end - 1], owner[start]
            self.levels.append(
                {"ones": ones, "shared": ones | zeros, "first": start, "last": end, "low": low, "high": high}
            )
            if (owner[1:] != owner[:-1]).all():
                break
        for above, below in zip(self.levels[1:], self.levels):
            # The bits a node shares beyond the node above it.
            parent = np.repeat(np.arange(len(above["first"])), above["last"] - above["first"])
            below["new"] = below["shared"] & ~above["shared"][parent]
        self.levels[-1]["new"] = self.levels[-1]["shared"]

    def links(self, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places whose links give the components of all pairs within
        ``distance`` in a bucket."""
        top = self.levels[-1]
        at = np.repeat(np.arange(len(top["low"])), top["high"] - top["low"])
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        stack = [
            (len(self.levels) - 1, np.arange(i, min(i + FRONTIER // FANOUT, len(at))), None, None)
            for i in range(0, len(at), FRONTIER // FANOUT)
        ]
        while stack:
            depth, who, node, so_far = stack.pop()
            if node is None:
                node, so_far = at[who], np.zeros(len(who), np.int64)
            level = self.levels[depth]
            # Pairs count once: the searcher lies before what it finds.
            ahead = level["high"][node] > who + 1
            who, node, so_far = who[ahead], node[ahead], so_far[ahead]
            differ = (self.codes[who] ^ level["ones"][node]) & level["new"][node]
            so_far = so_far + np.bitwise_count(differ)
            near = so_far <= distance
            who, node, so_far = who[near], node[near], so_far[near]
            if not len(who):
                continue
            # A group all of whose codes must lie within the distance.
            whole = so_far + 64 - np.bitwise_count(level["shared"][node]) <= distance
            whole &= level["low"][node] > who
            if whole.any():
                found.append(self._spread(who[whole], level["low"][node[whole]], level["high"][node[whole]]))
                who, node, so_far = who[~whole], node[~whole], so_far[~whole]
            first, last = level["first"][node], level["last"][node]
            each = last - first
            for part in self._parts(each):
                n = each[part]
                child = np.repeat(first[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                searcher = np.repeat(who[part], n)
                if depth:
                    stack.append((depth - 1, searcher, child, np.repeat(so_far[part], n)))
                    continue
                ok = child > searcher
                searcher, child = searcher[ok], child[ok]
                ok = np.bitwise_count(self.codes[searcher] ^ self.codes[child]) <= distance
                found.append((searcher[ok], child[ok]))
        a, b = (np.concatenate(x) for x in zip(*found))
        root = _roots(len(self.codes), a, b)
        tied = np.flatnonzero(root != np.arange(len(root)))
        return tied, root[tied]

    @staticmethod
    def _parts(each: np.ndarray) -> Iterator[slice]:
        step = FRONTIER // FANOUT
        for i in range(0, len(each), step):
            yield slice(i, i + step)

    @staticmethod
    def _spread(who: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = high - low
        return np.repeat(who, n), np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the buckets of one partition; rows come sorted by bucket."""

    def found(buckets: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(codes), buckets))
        buckets, codes = buckets[order], codes[order]
        u, v = GrayIndex(buckets, codes).links()
        signed = codes.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[u]), pa.array(signed[v])], ["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
        rows += batch.num_rows
        if rows >= 200_000:
            buckets, codes = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(buckets, buckets[-1]))  # the last bucket may go on
            if cut:
                yield found(buckets[:cut], codes[:cut])
            held, rows = [(buckets[cut:], codes[cut:])], len(codes) - cut
    if held:
        yield found(*(np.concatenate(x) for x in zip(*held)))


def _filed(rows: DataFrame, bits: int) -> DataFrame:
    """Each row under the values of four blocks of its ``bits`` remaining bits:
    the block leaves what remains to compare, the bucket keeps the way so far."""
    wide = bits // 4
    at = F.explode(F.array(*[F.lit(wide * i) for i in range(4)]))
    cut = rows.select("*", at.alias("shift"))
    value = F.expr(f"shiftrightunsigned(rest, shift) & {(1 << wide) - 1}L")
    low = F.expr("rest & (shiftleft(1L, shift) - 1L)")
    # The bits above the block move down next to those below it.
    high = F.expr(f"IF(shift + {wide} >= 64, 0L, shiftleft(shiftrightunsigned(rest, shift + {wide}), shift))")
    return cut.select(
        F.xxhash64("bucket", "shift", value).alias("bucket"), "code", low.bitwiseOR(high).alias("rest")
    )


def links(codes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """A spanning forest ``(u, v)`` of all pairs of distinct ``code`` values at
    distance ``DISTANCE`` or less.

    Buckets are named by a hash of their block values.  Two that share a name
    are searched as one; codes are compared whole, so that adds work, not links.
    """
    rows = codes.select(F.lit(0).cast("long").alias("bucket"), "code", F.col("code").alias("rest"))
    out = None
    for level, bits in enumerate(LEVELS):
        rows = _filed(rows, bits)
        large = None
        if level + 1 < len(LEVELS):
            rows = stored(rows, "filed")
            large = rows.groupBy("bucket").count().where(F.col("count") > bucket).select("bucket")
            large = stored(large, "large")
            if large.isEmpty():
                large = None
        small = rows if large is None else rows.join(large, "bucket", "left_anti")
        found = (
            small.select("bucket", "code")
            .repartition("bucket")
            .sortWithinPartitions("bucket")
            .mapInArrow(_search, "u bigint, v bigint")
        )
        out = found if out is None else out.union(found)
        if large is None:
            break
        rows = rows.join(large, "bucket", "left_semi")
    return out


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint (long), component_id`` for every row of ``docs``."""
    rows = stored(docs.select("doc_id", fingerprints("text").alias("code")), "fingerprints")
    codes = stored(rows.groupBy("code").agg(F.min("doc_id").alias("least")), "codes")
    roots = components(links(codes.select("code")))
    known = codes.join(roots.withColumnRenamed("u", "code"), "code", "left").select(
        "code", "least", F.coalesce("root", "code").alias("root")
    )
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    class_of = known.join(named, "root").select("code", "component_id")
    return rows.join(class_of, "code").select("doc_id", F.col("code").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Documents with the least id of their component; of rows that share that
    id, the one whose text comes first.  Rows without an id are compared by
    text only after those with one: a component without any id keeps one row."""
    marked = stored(docs.withColumn("_code", fingerprints("text")), "marked")
    codes = stored(marked.groupBy("_code").agg(F.min("doc_id").alias("least")), "codes")
    roots = components(links(codes.select(F.col("_code").alias("code"))))
    known = codes.join(roots.withColumnRenamed("u", "_code"), "_code", "left").select(
        "_code", "least", F.coalesce("root", "_code").alias("root")
    )
    # The winner of a component: least id, then least fingerprint.
    ranked = known.groupBy("root").agg(
        F.min(F.struct(F.col("least").isNull().alias("none"), "least", "_code")).alias("best")
    )
    winners = ranked.select(F.col("best._code").alias("_code"), F.col("best.least").alias("_least"))
    left = marked.join(winners, "_code").where(F.col("doc_id").eqNullSafe(F.col("_least")))
    # What is left of a component shares one id and one fingerprint.  Ids that
    # are unique leave one row; repeated rows are decided by text, by key only.
    columns = docs.columns
    placed = stored(left.withColumn("_row", F.monotonically_increasing_id()), "left")
    first = placed.groupBy("_code").agg(F.min(F.struct(F.xxhash64(*columns), "_row")).alias("f"))
    return placed.join(first.select(F.col("f._row").alias("_row")), "_row", "left_semi").select(*columns)
