"""Exact top-k inner products: norm-sorted vectors, partial sums in rotated space.

Components become integers, ``floor(256 * x)``.  The rotation is that of the
singular vectors of all vectors, from their summed products of components, so
that the first components carry most of a product.  Vectors are dealt out by
ranges of descending length and stored in blocks, queries in batches of ``QUERIES``:

1. The longest vectors, ``HEAD`` of them, give each query a first k-th score, in tasks
   over batches.
2. A join of batches and blocks keeps the pairs whose lengths can reach a k-th score of
   the batch; blocks meet blocks, and Spark deals the pairs out over all tasks at once.
   A side is broadcast only below Spark's threshold.
3. A task takes the blocks as they come.  A block whose longest vector cannot reach a
   query's k-th score by Cauchy-Schwarz is left out; otherwise the product of
   the first components plus the product of the remaining lengths decides, and
   only vectors that may still enter are multiplied in whole, as integers.
4. The best of all tasks meet in one window over queries.

Vectors that are null or hold null or non-finite components take no part.
Shorter vectors count as filled up with zeros.  Repeated rows are candidates
each; a query leaves out its own row only.  Fewer candidates than ``k`` give
fewer rows.  Scores are exact: products that may pass 2 ** 53 are worked in whole
numbers; one beyond 64 bits among the ``k`` best of a task ends the query.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourcemine.llm.common import stored
from sourcemine.storage import BATCH_SETTING, _settings

K = 5
HEAD = 4096
QUERIES = 256
STORED = 2048  # vectors of a stored block, searched ``BLOCK`` at a time
BLOCK = 512
BATCHES_KEPT = 32  # whose best rows a task holds before it sends them on
BLOCKS_PER_ARROW_BATCH = 8
EXACT = 2.0**53
FIRST = 16  # components of the partial sum
NO_ID = (1 << 63) - 1  # stands for a null id, which sorts last
SLACK = 1e-6  # relative; far above the rounding of a product of doubles


def integers(vectors: DataFrame) -> DataFrame:
    """``row, vec_id, whole`` (array of double that holds integers), stored."""
    scaled = F.transform("embedding", lambda x: F.lit(256.0) * x.cast("double"))
    # From 2 ** 53 on a double is whole, and floor() would stop at 64 bits.
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    fine = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", whole.alias("whole"))
    rows = rows.withColumn("vec_id", F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes] or [[]]).astype(int)] = flat
    return out


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors.  Each task sends ``width`` squared
    sums; Spark adds them up, and as many numbers reach the driver."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), width)
            total += x.T @ x
        i, j = np.divmod(np.arange(width * width), width)
        columns = [pa.array(i), pa.array(j), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "x"])

    sums = rows.select("whole").mapInArrow(products, "i bigint, j bigint, x double")
    gram = np.zeros((width, width))
    for r in sums.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        gram[r["i"], r["j"]] = r["x"]
    return np.linalg.eigh(gram)[1][:, ::-1]


class Block:
    """Vectors of similar length, longest first."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, turn: np.ndarray):
        norms = np.sqrt((x * x).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        self.rows, self.ids = rows[order], ids[order]
        self.x, self.norms = x[order], norms[order]
        turned = self.x @ turn
        self.first = turned[:, :FIRST]
        self.rest = np.sqrt((turned[:, FIRST:] ** 2).sum(axis=1))


def best_of(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best of each query among (query, id, row, score) columns, in order."""
    q, ids, rows, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((rows, ids, -score, q))
    who = q[order]
    first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
    order = order[place < k]
    return q[order], ids[order], rows[order], score[order]


class Batch:
    """Queries of one batch with their best candidates so far."""

    def __init__(self, asked: Block, k: int, least: np.ndarray | None = None):
        self.rows, self.ids, self.x, self.norms = asked.rows, asked.ids, asked.x, asked.norms
        self.first, self.rest, self.k = asked.first, asked.rest, k
        self.least = np.full(len(self.rows), -np.inf) if least is None else least.copy()
        nothing = np.zeros(0, np.int64)
        self.best = (nothing, nothing, nothing, np.zeros(0))
        self.whole: dict[int, list[tuple[int, int, int]]] = {}  # of products that doubles do not hold

    def search_whole(self, q: int, block: Block) -> None:
        """All products of a query and a block as whole numbers."""
        mine = [int(v) for v in self.x[q]]
        found = self.whole.setdefault(q, [])
        for row, i, other in zip(block.rows.tolist(), block.ids.tolist(), block.x.tolist()):
            if row != self.rows[q]:
                found.append((-sum(a * int(b) for a, b in zip(mine, other)), i, row))
        self.whole[q] = heapq.nsmallest(self.k, found)

    def search(self, block: Block) -> None:
        """Bring ``best`` and ``least`` (the k-th scores) up to date."""
        slack = SLACK * (1 + self.norms)
        reach = self.norms * block.norms[0]
        alive = np.flatnonzero(reach + slack * (1 + block.norms[0]) >= self.least)
        for q in alive[reach[alive] >= EXACT]:
            self.search_whole(int(q), block)
        alive = alive[reach[alive] < EXACT]
        found = [self.best]
        for at in range(0, len(alive), 256):
            q = alive[at : at + 256]
            bound = self.first[q] @ block.first.T + self.rest[q, None] * block.rest
            bound += slack[q, None] * (1 + block.norms)
            i, j = np.nonzero(bound >= self.least[q, None])
            if 8 * len(i) > bound.size:
                # Most may still enter: one product of matrices needs no copies.
                score = (self.x[q] @ block.x.T)[i, j]
                i = q[i]
            else:
                i = q[i]
                score = np.einsum("nd,nd->n", self.x[i], block.x[j])
            ok = (score >= self.least[i]) & (self.rows[i] != block.rows[j])
            i, j, score = i[ok], j[ok], score[ok]
            if len(i):
                found.append(best_of([(i, block.ids[j], block.rows[j], score)], self.k))
        if len(found) > 1:
            self.best = best_of(found, self.k)
            q, score = self.best[0], self.best[3]
            last = np.flatnonzero(np.bincount(q, minlength=len(self.rows)) == self.k)
            ends = np.searchsorted(q, last, side="right") - 1
            self.least[last] = np.maximum(self.least[last], score[ends])

    def found(self) -> pa.RecordBatch | None:
        q, ids, rows, score = self.best
        more = [(q, i, row, -score) for q, own in self.whole.items() for score, i, row in own]
        at = [*q.tolist(), *[m[0] for m in more]]
        columns = [self.rows[at].tolist(), self.ids[at].tolist(), [*rows.tolist(), *[m[2] for m in more]]]
        columns += [[*ids.tolist(), *[m[1] for m in more]], [*map(int, score.tolist()), *[m[3] for m in more]]]
        names = ["query_row", "query_id", "row", "vec_id", "score"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names) if at else None


def _packed(batches: Iterator[pa.RecordBatch], width: int, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows ``row, vec_id, whole`` by ``size`` in the order they come, as bytes."""
    waiting: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        rows = tuple(batch.column(i).to_numpy() for i in (0, 1))
        waiting.append((*rows, matrix(batch.column(2), width)))
        while sum(len(w[0]) for w in waiting) >= size:
            whole = [np.concatenate(part) for part in zip(*waiting)]
            yield tuple(part[:size] for part in whole)
            waiting = [tuple(part[size:] for part in whole)]
    if waiting and sum(len(w[0]) for w in waiting):
        yield tuple(np.concatenate(part) for part in zip(*waiting))


def blocks_of(rows: DataFrame, width: int, size: int, order: list) -> DataFrame:
    """``block, longest, rows, ids, vectors``: vectors by ranges of an order, in blocks."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "vec_id", "whole")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, x in _packed(batches, width, size):
            longest = float(np.sqrt((x * x).sum(axis=1)).max())
            columns = [[longest], [row.tobytes()], [ids.tobytes()], [x.tobytes()]]
            kinds = [pa.float64(), *[pa.binary()] * 3]
            names = ["longest", "rows", "ids", "vectors"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    found = dealt.mapInArrow(build, "longest double, rows binary, ids binary, vectors binary")
    return stored(found.withColumn("block", F.monotonically_increasing_id()), "by-norm")


def _arrays(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, ids = (np.frombuffer(row[n], np.int64) for n in ("rows", "ids"))
    return rows, ids, np.frombuffer(row["vectors"]).reshape(-1, width)


def _pieces(row: dict, width: int, turn: np.ndarray) -> list[Block]:
    rows, ids, x = _arrays(row, width)
    return [Block(rows[i : i + BLOCK], ids[i : i + BLOCK], x[i : i + BLOCK], turn) for i in range(0, len(rows), BLOCK)]


def top_k(spark: SparkSession, vectors: DataFrame, queries: str, k: int = K) -> DataFrame:
    """The ``k`` best candidates of each row of ``vectors`` that satisfies the
    SQL condition ``queries``; ties go to the smaller ``vec_id``, null last."""
    rows = integers(vectors)
    schema = "query_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint"
    width = rows.agg(F.max(F.size("whole"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = max(1, width)
    turn = rotation(rows, width)
    norm = F.sqrt(F.aggregate("whole", F.lit(0.0), lambda a, x: a + x * x))
    blocks = blocks_of(rows, width, STORED, [norm.desc(), F.col("row")])
    asked = rows.where(F.col("vec_id") != NO_ID).where(queries)
    batches = blocks_of(asked, width, QUERIES, [norm.desc(), F.col("row")])

    # The head: HEAD vectors in whole blocks, whatever the size of the table.
    first = blocks.orderBy(F.col("longest").desc(), "block").limit(HEAD // STORED)
    head = [_arrays(r, width) for r in first.collect()]
    shared = spark.sparkContext.broadcast((turn, head))

    def seed(arrows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, head = shared.value
        heads = [Block(*(part[i : i + BLOCK] for part in own), turn) for own in head for i in range(0, len(own[0]), BLOCK)]
        for arrow in arrows:
            least = []
            for row in arrow.to_pylist():
                batch = Batch(Block(*_arrays(row, width), turn), k)
                for block in heads:
                    batch.search(block)
                least.append(batch.least)
            ends = [pa.array([float(x.min()) for x in least]), pa.array([x.tobytes() for x in least], pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrow.columns, *ends], [*arrow.schema.names, "least", "each"])

    with _settings(spark, {BATCH_SETTING: BLOCKS_PER_ARROW_BATCH}):
        seeded = batches.select("block", "longest", "rows", "ids", "vectors").mapInArrow(
            seed, "block bigint, longest double, rows binary, ids binary, vectors binary, least double, each binary"
        )
        seeded = stored(seeded, "seeded")
    # By Cauchy-Schwarz no vector of such a block can enter for any query of the batch.
    asking = seeded.select([F.col(c).alias(f"q_{c}") for c in seeded.columns])
    reach = F.col("q_longest") * F.col("longest")
    slack = F.lit(SLACK) * (1 + F.col("q_longest")) * (1 + F.col("longest"))
    pairs = asking.join(blocks, reach + slack >= F.col("q_least"))

    def search(arrows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = shared.value[0]
        kept: OrderedDict[int, Batch] = OrderedDict()
        last: tuple[int, list[Block]] | None = None
        for arrow in arrows:
            for i in range(arrow.num_rows):
                row = {n: arrow.column(n)[i] for n in arrow.schema.names}
                number, block = row["q_block"].as_py(), row["block"].as_py()
                if last is None or last[0] != block:
                    last = block, _pieces({n: row[n].as_py() for n in ("rows", "ids", "vectors")}, width, turn)
                if number not in kept:
                    own = {n: row[f"q_{n}"].as_py() for n in ("rows", "ids", "vectors")}
                    kept[number] = Batch(Block(*_arrays(own, width), turn), k, np.frombuffer(row["q_each"].as_py()))
                kept.move_to_end(number)
                for part in last[1]:
                    kept[number].search(part)
                if len(kept) > BATCHES_KEPT and (out := kept.popitem(last=False)[1].found()):
                    yield out
        for batch in kept.values():
            if out := batch.found():
                yield out

    with _settings(spark, {BATCH_SETTING: BLOCKS_PER_ARROW_BATCH}):
        found = stored(pairs.mapInArrow(search, schema), "found")
    by = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return (
        found.withColumn("rank", F.row_number().over(by))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
    )
