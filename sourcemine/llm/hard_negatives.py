"""Hard negatives: exact windows of inner products over an STR-packed R-tree.

Components become integers, ``floor(256 * x)``.  For each anchor the ``positives``
best other rows of its label are found, and for each of those the ``negatives`` best
rows of another label whose score lies between ``low`` and ``high`` percent of the
positive's.  Higher scores come first, ties go to the smaller ``vec_id``, null last.

The tree: rows are dealt out by ranges of label and of the coordinate that varies
most, and tiled inside a range by that coordinate and the next ones (sort-tile-
recursive), labels apart where they are large enough.  ``LEAF`` rows make a leaf,
``FANOUT`` leaves a stored subtree; each has its minimum bounding box and range of
labels.  The product of an anchor with a box is an interval, the sum of one
interval for each coordinate.

The search: anchors travel in batches of ``BATCH`` neighbours, with a box of their
own.  A join of batches and subtrees keeps the pairs whose interval and labels can
give a result, so blocks meet blocks and Spark deals the pairs out; a side is
broadcast only below Spark's threshold.  A task walks each subtree best first for
each anchor: the queue gives the box with the highest possible score, boxes outside
all windows or strictly below the last score kept so far (or equal to it with larger
ids only) are left out, and leaves are multiplied in whole.  What the tasks keep, a
few rows an anchor, meets in one window over anchors.

Rows whose label, vector or any component is null or not finite take no part; nor do
rows with a null id as anchors.  Shorter vectors count as filled up with zeros.
Repeated rows are candidates each, an anchor leaves out its own row only and each of
its repetitions is an anchor too.  Fewer candidates give fewer rows; an anchor without
a positive gives none, nor does a positive below zero, whose window is empty.  Scores
are exact integers of any size; one beyond 64 bits that would be returned ends the
query.  Other columns are left out.
"""

from __future__ import annotations

import bisect
import heapq
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourcemine.llm.common import numbered, stored
from sourcemine.storage import BATCH_SETTING, _settings

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
LEAF, FANOUT = 128, 16
TILE = LEAF * FANOUT * 8  # rows that a task tiles at once
TILED = 3  # coordinates to tile by
BATCH = 256
BATCHES_KEPT = 32  # whose best rows a task holds before it sends them on
BLOCKS_PER_ARROW_BATCH = 4
NO_ID = (1 << 63) - 1  # stands for a null id, which sorts last
EXACT = 2.0**53
SLACK = 1e-9  # of the product of lengths; far above the rounding of a sum of doubles


def integers(vectors: DataFrame) -> DataFrame:
    """``row, vec_id, label, whole`` (doubles that hold integers, all of one width)."""
    scaled = F.transform("embedding", lambda x: F.lit(256.0) * x.cast("double"))
    # From 2 ** 53 on a double is whole, and floor() would stop at 64 bits.
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    fine = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    rows = vectors.where(F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        whole.alias("whole"),
    )
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "mined-vectors")


def widened(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn(
        "whole", F.concat("whole", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("whole")))
    )


def axes_of(rows: DataFrame, width: int) -> list[int]:
    """Coordinates by falling variance: two sums for each reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total += np.stack([x.sum(axis=0), (x * x).sum(axis=0), np.full(width, len(x))])
        columns = [pa.array(np.arange(width)), *map(pa.array, total)]
        yield pa.RecordBatch.from_arrays(columns, ["at", "s", "q", "n"])

    facts = rows.select("whole").mapInArrow(sums, "at bigint, s double, q double, n double")
    spread = F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")
    order = facts.groupBy("at").agg(spread.alias("spread")).orderBy(F.col("spread").desc(), "at")
    return [r["at"] for r in order.limit(TILED).collect()]


def tiles(x: np.ndarray, labels: np.ndarray, ids: np.ndarray, axes: list[int]) -> Iterator[np.ndarray]:
    """Places of the rows of each leaf, sort-tile-recursive; rows come by label."""

    def cut(places: np.ndarray, depth: int) -> Iterator[np.ndarray]:
        keys = (ids[places], *(x[places, a] for a in reversed(axes)), x[places, axes[depth]])
        places = places[np.lexsort(keys)]
        leaves = -(-len(places) // LEAF)
        if depth == len(axes) - 1 or leaves == 1:
            yield from (places[at : at + LEAF] for at in range(0, len(places), LEAF))
            return
        slabs = int(np.ceil(leaves ** (1 / (len(axes) - depth))))
        step = LEAF * -(-leaves // slabs)
        for at in range(0, len(places), step):
            yield from cut(places[at : at + step], depth + 1)

    runs = np.flatnonzero(np.append(True, labels[1:] != labels[:-1]))
    start = 0
    for end in [*runs[1:], len(labels)]:
        # Small labels share their leaves.
        if end - start >= LEAF or end == len(labels):
            yield from cut(np.arange(start, end), 0)
            start = end


def subtrees(rows: DataFrame, axes: list[int]) -> DataFrame:
    """The stored tree: one row a subtree, its box, and its leaves as bytes."""
    order = [F.col("label"), F.col("whole")[axes[0]], F.col("row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = (
        "low array<double>, high array<double>, length double, label_low bigint, label_high bigint, "
        "sizes binary, rows binary, ids binary, labels binary, vectors binary"
    )
    names = [part.strip().split()[0] for part in schema.split(",")]

    def packed(x, rows, ids, labels) -> Iterator[pa.RecordBatch]:
        leaves = list(tiles(x, labels, ids, axes))
        for at in range(0, len(leaves), FANOUT):
            own = leaves[at : at + FANOUT]
            places = np.concatenate(own)
            box, them = x[places], labels[places]
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "low": box.min(axis=0).tolist(),
                        "high": box.max(axis=0).tolist(),
                        "length": float(np.sqrt((box * box).sum(axis=1)).max()),
                        "label_low": int(them.min()),
                        "label_high": int(them.max()),
                        "sizes": np.array([len(p) for p in own], np.int64).tobytes(),
                        "rows": rows[places].tobytes(),
                        "ids": ids[places].tobytes(),
                        "labels": them.tobytes(),
                        "vectors": box.tobytes(),
                    }
                ],
                schema=pa.schema(
                    [(n, pa.list_(pa.float64())) for n in names[:2]]
                    + [("length", pa.float64()), ("label_low", pa.int64()), ("label_high", pa.int64())]
                    + [(n, pa.binary()) for n in names[5:]]
                ),
            )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            rows, ids, labels = (batch.column(i).to_numpy() for i in range(3))
            waiting.append((x.reshape(len(rows), -1), rows, ids, labels))
            if sum(len(w[1]) for w in waiting) >= TILE:
                whole = [np.concatenate(part) for part in zip(*waiting)]
                yield from packed(*(part[:TILE] for part in whole))
                waiting = [tuple(part[TILE:] for part in whole)]
        if waiting and len(whole := np.concatenate([w[1] for w in waiting])):
            yield from packed(*(np.concatenate(part) for part in zip(*waiting)))

    found = dealt.select("row", "vec_id", "label", "whole").mapInArrow(build, schema)
    return stored(found.withColumn("tree", F.monotonically_increasing_id()), "subtrees")


class Subtree:
    """Leaves of one stored row, with the box of each."""

    def __init__(self, row: dict, width: int):
        sizes = np.frombuffer(row["sizes"], np.int64)
        self.cuts = np.concatenate([[0], np.cumsum(sizes)])
        self.rows, self.ids, self.labels = (np.frombuffer(row[n], np.int64) for n in ("rows", "ids", "labels"))
        self.x = np.frombuffer(row["vectors"]).reshape(-1, width)
        starts = self.cuts[:-1]
        self.low, self.high = np.minimum.reduceat(self.x, starts), np.maximum.reduceat(self.x, starts)
        self.first_id = np.minimum.reduceat(self.ids, starts)
        self.label_low = np.minimum.reduceat(self.labels, starts)
        self.label_high = np.maximum.reduceat(self.labels, starts)
        self.length = row["length"]

    def intervals(self, q: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest product of each anchor with each leaf."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        low = up @ self.low.T + down @ self.high.T - slack[:, None]
        return low, up @ self.high.T + down @ self.low.T + slack[:, None]

    def scores(self, leaf: int, q: np.ndarray, exact: bool) -> np.ndarray:
        x = self.x[self.cuts[leaf] : self.cuts[leaf + 1]]
        if exact:
            return x @ q
        whole = [int(v) for v in q]
        return np.array([sum(int(a) * b for a, b in zip(row, whole)) for row in x.tolist()], object)


class Best:
    """The ``k`` best rows of a window of scores, as (-score, id, row)."""

    def __init__(self, k: int, low: int | float = float("-inf"), high: int | float = float("inf")):
        self.k, self.low, self.high = k, low, high
        self.kept: list[tuple[int, int, int]] = []

    def need(self) -> int | float:
        return -self.kept[-1][0] if len(self.kept) == self.k else self.low

    def closed_to(self, high: float, low: float, first_id: int) -> bool:
        """Whether no row of a box with this interval can enter."""
        if low > self.high or high < self.low:
            return True
        if len(self.kept) < self.k:
            return False
        last = self.kept[-1]
        return high < -last[0] or (high == -last[0] and first_id > last[1])

    def offer(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        fit = np.flatnonzero((scores >= self.need()) & (scores <= self.high))
        if len(fit) > 4 * self.k and scores.dtype != object:
            fit = fit[np.lexsort((rows[fit], ids[fit], -scores[fit]))[: self.k]]
        for i in fit:
            entry = (-int(scores[i]), int(ids[i]), int(rows[i]))
            if len(self.kept) < self.k:
                bisect.insort(self.kept, entry)
            elif entry < self.kept[-1]:
                bisect.insort(self.kept, entry)
                self.kept.pop()


class Anchors:
    """One batch of anchors with the windows that each of them fills."""

    def __init__(self, anchors: list[dict], k: int, alike: bool):
        self.x = np.array([a["whole"] for a in anchors], float)
        self.lengths = np.sqrt((self.x * self.x).sum(axis=1))
        self.rows = [a["row"] for a in anchors]
        self.labels = [a["label"] for a in anchors]
        self.alike = alike
        self.names = [a.get("windows") or [{}] for a in anchors]
        self.windows = [[Best(k, **w) for w in own] for own in self.names]

    def search(self, tree: Subtree) -> None:
        sizes = self.lengths * tree.length
        exact = sizes < EXACT
        lows, highs = tree.intervals(self.x, np.where(exact, 0.0, SLACK * sizes))
        for i, label in enumerate(self.labels):
            own = self.windows[i]
            if self.alike:
                may = (tree.label_low <= label) & (tree.label_high >= label)
            else:
                may = (tree.label_low != label) | (tree.label_high != label)
            queue = [(-highs[i, leaf], leaf) for leaf in np.flatnonzero(may).tolist()]
            heapq.heapify(queue)
            while queue:
                high, leaf = heapq.heappop(queue)
                facts = (-high, lows[i, leaf], int(tree.first_id[leaf]))
                open_to = [w for w in own if not w.closed_to(*facts)]
                if not open_to:
                    if all(-high < w.need() for w in own):
                        break  # best first: all further boxes are lower still
                    continue
                at = slice(tree.cuts[leaf], tree.cuts[leaf + 1])
                scores = tree.scores(leaf, self.x[i], bool(exact[i]))
                if self.alike:
                    take = (tree.labels[at] == label) & (tree.rows[at] != self.rows[i])
                else:
                    take = tree.labels[at] != label
                scores, ids, rows = scores[take], tree.ids[at][take], tree.rows[at][take]
                for window in open_to:
                    window.offer(scores, ids, rows)

    def found(self) -> pa.RecordBatch | None:
        out = [
            (self.rows[i], number, entry[2], entry[1], -entry[0])
            for i, own in enumerate(self.windows)
            for number, window in enumerate(own)
            for entry in window.kept
        ]
        names = ["anchor_row", "window", "row", "vec_id", "score"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names) if out else None


def product_interval() -> tuple[Column, Column]:
    """Lowest and highest product of any two vectors of the boxes of a batch
    (``q_low``, ``q_high``) and a subtree (``low``, ``high``)."""
    sides = F.arrays_zip("q_low", "q_high", "low", "high")

    def ends(s: Column) -> list[Column]:
        return [s[q] * s[b] for q in ("q_low", "q_high") for b in ("low", "high")]

    slack = F.lit(SLACK) * F.col("q_length") * F.col("length")
    lowest = F.aggregate(sides, F.lit(0.0), lambda a, s: a + F.least(*ends(s)))
    highest = F.aggregate(sides, F.lit(0.0), lambda a, s: a + F.greatest(*ends(s)))
    return lowest - slack, highest + slack


def batches_of(anchors: DataFrame) -> DataFrame:
    """Anchors (``row, label, whole, batch`` and more) by batch, with its box."""
    norm = F.sqrt(F.aggregate("whole", F.lit(0.0), lambda a, x: a + x * x))
    grouped = anchors.groupBy("batch").agg(
        F.collect_list(F.struct(*[c for c in anchors.columns if c != "batch"])).alias("anchors"),
        F.max(norm).alias("q_length"),
        F.min("label").alias("q_label_low"),
        F.max("label").alias("q_label_high"),
        *[f.alias(n) for f, n in _window_ends(anchors)],
    )
    vectors = F.transform("anchors", lambda a: a["whole"])

    def corner(pick) -> Column:
        return F.aggregate(vectors, vectors[0], lambda a, x: F.zip_with(a, x, pick))

    boxes = grouped.withColumn("q_low", corner(lambda a, b: F.least(a, b)))
    # Stored: the join would compute the boxes again for each pair.
    return stored(boxes.withColumn("q_high", corner(lambda a, b: F.greatest(a, b))), "batches")


def _window_ends(anchors: DataFrame) -> list[tuple[Column, str]]:
    if "windows" not in anchors.columns:
        return []
    return [
        (F.min(F.array_min(F.transform("windows", lambda w: w["low"]))), "least"),
        (F.max(F.array_max(F.transform("windows", lambda w: w["high"]))), "most"),
    ]


def searched(batches: DataFrame, trees: DataFrame, width: int, k: int, alike: bool) -> DataFrame:
    """The best ``k`` rows of each anchor and window: ``anchor_row, window, row, vec_id, score, rank``."""
    low, high = product_interval()
    if alike:
        meet = (F.col("label_low") <= F.col("q_label_high")) & (F.col("label_high") >= F.col("q_label_low"))
    else:
        one = (F.col("label_low") == F.col("label_high")) & (F.col("q_label_low") == F.col("q_label_high"))
        meet = ~(one & (F.col("label_low") == F.col("q_label_low")))
        meet &= (high >= F.col("least")) & (low <= F.col("most"))
    pairs = batches.join(trees, meet).select("batch", "anchors", "tree", *trees.drop("tree").columns)

    def search(arrows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, Anchors] = OrderedDict()
        last: tuple[int, Subtree] | None = None
        for arrow in arrows:
            for i in range(arrow.num_rows):
                batch, tree = (arrow.column(n)[i].as_py() for n in ("batch", "tree"))
                if last is None or last[0] != tree:
                    names = ("sizes", "rows", "ids", "labels", "vectors", "length")
                    last = tree, Subtree({n: arrow.column(n)[i].as_py() for n in names}, width)
                if batch not in kept:
                    kept[batch] = Anchors(arrow.column("anchors")[i].as_py(), k, alike)
                kept.move_to_end(batch)
                kept[batch].search(last[1])
                if len(kept) > BATCHES_KEPT and (out := kept.popitem(last=False)[1].found()):
                    yield out
        for anchors in kept.values():
            if out := anchors.found():
                yield out

    schema = "anchor_row bigint, window bigint, row bigint, vec_id bigint, score bigint"
    with _settings(batches.sparkSession, {BATCH_SETTING: BLOCKS_PER_ARROW_BATCH}):
        found = stored(pairs.mapInArrow(search, schema), "searched")
    by = Window.partitionBy("anchor_row", "window").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def mined(
    vectors: DataFrame,
    anchors: str,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` (``vec_id, embedding, label``) that
    satisfy the SQL condition ``anchors``.  See the head of the module."""
    spark = vectors.sparkSession
    schema = (
        "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
        "positive_score bigint, negative_score bigint"
    )
    rows = integers(vectors)
    width = rows.agg(F.max(F.size("whole"))).first()[0]
    if width is None:
        return spark.createDataFrame([], schema)
    width = max(1, width)
    rows = widened(rows, width)
    axes = axes_of(rows, width)
    trees = subtrees(rows, axes)
    asked = rows.where(F.col("vec_id") != NO_ID).where(anchors)
    order = [F.col("label"), F.col("whole")[axes[0]], F.col("row")]
    asked = numbered(asked, order, "anchors", name="place")
    asked = stored(asked.withColumn("batch", F.floor(F.col("place") / BATCH)).drop("place"), "asked")
    first = searched(batches_of(asked.drop("vec_id")), trees, width, positives, alike=True)
    first = stored(first.select("anchor_row", "rank", "vec_id", "score"), "positives")
    # 100 * score between low and high times the positive's, in whole numbers.
    wide = F.col("score").cast("decimal(20,0)")
    ends = first.select(
        "anchor_row",
        "rank",
        F.ceil(wide * low / 100).cast("long").alias("low"),
        F.floor(wide * high / 100).cast("long").alias("high"),
    )
    windows = ends.groupBy("anchor_row").agg(
        F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("windows")
    )
    windows = windows.withColumn("windows", F.transform("windows", lambda w: F.struct(w["low"], w["high"])))
    known = asked.drop("vec_id").join(windows, F.col("row") == F.col("anchor_row")).drop("anchor_row")
    second = searched(batches_of(known), trees, width, negatives, alike=False)
    positive = first.select(
        "anchor_row",
        (F.col("rank") - 1).cast("long").alias("window"),
        F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    named = asked.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return (
        second.join(positive, ["anchor_row", "window"])
        .join(named, "anchor_row")
        .select(
            "anchor_id",
            F.nullif("positive_id", F.lit(NO_ID)).alias("positive_id"),
            F.col("rank").cast("int").alias("rank"),
            F.nullif("vec_id", F.lit(NO_ID)).alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
