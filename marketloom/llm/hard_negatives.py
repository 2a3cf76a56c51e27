"""Hard negatives by a multiway hyperplane tree (GNAT): exact searches in windows of scores.

The score is an inner product, which is no distance. Each row gets one more component that brings all rows to one length M, and
an anchor a zero there; then distance^2 = |anchor|^2 + M^2 - 2 * score, and a window of scores is an annulus around the anchor.

The tree's split points are chosen from a bounded sample of rows; every row goes down to the nearest split point at each node.
For each pair of siblings (i, j) a node stores the least and greatest distance from point i to the rows below j, over all rows.
A search drops j if, for any i, that range doesn't meet the distances that rows in the annulus can have from i. What is left
are leaves, whose rows are scored one by one in whole numbers, in blocks. Dropping is safe by the triangle inequality, with
SLACK for rounding, so results are exact whatever the sample; the sample decides only how much is dropped.

Three searches follow each other: an anchor's own leaf gives some positives and so a bound; the annulus of that bound gives the
positives; their windows give the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, partitions, release

#: Rows that the split points are chosen from, children of a node, levels: at most FANOUT ** LEVELS leaves.
SAMPLE, FANOUT, LEVELS = 4_096, 16, 2
#: Rows of a leaf and anchors in a block, about; both are dealt by a hash of the row.
BLOCK, ASKED = 1_024, 256
SLACK = 1e-9
EVERY = 100
#: Scores without a bound.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

Range = tuple[int, int, int, float, float]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of longs, shorter ones filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _extra(x: np.ndarray, longest: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0.0))])


def _far(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (points * points).sum(1) - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0.0))


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers: by doubles where they hold them, else by longs or numbers of any size."""
    most = float(np.abs(x).max(initial=0, where=x > LOWEST)) * float(np.abs(y).max(initial=0, where=y > LOWEST)) * max(1, x.shape[1])
    if (x > LOWEST).all() and (y > LOWEST).all():
        if most < 2**53:
            return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
        if most < 2**56:  # so that 100 times a score is a long
            return x @ y.T
    return x.astype(object) @ y.T.astype(object)


class Tree:
    """Split points by node; node 0 is the root, and a node's children have the numbers of `below`, or none where they are leaves."""

    def __init__(self, sample: np.ndarray, longest: float):
        self.longest, self.points, self.below, self.dim = longest, [], [], sample.shape[1]
        self._grow(_extra(sample, longest), LEVELS)

    def _grow(self, x: np.ndarray, levels: int) -> int:
        node = len(self.points)
        self.points.append(self._chosen(x))
        self.below.append([-1] * len(self.points[node]))
        nearest = _far(x, self.points[node]).argmin(1) if len(x) else np.empty(0, int)
        for i in range(len(self.points[node])):
            held = x[nearest == i]
            if levels > 1 and len(held) >= 2 * FANOUT:
                self.below[node][i] = self._grow(held, levels - 1)
        return node

    @staticmethod
    def _chosen(x: np.ndarray) -> np.ndarray:
        """Up to FANOUT rows, each the farthest from those before; equal rows are chosen once."""
        if not len(x):
            return np.zeros((1, x.shape[1]))
        chosen, far = [0], _far(x, x[:1])[:, 0]
        while len(chosen) < FANOUT and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _far(x, x[chosen[-1:]])[:, 0])
        return x[chosen]

    def down(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(node, child, which rows of x go there, their distances from the node's points), from the root to the leaves."""
        work = [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            far = _far(x[rows], self.points[node])
            nearest = far.argmin(1)
            for i in np.unique(nearest):
                here = nearest == i
                yield node, int(i), rows[here], far[here]
                if self.below[node][i] >= 0:
                    work.append((self.below[node][i], rows[here]))

    def leaf(self, node: int, child: int) -> int | None:
        return node * FANOUT + child if self.below[node][child] < 0 else None

    def ranges(self, x: np.ndarray) -> list[Range]:
        """(node, i, j, least, greatest distance) from point i to the rows of x that go below j."""
        return [
            (node, i, j, float(far[:, i].min()), float(far[:, i].max())) for node, j, _, far in self.down(_extra(x, self.longest)) for i in range(far.shape[1])
        ]


class Index:
    """A tree with the ranges over all rows. Children without rows are dropped by every search."""

    def __init__(self, tree: Tree, ranges: list[Range]):
        self.tree, self.least, self.greatest = tree, [], []
        for points in tree.points:
            self.least.append(np.full((len(points),) * 2, np.inf))
            self.greatest.append(np.full((len(points),) * 2, -np.inf))
        for node, i, j, low, high in ranges:
            self.least[node][i, j], self.greatest[node][i, j] = low, high

    def leaves(self, query: np.ndarray, windows: list[tuple[float, float]]) -> list[int]:
        """Leaves that may hold rows whose score lies in one of the windows, ends included."""
        q = np.append(query.astype(np.float64), 0.0)
        whole = q @ q + self.tree.longest
        slack = SLACK * max(whole, 1.0)
        rings = [(np.sqrt(max(0.0, whole - 2 * high - slack)), np.sqrt(max(0.0, whole - 2 * low + slack))) for low, high in windows if whole - 2 * low + slack >= 0]
        found, work, rim = [], [0], np.sqrt(slack)
        while work:
            node = work.pop()
            far = _far(q[None], self.tree.points[node])[0][:, None]
            keep = np.zeros(len(far), bool)
            for inner, outer in rings:
                low, high = np.maximum(far - outer, inner - far) - rim, far + outer + rim
                keep |= ((self.greatest[node] >= low) & (self.least[node] <= high)).all(0)
            for j in np.flatnonzero(keep):
                below = self.tree.below[node][j]
                work.append(below) if below >= 0 else found.append(node * FANOUT + int(j))
        return found

    def nearest(self, query: np.ndarray) -> int:
        """The leaf that the query itself falls in; of those with rows where that has none."""
        q, node = np.append(query.astype(np.float64), 0.0)[None], 0
        while True:
            far = np.where(np.isfinite(self.least[node]).all(0), _far(q, self.tree.points[node])[0], np.inf)
            child = int(far.argmin())
            if self.tree.below[node][child] < 0:
                return node * FANOUT + child
            node = self.tree.below[node][child]


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, v: rows that take part, labels noised (every seventh id has the next of ten), components floor(256 x)."""
    x = F.col(vector)
    whole = ~F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    rows = vectors.where(F.col(label).isNotNull() & x.isNotNull() & whole)
    moved = F.when(F.col(id_col) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), moved.cast("long").alias("label"), F.transform(x, lambda e: F.floor(F.lit(256.0) * e.cast("double"))).alias("v"))


def _indexed(rows: DataFrame) -> tuple[DataFrame, Index, dict[int, int]]:
    """Blocks (leaf, slice, ids, known, labels, v) of all rows, the index, and the number of slices of each leaf.

    To the driver come the sample, and a row for each leaf and for each pair of siblings: all bounded by the parameters.
    """
    spark = rows.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    dim, longest = rows.agg(F.max(F.size("v")), F.max(square)).first()
    dim = max(1, dim or 0)
    sample = rows.orderBy(F.xxhash64("at")).limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    tree = Tree(_matrix(sample, dim), float(longest or 0.0) * (1 + SLACK))

    def place(batches):
        for batch in batches:
            x = _extra(_matrix(batch.column("v"), dim), tree.longest)
            leaf = np.zeros(len(x), np.int32)
            for node, child, which, _ in tree.down(x):
                if tree.leaf(node, child) is not None:
                    leaf[which] = tree.leaf(node, child)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    placed = materialize(map_arrow(rows, place, "at long, vec_id long, label long, v array<long>, leaf int"), "placed")
    slices = {r.leaf: -(-r.n // BLOCK) for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    n = F.element_at(F.create_map(*[F.lit(x) for k, s in slices.items() for x in (k, s)]), F.col("leaf")) if slices else F.lit(1)
    dealt = placed.withColumn("slice", F.pmod(F.xxhash64("at"), n).cast("int")).repartition(max(8, 2 * partitions(spark)), "leaf", "slice")

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = lambda c: group.column(c).chunk(0)
        packed = [column("leaf")[:1], column("slice")[:1], column("at").to_numpy().tobytes(), column("vec_id").fill_null(HIGHEST).to_numpy().tobytes(),
                  np.asarray(column("vec_id").is_valid()).tobytes(), column("label").to_numpy().tobytes(), _matrix(column("v"), dim).tobytes()]
        return pa.table([x if isinstance(x, pa.Array) else pa.array([x], pa.binary()) for x in packed], names=["leaf", "slice", "ats", "ids", "known", "labels", "v"])

    types = "leaf int, slice int, ats binary, ids binary, known binary, labels binary, v binary"
    blocks = materialize(dealt.groupBy("leaf", "slice").applyInArrow(pack, types), "blocks")

    def measure(batches):
        for batch in batches:
            for v in batch.column("v").to_pylist():
                found = tree.ranges(np.frombuffer(v, np.int64).reshape(-1, dim))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["node", "i", "j", "low", "high"])

    ranges = map_arrow(blocks.select("v"), measure, "node long, i long, j long, low double, high double")
    ranges = ranges.groupBy("node", "i", "j").agg(F.min("low"), F.max("high")).collect()
    release(placed)
    return blocks, Index(tree, [tuple(r) for r in ranges]), slices


def _search(blocks: DataFrame, asked: DataFrame, slices: dict[int, int], chunks: int, dim: int, k: int, same: bool) -> DataFrame:
    """(at, nth, found, vec_id, score): for each row of asked and each of its windows, the k best rows in it.

    asked: at, label, v, windows (array of low and high), leaf. Candidates have the asked row's label, or another, and are not that row
    itself. A block of rows meets a block of anchors; each such pair sends on k rows of a window at most.
    """
    spark = blocks.sparkSession
    n = F.element_at(F.create_map(*[F.lit(x) for i, s in slices.items() for x in (i, s)]), F.col("leaf")) if slices else F.lit(1)
    dealt = asked.withColumn("chunk", F.pmod(F.xxhash64("at"), F.lit(chunks)).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = lambda c: group.column(c).chunk(0)
        windows = column("windows").to_pylist()
        ends = np.array([(w["nth"], w["low"], w["high"], row) for row, ws in enumerate(windows) for w in ws], np.int64).reshape(-1, 4)
        packed = [column("at").to_numpy().tobytes(), column("label").to_numpy().tobytes(), _matrix(column("v"), dim).tobytes(), ends.tobytes()]
        return pa.table([column("leaf")[:1], *[pa.array([x], pa.binary()) for x in packed]], names=["leaf", "q_at", "q_labels", "q_v", "ends"])

    queries = dealt.groupBy("leaf", "chunk").applyInArrow(pack, "leaf int, q_at binary, q_labels binary, q_v binary, ends binary")
    queries = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), n - 1)))
    # packed rows are larger than Spark takes them for, so they are never broadcast; each side moves once
    dealt_to = max(8, 4 * partitions(spark))
    pairs = blocks.repartition(dealt_to, "leaf", "slice").join(queries.repartition(dealt_to, "leaf", "slice").hint("merge"), ["leaf", "slice"])

    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ats, ids, known, labels = (np.frombuffer(row[c], t) for c, t in (("ats", np.int64), ("ids", np.int64), ("known", bool), ("labels", np.int64)))
                q_at, q_labels = np.frombuffer(row["q_at"], np.int64), np.frombuffer(row["q_labels"], np.int64)
                v, q = np.frombuffer(row["v"], np.int64).reshape(-1, dim), np.frombuffer(row["q_v"], np.int64).reshape(-1, dim)
                s, out = scores(q, v), []
                for nth, low, high, i in np.frombuffer(row["ends"], np.int64).reshape(-1, 4):
                    fits = ((labels == q_labels[i]) == same) & (s[i] >= low) & (s[i] <= high) & (ats != q_at[i])
                    hit = np.flatnonzero(fits)
                    if len(hit) > k and s.dtype != object:
                        least = np.partition(s[i][hit], len(hit) - k)[len(hit) - k]
                        hit = hit[s[i][hit] >= least]
                    order = sorted(hit, key=lambda h: (-int(s[i][h]), not known[h], ids[h], ats[h]))[:k]  # noqa: B023
                    out += [(int(q_at[i]), int(nth), int(ats[h]), int(ids[h]) if known[h] else None, max(LOWEST, min(HIGHEST, int(s[i][h])))) for h in order]
                if out:
                    names = ["at", "nth", "found", "vec_id", "score"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    found = map_arrow(pairs, score, "at long, nth long, found long, vec_id long, score long")
    best = Window.partitionBy("at", "nth").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "found")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def _visits(asked: DataFrame, index: Index, dim: int, own: bool) -> DataFrame:
    """asked (at, label, v, windows) with leaf: a row for each leaf that a window may have rows in, or for the nearest leaf alone."""
    def each(batches):
        for batch in batches:
            x, windows = _matrix(batch.column("v"), dim), batch.column("windows").to_pylist()
            found = [[index.nearest(q)] if own else index.leaves(q, [(w["low"], w["high"]) for w in ws]) for q, ws in zip(x, windows, strict=True)]
            rows = np.repeat(np.arange(len(x)), [len(f) for f in found])
            leaf = pa.array([i for f in found for i in f], pa.int32())
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, leaf], names=[*taken.schema.names, "leaf"])

    types = "at long, label long, v array<long>, windows array<struct<nth: long, low: long, high: long>>"
    return map_arrow(asked.select("at", "label", "v", "windows"), each, f"{types}, leaf int")


def _window(nth, low, high):
    return F.struct(nth.cast("long").alias("nth"), low.cast("long").alias("low"), high.cast("long").alias("high"))


def hard_negatives(vectors: DataFrame, k: int = 5, least_percent: int = 80, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives of each anchor's positives.

    Anchors are rows with an id divisible by EVERY; a positive is one of the k best other rows of the anchor's label; its negatives
    are the k best rows of other labels whose score is least_percent to 100 per cent of the positive's. Scores are inner products
    of components floor(256 x); higher ones come first, ties by smaller id, null ids last. Rows with a null label, a null vector or
    a component that is null or not finite take no part. Repeated ids are rows of their own, as anchors too. Shorter
    vectors are filled with zeros, components kept in the range of a long; scores beyond it are compared as they are and
    returned as its ends. A window below zero is empty. Other columns are ignored; an empty table gives an empty one.
    """
    rows = materialize(prepared(vectors, id_col, vector, label).withColumn("at", F.monotonically_increasing_id()).select("at", "vec_id", "label", "v"), "vectors")
    anchors = materialize(rows.where(F.col("vec_id") % EVERY == 0), "anchors")
    blocks, index, slices = _indexed(rows)
    dim, chunks = index.tree.dim, max(1, -(-anchors.count() // ASKED))
    everything = F.array(_window(F.lit(0), F.lit(LOWEST), F.lit(HIGHEST)))
    near = _search(blocks, _visits(anchors.withColumn("windows", everything), index, dim, True), slices, chunks, dim, k, True)
    # the k-th best of one leaf bounds the k-th best of all; with fewer there, any row may be among the best
    bound = near.groupBy("at").agg(F.when(F.count("*") == k, F.min("score")).alias("low"))
    asked = anchors.join(bound, "at", "left").withColumn("windows", F.array(_window(F.lit(0), F.coalesce("low", F.lit(LOWEST)), F.lit(HIGHEST)))).drop("low")
    asked = materialize(asked, "bounds")
    positives = materialize(_search(blocks, _visits(asked, index, dim, False), slices, chunks, dim, k, True), "positives")
    # least_percent * positive <= 100 * negative, as a whole number: rounded up
    low = -F.floor(-F.col("score").cast("decimal(20,0)") * least_percent / 100)
    windows = positives.where("score >= 0").groupBy("at").agg(F.collect_list(_window(F.col("place"), low, F.col("score"))).alias("windows"))  # k at most
    asked = materialize(anchors.join(windows, "at"), "windows")
    negatives = _search(blocks, _visits(asked, index, dim, False), slices, chunks, dim, k, False)
    negatives = negatives.select("at", F.col("nth").alias("place"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("place").cast("int").alias("rank"))
    names = anchors.select("at", F.col("vec_id").alias("anchor_id"))
    best = positives.select("at", F.col("place").cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(best, ["at", "place"]).join(names, "at").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
