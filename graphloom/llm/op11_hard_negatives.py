"""Hard negatives by best-first search in packed R-trees.

Vectors are packed by sort-tile-recursive: Spark range-partitions them by their first
coordinates into tiles of bounded size, and inside a tile the rows are sorted and cut by
one coordinate after the other down to leaves.  Each node knows the least and the largest
value of every coordinate, which gives an interval that its inner products with an anchor
lie in.  A queue takes the node of the highest upper end first; nodes whose interval lies
outside of all score windows, or strictly below the kth score found in each of them, are left out.

Anchors are the stated query set: they are sent to all tiles in blocks of bounded size, one
pass for each block.  A task keeps its k best of each window over all its tiles, so that later
tiles are pruned by what earlier ones gave; the tasks' finds are merged by Spark.
A first search finds the positives (same label), a second one the negatives in the windows
that the positives' scores set.

In many dimensions boxes overlap and little is pruned: the search is then a scan of all
leaves for each anchor, anchors times rows.

Defined cases: rows with a null vec_id, a null label, a null vector, or a null or
non-finite component take no part; an empty vector is at score 0 with all; shorter
vectors count as if they ended in zeros; repeated rows are rows of their own, and "other" rows have
another vec_id; scores are 64-bit integers; equal scores are ordered by vec_id; an empty
table, or one without anchors, gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

#: Rows of a leaf, children of an inner node.
LEAF, FANOUT = 128, 8
#: Components of a tile and of a block of anchors, at most (about).
TILE, BLOCK = 1 << 20, 1 << 21
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Products below this are whole numbers in double precision.
EXACT = float(1 << 52)
TILES = "ids binary, labels binary, vectors binary, leaves binary, dim bigint"
FOUND = "key bigint, window int, id bigint, score bigint"
RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def usable(vectors: DataFrame, relabel: bool = False) -> DataFrame:
    """vec_id, label, v (whole-numbered components) of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.col("label").cast("bigint")
    if relabel:
        label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = C.clean(vectors, "vec_id", "embedding", "label").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), F.transform(x, lambda c: F.floor(256 * c.cast("double")).cast("bigint")).alias("v"))


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    out = np.zeros((len(column), dim), np.int64)
    at = column.offsets.to_numpy()
    size = np.diff(at)
    out[np.arange(dim) < size[:, None]] = column.values.to_numpy()[at[0] : at[-1]]
    return out


def packed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and offsets of the leaves, by sort-tile-recursive."""
    order, sizes = [], []
    todo = [(np.arange(len(v)), 0)]
    while todo:
        rows, axis = todo.pop()
        leaves = -(-len(rows) // LEAF)
        if leaves <= 1 or axis == v.shape[1]:
            for a in range(0, len(rows), LEAF):
                order.append(rows[a : a + LEAF])
                sizes.append(len(order[-1]))
            continue
        rows = rows[np.argsort(v[rows, axis], kind="stable")]
        slabs = math.ceil(leaves ** (1 / (v.shape[1] - axis)) - 1e-9)
        each = -(-leaves // slabs) * LEAF
        todo += [(rows[a : a + each], axis + 1) for a in reversed(range(0, len(rows), each))]
    return np.concatenate(order), np.cumsum([0, *sizes])


class Tree:
    """A packed tree: rows in leaf order, and the boxes of all levels from the leaves up."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, leaves: np.ndarray) -> None:
        self.ids, self.labels, self.v, self.leaves = ids, labels, v, leaves
        lo, hi = (f.reduceat(v, leaves[:-1], axis=0) for f in (np.minimum, np.maximum))
        self.boxes = [(lo, hi)]
        while len(lo) > 1:
            at = np.arange(0, len(lo), FANOUT)
            lo, hi = np.minimum.reduceat(lo, at, axis=0), np.maximum.reduceat(hi, at, axis=0)
            self.boxes.append((lo, hi))
        self.largest = float(np.abs(v).max(initial=0))

    def intervals(self, anchors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each level, the ends of the inner products' intervals: an anchor a row, a node a column."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        high = [up @ hi.T + down @ lo.T for lo, hi in self.boxes]
        low = [up @ lo.T + down @ hi.T for lo, hi in self.boxes]
        return low, high


class Windows:
    """The k best finds of one anchor in each of its score windows."""

    __slots__ = ("ceiling", "found", "hi", "k", "lo", "need")

    def __init__(self, windows: list[tuple[int, int]], k: int) -> None:
        self.lo, self.hi = [w[0] for w in windows], [w[1] for w in windows]
        self.k, self.need, self.ceiling = k, list(self.lo), max(self.hi, default=LEAST)
        self.found: list[list[tuple[int, int]]] = [[] for _ in windows]  # (-score, id), ascending

    def wanted(self, low: float, high: float) -> bool:
        """Whether a score of the interval could still be among the finds."""
        return any(high >= need and low <= hi for need, hi in zip(self.need, self.hi, strict=True))

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for w, (need, hi) in enumerate(zip(self.need, self.hi, strict=True)):
            at = np.flatnonzero((scores >= need) & (scores <= hi))
            if not len(at):
                continue
            if len(at) > self.k:
                at = at[np.lexsort((ids[at], -scores[at]))[: self.k]]
            held = sorted(self.found[w] + [(-int(s), int(i)) for s, i in zip(scores[at], ids[at], strict=True)])[: self.k]
            self.found[w] = held
            if len(held) == self.k:
                self.need[w] = -held[-1][0]


def search(tree: Tree, anchor: np.ndarray, low: list[np.ndarray], high: list[np.ndarray], wanted: Windows, mask: np.ndarray) -> int:
    """Best-first search for one anchor; low, high: its intervals by level; mask: rows that count.  Returns the leaves read."""
    top, read = len(low) - 1, 0
    heap = [(-high[top][0], top, 0)]
    while heap:
        bound, level, node = heapq.heappop(heap)
        if -bound < min(wanted.need):
            break
        if not wanted.wanted(low[level][node], -bound):
            continue
        if level:
            first = node * FANOUT
            for child in range(first, min(first + FANOUT, len(high[level - 1]))):
                heapq.heappush(heap, (-high[level - 1][child], level - 1, child))
            continue
        a, b = tree.leaves[node], tree.leaves[node + 1]
        scores = tree.v[a:b] @ anchor
        at = np.flatnonzero(mask[a:b] & (scores >= min(wanted.need)) & (scores <= wanted.ceiling))
        read += 1
        if len(at):
            wanted.offer(scores[at], tree.ids[a:b][at])
    return read


def _tile(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """One row for each tile: its packed tree.  A partition is cut where its rows are more than a tile."""
    most = tile_rows(dim)
    held, n = [], 0

    def tree() -> pa.RecordBatch:
        ids, labels, v = (np.concatenate(x) for x in zip(*held, strict=True))
        order, leaves = packed(v)
        cols = [ids[order], labels[order], v[order], leaves.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cols] + [pa.array([dim])], names=[x.split()[0] for x in TILES.split(", ")])

    for batch in batches:
        for a in range(0, batch.num_rows, most):
            part = batch.slice(a, most)
            held.append((part["vec_id"].to_numpy(), part["label"].to_numpy(), matrix(part["v"], dim)))
            n += part.num_rows
            if n >= most:
                yield tree()
                held, n = [], 0
    if n:
        yield tree()


def tile_rows(dim: int) -> int:
    return max(LEAF, TILE // max(dim, 1))


def _search(batches: Iterator[pa.RecordBatch], sent, same: bool, k: int) -> Iterator[pa.RecordBatch]:
    keys, ids, labels, v, windows = sent.value
    largest, state = float(np.abs(v).max(initial=0)), [Windows(w, k) for w in windows]
    for batch in batches:
        for row in batch.to_pylist():
            dim = row["dim"]
            get = lambda c: np.frombuffer(row[c], np.int64)  # noqa: B023, E731
            tree = Tree(get("ids"), get("labels"), get("vectors").reshape(-1, dim), get("leaves"))
            if tree.largest * largest * dim < EXACT:  # whole numbers all the way, and much faster
                tree.v = tree.v.astype(np.float64)
                tree.boxes = [(lo.astype(np.float64), hi.astype(np.float64)) for lo, hi in tree.boxes]
            for a in range(0, len(keys), 512):
                some = v[a : a + 512].astype(tree.v.dtype)
                low, high = tree.intervals(some)
                for i in range(len(some)):
                    mine = state[a + i]
                    if mine.found:
                        mask = (tree.labels == labels[a + i]) & (tree.ids != ids[a + i]) if same else tree.labels != labels[a + i]
                        search(tree, some[i], [x[i] for x in low], [x[i] for x in high], mine, mask)
    out = [(int(key), w, i, -s) for key, mine in zip(keys, state, strict=True) for w, held in enumerate(mine.found) for s, i in held]
    for a in range(0, len(out), 50_000):
        cols = zip(*out[a : a + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])


def best(tiles: DataFrame, anchors: DataFrame, dim: int, same: bool, k: int) -> DataFrame:
    """key, window, id, score, rank: the k best rows of each window.

    anchors: key, vec_id, label, v and windows (array of lo, hi); stored.
    """
    spark = tiles.sparkSession
    blocks = max(1, math.ceil(anchors.count() * max(dim, 1) / BLOCK))
    finds = []
    for b in range(blocks):
        rows = anchors.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        v = matrix(rows["v"].combine_chunks(), dim)
        windows = [[(x["lo"], x["hi"]) for x in w if x["lo"] <= x["hi"]] for w in rows["windows"].to_pylist()]
        sent = spark.sparkContext.broadcast((rows["key"].to_numpy(), rows["vec_id"].to_numpy(), rows["label"].to_numpy(), v, windows))
        finds.append(C.stored(tiles.mapInArrow(lambda it, sent=sent: _search(it, sent, same, k), FOUND), "finds"))
        sent.destroy()
    all_finds = spark.createDataFrame([], FOUND)
    for x in finds:
        all_finds = all_finds.unionByName(x)
    order = W.partitionBy("key", "window").orderBy(F.desc("score"), "id")
    return all_finds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, v.  Anchors are the rows whose vec_id is divisible by ``every``.
    A negative has ``least`` to ``most`` per cent of the positive's score.
    """
    spark = rows.sparkSession
    rows = C.stored(rows, "vectors")
    n, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    kinds = ("bigint", "bigint", "int", "bigint", "bigint", "bigint")
    dim = max(dim, 1)
    if not n:
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in zip(RESULT, kinds, strict=True)))
    slabs = rows.repartitionByRange(math.ceil(n / tile_rows(dim)), F.get("v", F.lit(0)), F.get("v", F.lit(1)), "vec_id")
    tiles = C.stored(slabs.mapInArrow(lambda it: _tile(it, dim), TILES), "tiles")
    anchors = rows.where(F.col("vec_id") % every == 0).withColumn("key", F.monotonically_increasing_id())
    anchors = C.stored(anchors, "anchors")
    open_ = F.array(F.struct(F.lit(LEAST).cast("bigint").alias("lo"), F.lit(MOST).alias("hi")))
    first = C.stored(best(tiles, anchors.withColumn("windows", open_), dim, True, positives), "positives")
    # positives of one anchor with the same score share a window
    lo = F.expr(f"CAST(ceil(CAST(score AS DECIMAL(20, 0)) * {least} / 100) AS BIGINT)")
    hi = F.expr(f"CAST(floor(CAST(score AS DECIMAL(20, 0)) * {most} / 100) AS BIGINT)")
    windows = first.select("key", lo.alias("lo"), hi.alias("hi"), "score").distinct().where("lo <= hi")
    windows = windows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "score"))).alias("windows"))
    wanted = C.stored(anchors.join(windows, "key"), "windows")
    second = best(tiles, wanted, dim, False, negatives).select("key", "window", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    named = wanted.select("key", F.col("vec_id").alias("anchor_id"), F.posexplode("windows").alias("window", "w")).select("key", "anchor_id", "window", F.col("w.score").alias("positive_score"))
    out = second.join(named, ["key", "window"]).join(first.select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["key", "positive_score"])
    return out.select(*RESULT)


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Contract digest: negatives of all anchors."""
    return mine(usable(C.table(spark, sf_dir, "embeddings"), relabel=True))


SQL = """
WITH r AS (
  SELECT row_number() OVER () AS k, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.k, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0
), p AS (
  SELECT k, anchor_id, id, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, id) AS n FROM s WHERE same AND id <> anchor_id
), q AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.k, p.n ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.k = p.k AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE p.n <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM q WHERE rank <= 5
"""
