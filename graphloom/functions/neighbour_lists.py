"""Joins of neighbour lists inside tasks: wedges and counts of shared neighbours are made there and never shuffled.

Lists are dealt to cells of a grid of blocks.  What a cell holds in memory is bounded by
``ENTRIES``; a graph of more entries gets more blocks, and a list goes to as many cells
as there are blocks at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of lists that a task holds.
ENTRIES = 6 << 20
#: Wedges that a task looks at together, cells of a table of counts, and bits of the filter before the search.
WEDGES, COUNTS, FILTER_BITS = 1 << 21, 1 << 24, 24


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _lengths(column: pa.ListArray) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def _ranges(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range its index and its numbers, one after the other."""
    of = np.repeat(np.arange(len(length)), length)
    return of, np.arange(len(of)) + np.repeat(start - np.cumsum(length) + length, length)


def _pieces(length: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of ranges that hold about ``most`` numbers together."""
    ends = np.cumsum(length)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


class _Index:
    """Places of ids in a sorted array of all of them."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = np.unique(ids)

    def of(self, ids: np.ndarray) -> np.ndarray:
        """-1 where an id is not there."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)


class _Edges:
    """Edges b -> c that a task holds, with their weights."""

    def __init__(self, b: np.ndarray, c: np.ndarray, w: np.ndarray) -> None:
        self.starts, self.ends = _Index(b), _Index(c)
        key = self.starts.of(b) * len(self.ends.ids) + self.ends.of(c)
        order = np.argsort(key, kind="stable")
        self.key, self.w = key[order], w[order]
        self.there = np.zeros(1 << FILTER_BITS, bool)
        self.there[self._hash(self.key)] = True

    @staticmethod
    def _hash(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)

    def find(self, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs of places are edges, and where."""
        key = b * len(self.ends.ids) + c
        some = np.flatnonzero(self.there[self._hash(key)])
        at = np.minimum(np.searchsorted(self.key, key[some]), len(self.key) - 1)
        found = self.key[at] == key[some]
        return some[found], at[found]


def _closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triangles: lists of a cell that are its own (first) are edges b -> c, the others hold wedges a -> b, a -> c."""
    cell, own, edges = None, [], None
    names = ("a", "b", "c", "ka", "kb", "kc", "ab", "ac", "bc")
    for batch in batches:
        cells, query = batch.column("cell").to_numpy(), batch.column("query").to_numpy()
        cuts = np.flatnonzero(np.diff(cells) | np.diff(query)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(cells)], strict=True):
            part = batch.slice(lo, hi - lo)
            if cells[lo] != cell:
                cell, own, edges = cells[lo], [], None
            ids, ks, ws = (part.column(c) for c in ("ids", "ks", "ws"))
            node, n = part.column("node").to_numpy(), _lengths(ids)
            if not query[lo]:
                own.append((np.repeat(node, n), _flat(ids), _flat(ws)))
                continue
            if edges is None:
                if not own:
                    continue
                edges, own = _Edges(*(np.concatenate(x) for x in zip(*own, strict=True))), []
            # ends that no edge of the cell has are left out
            i, k, w = _flat(ids), _flat(ks), _flat(ws)
            row = np.repeat(np.arange(len(n)), n)
            b, c = edges.starts.of(i), edges.ends.of(i)
            keep = np.flatnonzero((b >= 0) | (c >= 0))
            i, k, w, row, b, c = i[keep], k[keep], w[keep], row[keep], b[keep], c[keep]
            last = np.searchsorted(row, row, "right")
            first = np.flatnonzero(b >= 0)
            length = last[first] - first - 1
            for piece in _pieces(length, WEDGES):
                of, to = _ranges(first[piece] + 1, length[piece])
                at = first[piece][of]
                real = c[to] >= 0
                at, to = at[real], to[real]
                hit, where = edges.find(b[at], c[to])
                if len(hit):
                    x, y = at[hit], to[hit]
                    a = row[x]
                    out = (node[a], i[x], i[y], part.column("k").to_numpy()[a], k[x], k[y], w[x], w[y], edges.w[where])
                    yield pa.RecordBatch.from_arrays([pa.array(o) for o in out], names=names)


def triangles(up: DataFrame, m: int) -> DataFrame:
    """a, b, c, the degrees ka, kb, kc and the weights ab, ac, bc of every triangle of m edges (src, dst, w, k1, k2) that point upward by (degree, id).

    A block of nodes holds their upward edges; a list of upward ends goes to each block that holds one of them.
    Blocks have several cells, which share the lists out.
    """
    tasks = _partitions(up)
    blocks = max(math.ceil(m / ENTRIES), min(math.isqrt(tasks), math.ceil(m / (1 << 16))), 1)
    shares = max(1, tasks // blocks) if m > 1 << 16 else 1
    lists = up.groupBy(F.col("src").alias("node")).agg(F.max("k1").alias("k"), F.sort_array(F.collect_list(F.struct("k2", "dst", "w"))).alias("x"))
    lists = lists.select("node", "k", F.col("x.dst").alias("ids"), F.col("x.k2").alias("ks"), F.col("x.w").alias("ws"))
    block = lambda x: F.pmod(F.xxhash64(x), F.lit(blocks)).cast("int")
    own = F.transform(F.sequence(F.lit(0), F.lit(shares - 1)), lambda s: F.struct((block("node") * shares + s).alias("cell"), F.lit(0).alias("query")))
    share = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(shares)).cast("int")
    # the last end of a list begins no wedge
    asked = F.transform(F.array_distinct(F.transform(F.slice("ids", 1, F.greatest(F.size("ids") - 1, F.lit(0))), block)), lambda b: F.struct((b * shares + share).alias("cell"), F.lit(1).alias("query")))
    dealt = lists.select(F.explode(F.concat(own, asked)).alias("to"), "node", "k", "ids", "ks", "ws").select("to.cell", "to.query", "node", "k", "ids", "ks", "ws")
    dealt = dealt.repartition(max(1, blocks * shares), "cell").sortWithinPartitions("cell", "query")
    kinds = dict(up.dtypes)
    ends = ", ".join(f"{c} {kinds['src']}" for c in "abc")
    return dealt.mapInArrow(_closing, f"{ends}, ka bigint, kb bigint, kc bigint, ab double, ac double, bc double")


def _tabled(of: np.ndarray, other: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs, and how often each occurs."""
    code = of * width + other
    if not len(code):
        return of, other, code
    size = int(of[-1] + 1) * width
    if size <= COUNTS and size <= 32 * len(code):
        n = np.bincount(code, minlength=size)
        code = np.flatnonzero(n)
        n = n[code]
    else:
        code, n = np.unique(code, return_counts=True)
    return code // width, code % width, n


def _sharing(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """x, y, n, kx, ky, tied of nodes that share neighbours, cell by cell: lists of one block against those of another."""
    cell, sides = None, ([], [])

    def done() -> Iterator[pa.RecordBatch]:
        if cell is None or not sides[0] or not (sides[1] or cell // blocks == cell % blocks):
            return
        one = [np.concatenate(x) for x in zip(*sides[0], strict=True)]
        two = one if cell // blocks == cell % blocks else [np.concatenate(x) for x in zip(*sides[1], strict=True)]
        yield from _shared(one, two, two is one)

    for batch in batches:
        cells, side = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
        cuts = np.flatnonzero(np.diff(cells) | np.diff(side)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(cells)], strict=True):
            if cells[lo] != cell:
                yield from done()
                cell, sides = cells[lo], ([], [])
            part = batch.slice(lo, hi - lo)
            ids = part.column("ids")
            sides[side[lo]].append((part.column("node").to_numpy(), _lengths(ids), _flat(ids)))
    yield from done()


def _shared(one: list[np.ndarray], two: list[np.ndarray], same: bool) -> Iterator[pa.RecordBatch]:
    (x, kx, xv), (y, ky, yv) = one, two
    via = _Index(yv)
    place = via.of(yv)
    order = np.argsort(place, kind="stable")
    member = np.repeat(np.arange(len(y)), ky)[order]
    count = np.bincount(place, minlength=len(via.ids))
    start = np.cumsum(count) - count
    # entries of x whose neighbour the other side has too, each with its members there
    row, at = np.repeat(np.arange(len(x)), kx), via.of(xv)
    inner, into = row[at >= 0], at[at >= 0]
    steps = np.bincount(inner, weights=count[into], minlength=len(x)).astype(np.int64)
    bounds = np.cumsum(np.bincount(inner, minlength=len(x)))
    tied_at = _Index(y)
    known = np.argsort(y, kind="stable")
    tied = tied_at.of(xv)
    tie = np.sort(row[tied >= 0] * len(y) + known[tied[tied >= 0]])
    for rows in _pieces(np.maximum(steps, 1), WEDGES):
        for lo in range(rows.start, rows.stop, max(1, COUNTS // len(y))):
            hi = min(rows.stop, lo + max(1, COUNTS // len(y)))
            e = slice(bounds[lo - 1] if lo else 0, bounds[hi - 1])
            of, to = _ranges(start[into[e]], count[into[e]])
            i, j, n = _tabled(inner[e][of] - lo, member[to], len(y))
            i = i + lo
            if same:
                other = i != j
                i, j, n = i[other], j[other], n[other]
            if not len(n):
                continue
            code = i * len(y) + j
            near = tie[np.minimum(np.searchsorted(tie, code), len(tie) - 1)] == code if len(tie) else np.zeros(len(code), bool)
            for part in (slice(p, p + WEDGES) for p in range(0, len(n), WEDGES)):
                a, b, c, t = i[part], j[part], n[part], near[part]
                for src, dst, p, q, k1, k2 in ((x, y, a, b, kx, ky),) if same else ((x, y, a, b, kx, ky), (y, x, b, a, ky, kx)):
                    out = (src[p], dst[q], c.astype(np.int64), k1[p].astype(np.int64), k2[q].astype(np.int64), t)
                    yield pa.RecordBatch.from_arrays([pa.array(o) for o in out], names=("x", "y", "n", "kx", "ky", "tied"))


def shared_neighbours(edges: DataFrame, m: int) -> DataFrame:
    """x, y, n, kx, ky, tied: ordered pairs of nodes that share n neighbours, their degrees, and whether an edge joins them.

    edges: m different (src, dst) without loops, both directions.  A cell compares the lists of two blocks of nodes.
    """
    tasks = _partitions(edges)
    blocks = max(1, math.ceil(2 * m / ENTRIES), math.isqrt(2 * tasks) if m > 1 << 14 else 1)
    lists = edges.groupBy(F.col("src").alias("node")).agg(F.collect_list("dst").alias("ids"))
    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    to = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.struct((F.least(own, b) * blocks + F.greatest(own, b)).alias("cell"), (own > b).cast("int").alias("side")))
    dealt = lists.select(F.explode(to).alias("to"), "node", "ids").select("to.cell", "to.side", "node", "ids")
    dealt = dealt.repartition(max(1, blocks * (blocks + 1) // 2), "cell").sortWithinPartitions("cell", "side")
    kind = dict(edges.dtypes)["src"]
    return dealt.mapInArrow(lambda it: _sharing(it, blocks), f"x {kind}, y {kind}, n bigint, kx bigint, ky bigint, tied boolean")
