"""Random graphs whose edges are drawn by distance or by module, without a scan of all pairs; sampled path lengths; orders by module."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import stored

from . import paths as R
from . import random_graphs as A
from .weights import ranked

#: Cells of a line that one row of work holds at most.
CELLS = 1 << 20


def _drawn(frames: Iterator[pd.DataFrame], until: float, seed: int) -> Iterator[pd.DataFrame]:
    """line, cell, at: the cells whose exponential time is below ``until``.

    Thin lines draw the points of a Poisson process, of which a cell's first one counts;
    lines that keep more than half of their cells draw a time for each.
    """
    for frame in frames:
        for line, start, cells, rate in zip(frame["line"], frame["start"], frame["cells"], frame["rate"], strict=True):
            rng = np.random.default_rng([seed, int(line) & 0xFFFFFFFF, int(line) >> 32 & 0xFFFFFFFF, int(start)])
            if rate * until > 0.7:
                at = rng.exponential(1 / rate, cells)
                cell = np.flatnonzero(at < until)
                at = at[cell]
            else:
                n = rng.poisson(cells * rate * until)
                cell, at = rng.integers(0, cells, n), rng.uniform(0, until, n)
                order = np.lexsort((at, cell))
                cell, at = cell[order], at[order]
                first = np.ones(n, bool)
                first[1:] = np.diff(cell) != 0
                cell, at = cell[first], at[first]
            yield pd.DataFrame({"line": np.full(len(cell), line, np.int64), "cell": cell.astype(np.int64) + start, "at": at})


def draw_cells(lines: DataFrame, k: int, until: float, seed: int = 1, max_rounds: int = 60) -> DataFrame:
    """line, cell of k different cells, drawn one after the other with chances in proportion to the rate of their line.

    lines: line, cells (how many), rate.  That is the order of exponential times; only those below a bound
    are generated, about as many as are wanted, and the bound grows if they are too few.
    """
    work = lines.where("rate > 0 AND cells > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1, F.lit(CELLS).cast("bigint"))))
    work = stored(work.select("line", "start", F.least(F.lit(CELLS), F.col("cells") - F.col("start")).cast("bigint").alias("cells"), "rate"), "lines")
    if k > (work.agg(F.sum("cells")).first()[0] or 0):
        raise ValueError(f"{k} cells are wanted, more than there are")
    parts = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(max_rounds):
        bound = until
        got = stored(work.repartition(parts, "line", "start").mapInPandas(lambda it, bound=bound: _drawn(it, bound, seed), "line bigint, cell bigint, at double"), "cells")
        if got.count() >= k:
            return ranked(got, [F.col("at"), F.col("line"), F.col("cell")]).where(F.col("rank") <= k).select("line", "cell")
        until *= 1.5
    raise RuntimeError("too few cells were drawn")


def _bound(cells: np.ndarray, rates: np.ndarray, k: int) -> float:
    """A time by which about k cells, and a margin, have had their turn."""
    wanted = min(k + 4 * math.sqrt(k) + 10, cells.sum() * (1 - 1e-6))
    lo, hi = 0.0, 1.0
    gone = lambda t: float((cells * -np.expm1(-rates * t)).sum())
    while gone(hi) < wanted and hi < 1e300:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gone(mid) < wanted else (lo, mid)
    return hi


def toeplitz_edges(nodes: DataFrame, k: int, spread: float, seed: int = 1) -> DataFrame:
    """src, dst, w = 1: k directed edges drawn with a normal fall-off by the distance of the nodes in order; no loops.

    The chance of a distance is the normal density around 0.5 with deviation ``spread``.  Pairs come by
    diagonal: distances beyond 38 deviations have no chance, so the work grows with the edges and with ``spread``.
    """
    v = stored(A._numbered(nodes), "nodes")
    n = v.count()
    d = np.arange(1, min(n - 1, int(0.5 + 38 * spread)) + 1, dtype=float)
    rate = np.exp(-0.5 * ((d - 0.5) / spread) ** 2)
    rate[rate < 1e-300] = 0
    if not len(d):
        raise ValueError("no two nodes are near enough")
    until = _bound(np.concatenate([n - d, n - d]) * (np.tile(rate, 2) > 0), np.tile(rate, 2), k)
    s = F.lit(float(spread))
    line = v.sparkSession.range(1, len(d) + 1).select(F.explode(F.array(F.col("id"), -F.col("id"))).alias("line"), (F.lit(n) - F.col("id")).alias("cells"), F.exp(-0.5 * F.pow((F.col("id") - 0.5) / s, F.lit(2))).alias("rate"))
    got = draw_cells(line, k, until, seed)
    # cell c of diagonal d is the pair (c, c + d), of diagonal -d the pair (c + d, c)
    e = got.select((F.col("cell") + F.greatest(F.lit(0), -F.col("line"))).alias("a"), (F.col("cell") + F.greatest(F.lit(0), F.col("line"))).alias("b"))
    return e.join(v.select(F.col("i").alias("a"), F.col("node").alias("src")), "a").join(v.select(F.col("i").alias("b"), F.col("node").alias("dst")), "b").select("src", "dst", F.lit(1.0).alias("w"))


def even_clusters(nodes: DataFrame, k: int, bits: int, seed: int = 1) -> DataFrame:
    """src, dst, w = 1: clusters of 2 ** bits nodes in order, complete, and what is left of k directed edges spread evenly between clusters.

    Too small a k gives the clusters only.
    """
    v = stored(A._numbered(nodes), "nodes")
    n, size = v.count(), 1 << bits
    own = v.select(F.col("i").alias("a"), F.floor(F.col("i") / size).cast("bigint").alias("c"))
    inside = own.join(own.select(F.col("a").alias("b"), "c"), "c").where("a <> b").select("a", "b")
    left = k - inside.count()
    e = inside
    if left > 0:
        # the cells of a row are the nodes of other clusters
        first = F.floor(F.col("i") / size).cast("bigint") * size
        width = F.least(F.lit(size), F.lit(n) - first)
        lines = v.select(F.col("i").alias("line"), (F.lit(n) - width).cast("bigint").alias("cells"), F.lit(1.0).alias("rate"))
        cells = n * n - (n // size) * size * size - (n % size) ** 2
        if left > cells:
            raise ValueError(f"{k} edges are wanted, more than there are pairs")
        got = draw_cells(lines, left, _bound(np.array([float(cells)]), np.array([1.0]), left), seed)
        begin = F.floor(F.col("line") / size).cast("bigint") * size
        b = F.when(F.col("cell") >= begin, F.col("cell") + F.least(F.lit(size), F.lit(n) - begin)).otherwise(F.col("cell"))
        e = e.unionByName(got.select(F.col("line").alias("a"), b.cast("bigint").alias("b")))
    return e.join(v.select(F.col("i").alias("a"), F.col("node").alias("src")), "a").join(v.select(F.col("i").alias("b"), F.col("node").alias("dst")), "b").select("src", "dst", F.lit(1.0).alias("w"))


def sample_size(q: float, delta: float, eps: float) -> int:
    """How many sources give a q-quantile of path lengths that errs by ``delta`` at most with probability 1 - ``eps``."""
    return math.ceil(2 / (q * q) * math.log(2 / eps) * (1 - delta) ** 2 / (delta * delta))


def sampled_path_length(edges: DataFrame, nodes: DataFrame, q: float = 0.5, delta: float = 0.15, eps: float = 0.05, seed: int = 1) -> DataFrame:
    """sources, median: the median of the mean distances from nodes to what they reach, themselves included.

    Sources are picked by hash, as many as the error bound asks for, all if there are fewer nodes.
    """
    s = sample_size(q, delta, eps)
    sources = stored(nodes.select("node").distinct().orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(s), "sources")
    mean = R.distance_sums(edges, sources).select("node", (F.col("total") / (F.col("n") + 1)).alias("m"))
    return sources.join(mean, "node", "left").agg(F.count(F.lit(1)).alias("sources"), F.median(F.coalesce("m", F.lit(0.0))).alias("median"))


def randomise(edges: DataFrame, nodes: DataFrame, alpha: float = 1.0, seed: int = 1, max_rounds: int = 100) -> DataFrame:
    """Mirrored edges (w = 1) of the same degrees, at least a share ``alpha`` of them new (or as many as exchanges of pairs gave when three rounds moved nothing more).

    A graph with more than half of all pairs is rewired in its missing pairs, which
    are then the fewer; in a dense graph few exchanges of edges are possible, but the same ones show there.
    """
    v = stored(nodes.select("node").distinct(), "nodes")
    e = stored(edges.where("src <> dst").select("src", "dst", F.lit(1.0).alias("w")).distinct(), "plain")
    n, m = v.count(), e.count()
    dense = 2 * m > n * (n - 1)
    swapped = (lambda x: stored(v.select(F.col("node").alias("src")).join(v.select(F.col("node").alias("dst")), F.col("src") != F.col("dst")).join(x, ["src", "dst"], "left_anti").select("src", "dst", F.lit(1.0).alias("w")), "missing")) if dense else (lambda x: x)
    start = now = swapped(e)
    wanted, moved, idle = alpha * start.count(), 0, 0
    for turn in range(max_rounds):
        if moved >= wanted or idle == 3:
            break
        now = stored(A.rewire(now, 1, seed + turn, directed=False), "randomised")
        new = now.join(start, ["src", "dst"], "left_anti").count()
        moved, idle = new, 0 if new > moved else idle + 1
    return swapped(now)


def module_order(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """node, comm, module, place: an order that brings dense modules together.

    Modules come by their mean weight to other modules, the strongest first; a
    node comes by its strength to the module before its own less that to the module behind.
    ``module`` and ``place`` count from 1.
    """
    size = parts.groupBy("comm").agg(F.count(F.lit(1)).alias("n"))
    p = lambda end, c: parts.select(F.col("node").alias(end), F.col("comm").alias(c))
    e = edges.where("src <> dst").join(p("src", "c1"), "src").join(p("dst", "c2"), "dst")
    between = e.where("c1 <> c2").groupBy("c1", "c2").agg(F.sum("w").alias("w"))
    sized = lambda c, k: size.select(F.col("comm").alias(c), F.col("n").alias(k))
    dense = between.join(sized("c1", "n1"), "c1").join(sized("c2", "n2"), "c2").groupBy(F.col("c1").alias("comm")).agg(F.round(F.sum(F.col("w") / (F.col("n1") * F.col("n2"))), 9).alias("x"))
    ordered = stored(ranked(size.join(dense, "comm", "left").select("comm", F.coalesce("x", F.lit(0.0)).alias("x")), [F.desc("x"), F.col("comm")]).select("comm", F.col("rank").alias("module")), "modules")
    m = lambda c, k: ordered.select(F.col("comm").alias(c), F.col("module").alias(k))
    lean = e.join(m("c1", "m1"), "c1").join(m("c2", "m2"), "c2").where(F.abs(F.col("m1") - F.col("m2")) == 1)
    lean = lean.groupBy(F.col("src").alias("node")).agg(F.round(F.sum(F.when(F.col("m2") < F.col("m1"), F.col("w")).otherwise(-F.col("w"))), 9).alias("lean"))
    rows = parts.join(ordered, "comm").join(lean, "node", "left").select("node", "comm", "module", F.coalesce("lean", F.lit(0.0)).alias("lean"))
    return ranked(rows, [F.col("module"), F.desc("lean"), F.col("node")]).select("node", "comm", "module", F.col("rank").alias("place"))


def edges_by_simrank(edges: DataFrame, nodes: DataFrame, r: float = 0.9) -> DataFrame:
    """src, dst, s, rank: the edges of a mirrored graph (once each) by the similarity of their ends, ties by the ends."""
    edges = stored(edges.select("src", "dst"), "edges")
    s = R.simrank(edges, nodes, r)
    e = edges.where("src < dst").select("src", "dst").join(s.select(F.col("a").alias("src"), F.col("b").alias("dst"), "s"), ["src", "dst"], "left")
    return ranked(e.select("src", "dst", F.coalesce("s", F.lit(0.0)).alias("s")), [F.desc("s"), F.col("src"), F.col("dst")])


def nested_modularity(edges: DataFrame, parts: DataFrame, seed: int = 1) -> DataFrame:
    """comm, communities, q: the best modularity inside each community; all are optimised together, the community being the run."""
    from . import optimisers as O
    from .partitions import induced_modules

    inner = stored(induced_modules(edges, parts).withColumnRenamed("comm", "run"), "inner")
    runs = stored(parts.select(F.col("comm").cast("bigint").alias("run"), "node"), "members")
    best = stored(O.best_of_runs(inner, runs, "modularity", 1.0, seed), "best")
    q = O._qualities(O._split(inner), O._sized(best), "modularity", 1.0)
    return best.groupBy("run").agg(F.count_distinct("comm").alias("communities")).join(q, "run", "left").select(F.col("run").alias("comm"), "communities", F.coalesce("quality", F.lit(0.0)).alias("q"))


def small_world(clustering: DataFrame, dist: DataFrame) -> DataFrame:
    """s: mean clustering over the mean distance of reachable pairs."""
    c = clustering.agg(F.avg("c").alias("c"))
    return c.join(F.broadcast(dist.where("src <> dst").agg(F.avg("d").alias("l")))).select(F.try_divide("c", "l").alias("s"))
