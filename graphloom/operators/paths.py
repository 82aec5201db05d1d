"""Distances, reachability, cores and walks as fixpoint loops of DataFrame jobs.

Each loop step is a join and an aggregation; the frontier is written to the shared
folder, which cuts the lineage.  An absent row means unreachable.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.components import connected_components
from graphloom.plans.shared import stored

from .weights import ranked

#: Words of 64 sources that a row holds.
WORDS = 16


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def breadth_distances(edges: DataFrame, sources: DataFrame | None = None, max_steps: int = 1000) -> DataFrame:
    """src, dst, d: least number of edges; src = dst is the shortest closed walk.  sources (node): only from these."""
    e = edges.select("src", "dst").distinct()
    front = e if sources is None else e.join(sources.select(F.col("node").alias("src")), "src", "left_semi")
    layers = [stored(front.withColumn("d", F.lit(1).cast("bigint")), "reach")]
    seen = layers[0]
    for d in range(2, max_steps + 1):
        step = layers[-1].select("src", F.col("dst").alias("via")).join(e.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        new = stored(step.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("d", F.lit(d).cast("bigint")), "reach")
        if new.isEmpty():
            break
        layers.append(new)
        seen = _union(layers)
    else:
        raise RuntimeError("distances did not settle")
    return seen


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, i, n: in how many rows of the block bit i of its words is set."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        words = np.stack([c.to_numpy() for c in batch.columns[2:]], axis=1)
        for block in np.unique(blocks):
            some, n = words[blocks == block], np.zeros(64 * words.shape[1], np.int64)
            for lo in range(0, len(some), 1 << 12):
                n += np.unpackbits(np.ascontiguousarray(some[lo : lo + (1 << 12)].astype("<i8")).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            i = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), block)), pa.array(i), pa.array(n[i])], names=["block", "i", "n"])


def distance_sums(edges: DataFrame, sources: DataFrame, max_steps: int = 1000) -> DataFrame:
    """node, total, n: over the other nodes that a source reaches, the sum of distances and how many they are; sources that reach any.

    A node holds which sources have reached it as bits, a row for each block of sources,
    and passes on those that came in the step before: a step takes edges times blocks, not edges times sources.
    """
    e = stored(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    number = stored(ranked(sources.select("node").distinct(), [F.col("node")]).select("node", F.floor((F.col("rank") - 1) / (64 * WORDS)).alias("block"), F.pmod(F.col("rank") - 1, F.lit(64 * WORDS)).alias("i")), "numbers")
    names = [f"w{j}" for j in range(WORDS)]
    bit = F.expr("shiftleft(1L, CAST(pmod(i, 64) AS INT))")
    seen = front = stored(number.select("node", "block", *[F.when(F.floor(F.col("i") / 64) == j, bit).otherwise(F.lit(0).cast("bigint")).alias(w) for j, w in enumerate(names)]), "seen")
    layers = []
    for d in range(1, max_steps + 1):
        step = e.join(front.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node"), "block").agg(*[F.bit_or(w).alias(f"g_{w}") for w in names])
        got = step.join(seen, ["node", "block"], "left")
        new = got.select("node", "block", *[F.col(f"g_{w}").bitwiseAND(F.bitwise_not(F.coalesce(w, F.lit(0).cast("bigint")))).alias(w) for w in names])
        front = stored(new.where(" OR ".join(f"{w} <> 0" for w in names)), "front")
        if front.isEmpty():
            break
        layers.append(stored(front.mapInArrow(_counted, "block bigint, i bigint, n bigint").groupBy("block", "i").agg(F.sum("n").alias("n")).withColumn("d", F.lit(d).cast("bigint")), "layer"))
        seen = stored(seen.unionByName(front).groupBy("node", "block").agg(*[F.bit_or(w).alias(w) for w in names]), "seen")
    else:
        raise RuntimeError("distances did not settle")
    if not layers:
        return number.where("false").select("node", F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("n"))
    sums = _union(layers).groupBy("block", "i").agg(F.sum(F.col("d") * F.col("n")).alias("total"), F.sum("n").alias("n"))
    return number.join(sums, ["block", "i"]).select("node", "total", "n")


def distances(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, d of a binary graph, with 0 for a node and itself."""
    own = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("bigint").alias("d"))
    return breadth_distances(edges.where("src <> dst")).where("src <> dst").unionByName(own)


def breadth(edges: DataFrame, source: int) -> DataFrame:
    """node, d, parent from one source: the parent is the least node one step nearer; the source has -1."""
    spark = edges.sparkSession
    one = spark.createDataFrame([(source,)], "node bigint")
    d = breadth_distances(edges, one).where(F.col("dst") != source).select(F.col("dst").alias("node"), "d")
    all_ = d.unionByName(one.select("node", F.lit(0).cast("bigint").alias("d")))
    up = edges.select(F.col("src").alias("parent"), F.col("dst").alias("node")).join(all_.select(F.col("node").alias("parent"), (F.col("d") + 1).alias("d")), "parent")
    near = up.join(d, ["node", "d"]).groupBy("node").agg(F.min("parent").alias("parent"))
    return all_.join(near, "node", "left").select("node", "d", F.coalesce("parent", F.lit(-1)).alias("parent"))


def weighted_distances(lengths: DataFrame, nodes: DataFrame, max_steps: int = 1000) -> DataFrame:
    """src, dst, d, hops by repeated relaxation of the pairs that became shorter; ties take fewer hops."""
    e = lengths.where("src <> dst").select(F.col("src").alias("via"), "dst", F.col("w").alias("len"))
    front = stored(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("d"), F.lit(0).cast("bigint").alias("hops")), "dist")
    best = front
    for _ in range(max_steps):
        step = front.withColumnRenamed("dst", "via").join(e, "via").select("src", "dst", (F.col("d") + F.col("len")).alias("d"), (F.col("hops") + 1).alias("hops"))
        step = step.groupBy("src", "dst").agg(F.min(F.struct("d", "hops")).alias("new"))
        old = best.select("src", "dst", F.struct("d", "hops").alias("old"))
        front = stored(step.join(old, ["src", "dst"], "left").where("old IS NULL OR new < old").select("src", "dst", "new.d", "new.hops"), "front")
        if front.isEmpty():
            return best
        best = stored(best.join(front.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(front), "dist")
    raise RuntimeError("distances did not settle")


def path_summary(dist: DataFrame) -> DataFrame:
    """lambda, efficiency over reachable ordered pairs, radius and diameter of (src, dst, d)."""
    d = dist.where("src <> dst")
    ecc = d.groupBy("src").agg(F.max("d").alias("ecc")).agg(F.min("ecc").alias("radius"), F.max("ecc").alias("diameter"))
    return d.agg(F.avg("d").alias("lambda"), F.sum(1 / F.col("d")).alias("__inv")).join(ecc).select("lambda", "__inv", "radius", "diameter")


def eccentricity(dist: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, ecc: distance to the farthest node that can be reached; 0 if none can."""
    far = dist.groupBy(F.col("src").alias("node")).agg(F.max("d").alias("ecc"))
    return nodes.select("node").join(far, "node", "left").select("node", F.coalesce("ecc", F.lit(0)).alias("ecc"))


def charpath(dist: DataFrame, nodes: DataFrame) -> DataFrame:
    """lambda, efficiency, radius, diameter of distances that hold 0 for a node and itself.

    lambda is the mean over reachable pairs, each node with itself included; for the
    efficiency unreachable pairs count as 0.
    """
    ecc = eccentricity(dist, nodes).agg(F.min("ecc").alias("radius"), F.max("ecc").alias("diameter"), F.count(F.lit(1)).alias("n"))
    sums = dist.agg(F.avg("d").alias("lambda"), F.coalesce(F.sum(F.when(F.col("src") != F.col("dst"), 1 / F.col("d"))), F.lit(0.0)).alias("x"))
    e = F.coalesce(F.try_divide(F.col("x"), F.col("n") * (F.col("n") - 1)), F.lit(0.0))
    return sums.join(F.broadcast(ecc)).select("lambda", e.alias("efficiency"), "radius", "diameter")


def efficiency(dist: DataFrame, nodes: DataFrame) -> DataFrame:
    """e: mean of 1 / d over all ordered pairs, unreachable pairs counting as 0."""
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    return dist.where("src <> dst").agg(F.coalesce(F.sum(1 / F.col("d")), F.lit(0.0)).alias("x")).join(n).select(F.coalesce(F.try_divide(F.col("x"), F.col("n") * (F.col("n") - 1)), F.lit(0.0)).alias("e"))


def local_efficiency(edges: DataFrame, nodes: DataFrame, max_steps: int = 1000) -> DataFrame:
    """node, e: efficiency of the graph among each node's neighbours; one search, the node is a key."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    near = e.select(F.col("src").alias("ego"), F.col("dst").alias("node"))
    own = e.join(near.select("ego", F.col("node").alias("src")), "src").join(near.select("ego", F.col("node").alias("dst")), ["ego", "dst"]).select("ego", "src", "dst")
    own = stored(own, "ego")
    layers = [own.withColumn("d", F.lit(1).cast("bigint"))]
    for d in range(2, max_steps + 1):
        step = layers[-1].select("ego", "src", F.col("dst").alias("via")).join(own.select("ego", F.col("src").alias("via"), "dst"), ["ego", "via"]).where("src <> dst").select("ego", "src", "dst").distinct()
        new = stored(step.join(_union(layers).select("ego", "src", "dst"), ["ego", "src", "dst"], "left_anti").withColumn("d", F.lit(d).cast("bigint")), "ego")
        if new.isEmpty():
            break
        layers.append(new)
    else:
        raise RuntimeError("local distances did not settle")
    total = _union(layers).groupBy(F.col("ego").alias("node")).agg(F.sum(1 / F.col("d")).alias("x"))
    k = near.groupBy(F.col("ego").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    return nodes.select("node").join(k, "node", "left").join(total, "node", "left").select("node", F.coalesce(F.col("x") / F.when(F.col("k") > 1, F.col("k") * (F.col("k") - 1)), F.lit(0.0)).alias("e"))


def walks(edges: DataFrame, longest: int) -> DataFrame:
    """src, dst, q, n: number of walks of each length up to ``longest``."""
    e = edges.select("src", "dst")
    layers = [stored(e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).withColumn("q", F.lit(1)), "walks")]
    for q in range(2, longest + 1):
        step = layers[-1].select("src", F.col("dst").alias("via"), "n").join(e.select(F.col("src").alias("via"), "dst"), "via")
        layers.append(stored(step.groupBy("src", "dst").agg(F.sum("n").alias("n")).withColumn("q", F.lit(q)), "walks"))
    return _union(layers).select("src", "dst", "q", "n")


def simple_paths(edges: DataFrame, sources: DataFrame, longest: int) -> DataFrame:
    """src, dst, q, n: number of paths without repeated nodes; a path may close at its source, and ends there."""
    e = edges.where("src <> dst").select(F.col("src").alias("via"), F.col("dst").alias("to"))
    path = sources.select(F.array("node").alias("path"))
    out = []
    for q in range(1, longest + 1):
        last = F.element_at("path", -1)
        path = path.withColumn("via", last).join(e, "via").where((F.col("to") == F.element_at("path", 1)) | ~F.array_contains("path", F.col("to")))
        path = stored(path.select(F.concat("path", F.array("to")).alias("path")), "paths")
        out.append(path.select(F.element_at("path", 1).alias("src"), F.element_at("path", -1).alias("dst"), F.lit(q).alias("q")))
        path = path.where(F.element_at("path", 1) != F.element_at("path", -1))
    return _union(out).groupBy("src", "dst", "q").agg(F.count(F.lit(1)).alias("n"))


def cycle_probability(paths: DataFrame) -> DataFrame:
    """q, fcyc, pcyc: share of paths of length q that close, and probability that a path of length q - 1 closes in one step."""
    by = paths.groupBy("q").agg(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0)).alias("c"), F.sum("n").alias("n"))
    before = by.select((F.col("q") + 1).alias("q"), (F.col("n") - F.col("c")).alias("open"))
    return by.join(before, "q", "left").select("q", F.try_divide("c", "n").alias("fcyc"), F.coalesce(F.try_divide("c", "open"), F.lit(0.0)).alias("pcyc"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, comp (least node), size of undirected components; nodes without edges are their own."""
    c = nodes.select("node").join(connected_components(edges), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return c.join(c.groupBy("comp").agg(F.count(F.lit(1)).alias("size")), "comp").select("node", "comp", "size")


def _peeled(edges: DataFrame, k: float, weighted: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Edges of the core, and the nodes that each round took away."""
    left, rounds = stored(edges.where("src <> dst").select("src", "dst", "w"), "core"), []
    symmetric = left.select("src", "dst").exceptAll(left.select("dst", "src")).isEmpty()
    while True:
        x = F.sum("w") if weighted else F.count(F.lit(1)).cast("double")
        ends = left.select(F.col("src").alias("node"), "w")
        if not symmetric:
            ends = ends.unionByName(left.select(F.col("dst").alias("node"), "w"))
        weak = stored(ends.groupBy("node").agg(x.alias("x")).where(F.col("x") < k).select("node"), "weak")
        if weak.isEmpty():
            return left, rounds
        rounds.append(weak)
        left = stored(left.join(weak.withColumnRenamed("node", "src"), "src", "left_anti").join(weak.withColumnRenamed("node", "dst"), "dst", "left_anti"), "core")


def core(edges: DataFrame, nodes: DataFrame, k: float, weighted: bool = False) -> DataFrame:
    """Edges of the largest subgraph in which every node's degree (strength) is k or more; for directed edges both kinds count."""
    return _peeled(edges, k, weighted)[0]


def peel_levels(edges: DataFrame, nodes: DataFrame, k: float, weighted: bool = False) -> DataFrame:
    """node, level: the round, from 1, that takes the node away on the way to the core; 0 for its nodes, null for nodes without edges."""
    left, rounds = _peeled(edges, k, weighted)
    at = [weak.select("node", F.lit(i).cast("bigint").alias("level")) for i, weak in enumerate(rounds, 1)]
    kept = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
    return nodes.select("node").join(_union([kept.select("node", F.lit(0).cast("bigint").alias("level")), *at]), "node", "left")


def coreness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, core: the largest k whose core holds the node.

    From the degrees on, every node takes the largest h such that h neighbours hold h or
    more, until nothing changes; values only fall, so that comes to an end.
    """
    e = stored(edges.where("src <> dst").select("src", "dst").distinct(), "plain")
    now = stored(e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("core")), "core")
    while True:
        near = e.join(now.select(F.col("node").alias("dst"), "core"), "dst")
        # neighbours of equal value count together, so that a hub has a row for each value
        many = near.groupBy(F.col("src").alias("node"), "core").agg(F.count(F.lit(1)).alias("n"))
        upto = many.withColumn("n", F.sum("n").over(W.partitionBy("node").orderBy(F.desc("core"))))
        new = upto.groupBy("node").agg(F.max(F.least("core", "n")).alias("new"))
        step = stored(now.join(new, "node").select("node", F.least("core", "new").alias("core"), (F.col("new") < F.col("core")).alias("fell")), "core")
        if step.where("fell").isEmpty():
            return nodes.select("node").join(step, "node", "left").select("node", F.coalesce("core", F.lit(0).cast("bigint")).alias("core"))
        now = step.select("node", "core")


def simrank(edges: DataFrame, nodes: DataFrame, r: float = 0.9, eps: float = 1e-4, max_steps: int = 100) -> DataFrame:
    """a, b, s: similarity of nodes whose neighbours are similar, to a fixpoint; s(a, a) = 1, pairs at 0 are absent."""
    e = stored(edges.where("src <> dst").select("src", "dst"), "edges")
    k = stored(e.groupBy("src").agg(F.count(F.lit(1)).alias("k")), "degrees")
    own = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("s"))
    s = stored(own, "simrank")
    for _ in range(max_steps):
        one = s.join(e.select(F.col("src").alias("x"), F.col("dst").alias("a")), "a").groupBy("x", "b").agg(F.sum("s").alias("s"))
        two = one.join(e.select(F.col("src").alias("y"), F.col("dst").alias("b")), "b").where("x <> y").groupBy("x", "y").agg(F.sum("s").alias("s"))
        new = two.join(k.select(F.col("src").alias("x"), F.col("k").alias("kx")), "x").join(k.select(F.col("src").alias("y"), F.col("k").alias("ky")), "y")
        new = stored(new.select(F.col("x").alias("a"), F.col("y").alias("b"), (r * F.col("s") / (F.col("kx") * F.col("ky"))).alias("s")).unionByName(own), "simrank")
        gap = new.join(s.withColumnRenamed("s", "old"), ["a", "b"], "full").agg(F.max(F.abs(F.coalesce("s", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        s = new
        if gap < eps:
            return s
    raise RuntimeError("no fixpoint of the similarities within max_steps")


def pagerank(edges: DataFrame, nodes: DataFrame, d: float, teleport: DataFrame | None = None, eps: float = 1e-13, max_steps: int = 500) -> DataFrame:
    """node, r with sum 1 of r = d A D^-1 r + (1 - d) f, where D holds column sums; teleport (node, f) replaces the even f."""
    out = edges.groupBy("dst").agg(F.sum("w").alias("s"))
    p = stored(edges.join(out, "dst").select(F.col("dst").alias("of"), F.col("src").alias("node"), (F.col("w") / F.col("s")).alias("p")), "links")
    f = nodes.join(nodes.agg((1.0 / F.count(F.lit(1))).alias("f"))).select("node", "f") if teleport is None else teleport.join(teleport.agg(F.sum("f").alias("t"))).select("node", (F.col("f") / F.col("t")).alias("f"))
    f = stored(nodes.select("node").join(f, "node", "left").select("node", F.coalesce("f", F.lit(0.0)).alias("f")), "teleport")
    r = f.withColumnRenamed("f", "r")
    for _ in range(max_steps):
        got = p.join(r.withColumnRenamed("node", "of"), "of").groupBy("node").agg(F.sum(F.col("p") * F.col("r")).alias("x"))
        new = stored(f.join(got, "node", "left").select("node", (d * F.coalesce("x", F.lit(0.0)) + (1 - d) * F.col("f")).alias("r")), "rank")
        gap = new.join(r.withColumnRenamed("r", "old"), "node").agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0]
        r = new
        if gap < eps:
            break
    else:
        raise RuntimeError("the ranks did not settle within max_steps")
    return r.join(r.agg(F.sum("r").alias("t"))).select("node", (F.col("r") / F.col("t")).alias("r"))


def eigenvector(edges: DataFrame, nodes: DataFrame, eps: float = 1e-12, max_steps: int = 1000) -> DataFrame:
    """node, v: eigenvector of the largest eigenvalue of a mirrored graph, of length 1, by power iteration on A + I."""
    edges = stored(edges.select("src", "dst", "w"), "edges")
    v = stored(nodes.join(nodes.agg((1 / F.sqrt(F.count(F.lit(1)))).alias("v"))).select("node", "v"), "vector")
    for _ in range(max_steps):
        got = edges.select("src", F.col("dst").alias("node"), "w").join(v, "node").groupBy("src").agg(F.sum(F.col("w") * F.col("v")).alias("x"))
        x = v.join(got.withColumnRenamed("src", "node"), "node", "left").select("node", (F.col("v") + F.coalesce("x", F.lit(0.0))).alias("x"), F.col("v").alias("old"))
        x = stored(x, "vector")
        new = stored(x.join(x.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("t"))).select("node", (F.col("x") / F.col("t")).alias("v"), "old"), "vector")
        gap = new.agg(F.max(F.abs(F.col("v") - F.col("old")))).first()[0]
        v = new.select("node", "v")
        if gap < eps:
            return v
    raise RuntimeError("the vector did not settle within max_steps")


def betweenness(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, b) and (src, dst, b) of a binary graph: dependencies over all ordered pairs, by layers from all sources at once."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    layers = [stored(nodes.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("n")), "layer")]
    seen = layers[0].select("s", "node")
    while True:
        step = layers[-1].join(e.select(F.col("src").alias("node"), F.col("dst").alias("to")), "node").groupBy("s", F.col("to").alias("node")).agg(F.sum("n").alias("n"))
        new = stored(step.join(seen, ["s", "node"], "left_anti"), "layer")
        if new.isEmpty():
            break
        layers.append(new)
        seen = _union([x.select("s", "node") for x in layers])
    dep, by_edge = None, []
    for depth in range(len(layers) - 1, 0, -1):
        below = layers[depth]
        below = below.withColumn("dep", F.lit(0.0)) if dep is None else below.join(dep, ["s", "node"], "left").withColumn("dep", F.coalesce("dep", F.lit(0.0)))
        up = layers[depth - 1].select("s", F.col("node").alias("src"), F.col("n").alias("n_up"))
        flow = below.withColumnRenamed("node", "dst").join(e, "dst").join(up, ["s", "src"]).select("s", "src", "dst", (F.col("n_up") / F.col("n") * (1 + F.col("dep"))).alias("x"))
        flow = stored(flow, "flow")
        by_edge.append(flow)
        dep = stored(flow.groupBy("s", F.col("src").alias("node")).agg(F.sum("x").alias("dep")), "dep")
    flow = _union(by_edge)
    node = flow.where("s <> src").groupBy(F.col("src").alias("node")).agg(F.sum("x").alias("b"))
    return nodes.select("node").join(node, "node", "left").select("node", F.coalesce("b", F.lit(0.0)).alias("b")), flow.groupBy("src", "dst").agg(F.sum("x").alias("b"))


def efficiency_weighted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """e: mean of 1 / d over all ordered pairs, where an edge is as long as the inverse of its weight."""
    return efficiency(weighted_distances(edges.where("w <> 0").select("src", "dst", (1 / F.col("w")).alias("w")), nodes), nodes)


def local_efficiency_weighted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, e: over ordered pairs of a node's neighbours, the cube root of both weights and 1 / d among the neighbours.

    Nodes at either end of an edge are neighbours; a neighbour by edges both ways has the
    sum of both roots and counts twice, so a mirrored graph gives what each edge alone would.
    """
    e = edges.where("src <> dst AND w <> 0").select("src", "dst", "w")
    ways = e.select(F.col("src").alias("ego"), F.col("dst").alias("x"), "w").unionByName(e.select(F.col("dst").alias("ego"), F.col("src").alias("x"), "w"))
    near = stored(ways.groupBy("ego", "x").agg(F.sum(F.cbrt("w")).alias("c"), F.count(F.lit(1)).alias("a")), "near")
    at = lambda c: F.struct("ego", F.col(c).alias("at"))  # noqa: E731  a node of the graph around ego
    own = e.join(near.select("ego", F.col("x").alias("src")), "src").join(near.select("ego", F.col("x").alias("dst")), ["ego", "dst"])
    own = own.select(at("src").alias("src"), at("dst").alias("dst"), (1 / F.col("w")).alias("w"))
    d = weighted_distances(stored(own, "ego"), near.select(at("x").alias("node"))).where("src.at <> dst.at")
    c = lambda end: near.select(at("x").alias(end), F.col("c").alias(f"c_{end}"))
    total = d.join(c("src"), "src").join(c("dst"), "dst").groupBy(F.col("src.ego").alias("node")).agg(F.sum(F.col("c_src") * F.col("c_dst") * F.cbrt(1 / F.col("d"))).alias("x"))
    k = near.groupBy(F.col("ego").alias("node")).agg((F.sum("a") * F.sum("a") - F.sum(F.col("a") * F.col("a"))).alias("k"))
    return nodes.select("node").join(k, "node", "left").join(total, "node", "left").select("node", F.coalesce(F.try_divide("x", "k"), F.lit(0.0)).alias("e"))


def betweenness_weighted(lengths: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, b) and (src, dst, b) over all ordered pairs, by the shortest paths of edges with lengths, from all sources at once.

    The edges on shortest paths of a source have no cycle; a node's turn comes when
    all its predecessors have had theirs, and in reverse order on the way back.
    """
    e = lengths.where("src <> dst").select("src", "dst", F.col("w").alias("len"))
    d = weighted_distances(lengths, nodes)
    of = lambda c: d.select(F.col("src").alias("s"), F.col("dst").alias(c), F.col("d").alias(f"d_{c}"))
    tight = stored(e.join(of("src"), "src").join(of("dst"), ["s", "dst"]).where("d_src + len = d_dst").select("s", "src", "dst"), "tight")
    wanted = tight.groupBy("s", "dst").agg(F.count(F.lit(1)).alias("wanted"))
    layers, arrived = [stored(nodes.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("n")), "layer")], None
    while True:
        step = tight.join(layers[-1].withColumnRenamed("node", "src"), ["s", "src"]).select("s", "dst", "n", F.lit(1).alias("c"))
        step = step if arrived is None else step.unionByName(arrived)
        arrived = stored(step.groupBy("s", "dst").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).join(wanted, ["s", "dst"]), "arrived")
        new = stored(arrived.where("c = wanted").select("s", F.col("dst").alias("node"), "n"), "layer")
        if new.isEmpty():
            break
        layers.append(new)
        arrived = arrived.where("c < wanted").drop("wanted")
    counts, flows = _union(layers), []
    for layer in reversed(layers[1:]):
        below = layer.withColumn("dep", F.lit(0.0)) if not flows else layer.join(_union(flows).groupBy("s", F.col("src").alias("node")).agg(F.sum("x").alias("dep")), ["s", "node"], "left").withColumn("dep", F.coalesce("dep", F.lit(0.0)))
        up = counts.select("s", F.col("node").alias("src"), F.col("n").alias("n_up"))
        flows.append(stored(below.withColumnRenamed("node", "dst").join(tight, ["s", "dst"]).join(up, ["s", "src"]).select("s", "src", "dst", (F.col("n_up") / F.col("n") * (1 + F.col("dep"))).alias("x")), "flow"))
    flow = _union(flows) if flows else tight.withColumn("x", F.lit(0.0))
    node = flow.where("s <> src").groupBy(F.col("src").alias("node")).agg(F.sum("x").alias("b"))
    return nodes.select("node").join(node, "node", "left").select("node", F.coalesce("b", F.lit(0.0)).alias("b")), flow.groupBy("src", "dst").agg(F.sum("x").alias("b"))


def connecting_threshold(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """thr: the largest weight down to which edges must be kept for one component; null if there are several anyway."""
    tree = maximum_spanning_forest(edges, nodes)
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    return tree.agg(F.count(F.lit(1)).alias("m"), F.min("w").alias("low")).join(F.broadcast(n)).select(F.when(F.col("m") == F.col("n") - 1, F.col("low")).alias("thr"))


def edge_range(edges: DataFrame, max_steps: int = 1000) -> DataFrame:
    """src, dst, range: distance of an edge's ends once it is gone, null if there is none; one search, the edge is a key."""
    e = stored(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    front = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("src").alias("at"))
    seen, found = front, []
    for d in range(1, max_steps + 1):
        step = front.join(e.select(F.col("src").alias("at"), F.col("dst").alias("to")), "at").where("NOT (at = a AND to = b)").select("a", "b", F.col("to").alias("at")).distinct()
        front = stored(step.join(seen, ["a", "b", "at"], "left_anti"), "range")
        found.append(front.where("at = b").select("a", "b", F.lit(d).cast("bigint").alias("range")))
        seen = stored(seen.unionByName(front), "range")
        front = front.join(found[-1].select("a", "b"), ["a", "b"], "left_anti")
        if front.isEmpty():
            break
    else:
        raise RuntimeError("ranges did not settle")
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(_union(found), ["a", "b"], "left").select(F.col("a").alias("src"), F.col("b").alias("dst"), "range")


def shortcuts(edges: DataFrame) -> DataFrame:
    """src, dst, range, short: an edge is a shortcut if its range is above 2 or infinite (null)."""
    return edge_range(edges).withColumn("short", F.coalesce(F.col("range") > 2, F.lit(True)))


def range_summary(ranges: DataFrame) -> DataFrame:
    """eta, fs: mean of the finite ranges, and share of the edges that are shortcuts."""
    return ranges.agg(F.avg("range").alias("eta"), F.avg(F.col("short").cast("double")).alias("fs"))


def maximum_spanning_forest(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src < dst, w of a forest of the largest weights (ties by ids): every component takes its best edge, until none leads out."""
    e = stored(edges.where("src < dst").select("src", "dst", "w"), "edges")
    label = stored(nodes.select("node", F.col("node").alias("comp")), "label")
    taken = e.limit(0)
    while True:
        of = lambda c, label=label: label.select(F.col("node").alias(c), F.col("comp").alias(f"c_{c}"))
        out = e.join(of("src"), "src").join(of("dst"), "dst").where("c_src <> c_dst")
        ends = out.select("src", "dst", "w", F.explode(F.array("c_src", "c_dst")).alias("comp"))
        best = ends.groupBy("comp").agg(F.max(F.struct("w", (-F.col("src")).alias("s"), (-F.col("dst")).alias("t"))).alias("x")).select((-F.col("x.s")).alias("src"), (-F.col("x.t")).alias("dst"), "x.w").distinct()
        best = stored(best, "best")
        if best.isEmpty():
            return taken
        taken = stored(taken.unionByName(best), "forest")
        comp = connected_components(taken)
        label = stored(nodes.select("node").join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "label")


def backbone(edges: DataFrame, nodes: DataFrame, average_degree: float) -> DataFrame:
    """Spanning forest and the strongest other edges, up to an average degree; each edge once (src < dst)."""
    from .weights import ranked

    tree = stored(maximum_spanning_forest(edges, nodes), "tree")
    rest = edges.where("src < dst").select("src", "dst", "w").join(tree.select("src", "dst"), ["src", "dst"], "left_anti")
    room = nodes.agg((F.count(F.lit(1)) * average_degree / 2).alias("n")).join(tree.agg(F.count(F.lit(1)).alias("t"))).select((F.col("n") - F.col("t")).alias("room"))
    more = ranked(rest, [F.desc("w"), F.col("src"), F.col("dst")]).join(F.broadcast(room)).where("rank <= room").select("src", "dst", "w")
    return tree.unionByName(more)


def motif_codes(edges: DataFrame) -> DataFrame:
    """u < v < x and a 6-bit code of every connected triple: bits uv, vu, ux, xu, vx, xv."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    near = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    wedge = near.select(F.col("src").alias("m"), F.col("dst").alias("p")).join(near.select(F.col("src").alias("m"), F.col("dst").alias("q")), "m").where("p < q")
    three = wedge.select(F.sort_array(F.array("m", "p", "q")).alias("t")).distinct().select(*[F.col("t")[i].alias(c) for i, c in enumerate("uvx")])
    code = F.lit(0)
    for i, (a, b) in enumerate(("uv", "vu", "ux", "xu", "vx", "xv")):
        three = three.join(e.select(F.col("src").alias(a), F.col("dst").alias(b), F.lit(1 << i).alias(f"{a}{b}")), [a, b], "left")
        code = code + F.coalesce(f"{a}{b}", F.lit(0))
    return three.select("u", "v", "x", code.cast("bigint").alias("code"))


def motif3_classes() -> list[tuple[int, int]]:
    """(code, class): triples that are the same up to node order share the least of their codes."""
    from itertools import permutations

    pairs = [(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)]
    out = []
    for code in range(64):
        arcs = [p for i, p in enumerate(pairs) if code >> i & 1]
        out.append((code, min(sum(1 << pairs.index((o[a], o[b])) for a, b in arcs) for o in permutations(range(3)))))
    return out


def motifs3(edges: DataFrame) -> DataFrame:
    """node, class, n: triples of each class around each node."""
    spark = edges.sparkSession
    classes = spark.createDataFrame(motif3_classes(), "code bigint, class bigint")
    t = motif_codes(edges).join(F.broadcast(classes), "code")
    return t.select(F.explode(F.array("u", "v", "x")).alias("node"), "class").groupBy("node", "class").agg(F.count(F.lit(1)).alias("n"))
