"""Spectral bisection of communities, and centrality from closed walks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import stored

#: A split counts if it raises the quality by more than this (rounding of sums).
LEAST_GAIN = 1e-10
#: Groups of up to so many nodes are split inside one task; a dense matrix of that size is 8 MB.
DENSE = 1000


def _halves(b: np.ndarray) -> tuple[np.ndarray, float]:
    """Sides (1, -1) of the rows of a symmetric matrix without row sums, and the sum of its entries with those signs.

    The signs of the leading eigenvector; then every row changes sides once, the best
    one first, and the best of all states on the way counts; until that helps no more.
    """
    values, vectors = np.linalg.eigh(b)
    lead = vectors[:, -1]
    lead = lead * (1 if lead[np.argmax(np.abs(lead))] > 0 else -1)
    side = np.where(lead >= 0, 1.0, -1.0)
    off = b - np.diag(np.diag(b))
    q, least = side @ b @ side, 1e-12 * np.abs(b).sum()
    while True:
        s, field, open_ = side.copy(), off @ side, np.ones(len(b), bool)
        now, best, kept = q, q, None
        for _ in range(len(b)):
            gain = np.where(open_, -4 * s * field, -np.inf)
            i = int(np.argmax(gain))
            now += gain[i]
            s[i] = -s[i]
            field += 2 * s[i] * off[:, i]
            open_[i] = False
            if now > best + least:
                best, kept = now, s.copy()
        if kept is None:
            return side, q
        side, q = kept, kept @ b @ kept


def _split_dense(gamma: float, total: float):
    def split(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node")
        ids, out, into = (nodes[c].to_numpy() for c in ("node", "ko", "ki"))
        a = np.zeros((len(ids), len(ids)))
        np.add.at(a, (np.searchsorted(ids, edges["src"]), np.searchsorted(ids, edges["dst"])), edges["w"].to_numpy())
        b = a - gamma * (np.outer(out, into) + np.outer(into, out)) / (2 * total)
        b -= np.diag(b.sum(axis=1))
        side, q = _halves(b)
        return pd.DataFrame({"node": ids, "comm": nodes["comm"].to_numpy(), "up": side > 0, "gain": q / (2 * total)})

    return split


def _product(e: DataFrame, v: DataFrame, x: str, gamma: float, total: float) -> DataFrame:
    """v with y: the matrix of each group times the column ``x``.  The matrix stays a sparse sum and a product of two vectors."""
    sums = v.groupBy("comm").agg(F.sum(F.col("ki") * F.col(x)).alias("si"), F.sum(F.col("ko") * F.col(x)).alias("so"))
    got = e.join(v.select(F.col("node").alias("dst"), F.col(x).alias("xd")), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("xd")).alias("a"))
    y = F.coalesce("a", F.lit(0.0)) - gamma * (F.col("ko") * F.col("si") + F.col("ki") * F.col("so")) / (2 * total) - F.col("r") * F.col(x)
    return v.join(got, "node", "left").join(sums, "comm").select(*v.columns, y.alias("y"))


def _ritz(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weights of the basis vectors in each group's leading Ritz vector; one row of coefficients a group."""
    for frame in frames:
        out = []
        for steps in frame["steps"]:
            t = np.zeros((len(steps), len(steps)))
            for k, row in enumerate(sorted(steps, key=lambda x: x["k"])):
                c = np.array(row["c"], float)
                t[: len(c), k] = c
                t[k, : len(c)] = c
            out.append(np.linalg.eigh(t)[1][:, -1].tolist())
        yield pd.DataFrame({"comm": frame["comm"], "weights": out})


def _split_wide(e: DataFrame, v: DataFrame, gamma: float, total: float, seed: int, krylov: int = 16) -> DataFrame:
    """node, comm, up, gain for groups of any size, all groups at once: Lanczos steps, then moves of single nodes.

    A node's row holds its entries of the basis; a step is one sparse product and one
    sum for each group.
    """
    inside = e.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)).alias("loop"))
    group = v.groupBy("comm").agg(F.sum("ki").alias("gi"), F.sum("ko").alias("go"))
    null = (F.col("ko") * F.col("gi") + F.col("ki") * F.col("go")) / (2 * total) * gamma
    v = v.join(inside, "node", "left").join(group, "comm").withColumn("r", F.coalesce("k", F.lit(0.0)) - null)
    own = F.coalesce("loop", F.lit(0.0)) - gamma * F.col("ko") * F.col("ki") / total - F.col("r")  # the matrix' diagonal
    draw = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30)) / (1 << 30) - 0.5
    v = v.select("comm", "node", "ko", "ki", "r", own.alias("own"), draw.alias("x"))
    unit = lambda d, c: d.join(d.groupBy("comm").agg(F.sqrt(F.sum(F.col(c) * F.col(c))).alias("size")), "comm").withColumn(c, F.when(F.col("size") > 1e-9, F.col(c) / F.col("size")).otherwise(0.0)).drop("size")
    v = stored(unit(v, "x").withColumn("b", F.array("x")), "basis")
    steps = None
    for k in range(krylov):
        y = stored(_product(e, v, "x", gamma, total), "step")
        c = y.groupBy("comm").agg(F.array(*[F.sum(F.col("y") * F.get("b", F.lit(j))) for j in range(k + 1)]).alias("c"))
        c = stored(c, "coefficients")
        one = c.select("comm", F.lit(k).alias("k"), "c")
        steps = one if steps is None else steps.unionByName(one)
        if k + 1 < krylov:
            less = F.aggregate(F.zip_with("c", "b", lambda p, q: p * q), F.col("y"), lambda s, x: s - x)
            new = unit(y.join(c, "comm").withColumn("x", less).drop("y", "c"), "x")
            v = stored(new.withColumn("b", F.concat("b", F.array("x"))), "basis")
    weights = steps.groupBy("comm").agg(F.collect_list(F.struct("k", "c")).alias("steps")).mapInPandas(_ritz, "comm bigint, weights array<double>")
    x = F.aggregate(F.zip_with("weights", "b", lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    sides = v.join(weights, "comm").select("comm", "node", "ko", "ki", "r", "own", F.when(x >= 0, 1.0).otherwise(-1.0).alias("s"))
    return _moved_sides(e, sides, gamma, total, seed)


def _moved_sides(e: DataFrame, sides: DataFrame, gamma: float, total: float, seed: int) -> DataFrame:
    """node, comm, up, gain after moves to the other side that raise a group's value, in all groups at once.

    Half of a group's nodes that would gain move together; where that does not help,
    its best node moves alone, which gains for sure; a group without such a node is done.
    """
    value = lambda y: y.groupBy("comm").agg(F.sum(F.col("s") * F.col("y")).alias("q"))
    now = stored(_product(e, sides, "s", gamma, total), "sides")
    state, turn = stored(value(now).withColumn("mode", F.lit("many")), "state"), 0
    while True:
        turn += 1
        up = now.withColumn("g", -4 * F.col("s") * (F.col("y") - F.col("own") * F.col("s"))).where(F.col("g") > LEAST_GAIN * total)
        best = up.groupBy("comm").agg(F.max_by("node", F.struct("g", "node")).alias("best"))
        half = F.pmod(F.xxhash64("node", F.lit(turn), F.lit(seed)), F.lit(2)) == 0
        some = up.join(state.where("mode <> 'done'"), "comm").join(best, "comm").where(((F.col("mode") == "many") & half) | (F.col("node") == F.col("best")))
        flips = stored(some.select("node", F.lit(True).alias("flip")), "flips")
        if not flips.limit(1).count():
            return now.join(state, "comm").select("node", "comm", (F.col("s") > 0).alias("up"), (F.col("q") / (2 * total)).alias("gain"))
        tried = now.drop("y").join(flips, "node", "left").withColumn("s", F.when(F.col("flip"), -F.col("s")).otherwise(F.col("s"))).drop("flip")
        tried = stored(_product(e, tried, "s", gamma, total), "sides")
        better = state.join(value(tried).withColumnRenamed("q", "new"), "comm").withColumn("won", F.col("new") > F.col("q"))
        better = stored(better, "state")
        won = better.select("comm", "won")
        columns = [c for c in now.columns if c not in ("s", "y")]
        both = now.join(tried.select("node", F.col("s").alias("s2"), F.col("y").alias("y2")), "node").join(won, "comm")
        now = stored(both.select(*columns, F.when(F.col("won"), F.col("s2")).otherwise(F.col("s")).alias("s"), F.when(F.col("won"), F.col("y2")).otherwise(F.col("y")).alias("y")), "sides")
        mode = F.when(F.col("won"), "many").when(F.col("mode") == "many", "one").otherwise("done")
        state = better.select("comm", F.when(F.col("won"), F.col("new")).otherwise(F.col("q")).alias("q"), mode.alias("mode"))


def bisect(edges: DataFrame, nodes: DataFrame, gamma: float = 1.0, dense: int = DENSE, seed: int = 1, krylov: int = 16) -> DataFrame:
    """level, node, comm: partitions by repeated halving; each level halves all groups whose halving raises the modularity.

    Groups are halved by the signs of the leading eigenvector of their modularity
    matrix (less its row sums, so that a halving's value is what the modularity of the whole gains), then by moves
    of single nodes.  Directed graphs hold their arcs, undirected ones both directions.
    Groups of at most ``dense`` nodes are split inside one task each; larger ones by ``krylov`` sparse products, all at once,
    without building a matrix.  A community is named by its least node; a graph without weight stays one group.
    """
    e = edges.select("src", "dst", "w")
    total = e.agg(F.sum("w")).first()[0] or 0.0
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("w").alias("ko"), F.lit(0.0).alias("ki")), F.struct(F.col("dst").alias("node"), F.lit(0.0).alias("ko"), F.col("w").alias("ki")))).alias("x"))
    k = ends.groupBy("x.node").agg(F.sum("x.ko").alias("ko"), F.sum("x.ki").alias("ki"))
    half = e.select("src", "dst", (F.col("w") / 2).alias("w"))
    both = half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    both = stored(both, "symmetric")
    start = nodes.select("node").distinct().join(k, "node", "left").select("node", F.coalesce("ko", F.lit(0.0)).alias("ko"), F.coalesce("ki", F.lit(0.0)).alias("ki"))
    now = stored(start.join(start.agg(F.min("node").alias("comm"))), "groups").withColumn("open", F.lit(total != 0.0))
    level, out = 0, None
    while True:
        step = now.select(F.lit(level).alias("level"), "node", "comm")
        out = step if out is None else out.unionByName(step)
        size = now.where("open").groupBy("comm").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        v = stored(now.join(size, "comm").select("comm", "node", "ko", "ki", "n"), "open")
        if not v.limit(1).count():
            return out
        c = v.select("node", "comm")
        inner = both.join(c.select(F.col("node").alias("src"), "comm"), "src").join(c.select(F.col("node").alias("dst"), F.col("comm").alias("other")), "dst").where("comm = other").select("comm", "src", "dst", "w")
        small, wide = F.col("n") <= dense, v.where(F.col("n") > dense)
        few = inner.join(size.where(small).select("comm"), "comm").select(F.col("comm").alias("grp"), "src", "dst", "w")
        pairs = v.where(small).select(F.col("comm").alias("grp"), "comm", "node", "ko", "ki").groupBy("grp").cogroup(few.groupBy("grp"))
        halves = pairs.applyInPandas(_split_dense(gamma, total), "node bigint, comm bigint, up boolean, gain double")
        if wide.limit(1).count():
            e_wide = stored(inner.join(size.where(~small).select("comm"), "comm"), "inner")
            halves = halves.unionByName(_split_wide(e_wide, wide.drop("n"), gamma, total, seed + level, krylov))
        halves = stored(halves, "halves")
        # a half is named by its least node; halvings that gain nothing, or have one side, close the group
        named = halves.groupBy("comm", "up").agg(F.min("node").alias("name"))
        real = halves.groupBy("comm").agg(F.max("gain").alias("gain"), F.count_distinct("up").alias("sides")).where((F.col("gain") > LEAST_GAIN) & (F.col("sides") == 2)).select("comm")
        moved = halves.join(real, "comm").join(named, ["comm", "up"]).select("node", "name")
        now = stored(now.join(moved, "node", "left").select("node", "ko", "ki", F.coalesce("name", "comm").alias("comm"), F.col("name").isNotNull().alias("open")), "groups")
        if not now.where("open").limit(1).count():
            return out
        level += 1


def spectral(edges: DataFrame, nodes: DataFrame, gamma: float = 1.0, dense: int = DENSE, seed: int = 1, krylov: int = 16) -> DataFrame:
    """node, comm: the last level of ``bisect``."""
    tree = stored(bisect(edges, nodes, gamma, dense, seed, krylov), "tree")
    return tree.join(tree.agg(F.max("level").alias("level")), "level").select("node", "comm")


def terms_for(most: float, eps: float) -> int:
    """How many terms of exp's series leave a rest below ``eps`` of exp(0) at eigenvalues up to ``most``."""
    k, term = 0, 1.0
    while k < most or term / (1 - most / (k + 1)) > eps:
        k += 1
        term *= most / k
        if k > 100_000:
            raise RuntimeError("the series is too long")
    return k


def subgraph_centrality(edges: DataFrame, nodes: DataFrame, eps: float = 1e-9, sources: DataFrame | None = None) -> DataFrame:
    """node, c: closed walks of all lengths through a node of an undirected (mirrored) graph, length k weighing 1 / k!; weights do not count.

    The diagonal of exp(A), from walks that start at each source: w steps give the terms 2w and
    2w + 1.  The terms left out sum to less than ``eps``: eigenvalues are at most the square root of the
    largest number of walks of two steps.  ``sources`` (node) limits what is asked for;
    a source needs as many rows as the nodes its walks reach.
    """
    e = stored(edges.where("src <> dst").select("src", "dst").distinct(), "plain")
    k = e.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    two = e.join(k.withColumnRenamed("src", "dst"), "dst").groupBy("src").agg(F.sum("k").alias("n")).agg(F.max("n")).first()[0] or 0
    steps = (terms_for(math.sqrt(two), eps) + 1) // 2 if two else 0
    asked = stored((nodes if sources is None else sources).select("node").distinct(), "asked")
    walk = stored(asked.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("x")), "walks")
    terms = [asked.select("node", F.lit(1.0).alias("c"))]
    for i in range(1, steps + 1):
        new = stored(walk.join(e, walk.node == e.src).groupBy("source", F.col("dst").alias("node")).agg(F.sum("x").alias("x")), "walks")
        odd = walk.join(new.withColumnRenamed("x", "y"), ["source", "node"]).groupBy("source").agg(F.sum(F.col("x") * F.col("y")).alias("t"))
        even = new.groupBy("source").agg(F.sum(F.col("x") * F.col("x")).alias("t"))
        weight = lambda n: math.exp(-math.lgamma(n + 1))
        terms += [odd.select(F.col("source").alias("node"), (F.col("t") * weight(2 * i - 1)).alias("c")), even.select(F.col("source").alias("node"), (F.col("t") * weight(2 * i)).alias("c"))]
        walk = new
        if i % 10 == 0:
            terms = [stored(_summed(terms), "terms")]
    return _summed(terms)


def _summed(terms: list[DataFrame]) -> DataFrame:
    all_ = terms[0]
    for t in terms[1:]:
        all_ = all_.unionByName(t)
    return all_.groupBy("node").agg(F.sum("c").alias("c"))
