"""Community detection and consensus, as synchronous moves of DataFrame joins."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import stored

from . import partitions as P
from .optimisers import best_of_runs
from .similarity import in_runs


def _sweep(edges: DataFrame, parts: DataFrame, gamma: float, turn: int, seed: int, random_share: float = 0.0) -> DataFrame:
    """Move every node of this turn's half to the neighbouring community of largest gain."""
    total = edges.agg(F.sum("w").alias("total"))
    k = edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    own = parts.join(k, "node", "left").withColumn("k", F.coalesce("k", F.lit(0.0)))
    size = own.groupBy("comm").agg(F.sum("k").alias("k_all"))
    s = P.to_communities(edges.where("src <> dst"), parts)
    at = own.select("node", F.col("comm").alias("now"), "k")
    # gains of leaving for each neighbouring community, and of staying
    all_ = s.unionByName(own.select("node", "comm", F.lit(0.0).alias("s"))).groupBy("node", "comm").agg(F.sum("s").alias("s"))
    gain = all_.join(at, "node").join(size, "comm").join(F.broadcast(total))
    gain = gain.withColumn("g", F.col("s") - gamma * F.col("k") * (F.col("k_all") - F.when(F.col("comm") == F.col("now"), F.col("k")).otherwise(0.0)) / F.col("total"))
    best = gain.groupBy("node", "now").agg(F.max(F.struct("g", (-F.col("comm")).alias("c"))).alias("b"), F.max(F.when(F.col("comm") == F.col("now"), F.col("g"))).alias("stay"))
    mine = F.pmod(F.xxhash64("node", F.lit(turn), F.lit(seed)), F.lit(2)) == 0
    moved = F.when(mine & (F.col("b.g") > F.col("stay") + 1e-10), -F.col("b.c")).otherwise(F.col("now"))
    return best.select("node", moved.alias("comm"))


def louvain(edges: DataFrame, nodes: DataFrame, gamma: float = 1.0, seed: int = 1) -> DataFrame:
    """level, node, comm: a dendrogram of partitions of a mirrored graph with positive weights.

    Half of the nodes, chosen by hash, move at a time, so that neighbours do not chase
    each other; a level ends after three sweeps that did not raise its quality, and the communities
    become the nodes of the next, until a level raises nothing.  Only qualities reach the driver.
    """
    turn = 0
    out, graph = None, stored(edges.select("src", "dst", "w"), "graph")
    members = stored(nodes.select("node", F.col("node").alias("comm")), "level")
    for level in itertools.count():
        best, q, idle = members, P.modularity(graph, members, gamma).first()[0] or 0.0, 0
        now, start = best, q
        while idle < 3:
            turn += 1
            now = stored(_sweep(graph, now, gamma, turn, seed), "sweep")
            new = P.modularity(graph, now, gamma).first()[0] or 0.0
            idle = 0 if new > q + 1e-10 else idle + 1
            if new > q + 1e-10:
                best, q = now, new
        if q <= start + 1e-10:
            break
        least = best.groupBy("comm").agg(F.min("node").alias("least"))
        best = stored(best.join(least, "comm").select("node", F.col("least").alias("comm")), "level")
        step = best.withColumn("level", F.lit(level)).select("level", "node", "comm")
        out = step if out is None else out.unionByName(step)
        graph = stored(P.induced_graph(graph, best), "graph")
        members = stored(best.select(F.col("comm").alias("node"), "comm").distinct(), "level")
    return out if out is not None else nodes.select(F.lit(0).alias("level"), "node", F.col("node").alias("comm"))


def best_partition(edges: DataFrame, nodes: DataFrame, gamma: float = 1.0, seed: int = 1) -> DataFrame:
    """node, comm of the last level of ``louvain``."""
    tree = stored(louvain(edges, nodes, gamma, seed), "tree")
    return P.partition_at_level(tree, tree.agg(F.max("level")).first()[0])


def label_propagation(edges: DataFrame, nodes: DataFrame, seed: int = 1, max_turns: int = 1000) -> DataFrame:
    """node, comm: every node takes the label of most weight around it, ties by a hash; until labels rest."""
    now = stored(nodes.select("node", F.col("node").alias("comm")), "labels")
    e = edges.where("src <> dst")
    for turn in range(max_turns):
        s = P.to_communities(e, now)
        best = s.groupBy("node").agg(F.max_by("comm", F.struct("s", F.xxhash64("comm", F.lit(seed)))).alias("to"))
        mine = F.pmod(F.xxhash64("node", F.lit(turn), F.lit(seed)), F.lit(2)) == 0
        new = stored(now.join(best, "node", "left").select("node", F.when(mine, F.coalesce("to", "comm")).otherwise(F.col("comm")).alias("comm"), (F.coalesce("to", "comm") != F.col("comm")).alias("open")), "labels")
        rest = not new.agg(F.bool_or("open")).first()[0]
        now = new.select("node", "comm")
        if rest:
            return now
    raise RuntimeError("the labels did not come to rest within max_turns")


def consensus(edges: DataFrame, nodes: DataFrame, tau: float, runs: int = 5, method: str = "modularity", gamma: float = 1.0, seed: int = 1, max_rounds: int = 100) -> DataFrame:
    """node, comm: partitions of several runs, clustered by how often they agree until all runs agree.

    Each round optimises all runs together on the graph of the pairs that are in one community in at
    least ``tau`` of the last round's runs, weighted by that share.
    """
    start = lambda e: stored(_named(best_of_runs(in_runs(e, 1, runs), in_runs(nodes.select("node"), 1, runs), method, gamma, seed, True)), "runs")
    parts = start(edges.select("src", "dst", "w"))
    for _ in range(max_rounds):
        if parts.groupBy("node").agg(F.count_distinct("comm").alias("k")).where("k > 1").isEmpty():
            return parts.where("run = 1").select("node", "comm")
        seed += 1
        together = P.agreement(parts.withColumnRenamed("run", "part")).withColumn("w", F.col("n") / runs).where(F.col("w") >= tau)
        parts = start(stored(together.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), "agreement"))
    raise RuntimeError("the runs do not come to agree")


def _named(parts: DataFrame) -> DataFrame:
    """run, node, comm: communities by their least node."""
    least = parts.groupBy("run", "comm").agg(F.min("node").alias("least"))
    return parts.join(least, ["run", "comm"]).select("run", "node", F.col("least").alias("comm"))


def resolution_profile(edges: DataFrame, nodes: DataFrame, gammas: list[float]) -> DataFrame:
    """gamma, communities, quality of the best partition at each resolution."""
    out = None
    for g in gammas:
        p = stored(best_partition(edges, nodes, g), "profile")
        one = p.agg(F.count_distinct("comm").alias("communities")).join(P.modularity(edges, p, g)).select(F.lit(float(g)).alias("gamma"), "communities", F.col("q").alias("quality"))
        out = one if out is None else out.unionByName(one)
    return out
