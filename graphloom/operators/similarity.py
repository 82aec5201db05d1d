"""How alike two graphs on the same nodes are, by their communities, and tests of it; runs and shuffles are keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import stored

from . import null_models as Z
from . import optimisers as O
from . import partitions as P


def _pairs(n: str):
    return F.col(n) * (F.col(n) - 1) / 2


def comodularity(e1: DataFrame, e2: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """One row of shares of node pairs that are together in both partitions.

    f_f: of the pairs together in either; g_e: of the edges of either graph; h_e, h_h: of the
    edges of both graphs that are together in both, among the edges of either graph and among those of
    both graphs that are together in either partition; p: communities of both less one.
    Pairs of nodes are counted from the sizes of communities and of their overlaps, not listed.
    """
    c = P.contingency(one, two)
    both = c.agg(F.sum(_pairs("n")).alias("f"))
    side = lambda p, k: p.groupBy("comm").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(_pairs("n")).alias(f"s{k}"), F.count(F.lit(1)).alias(f"m{k}"))
    half = lambda e, k: e.where("src < dst AND w <> 0").select("src", "dst", F.lit(1).alias(k))
    edges = half(e1, "in1").join(half(e2, "in2"), ["src", "dst"], "full")
    for k, p in (("1", one), ("2", two)):
        for end in ("src", "dst"):
            edges = edges.join(p.select(F.col("node").alias(end), F.col("comm").alias(f"{end}{k}")), end)
    t1, t2 = F.col("src1") == F.col("dst1"), F.col("src2") == F.col("dst2")
    shared = F.col("in1").isNotNull() & F.col("in2").isNotNull()
    counts = edges.agg(F.count(F.lit(1)).alias("e"), F.count_if(t1 & t2).alias("g"), F.count_if(shared & t1 & t2).alias("h"), F.count_if(shared & (t1 | t2)).alias("hh"))
    x = both.join(F.broadcast(side(one, 1))).join(F.broadcast(side(two, 2))).join(F.broadcast(counts))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return x.select(
        share(F.col("f"), F.col("s1") + F.col("s2") - F.col("f")).alias("f_f"), share(F.col("g"), F.col("e")).alias("g_e"), share(F.col("h"), F.col("e")).alias("h_e"),
        share(F.col("h"), F.col("hh")).alias("h_h"), (F.col("m1") + F.col("m2") - 1).alias("p"),
    )


def comodularity_ratio(one: DataFrame, two: DataFrame) -> DataFrame:
    """ratio: the share of pairs together in both partitions of those together in either, over what communities of these sizes give by chance.

    Sizes are counted first: there are at most sqrt(2 n) different ones.
    """
    sizes = lambda p: p.groupBy("comm").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("k"))
    n = one.agg(F.count(F.lit(1)).cast("double").alias("all"))
    other = sizes(two).agg(F.collect_list(F.struct("size", "k")).alias("other"))
    g = lambda x: x["size"].cast("double")
    h, m = F.col("size").cast("double"), F.col("all")
    term = lambda x: x["k"] * h * h * g(x) * g(x) / (m * m * m * (h + g(x)) - m * h * g(x))
    scale = sizes(one).join(F.broadcast(n)).join(F.broadcast(other)).agg(F.sum(F.col("k") * F.aggregate("other", F.lit(0.0), lambda s, x: s + term(x))).alias("scale"))
    c = P.contingency(one, two).agg(F.sum(_pairs("n")).alias("f"))
    side = lambda p, k: p.groupBy("comm").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(_pairs("n")).alias(k))
    x = c.join(F.broadcast(side(one, "s1"))).join(F.broadcast(side(two, "s2"))).join(F.broadcast(scale))
    return x.select(F.try_divide(F.try_divide(F.col("f"), F.col("s1") + F.col("s2") - F.col("f")), F.col("scale")).alias("ratio"))


def cross_modularity(e1: DataFrame, e2: DataFrame, one: DataFrame, two: DataFrame, method: str = "sta") -> DataFrame:
    """similarity: the qualities of each graph under the other's partition over those under its own."""
    keyed = lambda d: d.withColumn("run", F.lit(0)) if "run" not in d.columns else d
    return cross_modularity_runs(keyed(e1), keyed(e2), keyed(one), keyed(two), method).select("similarity")


def cross_modularity_runs(e1: DataFrame, e2: DataFrame, one: DataFrame, two: DataFrame, method: str = "sta") -> DataFrame:
    """run, similarity: ``cross_modularity`` in each run."""
    q = lambda e, p, name: O._qualities(O._split(e), O._sized(p.select("run", "node", "comm")), method, 1.0).withColumnRenamed("quality", name)
    x = q(e1, one, "q11").join(q(e2, two, "q22"), "run").join(q(e1, two, "q12"), "run").join(q(e2, one, "q21"), "run")
    return x.select("run", F.try_divide(F.col("q12") + F.col("q21"), F.col("q11") + F.col("q22")).alias("similarity"))


def entropic_similarity(one: DataFrame, two: DataFrame) -> DataFrame:
    """similarity: 1 less the variation of information over the logarithm of the number of nodes."""
    return P.compare(one, two).select((1 - F.col("nvi")).alias("similarity"))


def in_runs(df: DataFrame, first: int, last: int) -> DataFrame:
    """df once for each run first .. last."""
    return df.select(F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))).alias("run"), *df.columns)


def degenerate_partitions(edges: DataFrame, nodes: DataFrame, runs: int, cap: float = 0.1, cutoff: float = 0.95, method: str = "sta", seed: int = 1, max_tries: int = 50) -> DataFrame:
    """run, node, comm: different partitions of nearly the best quality, one for each run.

    Each run optimises on a way of its own, sends every node with a chance below ``cap`` (drawn for the
    run) to some neighbouring community and settles again; what keeps more than ``cutoff``
    of the quality is taken, the other runs try again.  All runs are the same jobs.
    """
    e = stored(in_runs(edges, 1, runs), "runs")
    wanted, out = stored(in_runs(nodes.select("node"), 1, runs), "wanted"), None
    for turn in range(max_tries):
        own = seed + 7919 * turn
        e_now = stored(e.join(wanted.select("run").distinct(), "run"), "runs")
        start = stored(O._sized(O.best_of_runs(e_now, wanted, method, 1.0, own, True)), "start")
        split = stored(O._split(e_now), "split")
        start = O._settle(split, start, method, 1.0, own, True)
        chance = cap * F.pmod(F.xxhash64("run", F.lit(own)), F.lit(1 << 30)) / (1 << 30)
        end = O._settle(split, O._shaken(split, start, method, 1.0, chance, own), method, 1.0, own + 1, True)
        q = O._qualities(split, start, method, 1.0).join(O._qualities(split, end, method, 1.0).withColumnRenamed("quality", "q"), "run")
        good = stored(q.where((F.col("q") > F.lit(cutoff) * F.col("quality")) | (F.col("q") >= F.col("quality"))).select("run"), "good")
        one = end.join(good, "run").select("run", "node", "comm")
        out = one if out is None else out.unionByName(one)
        wanted = stored(wanted.join(good, "run", "left_anti"), "wanted")
        if not wanted.limit(1).count():
            return out
    raise RuntimeError("some runs found no degenerate partition")


def cross_modularity_degenerate(e1: DataFrame, e2: DataFrame, nodes: DataFrame, runs: int = 20, cap: float = 0.1, cutoff: float = 0.95, seed: int = 1) -> DataFrame:
    """run, similarity: ``cross_modularity`` of a degenerate partition of each graph; average or count them as wanted."""
    one = stored(degenerate_partitions(e1, nodes, runs, cap, cutoff, seed=seed), "one")
    two = stored(degenerate_partitions(e2, nodes, runs, cap, cutoff, seed=seed + 1), "two")
    return cross_modularity_runs(in_runs(e1, 1, runs), in_runs(e2, 1, runs), one, two)


def degenerate_rate(values: DataFrame, omega: float) -> DataFrame:
    """mean, p: the mean similarity, and the share of runs that are not above ``omega``."""
    return values.agg(F.avg("similarity").alias("mean"), F.avg((F.col("similarity") <= omega).cast("double")).alias("p"))


def best_cross_modularity(e1: DataFrame, e2: DataFrame, nodes: DataFrame, seed: int = 1) -> DataFrame:
    """run, similarity of keyed graphs (run, src, dst, w) under their own best partitions."""
    one, two = (stored(O.best_of_runs(e, nodes, "sta", 1.0, seed), "best") for e in (e1, e2))
    return cross_modularity_runs(e1, e2, one, two)


def similarity_test(e1: DataFrame, e2: DataFrame, nodes: DataFrame, shuffles: int = 1000, metric: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = best_cross_modularity, seed: int = 1, swaps: int = 5, steps: int = 10) -> DataFrame:
    """similarity, p: the share of shuffles whose similarity is above the true one.

    In a shuffle one of the graphs, by the toss of a coin, gives way to a null model that keeps signs, degrees
    and, nearly, strengths (``swaps`` and ``steps``: see ``null_model``).  metric: takes both graphs and the nodes keyed by ``run`` and returns
    run, similarity; run 0 is the true pair and all shuffles go through it together.
    """
    nodes = stored(nodes.select("node").distinct(), "nodes")
    toss = F.pmod(F.xxhash64("run", F.lit(seed)), F.lit(2)) == 0

    def mixed(e: DataFrame, mine) -> DataFrame:
        null = Z.null_model(e, nodes, shuffles, swaps, steps, seed=seed)
        return stored(in_runs(e.select("src", "dst", "w"), 0, shuffles).where((F.col("run") == 0) | ~mine).unionByName(null.where(mine)), "mixed")

    values = stored(metric(mixed(e1, toss), mixed(e2, ~toss), stored(in_runs(nodes, 0, shuffles), "keyed")), "similarities")
    true = values.where("run = 0").select(F.col("similarity").alias("true"))
    return values.where("run > 0").join(F.broadcast(true)).groupBy(F.col("true").alias("similarity")).agg(F.avg((F.col("similarity") > F.col("true")).cast("double")).alias("p"))
