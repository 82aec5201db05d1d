"""Network-based statistic: edges that differ between two groups of subjects, by the size of their components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.components import connected_components
from graphloom.plans.shared import stored


def edge_t(cells: DataFrame, groups: DataFrame, keys: list[str], tail: str = "both") -> DataFrame:
    """keys, src, dst, t: pooled two-sample t of each edge; absent cells are zero.

    cells: subject, src < dst, w; groups: keys, subject, grp (0 or 1).
    """
    size = groups.groupBy(*keys).agg(F.count_if(F.col("grp") == 0).alias("n0"), F.count_if(F.col("grp") == 1).alias("n1"))
    got = cells.join(groups, "subject")
    one = lambda g, x: F.sum(F.when(F.col("grp") == g, x).otherwise(0.0))
    s = got.groupBy(*keys, "src", "dst").agg(*[one(g, F.col("w")).alias(f"s{g}") for g in (0, 1)], *[one(g, F.col("w") * F.col("w")).alias(f"q{g}") for g in (0, 1)])
    s = s.join(F.broadcast(size), keys) if keys else s.join(F.broadcast(size))
    m = lambda g: F.col(f"s{g}") / F.col(f"n{g}")
    ss = lambda g: F.col(f"q{g}") - F.col(f"s{g}") * F.col(f"s{g}") / F.col(f"n{g}")
    pooled = F.sqrt((ss(0) + ss(1)) / (F.col("n0") + F.col("n1") - 2)) * F.sqrt(1 / F.col("n0") + 1 / F.col("n1"))
    t = F.try_divide(m(0) - m(1), pooled)
    t = {"both": F.abs(t), "left": -t, "right": t}[tail]
    return s.select(*keys, "src", "dst", F.coalesce(t, F.lit(0.0)).alias("t"))


def component_sizes(strong: DataFrame, keys: list[str]) -> DataFrame:
    """keys, comp, edges of the graphs of strong edges; all keys in one search."""
    key = F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")
    coded = stored(strong.select(*keys, F.xxhash64(key, "src").alias("a"), F.xxhash64(key, "dst").alias("b")), "strong")
    comp = connected_components(coded, "a", "b").withColumnRenamed("node", "a")
    return coded.join(comp, "a").groupBy(*keys, "comp").agg(F.count(F.lit(1)).alias("edges"))


def nbs(cells: DataFrame, groups: DataFrame, threshold: float, permutations: int = 100, tail: str = "both", seed: int = 1) -> DataFrame:
    """comp, edges, p of each component of edges with t over the threshold.

    p is the share of permutations of the groups whose largest component has as many
    edges; the permutation is a key, so all of them are one job.
    """
    cells = stored(cells, "cells")
    true = component_sizes(edge_t(cells, groups, [], tail).where(F.col("t") > threshold), [])
    order = groups.select("subject", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm")).withColumn("h", F.xxhash64("subject", "perm", F.lit(seed)))
    n0 = groups.where("grp = 0").count()
    # the first n0 subjects in the order of a hash are group 0
    lists = order.groupBy("perm").agg(F.sort_array(F.collect_list(F.struct("h", "subject"))).alias("x"))
    dealt = lists.select("perm", F.posexplode("x").alias("i", "s")).select("perm", "s.subject", F.when(F.col("i") < n0, 0).otherwise(1).alias("grp"))
    return _shares(true, edge_t(cells, stored(dealt, "perms"), ["perm"], tail).where(F.col("t") > threshold), permutations)


def _shares(true: DataFrame, strong: DataFrame, permutations: int) -> DataFrame:
    """comp, edges, p: the share of permutations whose largest component of strong edges has as many edges; one row for each permutation is broadcast."""
    null = component_sizes(strong, ["perm"]).groupBy("perm").agg(F.max("edges").alias("largest"))
    counted = true.join(F.broadcast(null), F.col("largest") >= F.col("edges"), "left").groupBy("comp", "edges").agg(F.count("largest").alias("k"))
    return counted.select("comp", "edges", (F.col("k") / permutations).alias("p"))


def paired_t(cells: DataFrame, pairs: DataFrame, keys: list[str], tail: str = "both") -> DataFrame:
    """keys, src, dst, t: one-sample t of the differences of paired subjects at each edge; absent cells are zero.

    cells: subject, src < dst, w; pairs: keys, pair, a, b, sign; a pair's difference is that of subject a and b, times sign.
    """
    n = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    of = lambda c, x: pairs.select(*keys, "pair", F.col(c).alias("subject"), (x * F.col("sign")).alias("times"))
    part = cells.join(of("a", 1).unionByName(of("b", -1)), "subject")
    diff = part.groupBy(*keys, "src", "dst", "pair").agg(F.sum(F.col("w") * F.col("times")).alias("x"))
    s = diff.groupBy(*keys, "src", "dst").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    s = s.join(F.broadcast(n), keys) if keys else s.join(F.broadcast(n))
    sd = F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))
    t = F.try_divide(F.col("s") / F.col("n"), sd) * F.sqrt("n")
    t = {"both": F.abs(t), "left": -t, "right": t}[tail]
    return s.select(*keys, "src", "dst", F.coalesce(t, F.lit(0.0)).alias("t"))


def nbs_paired(cells: DataFrame, pairs: DataFrame, threshold: float, permutations: int = 100, tail: str = "both", seed: int = 1) -> DataFrame:
    """comp, edges, p of each component of edges whose paired t is over the threshold.

    pairs: pair, a, b (subjects).  A permutation exchanges the subjects of every pair
    with probability 1/2; p is the share of them whose largest component has as many edges.
    """
    cells = stored(cells, "cells")
    two = pairs.select("pair", "a", "b")
    true = component_sizes(paired_t(cells, two.withColumn("sign", F.lit(1)), [], tail).where(F.col("t") > threshold), [])
    dealt = two.select("*", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm"))
    dealt = dealt.withColumn("sign", F.when(F.pmod(F.xxhash64("pair", "perm", F.lit(seed)), F.lit(2)) == 0, 1).otherwise(-1))
    return _shares(true, paired_t(cells, stored(dealt, "perms"), ["perm"], tail).where(F.col("t") > threshold), permutations)
