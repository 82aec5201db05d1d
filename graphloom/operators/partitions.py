"""Quality, comparison and bookkeeping of node partitions (node, comm)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ONE = F.lit  # short name for literals in expressions


def _both(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges with the communities of their ends, c1 and c2."""
    p = parts.select("node", "comm")
    return edges.join(p.select(F.col("node").alias("src"), F.col("comm").alias("c1")), "src").join(p.select(F.col("node").alias("dst"), F.col("comm").alias("c2")), "dst")


def to_communities(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """node, comm, s: weight from each node into each community."""
    p = parts.select(F.col("node").alias("dst"), "comm")
    return edges.join(p, "dst").groupBy(F.col("src").alias("node"), "comm").agg(F.sum("w").alias("s"))


def participation(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """node, pc: 1 less the sum of squared shares of a node's weight over communities; 0 without edges."""
    s = to_communities(edges, parts).groupBy("node").agg(F.sum("s").alias("k"), F.sum(F.col("s") * F.col("s")).alias("q"))
    return parts.select("node").join(s, "node", "left").select("node", F.coalesce(1 - F.try_divide(F.col("q"), F.col("k") * F.col("k")), F.lit(0.0)).alias("pc"))


def participation_sign(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """node, pos, neg: participation by positive and by negative weights."""
    pos = participation(edges.where("w > 0"), parts).withColumnRenamed("pc", "pos")
    neg = participation(edges.where("w < 0").withColumn("w", -F.col("w")), parts).withColumnRenamed("pc", "neg")
    return pos.join(neg, "node")


def diversity_sign(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """node, pos, neg: entropy of a node's weight over communities, relative to the logarithm of their number."""
    m = parts.agg(F.count_distinct("comm").alias("m"))

    def part(e: DataFrame, name: str) -> DataFrame:
        s = to_communities(e, parts)
        k = s.groupBy("node").agg(F.sum("s").alias("k"))
        share = F.col("s") / F.col("k")
        return s.join(k, "node").groupBy("node").agg(F.sum(-share * F.log(share)).alias(name))

    got = parts.select("node").join(part(edges.where("w > 0"), "pos"), "node", "left").join(part(edges.where("w < 0").withColumn("w", -F.col("w")), "neg"), "node", "left").join(F.broadcast(m))
    return got.select("node", *[F.coalesce(F.try_divide(F.col(c), F.log("m")), F.lit(0.0)).alias(c) for c in ("pos", "neg")])


def module_degree_zscore(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """node, z: weight inside the own community against its members' mean, in population deviations; 0 where they do not differ."""
    p = parts.select("node", "comm")
    own = _both(edges, parts).where("c1 = c2").groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("s"))
    k = p.join(own, "node", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    stats = k.groupBy("comm").agg(F.avg("s").alias("mu"), F.stddev_pop("s").alias("sd"))
    return k.join(stats, "comm").select("node", F.coalesce(F.try_divide(F.col("s") - F.col("mu"), F.col("sd")), F.lit(0.0)).alias("z"))


def modularity_sums(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """comm, inside, out, into: weights inside, from, and into each community."""
    e = _both(edges, parts)
    ends = e.select(F.explode(F.array(F.struct(F.col("c1").alias("comm"), F.when(F.col("c1") == F.col("c2"), F.col("w")).otherwise(0.0).alias("inside"), F.col("w").alias("out"), F.lit(0.0).alias("into")), F.struct(F.col("c2").alias("comm"), F.lit(0.0).alias("inside"), F.lit(0.0).alias("out"), F.col("w").alias("into")))).alias("x"))
    return ends.groupBy("x.comm").agg(F.sum("x.inside").alias("inside"), F.sum("x.out").alias("out"), F.sum("x.into").alias("into"))


def modularity(edges: DataFrame, parts: DataFrame, gamma: float = 1.0) -> DataFrame:
    """q: share of weight inside communities less gamma times its expectation; directed or mirrored edges."""
    c = modularity_sums(edges, parts)
    s = edges.agg(F.sum("w").alias("s"))
    return c.join(F.broadcast(s)).agg(F.sum(F.try_divide(F.col("inside"), F.col("s")) - gamma * F.try_divide(F.col("out") * F.col("into"), F.col("s") * F.col("s"))).alias("q"))


def modularity_sign(edges: DataFrame, parts: DataFrame, qtype: str = "sta") -> DataFrame:
    """q of a signed mirrored graph; qtype scales the positive and the negative part: sta, pos, smp, gja, neg."""
    def part(e: DataFrame, k: str) -> DataFrame:
        c = modularity_sums(e, parts)
        s = e.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias(f"s{k}"))
        x = c.join(F.broadcast(s)).agg(F.coalesce(F.sum(F.col("inside") - F.try_divide(F.col("out") * F.col("into"), F.col(f"s{k}"))), F.lit(0.0)).alias(f"x{k}"))
        return x.join(s)

    both = part(edges.where("w > 0"), "0").join(part(edges.where("w < 0").withColumn("w", -F.col("w")), "1"))
    one, all_ = F.lit(1.0), F.col("s0") + F.col("s1")
    d0, d1 = {"sta": (one / F.col("s0"), one / all_), "pos": (one / F.col("s0"), one * 0), "smp": (one / F.col("s0"), F.coalesce(F.try_divide(one, F.col("s1")), F.lit(0.0))), "gja": (one / all_, one / all_), "neg": (one * 0, F.try_divide(one, F.col("s1")))}[qtype]
    return both.select((d0 * F.col("x0") - d1 * F.col("x1")).alias("q"))


def community_sizes(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """comm, n, e, w of a mirrored graph: nodes, edges inside (once each) and their weight."""
    inside = _both(edges.where("src < dst"), parts).where("c1 = c2").groupBy(F.col("c1").alias("comm")).agg(F.count(F.lit(1)).alias("e"), F.sum("w").alias("w"))
    return parts.groupBy("comm").agg(F.count(F.lit(1)).alias("n")).join(inside, "comm", "left").select("comm", "n", F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("w", F.lit(0.0)).alias("w"))


def cpm(edges: DataFrame, parts: DataFrame, gamma: float) -> DataFrame:
    """quality of the constant Potts model: twice the weight inside less gamma n squared, over communities."""
    return community_sizes(edges, parts).agg(F.sum(2 * F.col("w") - gamma * F.col("n") * F.col("n")).alias("quality"))


def cpm_hamiltonian(edges: DataFrame, parts: DataFrame, gamma: float) -> DataFrame:
    return community_sizes(edges, parts).agg((-F.sum(F.col("e") - gamma * F.col("n") * F.col("n"))).alias("h"))


def rb_configuration(edges: DataFrame, parts: DataFrame, gamma: float) -> DataFrame:
    """quality: un-normalised modularity at resolution gamma."""
    c = modularity_sums(edges, parts)
    s = edges.agg(F.sum("w").alias("s"))
    return c.join(F.broadcast(s)).agg(F.sum(F.col("inside") - gamma * F.col("out") * F.col("into") / F.col("s")).alias("quality"))


def binary_kl(q, p):
    """Kullback-Leibler divergence of two binary distributions, in nats."""
    term = lambda a, b: F.when(a > 0, a * F.log(F.try_divide(a, b))).otherwise(0.0)
    return term(q, p) + term(1 - q, 1 - p)


def significance(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """quality: over communities n (n - 1) times the divergence of their density from the graph's."""
    n = parts.agg(F.count(F.lit(1)).alias("nn"))
    m = edges.where("src < dst").agg(F.count(F.lit(1)).alias("m"))
    c = community_sizes(edges, parts).where("n > 1").join(F.broadcast(n)).join(F.broadcast(m))
    p = 2 * F.col("m") / (F.col("nn") * (F.col("nn") - 1))
    q = 2 * F.col("e") / (F.col("n") * (F.col("n") - 1))
    return c.agg(F.sum(F.col("n") * (F.col("n") - 1) * binary_kl(q, p)).alias("quality"))


def surprise_parameters(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """mi, pi, m, p: edges and pairs inside communities, and in all."""
    inside = community_sizes(edges, parts).agg(F.sum("e").alias("mi"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pi"))
    m = edges.where("src < dst").agg(F.count(F.lit(1)).alias("m"))
    p = parts.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).cast("bigint").alias("p"))
    return inside.join(m).join(p)


def log_gamma(x):
    """Logarithm of the gamma function of a column above zero, by Stirling's series ten places on."""
    y = x + 10
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    back = sum((F.log(x + i) for i in range(1, 10)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - back


def log_binomial(n, k):
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def surprise(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """s: minus the decimal logarithm of the hypergeometric tail from mi on; the terms are rows, summed by their distance from the largest."""
    mi, pi, m, p = surprise_parameters(edges, parts).first()
    last = min(m, pi)
    if mi > last:
        raise ValueError("more edges inside communities than pairs")
    d = lambda x: F.lit(float(x))
    j = F.col("id").cast("double")
    terms = edges.sparkSession.range(mi, last + 1).where(F.lit(m) - F.col("id") <= p - pi)
    terms = terms.select((log_binomial(d(pi), j) + log_binomial(d(p - pi), d(m) - j) - log_binomial(d(p), d(m))).alias("t"))
    top = terms.agg(F.max("t").alias("top"))
    return terms.join(F.broadcast(top)).groupBy("top").agg(F.sum(F.exp(F.col("t") - F.col("top"))).alias("x")).select((-(F.col("top") + F.log("x")) / F.log(F.lit(10.0))).alias("s"))


def agreement(partitions: DataFrame) -> DataFrame:
    """a, b, n of node pairs: in how many of the partitions (part, node, comm) they are together."""
    p = partitions.select("part", "node", "comm")
    two = p.select("part", "comm", F.col("node").alias("b"))
    return p.join(two, ["part", "comm"]).where("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))


def agreement_weighted(partitions: DataFrame, weights: DataFrame) -> DataFrame:
    """a, b, x: sum of the weights (part, wt), scaled to sum 1, of the partitions that have a pair together."""
    total = weights.agg(F.sum("wt").alias("all"))
    p = partitions.select("part", "node", "comm").join(weights.join(F.broadcast(total)).select("part", (F.col("wt") / F.col("all")).alias("wt")), "part")
    two = p.select("part", "comm", F.col("node").alias("b"))
    return p.join(two, ["part", "comm"]).where("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.sum("wt").alias("x"))


def groups(parts: DataFrame) -> DataFrame:
    """comm and its members as a sorted list."""
    return parts.groupBy("comm").agg(F.sort_array(F.collect_set("node")).alias("members"))


def from_groups(listed: DataFrame) -> DataFrame:
    """Inverse of ``groups``: communities are numbered by place."""
    return listed.select(F.explode("members").alias("node"), "comm")


def renumbered(parts: DataFrame) -> DataFrame:
    """Labels 0, 1, .. in the order of each community's least node."""
    first = parts.groupBy("comm").agg(F.min("node").alias("first"))
    return parts.join(F.broadcast(_numbered(first, [F.col("first")])), "comm").select("node", F.col("number").alias("comm"))


def by_size(parts: DataFrame) -> DataFrame:
    """Labels 0, 1, .. from the largest community; of equals that of the lesser node first."""
    size = parts.groupBy("comm").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    return parts.join(_numbered(size, [F.desc("n"), F.col("first")]), "comm").select("node", F.col("number").alias("comm"))


def _numbered(comms: DataFrame, order: list) -> DataFrame:
    from .weights import ranked

    return ranked(comms, order).select("comm", (F.col("rank") - 1).cast("bigint").alias("number"))


def boundaries(parts: DataFrame) -> DataFrame:
    """comm, lo, hi: places of each community in a grid ordered by community and node."""
    size = parts.groupBy("comm").agg(F.count(F.lit(1)).alias("n"))
    w = W.orderBy("comm").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = size.withColumn("end", F.sum("n").over(w))  # one row for each community
    return ends.select("comm", (F.col("end") - F.col("n") - 0.5).alias("lo"), (F.col("end") - 0.5).alias("hi"))


def induced_graph(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges between communities with the sum of weights; loops hold the weight inside."""
    return _both(edges, parts).groupBy(F.col("c1").alias("src"), F.col("c2").alias("dst")).agg(F.sum("w").alias("w"))


def induced_modules(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """comm, src, dst, w: the edges inside each community."""
    return _both(edges, parts).where("c1 = c2").select(F.col("c1").alias("comm"), "src", "dst", "w")


def partition_at_level(dendrogram: DataFrame, level: int) -> DataFrame:
    """node, comm after the levels 0..level of (level, node, comm), each on the communities of the one before."""
    out = dendrogram.where("level = 0").select("node", "comm")
    for i in range(1, level + 1):
        step = dendrogram.where(F.col("level") == i).select(F.col("node").alias("comm"), F.col("comm").alias("next"))
        out = out.join(step, "comm").select("node", F.col("next").alias("comm"))
    return out


def subgraph_intensity(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, intensity, coherence: geometric mean of the weights, and its ratio to their mean."""
    g = F.exp(F.avg(F.log("w")))
    return edges.groupBy(*keys).agg(g.alias("intensity"), (g / F.avg("w")).alias("coherence"))


def contingency(one: DataFrame, two: DataFrame) -> DataFrame:
    """ca, cb, n: nodes in each pair of communities."""
    return one.select("node", F.col("comm").alias("ca")).join(two.select("node", F.col("comm").alias("cb")), "node").groupBy("ca", "cb").agg(F.count(F.lit(1)).alias("n"))


def compare(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: nmi, ha, hb (nats), vi, nvi (over ln n), vin and min (distance and mutual information), ari of two partitions."""
    c = contingency(one, two)
    a, b = c.groupBy("ca").agg(F.sum("n").alias("x")), c.groupBy("cb").agg(F.sum("n").alias("x"))
    pairs = lambda v: F.col(v) * (F.col(v) - 1) / 2
    side = lambda d, k: d.agg(F.sum(F.col("x") * F.log("x")).alias(f"l{k}"), F.sum(pairs("x")).alias(f"p{k}"), F.sum("x").alias(f"n{k}"))
    both = c.agg(F.sum(F.col("n") * F.log("n")).alias("lab"), F.sum(pairs("n")).alias("pab"))
    x = both.join(side(a, "a")).join(side(b, "b"))
    n = F.col("na")
    ha, hb, hab = (F.log(n) - F.col(c) / n for c in ("la", "lb", "lab"))
    x = x.select(n.alias("n"), ha.alias("ha"), hb.alias("hb"), hab.alias("hab"), "pa", "pb", "pab")
    mutual = F.col("ha") + F.col("hb") - F.col("hab")
    vi = F.greatest(F.lit(0.0), 2 * F.col("hab") - F.col("ha") - F.col("hb"))
    all_ = F.col("n") * (F.col("n") - 1) / 2
    expected = F.col("pa") * F.col("pb") / all_
    return x.select(
        F.coalesce(F.try_divide(2 * mutual, F.col("ha") + F.col("hb")), F.lit(1.0)).alias("nmi"), "ha", "hb", vi.alias("vi"), F.coalesce(F.try_divide(vi, F.log("n")), F.lit(0.0)).alias("nvi"),
        F.coalesce(F.try_divide(F.col("pab") - expected, (F.col("pa") + F.col("pb")) / 2 - expected), F.lit(1.0)).alias("ari"),
    )
