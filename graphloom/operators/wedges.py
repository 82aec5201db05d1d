"""Triangles, clustering, transitivity, and similarity of nodes by shared neighbours.

Triangles are found on edges that point from the node of lower degree to the higher
(ties by id), so that no node, hub or not, spans more than about sqrt(2 m) wedges;
lists of neighbours are shuffled, wedges are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions import neighbour_lists as lists
from graphloom.plans.shared import discard, stored

from . import weights

#: Ranks whose weights one task sums up in order.
RUN = 1 << 16


def _upward(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Edges src, dst, w of an undirected graph, once each and from the end of lower degree, with the degrees k1, k2; degrees (node, k); how many edges."""
    half = stored(edges.where("src < dst").select("src", "dst", F.col("w").cast("double").alias("w")), "half")
    k = stored(half.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("k")), "degrees")
    e = half.join(k.withColumnsRenamed({"node": "src", "k": "k1"}), "src").join(k.withColumnsRenamed({"node": "dst", "k": "k2"}), "dst")
    turn = lambda x, y: F.when(F.col("k1") <= F.col("k2"), F.col(x)).otherwise(F.col(y))
    up = stored(e.select(turn("src", "dst").alias("src"), turn("dst", "src").alias("dst"), "w", F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2")), "upward")
    discard(half)
    return up, k, up.count()


def triangles(edges: DataFrame) -> DataFrame:
    """a, b, c and the weights ab, ac, bc of every triangle of an undirected graph, once each."""
    up, _, m = _upward(edges)
    return lists.triangles(up, m).select("a", "b", "c", "ab", "ac", "bc")


def _around(t: DataFrame, intensity: bool) -> DataFrame:
    """node and the sum over its triangles of 1, or of the cube root of the weights' product."""
    x = F.cbrt(F.col("ab") * F.col("ac") * F.col("bc")) if intensity else F.lit(1.0)
    return t.select(F.explode(F.array("a", "b", "c")).alias("node"), x.alias("x")).groupBy("node").agg(F.sum("x").alias("t"))


def _plain(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.lit(1.0).alias("w"))


def clustering_und(edges: DataFrame, nodes: DataFrame, weighted: bool = False) -> DataFrame:
    """node, c: triangles around a node over the pairs of its neighbours; 0 without a pair."""
    up, k, m = _upward(edges if weighted else _plain(edges))
    got = nodes.select("node").join(k, "node", "left").join(_around(lists.triangles(up, m), weighted), "node", "left")
    return got.select("node", F.coalesce(2 * F.col("t") / F.when(F.col("k") > 1, F.col("k") * (F.col("k") - 1)), F.lit(0.0)).alias("c"))


def transitivity_und(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """t: three times the triangles over the connected triples."""
    up, k, m = _upward(edges if weighted else _plain(edges))
    t = lists.triangles(up, m).agg((6 * F.sum(F.cbrt(F.col("ab") * F.col("ac") * F.col("bc")) if weighted else F.lit(1.0))).alias("closed"))
    return t.join(F.broadcast(k.agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("triples")))).select(F.coalesce(F.try_divide("closed", "triples"), F.lit(0.0)).alias("t"))


def _cycles_dir(edges: DataFrame, nodes: DataFrame, weighted: bool) -> DataFrame:
    """node, cycles, triples of a directed graph: half of diag(S^3), and K(K-1) - 2 diag(A^2)."""
    e = edges.where("src <> dst")
    x = F.cbrt("w") if weighted else F.lit(1.0)
    s = e.select("src", "dst", x.alias("x")).unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), x.alias("x"))).groupBy("src", "dst").agg(F.sum("x").alias("w"))
    # the products of S over each triangle count once for either sense, which the half of diag(S^3) does as well
    t = triangles(s).select(F.explode(F.array("a", "b", "c")).alias("node"), (F.col("ab") * F.col("ac") * F.col("bc")).alias("x")).groupBy("node").agg(F.sum("x").alias("cycles"))
    deg = weights.degrees_dir(e, nodes).select("node", "deg")
    back = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("both"))
    got = deg.join(t, "node", "left").join(back, "node", "left")
    return got.select("node", F.coalesce("cycles", F.lit(0.0)).alias("cycles"), (F.col("deg") * (F.col("deg") - 1) - 2 * F.coalesce("both", F.lit(0))).alias("triples"))


def clustering_dir(edges: DataFrame, nodes: DataFrame, weighted: bool = False) -> DataFrame:
    """node, c of a directed graph; 0 where no triangle is possible."""
    return _cycles_dir(edges, nodes, weighted).select("node", F.when(F.col("triples") > 0, F.col("cycles") / F.col("triples")).otherwise(0.0).alias("c"))


def transitivity_dir(edges: DataFrame, nodes: DataFrame, weighted: bool = False) -> DataFrame:
    """t: all cycles over all possible ones."""
    return _cycles_dir(edges, nodes, weighted).agg(F.coalesce(F.try_divide(F.sum("cycles"), F.sum("triples")), F.lit(0.0)).alias("t"))


def flow_coefficient(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, fc, flow: paths i -> node -> j without a direct edge i -> j, over the pairs of its neighbours."""
    e = edges.where("src <> dst").select("src", "dst")
    two = e.select(F.col("src").alias("i"), F.col("dst").alias("v")).join(e.select(F.col("src").alias("v"), F.col("dst").alias("j")), "v").where("i <> j")
    through = two.join(e.select(F.col("src").alias("i"), F.col("dst").alias("j")), ["i", "j"], "left_anti").groupBy(F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("flow"))
    near = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    got = nodes.select("node").join(near, "node", "left").join(through, "node", "left").withColumn("flow", F.coalesce("flow", F.lit(0)))
    return got.select("node", F.coalesce(F.col("flow") / F.when(F.col("k") > 1, F.col("k") * (F.col("k") - 1)), F.lit(0.0)).alias("fc"), "flow")


def common_neighbours(edges: DataFrame) -> DataFrame:
    """a, b, n, ra, aa of pairs a < b that share neighbours: how many, and the sums of 1/k and 1/ln k over them."""
    e = edges.where("src <> dst").select("src", "dst")
    k = e.groupBy(F.col("src").alias("via")).agg(F.count(F.lit(1)).alias("k"))
    one = e.select(F.col("src").alias("a"), F.col("dst").alias("via"))
    pairs = one.join(k, "via").join(one.select(F.col("a").alias("b"), "via"), "via").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(1 / F.col("k")).alias("ra"), F.sum(1 / F.log("k")).alias("aa"))


def _corners(up: DataFrame, m: int) -> DataFrame:
    """src < dst, k, both: each edge of each triangle with the degree of the third node and the sum of its weights to both ends."""
    t = lists.triangles(up, m)
    corner = lambda x, y, k, wx, wy: F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"), F.col(k).alias("k"), (F.col(wx) + F.col(wy)).alias("both"))
    return t.select(F.explode(F.array(corner("a", "b", "kc", "ac", "bc"), corner("a", "c", "kb", "ab", "bc"), corner("b", "c", "ka", "ab", "ac"))).alias("x")).select("x.*")


def _ordered(up: DataFrame) -> DataFrame:
    """a < b with their degrees ka, kb."""
    least = F.col("src") < F.col("dst")
    return up.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.when(least, F.col("k1")).otherwise(F.col("k2")).alias("ka"), F.when(least, F.col("k2")).otherwise(F.col("k1")).alias("kb"))


def neighbour_scores(edges: DataFrame) -> DataFrame:
    """a, b and jaccard, resource allocation, Adamic-Adar, preferential attachment of each edge a < b."""
    up, _, m = _upward(_plain(edges))
    shared = _corners(up, m).groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(1 / F.col("k")).alias("ra"), F.sum(1 / F.log("k")).alias("aa"))
    got = _ordered(up).join(shared, ["a", "b"], "left")
    n = F.coalesce("n", F.lit(0))
    return got.select("a", "b", (n / (F.col("ka") + F.col("kb") - n)).alias("jaccard"), F.coalesce("ra", F.lit(0.0)).alias("ra"), F.coalesce("aa", F.lit(0.0)).alias("aa"), (F.col("ka") * F.col("kb")).alias("pa"))


def edge_neighbour_overlap(edges: DataFrame, directed: bool = False) -> DataFrame:
    """src, dst, overlap of each edge: shared neighbours over all neighbours, the ends left out; null without any."""
    e = edges.where("src <> dst").select("src", "dst")
    ends = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")) if directed else e.where("src < dst")
    up, _, m = _upward(_plain(ends.distinct()))
    shared = _corners(up, m).groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    # each end is a neighbour of the other
    got = _ordered(up).join(shared, ["a", "b"], "left").select("a", "b", F.try_divide(n, F.col("ka") + F.col("kb") - n - 2).alias("overlap"))
    if directed:
        return e.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(got, ["a", "b"]).select("src", "dst", "overlap")
    way = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))
    return got.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("x"), "overlap").select("x.src", "x.dst", "overlap")


def matching_index(edges: DataFrame) -> DataFrame:
    """a, b, m_in, m_out, m_all of pairs a < b that share a neighbour: twice the shared over the sum of edges, those between the two left out."""
    e = edges.where("src <> dst").select("src", "dst")

    def half(node: str, via: str, name: str) -> DataFrame:
        one = e.select(F.col(node).alias("a"), F.col(via).alias("via"))
        return one.join(one.select(F.col("a").alias("b"), "via"), "via").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias(name))

    inner, outer = half("dst", "src", "si"), half("src", "dst", "so")
    i, o = e.groupBy("dst").agg(F.count(F.lit(1)).alias("k")), e.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    got = inner.join(outer, ["a", "b"], "full")
    for end in "ab":
        got = got.join(i.select(F.col("dst").alias(end), F.col("k").alias(f"i{end}")), end, "left").join(o.select(F.col("src").alias(end), F.col("k").alias(f"o{end}")), end, "left")
    got = got.join(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("fwd")), ["a", "b"], "left").join(e.select(F.col("src").alias("b"), F.col("dst").alias("a"), F.lit(1).alias("bwd")), ["a", "b"], "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    # an edge a -> b is an outgoing one of a and an incoming one of b
    mutual = z("fwd") + z("bwd")
    n_in, n_out = z("ia") + z("ib") - mutual, z("oa") + z("ob") - mutual
    share = lambda s, n: F.coalesce(F.try_divide(2 * s, n), F.lit(0.0))
    return got.select("a", "b", share(z("si"), n_in).alias("m_in"), share(z("so"), n_out).alias("m_out"), share(z("si") + z("so"), n_in + n_out).alias("m_all"))


def dice(one: DataFrame, two: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, dice: shared neighbours in two graphs, twice, over the sum of degrees; 0 without edges."""
    both = one.where("src <> dst").select("src", "dst", F.lit(1).alias("x")).join(two.where("src <> dst").select("src", "dst", F.lit(1).alias("y")), ["src", "dst"], "full")
    z = lambda c: F.coalesce(c, F.lit(0))
    got = both.groupBy(F.col("src").alias("node")).agg(F.sum(z("x") * z("y")).alias("c"), F.sum(z("x") + z("y")).alias("k"))
    return nodes.select("node").join(got, "node", "left").select("node", F.coalesce(2 * F.col("c") / F.col("k"), F.lit(0.0)).alias("dice"))


def correlation(one: DataFrame, two: DataFrame, nodes: DataFrame, directed: bool = True) -> DataFrame:
    """r: Pearson correlation of all off-diagonal cells of two matrices, absent cells being zero."""
    where = "src <> dst" if directed else "src < dst"
    both = one.where(where).select("src", "dst", F.col("w").alias("x")).join(two.where(where).select("src", "dst", F.col("w").alias("y")), ["src", "dst"], "full")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    sums = both.agg(*[F.sum(v).alias(n) for n, v in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))])
    n = nodes.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / (1 if directed else 2)).alias("n"))
    c = lambda a, b, s: F.col("n") * F.col(s) - F.col(a) * F.col(b)
    return sums.join(F.broadcast(n)).select((c("sx", "sy", "sxy") / F.sqrt(c("sx", "sx", "sxx") * c("sy", "sy", "syy"))).alias("r"))


def assortativity(edges: DataFrame, nodes: DataFrame, flag: int = 0, weighted: bool = False) -> DataFrame:
    """r of the degrees (strengths) at both ends of the edges.

    flag 0: undirected; 1: out-in; 2: in-out; 3: out-out; 4: in-in, of directed graphs.
    """
    if flag == 0:
        d = (weights.strengths_und(edges, nodes) if weighted else weights.degrees_und(edges, nodes)).toDF("node", "x")
        first, second, e = d, d, edges.where("src < dst")
    else:
        d = weights.strengths_dir(edges, nodes) if weighted else weights.degrees_dir(edges, nodes)
        i, o = ("is", "os") if weighted else ("id", "od")
        one, two = {1: (o, i), 2: (i, o), 3: (o, o), 4: (i, i)}[flag]
        first, second, e = d.select("node", F.col(one).alias("x")), d.select("node", F.col(two).alias("x")), edges.where("src <> dst")
    ends = e.select("src", "dst").join(first.select(F.col("node").alias("src"), F.col("x").cast("double").alias("x")), "src").join(second.select(F.col("node").alias("dst"), F.col("x").cast("double").alias("y")), "dst")
    a, b, c = F.avg(F.col("x") * F.col("y")), F.pow(F.avg((F.col("x") + F.col("y")) / 2), 2), F.avg((F.col("x") * F.col("x") + F.col("y") * F.col("y")) / 2)
    return ends.agg(F.try_divide(a - b, c - b).alias("r"))


def local_reweighting(edges: DataFrame) -> DataFrame:
    """src, dst, w: weights scaled by how strongly the ends are tied to each other and to shared neighbours."""
    e = edges.where("src <> dst").select("src", "dst", "w")
    s = e.groupBy("src").agg(F.sum("w").alias("s"))
    all_ = e.agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("count"))
    up, _, m = _upward(e)
    shared = _corners(up, m).groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.sum("both").alias("t"))
    ends = e.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    got = ends.join(shared, ["a", "b"], "left").join(s.withColumnRenamed("s", "si"), "src").join(s.select(F.col("src").alias("dst"), F.col("s").alias("sj")), "dst").join(F.broadcast(all_))
    tie = 2 * (F.col("w") + 0.5 * F.coalesce("t", F.lit(0.0))) / (F.col("si") + F.col("sj"))
    raw = got.select("src", "dst", (F.col("count") * F.col("w") / F.col("total") * tie).alias("x"))
    rows = raw.groupBy("src").agg(F.sum("x").alias("row"))
    return raw.join(rows, "src").select("src", "dst", (F.col("x") / F.col("row")).alias("w"))


def _levels(edges: DataFrame, nodes: DataFrame, directed: bool) -> DataFrame:
    """lo, hi and nk, ek, wk: nodes of degree over each k in lo..hi, edges and weight among them.

    One row for each distinct degree, of which a graph of m edges has at most about 2 sqrt(m).
    """
    d = (weights.degrees_dir(edges, nodes) if directed else weights.degrees_und(edges, nodes)).select("node", "deg")
    ends = edges.join(d.select(F.col("node").alias("src"), F.col("deg").alias("d1")), "src").join(d.select(F.col("node").alias("dst"), F.col("deg").alias("d2")), "dst")
    least = ends.groupBy(F.least("d1", "d2").alias("deg")).agg(F.count(F.lit(1)).alias("e"), F.sum("w").alias("s"))
    levels = d.groupBy("deg").agg(F.count(F.lit(1)).alias("v")).join(least, "deg", "left")
    above = W.orderBy(F.desc("deg")).rowsBetween(W.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    below = F.coalesce(F.max("deg").over(W.orderBy(F.desc("deg")).rowsBetween(1, 1)), F.lit(0))
    return levels.select(below.alias("lo"), (F.col("deg") - 1).alias("hi"), total("v").alias("nk"), total("e").alias("ek"), total("s").alias("wk"))


def rich_club(edges: DataFrame, nodes: DataFrame, directed: bool = False) -> DataFrame:
    """k, nk, ek, r: nodes of degree over k, edges among them, and their share of all possible ones."""
    levels = _levels(edges.where("src <> dst"), nodes, directed)
    rows = levels.where("hi >= 1").select(F.explode(F.sequence(F.greatest("lo", F.lit(1).cast("bigint")), F.col("hi"))).alias("k"), "nk", "ek")
    last = levels.agg(F.max(F.col("hi") + 1).alias("k")).where("k >= 1").select("k", F.lit(0).cast("bigint").alias("nk"), F.lit(0).cast("bigint").alias("ek"))
    return rows.unionByName(last).select("k", "nk", "ek", F.try_divide(F.col("ek"), F.col("nk") * (F.col("nk") - 1)).alias("r"))


def rich_club_weighted(edges: DataFrame, nodes: DataFrame, directed: bool = False) -> DataFrame:
    """k, r: weight among nodes of degree k or more over the sum of as many of the strongest weights."""
    e = edges.where("src <> dst")
    levels = _levels(e, nodes, directed).where("hi >= 0").select(F.explode(F.sequence(F.col("lo") + 1, F.col("hi") + 1)).alias("k"), F.when(F.col("ek") > 0, F.col("ek")).alias("ek"), F.when(F.col("ek") > 0, F.col("wk")).alias("wk"))
    strong = weights.ranked(e.select("w", "src", "dst"), [F.desc("w"), F.col("src"), F.col("dst")])
    # sums of the strongest weights: of whole runs of ranks, and inside each run
    strong = strong.select("w", "rank", F.floor((F.col("rank") - 1) / RUN).alias("run"))
    runs = strong.groupBy("run").agg(F.sum("w").alias("s"))
    runs = runs.select("run", F.coalesce(F.sum("s").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    inside = F.sum("w").over(W.partitionBy("run").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    best = strong.select("run", F.col("rank").alias("ek"), inside.alias("inside")).join(levels.select("ek").distinct(), "ek", "left_semi").join(runs, "run").select("ek", (F.col("before") + F.col("inside")).alias("top"))
    return levels.join(best, "ek", "left").select("k", F.try_divide("wk", "top").alias("r"))


def matching_und(edges: DataFrame) -> DataFrame:
    """src, dst, m of ordered pairs that share a neighbour: twice the shared ones over those and dst's other neighbours, src left out."""
    e = stored(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    got = lists.shared_neighbours(e, e.count())
    return got.select(F.col("x").alias("src"), F.col("y").alias("dst"), (2 * F.col("n") / (F.col("ky") - F.col("tied").cast("int") + F.col("n"))).alias("m"))


def topological_overlap(edges: DataFrame, steps: int = 1) -> DataFrame:
    """a < b, overlap: shared nodes within ``steps`` edges (one more if a and b are tied) over those of the larger neighbourhood, of pairs that have any."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    near = e
    for _ in range(steps - 1):
        near = near.unionByName(near.select("src", F.col("dst").alias("via")).join(e.select(F.col("src").alias("via"), "dst"), "via").where("src <> dst").select("src", "dst")).distinct()
    k = near.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    shared = near.select(F.col("src").alias("a"), F.col("dst").alias("via")).join(near.select(F.col("src").alias("b"), F.col("dst").alias("via")), "via").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    got = shared.join(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("t")).where("a < b"), ["a", "b"], "full")
    got = got.join(k.select(F.col("src").alias("a"), F.col("k").alias("ka")), "a").join(k.select(F.col("src").alias("b"), F.col("k").alias("kb")), "b")
    n, t = F.coalesce("n", F.lit(0)), F.coalesce("t", F.lit(0))
    return got.select("a", "b", ((n + t) / (F.greatest("ka", "kb") - t + 1)).alias("overlap"))


def rentian(edges: DataFrame, places: DataFrame, boxes: DataFrame) -> DataFrame:
    """box, nodes, edges: nodes (node, x, y, z) inside each box (box, lo, hi on all axes) and edges that cross its surface."""
    inside = places.join(F.broadcast(boxes), (F.least("x", "y", "z") > F.col("lo")) & (F.greatest("x", "y", "z") < F.col("hi"))).select("box", "node")
    n = inside.groupBy("box").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.where("src < dst").select(F.monotonically_increasing_id().alias("e"), F.explode(F.array("src", "dst")).alias("node"))
    crossing = e.join(inside, "node").groupBy("box", "e").agg(F.count(F.lit(1)).alias("ends")).where("ends = 1").groupBy("box").agg(F.count(F.lit(1)).alias("edges"))
    return boxes.select("box").join(n, "box", "left").join(crossing, "box", "left").select("box", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))
