"""Rewiring that preserves degrees, and generators, as sampling jobs; a seed gives the same graph again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.components import connected_components
from graphloom.operators.weights import ranked
from graphloom.plans.shared import stored


def rewire(edges: DataFrame, rounds: int = 5, seed: int = 1, directed: bool = True, lattice: bool = False, by_sign: bool = False, connected: bool = False, stride: int = 0, avoid: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst, w) with the same degrees and other ends; weights go with the sources.

    In a round, edges fall into buckets by hash and the first and last of each bucket
    swap their targets, unless that makes a loop or an edge that exists or that two
    swaps would make.  lattice: only swaps that bring ends nearer; by_sign: only edges
    of the same sign, which change places with what joins their ends crosswise if that
    is of one other sign (or absent) on both sides; connected: rounds that split the graph are taken back.
    stride: nodes k * stride .. are the k-th of several graphs that are rewired together, each in itself.
    avoid (src, dst): places where no swap puts an edge (not with by_sign); edges that stand there may stay.
    Undirected graphs are mirrored and come back mirrored.
    """
    if avoid is not None and by_sign:
        raise ValueError("avoid does not go with by_sign")
    shut = None if avoid is None else stored((avoid if directed else avoid.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))).select("src", "dst").distinct(), "avoid")
    now = edges.where("src <> dst").select("src", "dst", "w")
    now = stored(now if directed else now.where("src < dst"), "rewired")
    n = now.count()
    graphs = now.select(F.floor(F.col("src") / stride)).distinct().count() if stride else 1
    pieces = _pieces(now) if connected else 0
    for r in range(rounds):
        h = F.xxhash64("src", "dst", F.lit(seed), F.lit(r))
        turn = (F.pmod(h, F.lit(7)) < 3) if not directed else F.lit(False)
        e = now.select(h.alias("h"), F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("s"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("t"), "w", "src", "dst")
        sign = F.signum("w") if by_sign else F.lit(0.0)
        graph = F.floor(F.col("src") / stride).cast("bigint") if stride else F.lit(0)
        bucket = e.groupBy((graph * n + F.pmod(F.col("h"), F.lit(max(1, n // 2 // graphs)))).alias("b"), sign.alias("sign"))
        two = bucket.agg(F.min(F.struct("h", "s", "t", "w", "src", "dst")).alias("x"), F.max(F.struct("h", "s", "t", "w", "src", "dst")).alias("y")).where("x.h < y.h")
        a, b, c, d = (F.col(k) for k in ("x.s", "x.t", "y.s", "y.t"))
        ok = (a != d) & (c != b) & (a != c) & (b != d)
        if lattice:
            ok = ok & (F.abs(a - d) + F.abs(c - b) < F.abs(a - b) + F.abs(c - d))
        if by_sign:
            new = stored(_exchanged(now, two.where(ok), directed), "rewired")
            now = new if not connected or _pieces(new) <= pieces else now
            continue
        two = two.where(ok).select("b", "sign", F.array(F.struct(a.alias("s"), d.alias("t"), F.col("x.w").alias("w")), F.struct(c.alias("s"), b.alias("t"), F.col("y.w").alias("w"))).alias("new"), F.array("x", "y").alias("old"))
        ends = (lambda s, t: (s, t)) if directed else (lambda s, t: (F.least(s, t), F.greatest(s, t)))
        made = two.select("b", "sign", F.explode("new").alias("e")).select("b", "sign", *[x.alias(k) for x, k in zip(ends(F.col("e.s"), F.col("e.t")), ("src", "dst"), strict=True)], "e.w")
        made = stored(made, "made")
        # a swap counts if both its edges are new and nobody else's
        taken = now.select("src", "dst") if shut is None else now.select("src", "dst").unionByName(shut)
        clash = made.join(taken, ["src", "dst"], "left_semi").select("b", "sign").unionByName(made.join(made.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), ["src", "dst"]).select("b", "sign")).distinct()
        made = made.join(clash, ["b", "sign"], "left_anti")
        gone = two.join(clash, ["b", "sign"], "left_anti").select(F.explode("old").alias("e")).select("e.src", "e.dst")
        new = stored(now.join(gone, ["src", "dst"], "left_anti").unionByName(made.select("src", "dst", "w")), "rewired")
        if not connected or _pieces(new) <= pieces:
            now = new
    return now if directed else now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def _exchanged(now: DataFrame, two: DataFrame, directed: bool) -> DataFrame:
    """Exchange the weights of a-b, c-d with those of a-d, c-b in the pairs ``two``; no place takes part in two exchanges."""
    ends = (F.col("p.s"), F.col("p.t")) if directed else (F.least("p.s", "p.t"), F.greatest("p.s", "p.t"))
    place = lambda i, s, t: F.struct(F.lit(i).alias("i"), F.col(s).alias("s"), F.col(t).alias("t"))
    four = two.select("b", "sign", F.explode(F.array(place(0, "x.s", "x.t"), place(1, "y.s", "y.t"), place(2, "x.s", "y.t"), place(3, "y.s", "x.t"))).alias("p"))
    four = four.select("b", "sign", "p.i", ends[0].alias("src"), ends[1].alias("dst")).join(now, ["src", "dst"], "left")
    four = stored(four, "places")
    sign = lambda i: F.max(F.when(F.col("i") == i, F.coalesce(F.signum("w"), F.lit(0.0))))
    fit = four.groupBy("b", "sign").agg(sign(2).alias("r2"), sign(3).alias("r3"), F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("of")).where("r2 = r3 AND r2 <> sign")
    four = stored(four.join(fit.select("b", "sign", "of"), ["b", "sign"]), "fitting")
    # of exchanges that want the same place, the one of least bucket goes on
    first = four.groupBy("src", "dst").agg(F.min(F.struct("b", "sign")).alias("first"))
    late = four.join(first, ["src", "dst"]).where(F.struct("b", "sign") != F.col("first")).select("b", "sign").distinct()
    done = four.join(late, ["b", "sign"], "left_anti").select("src", "dst", F.element_at("of", (F.col("i") + 2) % 4).alias("w"))
    return now.join(done, ["src", "dst"], "left_anti").unionByName(done.where("w IS NOT NULL"))


def _pieces(edges: DataFrame) -> int:
    return connected_components(edges).agg(F.count_distinct("comp")).first()[0]


def _numbered(nodes: DataFrame) -> DataFrame:
    return ranked(nodes.select("node"), [F.col("node")]).select("node", (F.col("rank") - 1).alias("i"))


def random_edges(nodes: DataFrame, k: int, seed: int = 1, directed: bool = True) -> DataFrame:
    """k different random edges without loops among the nodes; mirrored if undirected."""
    spark = nodes.sparkSession
    v = stored(_numbered(nodes), "nodes")
    n = v.count()
    most = n * (n - 1) // (1 if directed else 2)
    if k > most:
        raise ValueError(f"{k} edges; {most} are possible")
    if 2 * k > most:  # dense: leave edges out of all
        i, j = (F.col("id") / n).cast("bigint"), F.col("id") % n
        pool = spark.range(n * n).select(i.alias("a"), j.alias("b")).where("a <> b" if directed else "a < b")
    else:
        draws = spark.range(4 * k + 64).select(*[F.pmod(F.xxhash64("id", F.lit(seed), F.lit(x)), F.lit(n)).alias(c) for x, c in enumerate("ab")]).where("a <> b")
        pool = (draws if directed else draws.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    pick = ranked(pool, [F.xxhash64("a", "b", F.lit(seed)), F.col("a"), F.col("b")]).where(F.col("rank") <= k).drop("rank")
    e = pick.join(v.select(F.col("i").alias("a"), F.col("node").alias("src")), "a").join(v.select(F.col("i").alias("b"), F.col("node").alias("dst")), "b").select("src", "dst", F.lit(1.0).alias("w"))
    return e if directed else e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def ring_lattice(nodes: DataFrame, k: int) -> DataFrame:
    """Directed edges from each node to its nearest k / n on a ring, both sides in turn; k edges in all, the rest by distance and id."""
    v = stored(_numbered(nodes), "nodes")
    n = v.count()
    each = min(n - 1, -(-k // n))
    step = F.when(F.col("o") % 2 == 0, F.floor(F.col("o") / 2) + 1).otherwise(-(F.floor(F.col("o") / 2) + 1))
    e = v.select(F.col("node").alias("src"), "i", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("o")).withColumn("j", F.pmod(F.col("i") + step, F.lit(n)))
    pick = ranked(e, [F.col("o"), F.col("i")]).where(F.col("rank") <= k)
    return pick.join(v.select(F.col("i").alias("j"), F.col("node").alias("dst")), "j").select("src", "dst", F.lit(1.0).alias("w"))


def ring_of_cliques(spark: SparkSession, size: int, cliques: int) -> DataFrame:
    """Mirrored edges of cliques of ``size`` nodes, tied into a ring by one edge each."""
    own = spark.range(cliques * size * size).select((F.col("id") / (size * size)).cast("bigint").alias("c"), ((F.col("id") % (size * size)) / size).cast("bigint").alias("i"), (F.col("id") % size).alias("j")).where("i <> j")
    own = own.select((F.col("c") * size + F.col("i")).alias("src"), (F.col("c") * size + F.col("j")).alias("dst"))
    tie = spark.range(cliques).select((F.col("id") * size).alias("src"), (F.pmod(F.col("id") + 1, F.lit(cliques)) * size + 1).alias("dst"))
    both = own.unionByName(tie).unionByName(tie.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.select("src", "dst", F.lit(1.0).alias("w"))


def cliques(parts: DataFrame) -> DataFrame:
    """Mirrored edges between all nodes of the same community."""
    two = parts.select("comm", F.col("node").alias("dst"))
    return parts.select("comm", F.col("node").alias("src")).join(two, "comm").where("src <> dst").select("src", "dst", F.lit(1.0).alias("w"))


def ring_of_groups(parts: DataFrame) -> DataFrame:
    """Mirrored edges of one clique for each community, tied into a ring in the order of their sizes (ties by community).

    The last node of a clique is tied to the first of the next, the last of all to the
    first of all; with one community there is no ring.
    """
    ends = parts.groupBy("comm").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("low"), F.max("node").alias("high"))
    at = stored(ranked(ends, [F.col("size"), F.col("comm")]), "ring")
    n = F.broadcast(at.agg(F.count(F.lit(1)).alias("n")))
    nxt = at.join(n).select((F.when(F.col("rank") == 1, F.col("n")).otherwise(F.col("rank") - 1)).alias("rank"), F.col("low").alias("dst"), F.col("comm").alias("to"))
    tie = at.join(nxt, "rank").where("comm <> to").select(F.col("high").alias("src"), "dst", F.lit(1.0).alias("w"))
    return cliques(parts).unionByName(tie).unionByName(tie.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).distinct()


def cliques_on_random(nodes: DataFrame, parts: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """Mirrored edges of the largest component of a random graph of k edges, with one clique for each community hung on it.

    The first node of each clique is tied to a node of the component that a hash of the
    community picks.  nodes and parts hold different ids; of components of equal size
    the one of the least node stays.
    """
    drawn = stored(random_edges(nodes, k, seed, False), "random")
    comp = connected_components(drawn)
    most = F.broadcast(comp.groupBy("comp").count().agg(F.max_by("comp", F.struct("count", -F.col("comp"))).alias("comp")))
    base = stored(_numbered(comp.join(most, "comp").select("node")), "giant")
    kept = drawn.join(base.select(F.col("node").alias("src")), "src", "left_semi")
    low = parts.groupBy("comm").agg(F.min("node").alias("dst")).join(F.broadcast(base.agg(F.count(F.lit(1)).alias("n"))))
    pick = low.select("dst", F.pmod(F.xxhash64("comm", F.lit(seed)), F.col("n")).alias("i"))
    tie = pick.join(base.withColumnRenamed("node", "src"), "i").select("src", "dst", F.lit(1.0).alias("w"))
    return kept.unionByName(cliques(parts)).unionByName(tie).unionByName(tie.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def hierarchical(nodes: DataFrame, cluster: int, falloff: float, seed: int = 1) -> DataFrame:
    """Directed edges between all nodes of a cluster of 2 ** cluster, and beyond with probability falloff ** -level."""
    v = stored(_numbered(nodes), "nodes")
    n = v.count()
    pairs = nodes.sparkSession.range(n * n).select((F.col("id") / n).cast("bigint").alias("a"), (F.col("id") % n).alias("b")).where("a <> b")
    level = F.greatest(F.lit(0), F.floor(F.log2(F.bitwise_xor("a", "b"))) + 1 - cluster) if hasattr(F, "bitwise_xor") else F.greatest(F.lit(0), F.floor(F.log2(F.col("a").bitwiseXOR(F.col("b")))) + 1 - cluster)
    draw = F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    e = pairs.where(draw < F.pow(F.lit(falloff), -level))
    return e.join(v.select(F.col("i").alias("a"), F.col("node").alias("src")), "a").join(v.select(F.col("i").alias("b"), F.col("node").alias("dst")), "b").select("src", "dst", F.lit(1.0).alias("w"))


def small_worldness(edges: DataFrame, nodes: DataFrame, runs: int = 3, seed: int = 1) -> DataFrame:
    """c, l of the graph, their means over random graphs of as many edges, and the quotient of the ratios."""
    from . import paths as R
    from . import wedges as T

    k = edges.where("src < dst").count()
    measure = lambda e: T.clustering_und(e, nodes).agg(F.avg("c").alias("c")).join(R.breadth_distances(e).where("src <> dst").agg(F.avg("d").alias("l")))
    rand = None
    for r in range(runs):
        one = measure(stored(random_edges(nodes, k, seed + r, False), "random"))
        rand = one if rand is None else rand.unionByName(one)
    rand = rand.agg(F.avg("c").alias("c_rand"), F.avg("l").alias("l_rand"))
    return measure(edges).join(rand).select("c", "l", "c_rand", "l_rand", F.try_divide(F.col("c") / F.col("c_rand"), F.col("l") / F.col("l_rand")).alias("sigma"))
