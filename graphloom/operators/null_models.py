"""Null models: graphs that keep degrees and strengths, graphs of given degrees, covariances of given moments."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import stored

from .random_graphs import rewire
from .weights import ranked

#: Pairs of a wrong edge and another that a round of ``graph_of_degrees`` looks at, about.
TRIALS = 1 << 20


def null_model(edges: DataFrame, nodes: DataFrame, runs: int = 1, swaps: int = 5, steps: int = 10, directed: bool = False, seed: int = 1) -> DataFrame:
    """run, src, dst, w: random graphs with the degrees of each sign, the same weights, and nearly the strengths; runs 1 ..

    The places of both signs are rewired ``swaps`` times.  Then weights come back by rank: in each
    of ``steps`` steps the places left are ranked by the product of what strength their ends still lack for
    each of their open places, the weights left by size, and a random share of the places takes the weight of its rank.
    Ranks are distributed and hold all runs and signs at once.  Loops are left out; undirected graphs
    are mirrored.
    """
    number = stored(ranked(nodes.select("node").distinct(), [F.col("node")]).select("node", (F.col("rank") - 1).alias("i")), "numbers")
    n = number.count()
    e = edges.where("src <> dst AND w <> 0").select("src", "dst", "w")
    by = lambda c: number.select(F.col("node").alias(c), F.col("i").alias(f"{c}_i"))
    e = e.join(by("src"), "src").join(by("dst"), "dst").select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(runs).cast("bigint"))).alias("run"), F.col("src_i").alias("src"), F.col("dst_i").alias("dst"), "w")
    e = e.select((F.col("run") * n + F.col("src")).alias("src"), (F.col("run") * n + F.col("dst")).alias("dst"), "w")
    e = stored(e, "copies")
    half = lambda d: d if directed else d.where("src < dst")
    sign, size = F.signum("w").alias("sign"), F.abs("w").alias("w")
    run = F.floor(F.col("src") / n).cast("bigint").alias("run")
    ends = lambda d: d.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("into"), "sign", "w"), F.struct(F.col("dst").alias("node"), F.lit(1 if directed else 0).alias("into"), "sign", "w"))).alias("x")).groupBy("x.node", "x.into", "x.sign").agg(F.sum("x.w").alias("s"))
    signed = half(e).select("src", "dst", run, sign, size)
    lack = stored(ends(signed), "strengths")
    weights = stored(signed.select("run", "sign", "w").withColumn("h", F.monotonically_increasing_id()), "weights")
    places = stored(half(rewire(e, swaps, seed, directed, by_sign=True, stride=n)).select("src", "dst", run, sign), "places")
    done = None
    for step in range(steps, 0, -1):
        free = ends(places.withColumn("w", F.lit(1.0))).withColumnRenamed("s", "free")
        each = lack.join(free, ["node", "into", "sign"]).withColumn("s", F.col("s") / F.col("free"))
        s = lambda end, into: each.where(F.col("into") == into).select(F.col("node").alias(end), "sign", F.col("s").alias(f"s_{end}"))  # noqa: B023, E731
        open_ = places.join(s("src", 0), ["src", "sign"]).join(s("dst", 1 if directed else 0), ["dst", "sign"])
        expected = F.greatest("s_src", F.lit(0.0)) * F.greatest("s_dst", F.lit(0.0))
        order = [F.col("run"), F.col("sign"), F.col("x"), F.col("h")]
        left = ranked(open_.select("src", "dst", "run", "sign", expected.alias("x"), F.xxhash64("src", "dst", F.lit(seed)).alias("h")), order)
        right = ranked(weights.withColumn("x", F.col("w")), order).select("rank", "w", F.col("h").alias("wh"))
        take = F.pmod(F.xxhash64("src", "dst", F.lit(seed), F.lit(step)), F.lit(1 << 30)) < F.lit((1 << 30) // step)
        given = stored(left.join(right, "rank").select("src", "dst", "run", "sign", "w", "wh", take.alias("take")), "given")
        new = given.where("take").select("src", "dst", "run", "sign", "w")
        done = new if done is None else done.unionByName(new)
        places = given.where("NOT take").select("src", "dst", "run", "sign")
        weights = given.where("NOT take").select("run", "sign", "w", F.col("wh").alias("h"))
        spent = ends(new).select("node", "into", "sign", F.col("s").alias("t"))
        lack = stored(lack.join(spent, ["node", "into", "sign"], "left").select("node", "into", "sign", (F.col("s") - F.coalesce("t", F.lit(0.0))).alias("s")), "strengths")
    back = lambda c: number.select(F.col("i").alias(f"{c}_i"), F.col("node").alias(f"{c}_n"))
    out = done.select("run", F.pmod("src", F.lit(n)).alias("src_i"), F.pmod("dst", F.lit(n)).alias("dst_i"), (F.col("w") * F.col("sign")).alias("w"))
    out = out.join(back("src"), "src_i").join(back("dst"), "dst_i").select("run", F.col("src_n").alias("src"), F.col("dst_n").alias("dst"), "w")
    return out if directed else out.unionByName(out.select("run", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def strength_correlation(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """run, sign, r: correlation of the strengths of nodes in ``old`` with those in each run of ``new`` (out-strengths of directed graphs)."""
    part = lambda e, keys, name: e.where("w <> 0 AND src <> dst").groupBy(*keys, F.col("src").alias("node"), F.signum("w").alias("sign")).agg(F.sum("w").alias(name))
    runs = new.select("run").distinct()
    signs = old.where("w <> 0").select(F.signum("w").alias("sign")).distinct()
    all_ = nodes.select("node").join(F.broadcast(signs)).join(F.broadcast(runs))
    x = all_.join(part(old, [], "a"), ["node", "sign"], "left").join(part(new, ["run"], "b"), ["run", "node", "sign"], "left")
    x = x.select("run", "sign", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    return x.groupBy("run", "sign").agg(F.corr("a", "b").alias("r"))


def graph_of_degrees(degrees: DataFrame, seed: int = 1, max_rounds: int = 200) -> DataFrame:
    """src, dst, w = 1: a random directed graph without loops and multiple edges whose nodes have k_in and k_out edges.

    degrees: node, k_in, k_out.  The ends of edges are numbered in random order (distributed ranks) and those of
    equal number joined.  Loops and copies then exchange ends with edges picked by hash among
    those that fit, until none is left; raises if the sums differ or that does not come to an end.
    """
    sums = degrees.agg(F.coalesce(F.sum("k_in"), F.lit(0)), F.coalesce(F.sum("k_out"), F.lit(0))).first()
    if sums[0] != sums[1]:
        raise ValueError(f"in-degrees sum to {sums[0]}, out-degrees to {sums[1]}")
    stub = lambda k, salt: ranked(degrees.where(F.col(k) > 0).select("node", F.explode(F.sequence(F.lit(1), F.col(k).cast("int"))).alias("i")).withColumn("h", F.xxhash64("node", "i", F.lit(seed), F.lit(salt))), [F.col("h"), F.col("node"), F.col("i")])
    now = stub("k_out", 0).select("rank", F.col("node").alias("src")).join(stub("k_in", 1).select("rank", F.col("node").alias("dst")), "rank")
    now = stored(now.select(F.col("rank").alias("id"), "src", "dst"), "stubs")
    for turn in range(max_rounds):
        first = now.groupBy("src", "dst").agg(F.min("id").alias("first"))
        marked = stored(now.join(first, ["src", "dst"]).withColumn("bad", (F.col("src") == F.col("dst")) | (F.col("id") != F.col("first"))), "marked")
        bad = marked.where("bad").count()
        if not bad:
            return now.select("src", "dst", F.lit(1.0).alias("w"))
        # bad edges (a, b) meet all other edges (c, d) of their bucket and make (a, d) and (c, b)
        there = F.greatest(F.count(F.lit(1)) - bad, F.lit(1))
        buckets = marked.agg(F.ceil(F.least(there * bad / TRIALS, there / 2 + 1))).first()[0]
        bucket = lambda *salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(turn), *map(F.lit, salt)), F.lit(buckets)).alias("bucket")  # noqa: B023, E731
        x = marked.where("bad").select(F.col("id").alias("x"), F.col("src").alias("a"), F.col("dst").alias("b"), bucket(1))
        y = marked.where("NOT bad").select(F.col("id").alias("y"), F.col("src").alias("c"), F.col("dst").alias("d"), bucket())
        have = now.select("src", "dst").distinct()
        is_there = lambda src, dst, name: have.select(F.col("src").alias(src), F.col("dst").alias(dst), F.lit(1).alias(name))  # noqa: E731, B023
        met = x.join(y, "bucket").where("a <> d AND c <> b").join(is_there("a", "d", "ad"), ["a", "d"], "left").where("ad IS NULL").join(is_there("c", "b", "cb"), ["c", "b"], "left")
        # one partner each: if possible one with which both edges are new; else what is wrong moves on to (c, b)
        best = F.min_by(F.struct("x", "y", "a", "b", "c", "d", "cb"), F.struct(F.coalesce("cb", F.lit(0)), F.xxhash64("x", "y", F.lit(seed), F.lit(turn)))).alias("p")
        one = met.groupBy("x").agg(best).select("p.*")
        one = stored(one.groupBy("y").agg(best).select("p.*"), "swaps")
        # of swaps that make the same new edge the first counts
        made = one.select("x", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("d").alias("dst"), F.lit(True).alias("new")), F.struct(F.col("c").alias("src"), F.col("b").alias("dst"), F.isnull("cb").alias("new")))).alias("e")).select("x", "e.*").where("new")
        late = made.join(made.groupBy("src", "dst").agg(F.min("x").alias("least")), ["src", "dst"]).where("x <> least").select("x").distinct()
        good = one.join(late, "x", "left_anti").select(F.explode(F.array(F.struct(F.col("x").alias("id"), F.col("a").alias("src"), F.col("d").alias("dst")), F.struct(F.col("y").alias("id"), F.col("c").alias("src"), F.col("b").alias("dst")))).alias("e")).select("e.*")
        now = stored(now.join(good.select("id"), "id", "left_anti").unionByName(good), "stubs")
    raise RuntimeError(f"{bad} edges are still loops or copies")


def null_covariance(edges: DataFrame, sd: DataFrame, pairs: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """src, dst, cov, w: covariances and correlations of random series whose moments match a correlation graph.

    edges: correlations, mirrored (a missing edge is 0); sd: node, sd.  The mean and the variance of
    the covariances of two nodes and the mean of the variances give the number of independent draws a
    node has, their mean and their deviation; a pair's covariance is the product of its nodes' draws.
    ``pairs`` (src, dst) limits the result, which otherwise holds the pairs of ``edges``.
    """
    s = lambda c: sd.select(F.col("node").alias(c), F.col("sd").alias(f"sd_{c}"))
    w = edges.where("src < dst").join(s("src"), "src").join(s("dst"), "dst").select((F.col("w") * F.col("sd_src") * F.col("sd_dst")).alias("c"))
    got = w.agg(F.coalesce(F.sum("c"), F.lit(0.0)), F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0.0))).first()
    n, var = sd.agg(F.count(F.lit(1)), F.avg(F.col("sd") * F.col("sd"))).first()
    all_ = n * (n - 1) / 2
    if n < 2 or got[0] <= 0:
        raise ValueError("the mean covariance must be above zero")
    e = got[0] / all_
    v = got[1] / all_ - e * e
    m = max(2, math.floor((var * var - e * e) / v)) if v > 0 else 2
    mu = math.sqrt(e / m)
    sigma = math.sqrt(max(0.0, -(mu**2) + math.sqrt(mu**4 + v / m)))
    unit = lambda x, salt: (F.pmod(F.xxhash64("node", x, F.lit(seed), F.lit(salt)), F.lit(1 << 40)) + 0.5) / (1 << 40)
    normal = lambda x: mu + sigma * F.sqrt(-2 * F.log(unit(x, 0))) * F.cos(2 * math.pi * unit(x, 1))
    draws = stored(sd.select("node", F.transform(F.sequence(F.lit(1), F.lit(m)), normal).alias("x")), "draws")
    two = lambda c: draws.select(F.col("node").alias(c), F.col("x").alias(f"x_{c}"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda t, p: t + p)
    at = (edges if pairs is None else pairs).select("src", "dst").join(two("src"), "src").join(two("dst"), "dst")
    size = lambda c: F.sqrt(dot(c, c))
    return at.select("src", "dst", dot("x_src", "x_dst").alias("cov"), F.try_divide(dot("x_src", "x_dst"), size("x_src") * size("x_dst")).alias("w"))
