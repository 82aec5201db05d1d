"""Element-wise operations on edge weights, thresholds, degree and strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def threshold_absolute(edges: DataFrame, thr: float) -> DataFrame:
    """Edges of weight ``thr`` or more, without loops."""
    return edges.where((F.col("src") != F.col("dst")) & (F.col("w") >= thr))


def threshold_magnitude(edges: DataFrame, thr: float) -> DataFrame:
    """Edges of absolute weight ``thr`` or more."""
    return edges.where(F.abs("w") >= thr)


def threshold_tanh(edges: DataFrame, tau: float, n: int) -> DataFrame:
    """Edges of absolute weight tanh(tau / sqrt(n - 3)) or more."""
    return threshold_magnitude(edges, F.tanh(F.lit(tau / (n - 3) ** 0.5)))


def threshold_proportional(edges: DataFrame, nodes: DataFrame, share: float, directed: bool = True) -> DataFrame:
    """The largest weights, as many as ``share`` of all possible edges; ties by (src, dst).

    Ranks come from a distributed sort: counts of partitions of a range exchange
    are summed, so no task sees all edges.
    """
    half = edges.where("src <> dst" if directed else "src < dst")
    pairs = nodes.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / (1 if directed else 2)).alias("pairs"))
    kept = ranked(half, [F.desc("w"), F.col("src"), F.col("dst")]).join(F.broadcast(pairs)).where(F.col("rank") <= F.round(F.col("pairs") * share)).select("src", "dst", "w")
    if directed:
        return kept
    return kept.unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with ``rank`` 1, 2, .. in a total order, without bringing all rows to one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from graphloom.plans.shared import stored

    dealt = stored(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranked")
    own = dealt.withColumn("__own", F.row_number().over(W.partitionBy("__part").orderBy(*order)))
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return own.join(F.broadcast(before), "__part").withColumn("rank", F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def binarize(edges: DataFrame) -> DataFrame:
    return edges.where("w <> 0").select("src", "dst", F.lit(1.0).alias("w"))


def normalize(edges: DataFrame) -> DataFrame:
    """Weights over the largest absolute weight."""
    top = edges.agg(F.max(F.abs("w")).alias("__top"))
    return edges.join(F.broadcast(top)).select("src", "dst", (F.col("w") / F.col("__top")).alias("w"))


def rescale(edges: DataFrame) -> DataFrame:
    """Weights mapped linearly from their range to 0..1; a single value becomes 0."""
    ends = edges.agg(F.min("w").alias("__lo"), F.max("w").alias("__hi"))
    return edges.join(F.broadcast(ends)).select("src", "dst", F.coalesce(F.try_divide(F.col("w") - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0)).alias("w"))


def invert(edges: DataFrame) -> DataFrame:
    """Weights to lengths."""
    return edges.where("w <> 0").select("src", "dst", (1 / F.col("w")).alias("w"))


def weight_conversion(edges: DataFrame, how: str) -> DataFrame:
    return {"binarize": binarize, "normalize": normalize, "lengths": invert}[how](edges)


def cuberoot(x: Column) -> Column:
    return F.cbrt(x)


def fisher_z(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.atanh("w").alias("w"))


def fisher_r(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.tanh("w").alias("w"))


def average_matrices(subjects: DataFrame, symmetric: bool = False, fisher: bool = True) -> DataFrame:
    """Mean of the subjects' matrices (subject, src, dst, w), through Fisher's z; absent cells count as zero."""
    if symmetric:
        swapped = subjects.select("subject", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        subjects = subjects.select("subject", "src", "dst", "w").unionByName(swapped).groupBy("subject", "src", "dst").agg((F.sum("w") / 2).alias("w"))
    n = subjects.agg(F.count_distinct("subject").alias("__n"))
    z = F.atanh("w") if fisher else F.col("w")
    mean = F.col("__sum") / F.col("__n")
    return subjects.groupBy("src", "dst").agg(F.sum(z).alias("__sum")).join(F.broadcast(n)).select("src", "dst", (F.tanh(mean) if fisher else mean).alias("w"))


def is_symmetric(edges: DataFrame) -> DataFrame:
    """One row: whether every edge has its mirror of equal weight."""
    other = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("w2"))
    both = edges.join(other, ["src", "dst"], "left")
    return both.agg(F.coalesce(F.bool_and(F.col("w").eqNullSafe(F.col("w2"))), F.lit(True)).alias("symmetric"))


def nearest_x(points: DataFrame, value: float) -> DataFrame:
    """x whose y is nearest to value; of equals the least x."""
    return points.agg(F.min_by("x", F.struct(F.abs(F.col("y") - value), "x")).alias("x"))


def indicator(parts: DataFrame) -> DataFrame:
    """Long one-hot form of partitions: node, column, 1."""
    return parts.select("node", F.col("comm").alias("column"), F.lit(1.0).alias("value"))


# Degree and strength


def degrees_dir(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, id, od, deg: incoming, outgoing and all edges of each node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    got = ends.groupBy("e.node").agg(F.sum("e.i").alias("id"), F.sum("e.o").alias("od"))
    return nodes.select("node").join(got, "node", "left").select("node", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("id", "od")]).withColumn("deg", F.col("id") + F.col("od"))


def degrees_und(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    got = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    return nodes.select("node").join(got, "node", "left").select("node", F.coalesce("deg", F.lit(0)).alias("deg"))


def strengths_dir(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, is, os, str: sums of incoming, outgoing and all weights."""
    zero = F.lit(0.0)
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("node"), F.col("w").alias("i"), zero.alias("o")), F.struct(F.col("src").alias("node"), zero.alias("i"), F.col("w").alias("o")))).alias("e"))
    got = ends.groupBy("e.node").agg(F.sum("e.i").alias("is"), F.sum("e.o").alias("os"))
    return nodes.select("node").join(got, "node", "left").select("node", *[F.coalesce(c, zero).alias(c) for c in ("is", "os")]).withColumn("str", F.col("is") + F.col("os"))


def strengths_und(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    got = edges.groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("str"))
    return nodes.select("node").join(got, "node", "left").select("node", F.coalesce("str", F.lit(0.0)).alias("str"))


def strengths_sign(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, pos, neg: sums of positive weights, and of negative ones as a magnitude; loops left out."""
    got = edges.where("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.sum(F.when(F.col("w") > 0, F.col("w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("w") < 0, -F.col("w")).otherwise(0.0)).alias("neg"))
    return nodes.select("node").join(got, "node", "left").select("node", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("pos", "neg")])


def joint_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """od, id and the number of nodes that have them."""
    return degrees_dir(edges, nodes).groupBy("od", "id").agg(F.count(F.lit(1)).alias("n"))


def degree_balance(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with more outgoing, more incoming, and as many edges of both kinds."""
    d = degrees_dir(edges, nodes)
    return d.agg(F.count_if(F.col("od") > F.col("id")).alias("j_od"), F.count_if(F.col("id") > F.col("od")).alias("j_id"), F.count_if(F.col("id") == F.col("od")).alias("j_bl"))


def density(edges: DataFrame, nodes: DataFrame, directed: bool = True) -> DataFrame:
    """density, n, k of the graph without loops."""
    k = edges.where("src <> dst" if directed else "src < dst").agg(F.count(F.lit(1)).alias("k"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / (1 if directed else 2)
    return k.join(F.broadcast(n)).select(F.try_divide(F.col("k"), pairs).alias("density"), "n", "k")


def degree_histogram(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """degree 0..max and its number of nodes, zeros included."""
    d = degrees_und(edges, nodes)
    top = d.agg(F.max("deg").alias("top"))
    grid = top.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"))).alias("deg"))
    return grid.join(d.groupBy("deg").agg(F.count(F.lit(1)).alias("n")), "deg", "left").select("deg", F.coalesce("n", F.lit(0)).alias("n"))


def centrality_distribution(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Share of each node in the sum of degrees."""
    d = degrees_und(edges, nodes)
    return d.join(F.broadcast(d.agg(F.sum("deg").alias("__all")))).select("node", F.try_divide("deg", "__all").alias("share"))


def power_law_exponent(values: DataFrame, column: str, x0: float) -> DataFrame:
    """1 + n / sum(ln(x / x0)) over the values from x0 on."""
    x = values.where(F.col(column) >= x0)
    return x.agg((1 + F.try_divide(F.count(F.lit(1)), F.sum(F.log(F.col(column) / x0)))).alias("alpha"))


def threshold_sweep(edges: DataFrame, nodes: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, edges, density of an undirected graph cut at each threshold; one job, the threshold is a key."""
    spark = edges.sparkSession
    cuts = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    k = edges.where("src < dst").join(F.broadcast(cuts), F.col("w") >= F.col("threshold")).groupBy("threshold").agg(F.count(F.lit(1)).alias("k"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    full = cuts.join(k, "threshold", "left").join(F.broadcast(n)).withColumn("k", F.coalesce("k", F.lit(0)))
    return full.select("threshold", F.col("k").alias("edges"), F.try_divide(F.col("k"), F.col("n") * (F.col("n") - 1) / 2).alias("density"))
