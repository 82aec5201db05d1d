"""Connected patterns of three and four nodes: structural and functional, counted and weighted.

A pattern is a set of nodes in ascending order with a code: one bit for each arc, in
the order of ``arcs``.  Codes that are the same up to node order share a class, the
least of their codes.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arcs(size: int) -> list[tuple[int, int]]:
    """(from, to) of each bit, by place in the sorted nodes."""
    return [arc for i, j in combinations(range(size), 2) for arc in ((i, j), (j, i))]


def _connected(size: int, code: int) -> bool:
    seen, order = {0}, arcs(size)
    for _ in range(size):
        seen |= {y for k, arc in enumerate(order) if code >> k & 1 for x, y in (arc, arc[::-1]) if x in seen}
    return len(seen) == size


def classes(size: int) -> dict[int, int]:
    """The class of each code whose arcs tie all nodes together."""
    order, out = arcs(size), {}
    place = {a: i for i, a in enumerate(order)}
    moves = [[place[o[a], o[b]] for a, b in order] for o in permutations(range(size))]
    for code in range(1 << len(order)):
        if code not in out and _connected(size, code):
            same = [sum(1 << m[k] for k in range(len(order)) if code >> k & 1) for m in moves]
            out |= dict.fromkeys(same, min(same))
    return out


def patterns(edges: DataFrame, size: int) -> DataFrame:
    """n0 < n1 < .., code and the weight w0, w1, .. of each bit's arc (0 if absent) of every connected set of nodes.

    Sets grow by one neighbour at a time; a set that several of its parts lead to is kept once.
    """
    e = edges.where("src <> dst").select("src", "dst", "w")
    near = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    sets = near.where("src < dst").select(F.array("src", "dst").alias("t"))
    for _ in range(size - 2):
        grown = sets.select("t", F.explode("t").alias("src")).join(near, "src").where(~F.array_contains("t", F.col("dst")))
        sets = grown.select(F.array_sort(F.concat("t", F.array("dst"))).alias("t")).distinct()
    out, code = sets.select(*[F.col("t")[i].alias(f"n{i}") for i in range(size)]), F.lit(0).cast("bigint")
    for k, (a, b) in enumerate(arcs(size)):
        out = out.join(e.select(F.col("src").alias(f"n{a}"), F.col("dst").alias(f"n{b}"), F.col("w").alias(f"w{k}")), [f"n{a}", f"n{b}"], "left")
        code = code + F.when(F.col(f"w{k}").isNotNull(), 1 << k).otherwise(0)
    return out.select(*[f"n{i}" for i in range(size)], code.alias("code"), *[F.coalesce(f"w{k}", F.lit(0.0)).alias(f"w{k}") for k in range(size * (size - 1))])


def motifs(edges: DataFrame, size: int = 3, functional: bool = False) -> DataFrame:
    """node, class, n, intensity, coherence: patterns of each class around each node.

    Intensity sums the geometric means of the patterns' weights, coherence their
    ratios to the arithmetic means.  A functional pattern is any set of arcs inside
    that ties all nodes together: the subsets of a code are made on the spot and looked
    up in the table of classes, which has at most 4,096 rows.
    """
    bits = size * (size - 1)
    known = edges.sparkSession.createDataFrame(sorted(classes(size).items()), "sub bigint, class bigint")
    subsets = F.expr(f"aggregate(sequence(0, {bits - 1}), array(0L), (acc, k) -> if(getbit(code, k) = 1, concat(acc, transform(acc, x -> x | shiftleft(1L, k))), acc))")
    t = patterns(edges, size).withColumn("sub", F.explode(subsets) if functional else F.col("code")).join(F.broadcast(known), "sub")
    bits = range(bits)
    has = lambda k, x: F.when(F.col("sub").bitwiseAND(F.lit(1 << k).cast("bigint")) != 0, x).otherwise(0.0)
    add = lambda xs: sum(xs, F.lit(0.0))
    count = F.bit_count("sub")
    mean = add(has(k, F.col(f"w{k}")) for k in bits) / count
    strength = F.exp(add(has(k, F.log(f"w{k}")) for k in bits) / count)
    t = t.select(F.explode(F.array(*[f"n{i}" for i in range(size)])).alias("node"), "class", strength.alias("i"), (strength / mean).alias("q"))
    return t.groupBy("node", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("intensity"), F.sum("q").alias("coherence"))
