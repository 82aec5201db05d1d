"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import stored

#: Edges of a contracted graph that one task may take; beyond that, rounds go on.
FEW = 1 << 16


def _settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Node and least node of its component, of at most FEW edges."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for frame in frames:
        for a, b in zip(frame["a"], frame["b"], strict=True):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    yield pd.DataFrame({"a": list(up), "p": [top(x) for x in up]}, dtype="int64")


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 200) -> DataFrame:
    """node, comp (its component's least node) of every node with an edge to another.

    In each round every node points to the neighbour of least priority, a hash
    that changes by the round; paths are halved once and the graph is contracted.
    The edges left shrink by a constant factor, whatever the component's shape;
    the last FEW of them are settled by one task, as is a graph that has no more.
    Lineage is cut in each round, and only a count reaches the driver.
    """
    left = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a <> b")
    left = stored(left, "edges")
    few = left.limit(FEW + 1).count()
    if few <= FEW:
        to = stored(left.coalesce(1).mapInPandas(_settle, "a bigint, p bigint"), "parents")
        return to.select(F.col("a").alias("node"), F.col("p").alias("comp"))
    left = stored(left.distinct(), "edges")
    both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = stored(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    for turn in range(max_rounds):
        few = left.limit(FEW + 1).count()
        if not few:
            break
        of = lambda c: to.select(F.col("a").alias(c), F.col("p").alias(f"{c}_to"))
        if few <= FEW:
            to = stored(left.coalesce(1).mapInPandas(_settle, "a bigint, p bigint"), "parents")
            roots = roots.join(of("root"), "root", "left").select("node", F.coalesce("root_to", "root").alias("root"))
            break
        rank = lambda c, turn=turn: F.xxhash64(F.col(c), F.lit(turn))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("p"))
        to = to.withColumn("p", F.when(rank("p") < rank("a"), F.col("p")).otherwise(F.col("a")))
        to = stored(to, "parents")
        up = to.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        to = stored(to.join(up, "p").select("a", F.col("pp").alias("p")), "parents")
        left = left.join(of("a"), "a").join(of("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        left = stored(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        roots = stored(roots.join(of("root"), "root", "left").select("node", F.coalesce("root_to", "root").alias("root")), "roots")
    else:
        raise RuntimeError("components did not converge")
    least = roots.groupBy("root").agg(F.min("node").alias("comp"))
    return roots.join(least, "root").select("node", "comp")
