"""Graphs as tables: edges (src, dst, w), nodes (node), partitions (node, comm), and how the given tables become graphs.

An undirected graph holds every edge in both directions.  A missing row is a missing
edge; weights are never zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; where both exist the larger weight counts."""
    swapped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select("src", "dst", "w").unionByName(swapped).groupBy("src", "dst").agg(F.max("w").alias("w"))


def symmetrised(edges: DataFrame) -> DataFrame:
    """(A + A') / 2."""
    swapped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select("src", "dst", "w").unionByName(swapped).groupBy("src", "dst").agg((F.sum("w") / 2).alias("w")).where("w <> 0")


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line item: nations of customer and supplier, quantity and order date."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("src"))
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("dst"))
    return line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed: quantity that customers of a nation order from suppliers of another; loops included."""
    return _lines(spark, sf_dir).groupBy("src", "dst").agg(F.sum("l_quantity").alias("w"))


def excess_trade(spark: SparkSession, sf_dir: str, z: float = 1.2) -> DataFrame:
    """Directed and sparse: trade that is above what the strengths of both nations lead to expect by more than ``z`` deviations, without loops.

    The expectation is the product of the nation's orders and the other's deliveries over all
    trade; a deviation is that of as many line items of random quantity.
    """
    t = trade(spark, sf_dir)
    q = read(spark, sf_dir, "lineitem").agg((F.sum(F.col("l_quantity") * F.col("l_quantity")) / F.sum("l_quantity")).alias("item"))
    by = lambda c, name: t.groupBy(c).agg(F.sum("w").alias(name))
    x = t.join(by("src", "o"), "src").join(by("dst", "i"), "dst").join(F.broadcast(t.agg(F.sum("w").alias("t")))).join(F.broadcast(q))
    e = F.col("o") * F.col("i") / F.col("t")
    return without_loops(x).where(F.col("w") - e > z * F.sqrt(e * F.col("item"))).select("src", "dst", "w")


def partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected form of ``excess_trade``."""
    return mirrored(excess_trade(spark, sf_dir))


def change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected and signed: quantity traded in odd years less that of even years, without loops."""
    odd = F.when(F.year("o_orderdate") % 2 == 1, F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    both = without_loops(_lines(spark, sf_dir)).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), odd.alias("x"))
    half = both.groupBy("a", "b").agg(F.sum("x").alias("w")).where("w <> 0")
    return half.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(half.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))


def copart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected and sparse: parts that occur in the same order, weighted by the number of orders."""
    one = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    two = one.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return one.join(two, "l_orderkey").where("l_partkey <> dst").groupBy(F.col("l_partkey").alias("src"), "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition of the nations by region."""
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"), F.col("n_regionkey").cast("bigint").alias("comm"))


def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another partition of the nations: the remainder of their key by three."""
    return nations(spark, sf_dir).withColumn("comm", F.col("node") % 3)


#: The same graphs as DuckDB CTEs, for the oracles.
SQL = {
    "lines": """lines AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, l_quantity AS q, o_orderdate AS day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)""",
    "trade": "trade AS (SELECT src, dst, sum(q) AS w FROM lines GROUP BY 1, 2)",
    "top": """so AS (SELECT src, sum(w) AS o FROM trade GROUP BY 1), si AS (SELECT dst, sum(w) AS i FROM trade GROUP BY 1),
top AS (SELECT src, dst, w FROM (SELECT t.src, t.dst, w, o * i / (SELECT sum(w) FROM trade) AS e FROM trade t JOIN so USING (src) JOIN si USING (dst))
  WHERE src <> dst AND w - e > 1.2 * sqrt(e * (SELECT sum(l_quantity * l_quantity) / sum(l_quantity) FROM lineitem)))""",
    "und": "und AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM top UNION ALL SELECT dst, src, w FROM top) GROUP BY 1, 2)",
    "change": """half AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(CASE WHEN year(day) % 2 = 1 THEN q ELSE -q END) AS w
  FROM lines WHERE src <> dst GROUP BY 1, 2 HAVING sum(CASE WHEN year(day) % 2 = 1 THEN q ELSE -q END) <> 0),
change AS (SELECT a AS src, b AS dst, w FROM half UNION ALL SELECT b, a, w FROM half)""",
    "copart": """op AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
copart AS (SELECT x.p AS src, y.p AS dst, CAST(count(*) AS DOUBLE) AS w FROM op x JOIN op y ON x.o = y.o AND x.p <> y.p GROUP BY 1, 2)""",
    "node": "node AS (SELECT CAST(n_nationkey AS BIGINT) AS node FROM nation)",
    "p": "p AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(n_regionkey AS BIGINT) AS comm FROM nation)",
    "p3": "p3 AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(n_nationkey % 3 AS BIGINT) AS comm FROM nation)",
}
_NEEDS = {"trade": ["lines"], "top": ["trade"], "und": ["top"], "change": ["lines"]}


def with_(names: str, body: str, recursive: bool = False) -> str:
    """SQL that starts with the CTEs ``names`` and all they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in order) + body
