"""Registered queries of ranges, eccentricities, peeling, paired tests, constrained rewiring and clique benchmarks, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.catalog import register
from graphloom.more_queries import _rewired, _subjects
from graphloom.operators import paths as R
from graphloom.operators import populations as N
from graphloom.operators import random_graphs as A
from graphloom.operators import weights as X
from graphloom.path_queries import _PEEL, _sql, RANGES
from graphloom.plans import graphs as G
from graphloom.plans.graphs import with_
from graphloom.queries import r9

# ranges of edges
_SHORT = RANGES + ", y AS (SELECT *, coalesce(range > 2, true) AS short FROM x)"
register("shortcuts", lambda s, d: R.shortcuts(G.excess_trade(s, d)), with_("top", _SHORT + "\nSELECT a AS src, b AS dst, range, short FROM y", True))
register("range_summary", lambda s, d: r9(R.range_summary(R.shortcuts(G.excess_trade(s, d))), "eta", "fs"), with_("top", _SHORT + "\nSELECT round(avg(range), 9) AS eta, round(avg(CASE WHEN short THEN 1 ELSE 0 END), 9) AS fs FROM y", True))

# distances with their diagonal
_ALL = ", z AS (SELECT src, dst, d FROM dist UNION ALL SELECT node, node, 0 FROM node), x AS (SELECT src AS node, max(d) AS ecc FROM z GROUP BY 1)"
register("eccentricity", lambda s, d: R.eccentricity(R.distances(G.excess_trade(s, d), G.nations(s, d)), G.nations(s, d)), _sql("top node", "top", _ALL + "\nSELECT node, ecc FROM x"))
register(
    "charpath_dir",
    lambda s, d: r9(R.charpath(R.distances(G.excess_trade(s, d), G.nations(s, d)), G.nations(s, d)), "lambda", "efficiency"),
    _sql("top node", "top", _ALL + '\nSELECT round(avg(d), 9) AS "lambda", round((SELECT sum(1 / d) FROM dist) / 600, 9) AS efficiency, (SELECT min(ecc) FROM x) AS radius, (SELECT max(ecc) FROM x) AS diameter FROM z'),
)


def _levels(names: str, g: str, k: int, directed: bool) -> str:
    ends = {f"ends{i}": f"(SELECT src AS n, w FROM p{i}" + (f" UNION ALL SELECT dst, w FROM p{i}" if directed else "") + ")" for i in range(12)}
    body = _PEEL.rsplit("\n", 1)[0].format(g=g, k=k, x="count(*)", **ends)
    weak = " UNION ALL ".join(f"SELECT n AS node, {i + 1} AS level FROM {ends[f'ends{i}']} GROUP BY 1 HAVING count(*) < {k}" for i in range(12))
    return with_(names, body + f", lv AS ({weak} UNION ALL SELECT node, 0 FROM (SELECT src AS node FROM p12 UNION SELECT dst FROM p12))\nSELECT node, CAST(level AS BIGINT) AS level FROM node LEFT JOIN lv USING (node)")


register("peel_bu", lambda s, d: R.peel_levels(G.partners(s, d), G.nations(s, d), 6), _levels("und node", "und", 6, False))
register("peel_bd", lambda s, d: R.peel_levels(G.excess_trade(s, d), G.nations(s, d), 6), _levels("top node", "top", 6, True))


# paired subjects: a month of the first half of a year and the one half a year later
def _pairs(s, d) -> DataFrame:
    m = _subjects(s, d).select("subject").distinct()
    later = m.select(F.col("subject").alias("b"))
    return m.where(F.pmod(F.col("subject") - 1, F.lit(12)) < 6).select(F.col("subject").alias("pair"), F.col("subject").alias("a")).join(later, F.col("b") == F.col("a") + 6)


register(
    "nbs_paired_t",
    lambda s, d: r9(N.paired_t(_subjects(s, d), _pairs(s, d).withColumn("sign", F.lit(1)), []), "t"),
    with_("lines", """, m AS (SELECT CAST(year(day) * 12 + month(day) AS BIGINT) AS subject, least(src, dst) AS src, greatest(src, dst) AS dst, sum(q) AS w FROM lines WHERE src <> dst GROUP BY 1, 2, 3),
u AS (SELECT DISTINCT subject FROM m), pr AS (SELECT a.subject AS a, b.subject AS b FROM u a JOIN u b ON b.subject = a.subject + 6 WHERE (a.subject - 1) % 12 < 6), c AS (SELECT DISTINCT src, dst FROM m WHERE subject IN (SELECT a FROM pr UNION SELECT b FROM pr)),
x AS (SELECT c.src, c.dst, coalesce(p.w, 0) - coalesce(q.w, 0) AS x FROM pr CROSS JOIN c LEFT JOIN m p ON p.subject = pr.a AND p.src = c.src AND p.dst = c.dst LEFT JOIN m q ON q.subject = pr.b AND q.src = c.src AND q.dst = c.dst)
SELECT src, dst, round(coalesce(abs(avg(x) / nullif(stddev_samp(x), 0) * sqrt(count(*))), 0), 9) AS t FROM x GROUP BY 1, 2"""),
)
register("nbs_paired", lambda s, d: N.nbs_paired(_subjects(s, d), _pairs(s, d), 1.5).select("edges", "p"))


# rewiring that keeps more than the degrees
def _near(s, d) -> DataFrame:
    """Ordered pairs of nations of one region."""
    return A.cliques(G.regions(s, d)).select("src", "dst")


def _shunned(s, d) -> DataFrame:
    old = G.partners(s, d)
    new = A.rewire(old, 3, directed=False, avoid=_near(s, d))
    inside = new.join(old.select("src", "dst"), ["src", "dst"], "left_anti").join(_near(s, d), ["src", "dst"], "left_semi").agg(F.count(F.lit(1)).alias("inside"))
    return _rewired(new, old, lambda e: X.degrees_und(e, G.nations(s, d))).join(F.broadcast(inside))


def _pieces(e: DataFrame, nodes: DataFrame) -> DataFrame:
    return R.components(e, nodes).agg(F.count_distinct("comp").alias("pieces"))


def _nearer(new: DataFrame, old: DataFrame) -> DataFrame:
    far = lambda e, name: e.agg(F.sum(F.abs(F.col("src") - F.col("dst"))).alias(name))
    return far(new, "x").join(F.broadcast(far(old, "y"))).select((F.col("x") < F.col("y")).alias("nearer"))


def _latticed(s, d) -> DataFrame:
    old = G.partners(s, d)
    new = A.rewire(old, 6, directed=False, lattice=True, connected=True)
    return X.degrees_und(new, G.nations(s, d)).join(F.broadcast(_nearer(new, old))).join(F.broadcast(_pieces(new, G.nations(s, d))))


def _connected_dir(s, d) -> DataFrame:
    new = A.rewire(G.excess_trade(s, d), 3, connected=True)
    return X.degrees_dir(new, G.nations(s, d)).join(F.broadcast(_pieces(new, G.nations(s, d))))


_COMP = ", reach AS (SELECT node AS src, node AS dst FROM node UNION SELECT reach.src, und.dst FROM reach JOIN und ON reach.dst = und.src), pc AS (SELECT count(DISTINCT c) AS pieces FROM (SELECT min(dst) AS c FROM reach GROUP BY src))"
register("rewired_avoiding", _shunned, with_("und node", "\nSELECT node, count(dst) AS deg, true AS changed, true AS kept, CAST(0 AS BIGINT) AS inside FROM node LEFT JOIN und ON src = node GROUP BY 1"))
register("latticed_und", _latticed, with_("und node", _COMP + "\nSELECT node, count(dst) AS deg, true AS nearer, any_value(pieces) AS pieces FROM node LEFT JOIN und ON src = node, pc GROUP BY 1", True))
register("rewired_connected_dir", _connected_dir, with_("und node", _COMP + """
SELECT node, coalesce(i, 0) AS id, coalesce(o, 0) AS od, coalesce(i, 0) + coalesce(o, 0) AS deg, (SELECT pieces FROM pc) AS pieces FROM node LEFT JOIN (SELECT dst, count(*) AS i FROM top GROUP BY 1) a ON node = a.dst LEFT JOIN (SELECT src, count(*) AS o FROM top GROUP BY 1) b ON node = b.src""", True))  # fmt: skip


# benchmarks of cliques: the orders of a customer are one
def _orders(s, d) -> DataFrame:
    return G.read(s, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("node"), F.col("o_custkey").cast("bigint").alias("comm"))


def _hung(s, d) -> DataFrame:
    """Each clique's size, edges inside and edges that lead out, and the components of the whole graph."""
    parts = _orders(s, d).select((-F.col("node") - 1).alias("node"), "comm")
    people = G.read(s, d, "customer").select(F.col("c_custkey").cast("bigint").alias("node"))
    e = A.stored(A.cliques_on_random(people, parts, 2 * people.count()), "hung")
    pieces = _pieces(e, e.select(F.col("src").alias("node")).distinct())
    of = parts.select(F.col("node").alias("src"), "comm").join(e, "src")
    inner = of.groupBy("comm").agg(F.count_if(F.col("dst") < 0).alias("inner_edges"), F.count_if(F.col("dst") >= 0).alias("ties"))
    return parts.groupBy("comm").agg(F.count(F.lit(1)).alias("size")).join(inner, "comm").join(F.broadcast(pieces))


register("cliques_on_random", _hung, "SELECT CAST(o_custkey AS BIGINT) AS comm, count(*) AS size, count(*) * (count(*) - 1) AS inner_edges, CAST(1 AS BIGINT) AS ties, CAST(1 AS BIGINT) AS pieces FROM orders GROUP BY 1")
register("ring_of_groups", lambda s, d: A.ring_of_groups(_orders(s, d)), """WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS node, CAST(o_custkey AS BIGINT) AS comm FROM orders), c AS (SELECT comm, count(*) AS n, min(node) AS low, max(node) AS high FROM o GROUP BY 1),
r AS (SELECT high, coalesce(lead(low) OVER (ORDER BY n, comm), first_value(low) OVER (ORDER BY n, comm)) AS low FROM c)
SELECT a.node AS src, b.node AS dst, 1.0::DOUBLE AS w FROM o a JOIN o b ON a.comm = b.comm AND a.node <> b.node UNION SELECT high, low, 1.0::DOUBLE FROM r UNION SELECT low, high, 1.0::DOUBLE FROM r""")  # fmt: skip
