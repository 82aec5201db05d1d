"""Registered queries of community detection, random graphs, populations and formats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.catalog import register
from graphloom.operators import communities as M
from graphloom.operators import populations as N
from graphloom.operators import random_graphs as A
from graphloom.operators import weights as X
from graphloom.plans import graphs as G
from graphloom.plans.graphs import with_
from graphloom.plans.shared import shared_dir
from graphloom.queries import r9
from graphloom.sources import formats as S


def _file(s, kind: str) -> str:
    return f"{shared_dir(s)}/{kind}-{uuid.uuid4().hex}"


def _pajek(s, d) -> DataFrame:
    path = _file(s, "pajek")
    S.write_pajek(G.trade(s, d), G.nations(s, d), path)
    return S.read_pajek(s, path)


def _edge_list(s, d) -> DataFrame:
    path = _file(s, "list")
    S.write_edge_list(G.excess_trade(s, d), G.read(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"), F.col("n_name").alias("label")), path)
    return S.read_edge_list(s, path)


register("pajek_round_trip", _pajek, with_("trade", "\nSELECT src, dst, w FROM trade WHERE src <> dst"))
register("edge_list_round_trip", _edge_list, with_("top", "\nSELECT replace(a.n_name, ' ', '_') AS source, replace(b.n_name, ' ', '_') AS target FROM top JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst"))


def _subjects(s, d) -> DataFrame:
    """Trade between nations (src < dst) in each month."""
    lines = G.without_loops(G._lines(s, d)).select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("subject"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "l_quantity")
    return lines.groupBy("subject", F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("l_quantity").alias("w"))


def _groups(s, d) -> DataFrame:
    """Months of the first half of a year against the others."""
    return _subjects(s, d).select("subject").distinct().withColumn("grp", F.when(F.pmod(F.col("subject") - 1, F.lit(12)) < 6, 0).otherwise(1))


_T = """, m AS (SELECT CAST(year(day) * 12 + month(day) AS BIGINT) AS subject, least(src, dst) AS src, greatest(src, dst) AS dst, sum(q) AS w FROM lines WHERE src <> dst GROUP BY 1, 2, 3),
g AS (SELECT subject, CASE WHEN (subject - 1) % 12 < 6 THEN 0 ELSE 1 END AS grp FROM (SELECT DISTINCT subject FROM m)), c AS (SELECT count(*) FILTER (WHERE grp = 0) AS n0, count(*) FILTER (WHERE grp = 1) AS n1 FROM g),
s AS (SELECT src, dst, coalesce(sum(w) FILTER (WHERE grp = 0), 0) AS s0, coalesce(sum(w) FILTER (WHERE grp = 1), 0) AS s1, coalesce(sum(w * w) FILTER (WHERE grp = 0), 0) AS q0, coalesce(sum(w * w) FILTER (WHERE grp = 1), 0) AS q1 FROM m JOIN g USING (subject) GROUP BY 1, 2)
SELECT src, dst, round(abs((s0 / n0 - s1 / n1) / (sqrt((q0 - s0 * s0 / n0 + q1 - s1 * s1 / n1) / (n0 + n1 - 2)) * sqrt(1 / n0 + 1 / n1))), 9) AS t FROM s, c"""
register("nbs_edge_t", lambda s, d: r9(N.edge_t(_subjects(s, d), _groups(s, d), []), "t"), with_("lines", _T))
register("nbs", lambda s, d: N.nbs(_subjects(s, d), _groups(s, d), 1.5).select("edges", "p"))

register("louvain", lambda s, d: M.louvain(G.partners(s, d), G.nations(s, d)))
register("label_propagation", lambda s, d: M.label_propagation(G.partners(s, d), G.nations(s, d)))
register("consensus", lambda s, d: M.consensus(G.partners(s, d), G.nations(s, d), 0.5, 20))


def _rewired(new: DataFrame, old: DataFrame, measure) -> DataFrame:
    """The measure of the rewired graph, whether any edge is new or of another sign, and whether the number of edges and the sum of weights are kept."""
    held = lambda e: e.agg(F.struct(F.count(F.lit(1)), F.sum("w")).alias("held"))
    place = lambda e: e.select("src", "dst", F.signum("w").alias("sign"))
    moved = place(new).join(place(old), ["src", "dst", "sign"], "left_anti").agg((F.count(F.lit(1)) > 0).alias("changed"))
    kept = held(new).unionByName(held(old)).agg((F.count_distinct("held") == 1).alias("kept"))
    return measure(new).join(F.broadcast(moved)).join(F.broadcast(kept))


_signs = lambda e: e.groupBy(F.col("src").alias("node")).agg(F.count_if(F.col("w") > 0).alias("pos"), F.count_if(F.col("w") < 0).alias("neg"))
register("rewired_degrees_dir", lambda s, d: _rewired(A.rewire(G.excess_trade(s, d), 3), G.excess_trade(s, d), lambda e: X.degrees_dir(e, G.nations(s, d))), with_("top node", """
SELECT node, coalesce(i, 0) AS id, coalesce(o, 0) AS od, coalesce(i, 0) + coalesce(o, 0) AS deg, true AS changed, true AS kept FROM node LEFT JOIN (SELECT dst, count(*) AS i FROM top GROUP BY 1) a ON node = a.dst LEFT JOIN (SELECT src, count(*) AS o FROM top GROUP BY 1) b ON node = b.src"""))  # fmt: skip
register(
    "rewired_degrees_und",
    lambda s, d: _rewired(A.rewire(G.partners(s, d), 3, directed=False, connected=True), G.partners(s, d), lambda e: X.degrees_und(e, G.nations(s, d))),
    with_("und node", "\nSELECT node, count(dst) AS deg, true AS changed, true AS kept FROM node LEFT JOIN und ON src = node GROUP BY 1"),
)
register(
    "rewired_signs",
    lambda s, d: _rewired(A.rewire(G.change(s, d), 2, directed=False, by_sign=True), G.change(s, d), _signs),
    with_("change", "\nSELECT src AS node, count(*) FILTER (WHERE w > 0) AS pos, count(*) FILTER (WHERE w < 0) AS neg, true AS changed, true AS kept FROM change GROUP BY 1"),
)
register("latticed", lambda s, d: A.rewire(G.excess_trade(s, d), 3, lattice=True))
register("random_edges", lambda s, d: A.random_edges(G.nations(s, d), G.excess_trade(s, d).count()))
register("ring_lattice", lambda s, d: A.ring_lattice(G.nations(s, d), G.excess_trade(s, d).count()))
register("hierarchical", lambda s, d: A.hierarchical(G.nations(s, d), 2, 2.0))
register("small_worldness", lambda s, d: A.small_worldness(G.partners(s, d), G.nations(s, d), 2))
