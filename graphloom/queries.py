"""Registered queries over the given tables, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.catalog import register
from graphloom.operators import partitions as P
from graphloom.operators import wedges as T
from graphloom.operators import weights as X
from graphloom.plans import graphs as G
from graphloom.plans.graphs import with_


def r9(df: DataFrame, *names: str) -> DataFrame:
    """Round doubles, whose last digits depend on the order of a sum."""
    return df.select(*[F.round(c, 9).alias(c) if c in names else c for c in df.columns])


# 2.2 projections and element-wise functions

register("threshold_absolute", lambda s, d: X.threshold_absolute(G.trade(s, d), 1200), with_("trade", "\nSELECT * FROM trade WHERE src <> dst AND w >= 1200"))
register("threshold_magnitude", lambda s, d: X.threshold_magnitude(G.change(s, d), 100), with_("change", "\nSELECT * FROM change WHERE abs(w) >= 100"))
register("threshold_tanh", lambda s, d: X.threshold_tanh(X.normalize(G.trade(s, d)), 4.0, 25), with_("trade", "\nSELECT src, dst, w / (SELECT max(abs(w)) FROM trade) AS w FROM trade WHERE w / (SELECT max(abs(w)) FROM trade) >= tanh(4.0 / sqrt(22.0))"))
register(
    "threshold_proportional",
    lambda s, d: X.threshold_proportional(G.trade(s, d), G.nations(s, d), 0.2),
    with_("trade", "\nSELECT src, dst, w FROM (SELECT *, row_number() OVER (ORDER BY w DESC, src, dst) AS k FROM trade WHERE src <> dst) WHERE k <= 120"),
)
register("binarize", lambda s, d: X.weight_conversion(G.copart(s, d), "binarize"), with_("copart", "\nSELECT src, dst, CAST(1 AS DOUBLE) AS w FROM copart"))
register("normalize", lambda s, d: r9(X.weight_conversion(G.trade(s, d), "normalize"), "w"), with_("trade", "\nSELECT src, dst, round(w / (SELECT max(abs(w)) FROM trade), 9) AS w FROM trade"))
register("rescale", lambda s, d: r9(X.rescale(G.trade(s, d)), "w"), with_("trade", "\nSELECT src, dst, round((w - (SELECT min(w) FROM trade)) / ((SELECT max(w) FROM trade) - (SELECT min(w) FROM trade)), 9) AS w FROM trade"))
register("invert", lambda s, d: r9(X.weight_conversion(G.copart(s, d), "lengths"), "w"), with_("copart", "\nSELECT src, dst, round(1 / w, 9) AS w FROM copart"))
register("cuberoot", lambda s, d: G.change(s, d).select("src", "dst", F.round(X.cuberoot(F.col("w")), 9).alias("w")), with_("change", "\nSELECT src, dst, round(sign(w) * pow(abs(w), 1.0 / 3), 9) AS w FROM change"))
register(
    "fisher_round_trip",
    lambda s, d: r9(X.fisher_r(X.fisher_z(X.normalize(G.change(s, d)).where("abs(w) < 1"))), "w"),
    with_("change", "\nSELECT src, dst, round(w / (SELECT max(abs(w)) FROM change), 9) AS w FROM change WHERE abs(w) < (SELECT max(abs(w)) FROM change)"),
)


def _subjects(s, d) -> DataFrame:
    """Trade of each month, over the largest cell of all months plus one."""
    m = G._lines(s, d).groupBy(F.trunc("o_orderdate", "month").alias("subject"), "src", "dst").agg(F.sum("l_quantity").alias("w"))
    return m.join(F.broadcast(m.agg((F.max("w") + 1).alias("top")))).select("subject", "src", "dst", (F.col("w") / F.col("top")).alias("w"))


register(
    "average_matrices",
    lambda s, d: r9(X.average_matrices(_subjects(s, d)), "w"),
    with_("lines", """, m AS (SELECT date_trunc('month', day) AS subject, src, dst, sum(q) AS w FROM lines GROUP BY 1, 2, 3), n AS (SELECT count(DISTINCT subject) AS n, max(w) + 1 AS top FROM m)
SELECT src, dst, round(tanh(sum(atanh(w / top)) / any_value(n)), 9) AS w FROM m, n GROUP BY 1, 2"""),
)
register("symmetrised", lambda s, d: G.symmetrised(G.trade(s, d)), with_("trade", "\nSELECT src, dst, sum(w) / 2 AS w FROM (SELECT src, dst, w FROM trade UNION ALL SELECT dst, src, w FROM trade) GROUP BY 1, 2 HAVING sum(w) <> 0"))
register("is_symmetric", lambda s, d: X.is_symmetric(G.trade(s, d)), with_("trade", "\nSELECT bool_and(b.w IS NOT DISTINCT FROM a.w) AS symmetric FROM trade a LEFT JOIN trade b ON a.src = b.dst AND a.dst = b.src"))
register("nearest_x", lambda s, d: X.nearest_x(G.trade(s, d).select((F.col("src") * 100 + F.col("dst")).alias("x"), F.col("w").alias("y")), 1000.0), with_("trade", "\nSELECT src * 100 + dst AS x FROM trade ORDER BY abs(w - 1000), x LIMIT 1"))
register("indicator", lambda s, d: X.indicator(G.regions(s, d)), with_("p", '\nSELECT node, comm AS "column", CAST(1 AS DOUBLE) AS value FROM p'))

# 2.3 degree and strength

_DEG = """, deg AS (SELECT node, coalesce(i, 0) AS id, coalesce(o, 0) AS od FROM node LEFT JOIN (SELECT dst, count(*) AS i FROM top GROUP BY 1) a ON node = a.dst LEFT JOIN (SELECT src, count(*) AS o FROM top GROUP BY 1) b ON node = b.src)"""
register("degrees_dir", lambda s, d: X.degrees_dir(G.excess_trade(s, d), G.nations(s, d)), with_("top node", _DEG + "\nSELECT node, id, od, id + od AS deg FROM deg"))
register("degrees_und", lambda s, d: X.degrees_und(G.copart(s, d), G.read(s, d, "part").select(F.col("p_partkey").alias("node"))), with_("copart", "\nSELECT p_partkey AS node, coalesce(k, 0) AS deg FROM part LEFT JOIN (SELECT dst, count(*) AS k FROM copart GROUP BY 1) ON dst = p_partkey"))
register("joint_degree", lambda s, d: X.joint_degree(G.excess_trade(s, d), G.nations(s, d)), with_("top node", _DEG + "\nSELECT od, id, count(*) AS n FROM deg GROUP BY 1, 2"))
register("degree_balance", lambda s, d: X.degree_balance(G.excess_trade(s, d), G.nations(s, d)), with_("top node", _DEG + "\nSELECT count(*) FILTER (WHERE od > id) AS j_od, count(*) FILTER (WHERE id > od) AS j_id, count(*) FILTER (WHERE id = od) AS j_bl FROM deg"))
register(
    "strengths_dir",
    lambda s, d: X.strengths_dir(G.trade(s, d), G.nations(s, d)),
    with_("trade node", """, i AS (SELECT dst, sum(w) AS w FROM trade GROUP BY 1), o AS (SELECT src, sum(w) AS w FROM trade GROUP BY 1)
SELECT node, coalesce(i.w, 0) AS "is", coalesce(o.w, 0) AS os, coalesce(i.w, 0) + coalesce(o.w, 0) AS str FROM node LEFT JOIN i ON i.dst = node LEFT JOIN o ON o.src = node"""),
)
register("strengths_und", lambda s, d: X.strengths_und(G.copart(s, d), G.read(s, d, "part").select(F.col("p_partkey").alias("node"))), with_("copart", "\nSELECT p_partkey AS node, coalesce(w, 0) AS str FROM part LEFT JOIN (SELECT dst, sum(w) AS w FROM copart GROUP BY 1) ON dst = p_partkey"))
register(
    "strengths_sign",
    lambda s, d: X.strengths_sign(G.change(s, d), G.nations(s, d)),
    with_("change node", "\nSELECT node, coalesce(sum(w) FILTER (WHERE w > 0), 0) AS pos, coalesce(-sum(w) FILTER (WHERE w < 0), 0) AS neg FROM node LEFT JOIN change ON dst = node GROUP BY 1"),
)
register("density_dir", lambda s, d: X.density(G.excess_trade(s, d), G.nations(s, d)), with_("top node", "\nSELECT k / (n * (n - 1)) AS density, n, k FROM (SELECT count(*) AS k FROM top), (SELECT count(*) AS n FROM node)"))
register(
    "density_und",
    lambda s, d: X.density(G.copart(s, d), G.read(s, d, "part").select(F.col("p_partkey").alias("node")), False),
    with_("copart", "\nSELECT k / (n * (n - 1) / 2) AS density, n, k FROM (SELECT count(*) AS k FROM copart WHERE src < dst), (SELECT count(*) AS n FROM part)"),
)
_PARTDEG = ", deg AS (SELECT p_partkey AS node, coalesce(k, 0) AS deg FROM part LEFT JOIN (SELECT dst, count(*) AS k FROM copart GROUP BY 1) ON dst = p_partkey)"
_parts = lambda s, d: G.read(s, d, "part").select(F.col("p_partkey").alias("node"))
register(
    "degree_histogram",
    lambda s, d: X.degree_histogram(G.copart(s, d), _parts(s, d)),
    with_("copart", _PARTDEG + "\nSELECT g.deg, count(node) AS n FROM (SELECT unnest(range(0, (SELECT max(deg) + 1 FROM deg))) AS deg) g LEFT JOIN deg USING (deg) GROUP BY 1"),
)
register("centrality_distribution", lambda s, d: r9(X.centrality_distribution(G.copart(s, d), _parts(s, d)), "share"), with_("copart", _PARTDEG + "\nSELECT node, round(deg / (SELECT sum(deg) FROM deg), 9) AS share FROM deg"))
register("power_law_exponent", lambda s, d: r9(X.power_law_exponent(X.degrees_und(G.copart(s, d), _parts(s, d)), "deg", 10.0), "alpha"), with_("copart", _PARTDEG + "\nSELECT round(1 + count(*) / sum(ln(deg / 10.0)), 9) AS alpha FROM deg WHERE deg >= 10"))
register(
    "threshold_sweep",
    lambda s, d: r9(X.threshold_sweep(G.copart(s, d), _parts(s, d), [1.0, 2.0, 3.0, 4.0]), "density"),
    with_("copart", "\nSELECT CAST(t AS DOUBLE) AS threshold, count(w) AS edges, round(count(w) / ((SELECT count(*) FROM part) * ((SELECT count(*) FROM part) - 1) / 2), 9) AS density FROM (VALUES (1.0), (2.0), (3.0), (4.0)) v(t) LEFT JOIN copart ON w >= t AND src < dst GROUP BY 1"),
)

# 2.4 triangles, similarity and overlap

_TRI = ", tri AS (SELECT a.src AS a, a.dst AS b, b.dst AS c, a.w AS ab, b.w AS bc, c.w AS ac FROM {0} a JOIN {0} b ON a.dst = b.src AND a.src < a.dst AND b.src < b.dst JOIN {0} c ON c.src = a.src AND c.dst = b.dst), around AS (SELECT unnest([a, b, c]) AS node, {1} AS x FROM tri)"
_ONE, _CUBE = "1.0", "pow(ab * bc * ac, 1.0 / 3)"


def _clustering(graph: str, x: str) -> str:
    return _TRI.format(graph, x) + f", k AS (SELECT src, count(*) AS k FROM {graph} GROUP BY 1), t AS (SELECT node, sum(x) AS t FROM around GROUP BY 1)"


register("clustering_bu", lambda s, d: r9(T.clustering_und(G.copart(s, d), _parts(s, d)), "c"), with_("copart", _clustering("copart", _ONE) + "\nSELECT p_partkey AS node, round(coalesce(CASE WHEN k > 1 THEN 2 * t / (k * (k - 1)) END, 0), 9) AS c FROM part LEFT JOIN k ON src = p_partkey LEFT JOIN t ON t.node = p_partkey"))
register("clustering_wu", lambda s, d: r9(T.clustering_und(G.partners(s, d), G.nations(s, d), True), "c"), with_("und node", _clustering("und", _CUBE) + "\nSELECT node, round(coalesce(CASE WHEN k > 1 THEN 2 * t / (k * (k - 1)) END, 0), 9) AS c FROM node LEFT JOIN k ON src = node LEFT JOIN t USING (node)"))
register("transitivity_bu", lambda s, d: r9(T.transitivity_und(G.copart(s, d)), "t"), with_("copart", _clustering("copart", _ONE) + "\nSELECT round(6 * (SELECT count(*) FROM tri) / (SELECT sum(k * (k - 1)) FROM k), 9) AS t"))
register("transitivity_wu", lambda s, d: r9(T.transitivity_und(G.partners(s, d), True), "t"), with_("und", _clustering("und", _CUBE) + f"\nSELECT round(6 * (SELECT sum({_CUBE}) FROM tri) / (SELECT sum(k * (k - 1)) FROM k), 9) AS t"))


def _directed(weighted: bool) -> str:
    x = "pow(w, 1.0 / 3)" if weighted else "1.0"
    return f""", sym AS (SELECT src, dst, sum(x) AS w FROM (SELECT src, dst, {x} AS x FROM top UNION ALL SELECT dst, src, {x} FROM top) GROUP BY 1, 2),
cyc AS (SELECT a.src AS node, sum(a.w * b.w * c.w) / 2 AS cycles FROM sym a JOIN sym b ON a.dst = b.src JOIN sym c ON c.src = b.dst AND c.dst = a.src GROUP BY 1),
k AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM top UNION ALL SELECT dst FROM top) GROUP BY 1),
m AS (SELECT a.src AS node, count(*) AS m FROM top a JOIN top b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
x AS (SELECT node, coalesce(cycles, 0) AS cycles, coalesce(k, 0) * (coalesce(k, 0) - 1) - 2 * coalesce(m, 0) AS triples FROM node LEFT JOIN cyc USING (node) LEFT JOIN k USING (node) LEFT JOIN m USING (node))"""


for _w, _k in ((False, "bd"), (True, "wd")):
    register(f"clustering_{_k}", lambda s, d, w=_w: r9(T.clustering_dir(G.excess_trade(s, d), G.nations(s, d), w), "c"), with_("top node", _directed(_w) + "\nSELECT node, round(CASE WHEN triples > 0 THEN cycles / triples ELSE 0 END, 9) AS c FROM x"))
    register(f"transitivity_{_k}", lambda s, d, w=_w: r9(T.transitivity_dir(G.excess_trade(s, d), G.nations(s, d), w), "t"), with_("top node", _directed(_w) + "\nSELECT round(sum(cycles) / sum(triples), 9) AS t FROM x"))
register(
    "flow_coefficient",
    lambda s, d: r9(T.flow_coefficient(G.excess_trade(s, d), G.nations(s, d)), "fc"),
    with_("top node", """, f AS (SELECT a.dst AS node, count(*) AS flow FROM top a JOIN top b ON a.dst = b.src AND a.src <> b.dst WHERE NOT EXISTS (SELECT 1 FROM top c WHERE c.src = a.src AND c.dst = b.dst) GROUP BY 1),
k AS (SELECT src AS node, count(*) AS k FROM (SELECT src, dst FROM top UNION SELECT dst, src FROM top) GROUP BY 1)
SELECT node, round(coalesce(CASE WHEN k > 1 THEN coalesce(flow, 0) / (k * (k - 1)) END, 0), 9) AS fc, coalesce(flow, 0) AS flow FROM node LEFT JOIN f USING (node) LEFT JOIN k USING (node)"""),
)
_COMMON = ", k AS (SELECT src AS node, count(*) AS k FROM {0} GROUP BY 1), cn AS (SELECT a.src AS a, b.src AS b, count(*) AS n, sum(1 / k) AS ra, sum(1 / ln(k)) AS aa FROM {0} a JOIN {0} b ON a.dst = b.dst AND a.src < b.src JOIN k ON k.node = a.dst GROUP BY 1, 2)"
register(
    "neighbour_scores",
    lambda s, d: r9(T.neighbour_scores(G.copart(s, d)), "jaccard", "ra", "aa"),
    with_("copart", _COMMON.format("copart") + """
SELECT e.src AS a, e.dst AS b, round(coalesce(n, 0) / (x.k + y.k - coalesce(n, 0)), 9) AS jaccard, round(coalesce(ra, 0), 9) AS ra, round(coalesce(aa, 0), 9) AS aa, x.k * y.k AS pa
FROM copart e LEFT JOIN cn ON cn.a = e.src AND cn.b = e.dst JOIN k x ON x.node = e.src JOIN k y ON y.node = e.dst WHERE e.src < e.dst"""),
)
_OVERLAP = """, near AS ({near}), k AS (SELECT src, count(*) AS k FROM near GROUP BY 1), sh AS (SELECT a.src, b.src AS dst, count(*) AS n FROM near a JOIN near b ON a.dst = b.dst GROUP BY 1, 2)
SELECT e.src, e.dst, round(CASE WHEN x.k + y.k - coalesce(n, 0) - 2 > 0 THEN coalesce(n, 0) / (x.k + y.k - coalesce(n, 0) - 2) END, 9) AS overlap FROM {g} e LEFT JOIN sh ON sh.src = e.src AND sh.dst = e.dst JOIN k x ON x.src = e.src JOIN k y ON y.src = e.dst"""
register("edge_overlap_bu", lambda s, d: r9(T.edge_neighbour_overlap(G.copart(s, d)), "overlap"), with_("copart", _OVERLAP.format(near="SELECT src, dst FROM copart", g="copart")))
register("edge_overlap_bd", lambda s, d: r9(T.edge_neighbour_overlap(G.excess_trade(s, d), True), "overlap"), with_("top", _OVERLAP.format(near="SELECT src, dst FROM top UNION SELECT dst, src FROM top", g="top")))
register(
    "matching_index",
    lambda s, d: r9(T.matching_index(G.excess_trade(s, d)), "m_in", "m_out", "m_all"),
    with_("top node", """, q AS (SELECT x.node AS a, y.node AS b FROM node x JOIN node y ON x.node < y.node), n AS (SELECT a, b,
 (SELECT count(*) FROM top s JOIN top t ON s.src = t.src WHERE s.dst = a AND t.dst = b) AS si, (SELECT count(*) FROM top s JOIN top t ON s.dst = t.dst WHERE s.src = a AND t.src = b) AS so,
 (SELECT count(*) FROM top WHERE (dst = a AND src <> b) OR (dst = b AND src <> a)) AS ni, (SELECT count(*) FROM top WHERE (src = a AND dst <> b) OR (src = b AND dst <> a)) AS no FROM q)
SELECT a, b, round(coalesce(2 * si / nullif(ni, 0), 0), 9) AS m_in, round(coalesce(2 * so / nullif(no, 0), 0), 9) AS m_out, round(coalesce(2 * (si + so) / nullif(ni + no, 0), 0), 9) AS m_all FROM n WHERE si + so > 0"""),
)
register(
    "dice",
    lambda s, d: r9(T.dice(G.partners(s, d), G.mirrored(G.excess_trade(s, d, 0.5)), G.nations(s, d)), "dice"),
    with_("und node", """, t4 AS (SELECT src, dst FROM (SELECT t.src, t.dst, w, o * i / (SELECT sum(w) FROM trade) AS e FROM trade t JOIN so USING (src) JOIN si USING (dst)) WHERE src <> dst AND w - e > 0.5 * sqrt(e * (SELECT sum(l_quantity * l_quantity) / sum(l_quantity) FROM lineitem))), u4 AS (SELECT src, dst FROM t4 UNION SELECT dst, src FROM t4),
c AS (SELECT coalesce(a.src, b.src) AS node, count(a.src) AS x, count(b.src) AS y, count(*) FILTER (WHERE a.src IS NOT NULL AND b.src IS NOT NULL) AS c FROM und a FULL JOIN u4 b ON a.src = b.src AND a.dst = b.dst GROUP BY 1)
SELECT node, round(coalesce(2 * c / (x + y), 0), 9) AS dice FROM node LEFT JOIN c USING (node)"""),
)
_CORR = """, z AS (SELECT a.node AS src, b.node AS dst FROM node a, node b WHERE {0}) SELECT round(corr(coalesce(x.w, 0), coalesce(y.w, 0)), 9) AS r FROM z LEFT JOIN trade x USING (src, dst) LEFT JOIN change y USING (src, dst)"""
register("correlation_dir", lambda s, d: r9(T.correlation(G.trade(s, d), G.change(s, d), G.nations(s, d)), "r"), with_("trade change node", _CORR.format("a.node <> b.node")))
register("correlation_und", lambda s, d: r9(T.correlation(G.trade(s, d), G.change(s, d), G.nations(s, d), False), "r"), with_("trade change node", _CORR.format("a.node < b.node")))
_ASSORT = """, i AS (SELECT dst AS node, {0} AS x FROM {2} GROUP BY 1), o AS (SELECT src AS node, {0} AS x FROM {2} GROUP BY 1), e AS (SELECT CAST(coalesce({3}, 0) AS DOUBLE) AS x, CAST(coalesce({4}, 0) AS DOUBLE) AS y FROM {2} LEFT JOIN i i1 ON i1.node = src LEFT JOIN i i2 ON i2.node = dst LEFT JOIN o o1 ON o1.node = src LEFT JOIN o o2 ON o2.node = dst WHERE {1})
SELECT round((avg(x * y) - pow(avg((x + y) / 2), 2)) / (avg((x * x + y * y) / 2) - pow(avg((x + y) / 2), 2)), 9) AS r FROM e"""
for _f, (_a, _b) in {1: ("o1.x", "i2.x"), 2: ("i1.x", "o2.x"), 3: ("o1.x", "o2.x"), 4: ("i1.x", "i2.x")}.items():
    register(f"assortativity_wei_{_f}", lambda s, d, f=_f: r9(T.assortativity(G.excess_trade(s, d), G.nations(s, d), f, True), "r"), with_("top", _ASSORT.format("sum(w)", "src <> dst", "top", _a, _b)))
register("assortativity_bin", lambda s, d: r9(T.assortativity(G.copart(s, d), _parts(s, d)), "r"), with_("copart", _ASSORT.format("count(*)", "src < dst", "copart", "i1.x", "i2.x")))
register("assortativity_bin_dir", lambda s, d: r9(T.assortativity(G.excess_trade(s, d), G.nations(s, d), 4), "r"), with_("top", _ASSORT.format("count(*)", "src <> dst", "top", "i1.x", "i2.x")))
register(
    "local_reweighting",
    lambda s, d: r9(T.local_reweighting(G.partners(s, d)), "w"),
    with_("und", """, s AS (SELECT src, sum(w) AS s FROM und GROUP BY 1), t AS (SELECT a.src, b.src AS dst, sum(a.w + b.w) AS t FROM und a JOIN und b ON a.dst = b.dst AND a.src <> b.src GROUP BY 1, 2),
x AS (SELECT e.src, e.dst, e.w * (SELECT count(*) FROM und) / (SELECT sum(w) FROM und) * 2 * (e.w + 0.5 * coalesce(t, 0)) / (s.s + s2.s) AS x FROM und e LEFT JOIN t ON t.src = e.src AND t.dst = e.dst JOIN s ON s.src = e.src JOIN s s2 ON s2.src = e.dst)
SELECT src, dst, round(x / sum(x) OVER (PARTITION BY src), 9) AS w FROM x"""),
)
_RICH = """, d AS (SELECT {node} AS node, coalesce(k, 0) AS deg FROM {nodes} LEFT JOIN (SELECT node, count(*) AS k FROM ({ends}) GROUP BY 1) q ON q.node = {node}), e AS (SELECT least(x.deg, y.deg) AS deg, w FROM {g} JOIN d x ON x.node = src JOIN d y ON y.node = dst), lv AS (SELECT unnest(range(1, (SELECT max(deg) + 1 FROM d))) AS k)"""
_RICH_B = "\nSELECT k, nk, ek, round(ek / nullif(nk * (nk - 1), 0), 9) AS r FROM (SELECT k, (SELECT count(*) FROM d WHERE deg > k) AS nk, (SELECT count(*) FROM e WHERE deg > k) AS ek FROM lv)"
_RICH_W = ", rk AS (SELECT w, row_number() OVER (ORDER BY w DESC, src, dst) AS n FROM {g}) SELECT k, round((SELECT sum(w) FROM e WHERE deg >= k) / (SELECT sum(w) FROM rk WHERE n <= (SELECT count(*) FROM e WHERE deg >= k)), 9) AS r FROM lv"
_U = {"node": "p_partkey", "nodes": "part", "ends": "SELECT src AS node FROM copart", "g": "copart"}
_D = {"node": "node.node", "nodes": "node", "ends": "SELECT src AS node FROM top UNION ALL SELECT dst FROM top", "g": "top"}
register("rich_club_bu", lambda s, d: r9(T.rich_club(G.copart(s, d), _parts(s, d)), "r"), with_("copart", _RICH.format(**_U) + _RICH_B))
register("rich_club_bd", lambda s, d: r9(T.rich_club(G.excess_trade(s, d), G.nations(s, d), True), "r"), with_("top node", _RICH.format(**_D) + _RICH_B))
register("rich_club_wu", lambda s, d: r9(T.rich_club_weighted(G.partners(s, d), G.nations(s, d)), "r"), with_("und node", _RICH.format(**_D | {"g": "und", "ends": "SELECT src AS node FROM und"}) + _RICH_W.format(g="und")))
register("rich_club_wd", lambda s, d: r9(T.rich_club_weighted(G.excess_trade(s, d), G.nations(s, d), True), "r"), with_("top node", _RICH.format(**_D) + _RICH_W.format(g="top")))

# 2.6 - 2.8 partitions

_PC = ", s AS (SELECT src AS node, comm, sum(w) AS s FROM {0} JOIN p ON p.node = dst GROUP BY 1, 2), pc AS (SELECT node, 1 - sum(s * s) / (sum(s) * sum(s)) AS pc FROM s GROUP BY 1)"
register("participation_coef", lambda s, d: r9(P.participation(G.trade(s, d), G.regions(s, d)), "pc"), with_("trade p", _PC.format("trade") + "\nSELECT node, round(coalesce(pc, 0), 9) AS pc FROM p LEFT JOIN pc USING (node)"))
_SIGNED = ", s AS (SELECT src AS node, comm, w > 0 AS up, sum(abs(w)) AS s FROM change JOIN p ON p.node = dst GROUP BY 1, 2, 3), k AS (SELECT node, up, sum(s) AS k FROM s GROUP BY 1, 2), x AS (SELECT node, up, {0} AS x FROM s JOIN k USING (node, up) GROUP BY 1, 2)\nSELECT node, round(coalesce(max(x) FILTER (WHERE up), 0), 9) AS pos, round(coalesce(max(x) FILTER (WHERE NOT up), 0), 9) AS neg FROM p LEFT JOIN x USING (node) GROUP BY 1"
register("participation_coef_sign", lambda s, d: r9(P.participation_sign(G.change(s, d), G.regions(s, d)), "pos", "neg"), with_("change p", _SIGNED.format("1 - sum(s * s / (k * k))")))
register("diversity_coef_sign", lambda s, d: r9(P.diversity_sign(G.change(s, d), G.regions(s, d)), "pos", "neg"), with_("change p", _SIGNED.format("-sum(s / k * ln(s / k)) / ln((SELECT count(DISTINCT comm) FROM p))")))
register(
    "module_degree_zscore",
    lambda s, d: r9(P.module_degree_zscore(G.trade(s, d), G.regions(s, d)), "z"),
    with_("trade p", """, k AS (SELECT a.node, a.comm, coalesce(sum(w), 0) AS s FROM p a LEFT JOIN (SELECT src, w, comm FROM trade JOIN p ON p.node = dst) e ON e.src = a.node AND e.comm = a.comm GROUP BY 1, 2)
SELECT node, round(coalesce((s - avg(s) OVER w) / nullif(stddev_pop(s) OVER w, 0), 0), 9) AS z FROM k WINDOW w AS (PARTITION BY comm)"""),
)
_MOD = """, e AS (SELECT a.comm AS c1, b.comm AS c2, w FROM {0} JOIN p a ON a.node = src JOIN p b ON b.node = dst), t AS (SELECT sum(w) AS s FROM {0}),
c AS (SELECT comm, (SELECT coalesce(sum(w), 0) FROM e WHERE c1 = comm AND c2 = comm) AS i, (SELECT coalesce(sum(w), 0) FROM e WHERE c1 = comm) AS o, (SELECT coalesce(sum(w), 0) FROM e WHERE c2 = comm) AS n FROM (SELECT DISTINCT comm FROM p)), n AS (SELECT comm, count(*) AS n FROM p GROUP BY 1)"""
register("modularity_dir", lambda s, d: r9(P.modularity(G.trade(s, d), G.regions(s, d)), "q"), with_("trade p", _MOD.format("trade") + "\nSELECT round(sum(i / s - o * n / (s * s)), 9) AS q FROM c, t"))
register("modularity_und", lambda s, d: r9(P.modularity(G.partners(s, d), G.regions(s, d)), "q"), with_("und p", _MOD.format("und") + "\nSELECT round(sum(i / s - o * n / (s * s)), 9) AS q FROM c, t"))
register("rb_configuration", lambda s, d: P.rb_configuration(G.partners(s, d), G.regions(s, d), 0.5).select(F.round("quality", 5).alias("quality")), with_("und p", _MOD.format("und") + "\nSELECT round(sum(i - 0.5 * o * n / s), 5) AS quality FROM c, t"))
register("cpm", lambda s, d: P.cpm(X.binarize(G.partners(s, d)), G.regions(s, d), 0.25), with_("und p", _MOD.format("(SELECT src, dst, 1.0 AS w FROM und)") + "\nSELECT CAST(sum(c.i - 0.25 * n.n * n.n) AS DOUBLE) AS quality FROM c JOIN n USING (comm)"))
register("cpm_hamiltonian", lambda s, d: P.cpm_hamiltonian(G.partners(s, d), G.regions(s, d), 0.25), with_("und p", _MOD.format("(SELECT src, dst, 1.0 AS w FROM und)") + "\nSELECT CAST(-sum(c.i / 2 - 0.25 * n.n * n.n) AS DOUBLE) AS h FROM c JOIN n USING (comm)"))
_SIGN = {
    "sta": "x0 / s0 - x1 / (s0 + s1)", "pos": "x0 / s0", "smp": "x0 / s0 - coalesce(x1 / nullif(s1, 0), 0)", "gja": "x0 / (s0 + s1) - x1 / (s0 + s1)", "neg": "-x1 / s1",
}
for _q, _x in _SIGN.items():
    register(
        f"modularity_sign_{_q}",
        lambda s, d, q=_q: r9(P.modularity_sign(G.change(s, d), G.regions(s, d), q), "q"),
        with_("change p", f""", e AS (SELECT a.comm AS c1, b.comm AS c2, abs(w) AS w, w > 0 AS up FROM change JOIN p a ON a.node = src JOIN p b ON b.node = dst), t AS (SELECT up, sum(w) AS s FROM e GROUP BY 1),
c AS (SELECT comm, up, s, (SELECT coalesce(sum(w), 0) FROM e WHERE c1 = comm AND c2 = comm AND e.up = t.up) AS i, (SELECT coalesce(sum(w), 0) FROM e WHERE c1 = comm AND e.up = t.up) AS o FROM (SELECT DISTINCT comm FROM p), t),
x AS (SELECT sum(i - o * o / s) FILTER (WHERE up) AS x0, sum(i - o * o / s) FILTER (WHERE NOT up) AS x1, max(s) FILTER (WHERE up) AS s0, max(s) FILTER (WHERE NOT up) AS s1 FROM c)
SELECT round({_x}, 9) AS q FROM x"""),
    )
_SIZES = ", sz AS (SELECT comm, count(*) AS n FROM p GROUP BY 1), cs AS (SELECT comm, n, (SELECT count(*) FROM und JOIN p a ON a.node = src JOIN p b ON b.node = dst WHERE src < dst AND a.comm = sz.comm AND b.comm = sz.comm) AS e FROM sz)"
register(
    "significance",
    lambda s, d: P.significance(G.partners(s, d), G.regions(s, d)).select(F.round("quality", 7).alias("quality")),
    with_("und p", _SIZES + """, g AS (SELECT count(*) / 2 / (25 * 24 / 2) AS p FROM und), q AS (SELECT n, e / (n * (n - 1) / 2) AS q FROM cs WHERE n > 1)
SELECT round(sum(n * (n - 1) * (CASE WHEN q > 0 THEN q * ln(q / p) ELSE 0 END + CASE WHEN q < 1 THEN (1 - q) * ln((1 - q) / (1 - p)) ELSE 0 END)), 7) AS quality FROM q, g"""),
)
register("surprise_parameters", lambda s, d: P.surprise_parameters(G.partners(s, d), G.regions(s, d)), with_("und p", _SIZES + "\nSELECT CAST(sum(e) AS BIGINT) AS mi, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS pi, (SELECT count(*) FROM und WHERE src < dst) AS m, CAST(300 AS BIGINT) AS p FROM cs"))
register(
    "surprise",
    lambda s, d: P.surprise(G.partners(s, d), G.regions(s, d)).select(F.round("s", 7).alias("s")),
    with_("und p", _SIZES + """, v AS (SELECT CAST(sum(e) AS BIGINT) AS mi, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS pi, (SELECT count(*) FROM und WHERE src < dst) AS m, 300 AS p FROM cs),
lf AS (SELECT k, sum(CASE WHEN k > 0 THEN ln(greatest(k, 1)) ELSE 0 END) OVER (ORDER BY k) AS f FROM range(0, 301) AS r(k)),
j AS (SELECT v.*, unnest(range(mi, least(m, pi) + 1)) AS j FROM v),
lp AS (SELECT (a.f - b.f - c.f) + (d.f - e.f - g.f) - (h.f - i.f - k.f) AS x FROM j JOIN lf a ON a.k = pi JOIN lf b ON b.k = j JOIN lf c ON c.k = pi - j JOIN lf d ON d.k = p - pi JOIN lf e ON e.k = m - j JOIN lf g ON g.k = p - pi - m + j JOIN lf h ON h.k = p JOIN lf i ON i.k = m JOIN lf k ON k.k = p - m)
SELECT round(-(max(x) + ln(sum(exp(x - (SELECT max(x) FROM lp))))) / ln(10), 7) AS s FROM lp"""),
)


def _two(s, d) -> DataFrame:
    return G.regions(s, d).select(F.lit(1).cast("bigint").alias("part"), "node", "comm").unionByName(G.parity(s, d).select(F.lit(2).cast("bigint").alias("part"), "node", "comm"))


_TWO = ", two AS (SELECT 1 AS part, * FROM p UNION ALL SELECT 2, * FROM p3)"
register("agreement", lambda s, d: P.agreement(_two(s, d)), with_("p p3", _TWO + "\nSELECT a.node AS a, b.node AS b, count(*) AS n FROM two a JOIN two b USING (part, comm) WHERE a.node <> b.node GROUP BY 1, 2"))
register(
    "agreement_weighted",
    lambda s, d: r9(P.agreement_weighted(_two(s, d), s.createDataFrame([(1, 3.0), (2, 1.0)], "part bigint, wt double")), "x"),
    with_("p p3", _TWO + "\nSELECT a.node AS a, b.node AS b, CAST(sum(CASE part WHEN 1 THEN 0.75 ELSE 0.25 END) AS DOUBLE) AS x FROM two a JOIN two b USING (part, comm) WHERE a.node <> b.node GROUP BY 1, 2"),
)
register("groups", lambda s, d: P.groups(G.regions(s, d)).select("comm", F.concat_ws(",", "members").alias("members")), with_("p", "\nSELECT comm, array_to_string(list(node ORDER BY node), ',') AS members FROM p GROUP BY 1"))
register("from_groups", lambda s, d: P.from_groups(P.groups(G.regions(s, d))), with_("p", "\nSELECT node, comm FROM p"))
register("renumbered", lambda s, d: P.renumbered(G.regions(s, d)), with_("p", ", f AS (SELECT comm, row_number() OVER (ORDER BY min(node)) - 1 AS k FROM p GROUP BY 1)\nSELECT node, k AS comm FROM p JOIN f USING (comm)"))
register("by_size", lambda s, d: P.by_size(G.parity(s, d)), with_("p3", ", f AS (SELECT comm, row_number() OVER (ORDER BY count(*) DESC, min(node)) - 1 AS k FROM p3 GROUP BY 1)\nSELECT node, k AS comm FROM p3 JOIN f USING (comm)"))
register("boundaries", lambda s, d: P.boundaries(G.regions(s, d)), with_("p", ", k AS (SELECT comm, row_number() OVER (ORDER BY comm, node) - 1 AS k FROM p)\nSELECT comm, min(k) - 0.5::DOUBLE AS lo, max(k) + 0.5::DOUBLE AS hi FROM k GROUP BY 1"))
register("induced_graph", lambda s, d: P.induced_graph(G.trade(s, d), G.regions(s, d)), with_("trade p", "\nSELECT a.comm AS src, b.comm AS dst, sum(w) AS w FROM trade JOIN p a ON a.node = src JOIN p b ON b.node = dst GROUP BY 1, 2"))
register("induced_modules", lambda s, d: P.induced_modules(G.trade(s, d), G.regions(s, d)), with_("trade p", "\nSELECT a.comm, src, dst, w FROM trade JOIN p a ON a.node = src JOIN p b ON b.node = dst WHERE a.comm = b.comm"))
register(
    "partition_at_level",
    lambda s, d: P.partition_at_level(G.regions(s, d).select(F.lit(0).alias("level"), "node", "comm").unionByName(G.regions(s, d).select(F.lit(1).alias("level"), F.col("comm").alias("node"), (F.col("comm") % 2).alias("comm")).distinct()), 1),
    with_("p", "\nSELECT node, comm % 2 AS comm FROM p"),
)
register("subgraph_intensity", lambda s, d: r9(P.subgraph_intensity(P.induced_modules(G.trade(s, d), G.regions(s, d)), ["comm"]), "intensity", "coherence"), with_("trade p", "\nSELECT a.comm, round(exp(avg(ln(w))), 9) AS intensity, round(exp(avg(ln(w))) / avg(w), 9) AS coherence FROM trade JOIN p a ON a.node = src JOIN p b ON b.node = dst WHERE a.comm = b.comm GROUP BY 1"))
register("contingency", lambda s, d: P.contingency(G.regions(s, d), G.parity(s, d)), with_("p p3", "\nSELECT p.comm AS ca, p3.comm AS cb, count(*) AS n FROM p JOIN p3 USING (node) GROUP BY 1, 2"))
register(
    "compare_partitions",
    lambda s, d: r9(P.compare(G.regions(s, d), G.parity(s, d)), "nmi", "ha", "hb", "vi", "nvi", "ari"),
    with_("p p3", """, c AS (SELECT p.comm AS a, p3.comm AS b, count(*) AS n FROM p JOIN p3 USING (node) GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c),
ma AS (SELECT sum(n) AS n FROM c GROUP BY a), mb AS (SELECT sum(n) AS n FROM c GROUP BY b),
h AS (SELECT (SELECT -sum(n / t * ln(n / t)) FROM ma) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM mb) AS hb, (SELECT -sum(n / t * ln(n / t)) FROM c) AS hab,
 (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(n * (n - 1) / 2) FROM ma) AS pa, (SELECT sum(n * (n - 1) / 2) FROM mb) AS pb, t FROM t)
SELECT round(2 * (ha + hb - hab) / (ha + hb), 9) AS nmi, round(ha, 9) AS ha, round(hb, 9) AS hb, round(2 * hab - ha - hb, 9) AS vi, round((2 * hab - ha - hb) / ln(t), 9) AS nvi,
 round((s - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 9) AS ari FROM h"""),
)
