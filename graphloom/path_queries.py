"""Registered queries of the fixpoint operators, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog import register
from graphloom.operators import paths as R
from graphloom.operators import wedges as T
from graphloom.operators import weights as X
from graphloom.plans import graphs as G
from graphloom.plans.graphs import with_
from graphloom.queries import r9

_REACH = """, reach AS (SELECT src, dst, 1 AS d FROM {g} UNION SELECT reach.src, e.dst, d + 1 FROM reach JOIN {g} e ON reach.dst = e.src WHERE d < 25), bd AS (SELECT src, dst, CAST(min(d) AS BIGINT) AS d FROM reach GROUP BY 1, 2), dist AS (SELECT * FROM bd WHERE src <> dst)"""


def _sql(names: str, g: str, body: str) -> str:
    return with_(names, _REACH.format(g=g) + body, True)


register("breadth_distances", lambda s, d: R.breadth_distances(G.excess_trade(s, d)), _sql("top", "top", "\nSELECT src, dst, d FROM bd"))
register("distances", lambda s, d: R.distances(G.partners(s, d), G.nations(s, d)), _sql("und node", "und", "\nSELECT src, dst, d FROM dist UNION ALL SELECT node, node, 0 FROM node"))
register(
    "breadth",
    lambda s, d: R.breadth(G.excess_trade(s, d), 0),
    _sql("top", "top", ", z AS (SELECT dst AS node, d FROM dist WHERE src = 0 UNION ALL SELECT 0, 0)\nSELECT z.node, z.d, coalesce((SELECT min(t.src) FROM top t JOIN z y ON y.node = t.src WHERE t.dst = z.node AND y.d + 1 = z.d AND z.d > 0), -1) AS parent FROM z"),
)
register(
    "charpath",
    lambda s, d: r9(R.path_summary(R.distances(G.partners(s, d), G.nations(s, d))).select("lambda", "radius", "diameter"), "lambda"),
    _sql("und", "und", ', x AS (SELECT src, max(d) AS e FROM dist GROUP BY 1)\nSELECT round(avg(d), 9) AS "lambda", (SELECT min(e) FROM x) AS radius, (SELECT max(e) FROM x) AS diameter FROM dist'),
)
register("efficiency_bin", lambda s, d: r9(R.efficiency(R.distances(G.excess_trade(s, d), G.nations(s, d)), G.nations(s, d)), "e"), _sql("top", "top", "\nSELECT round(sum(1 / d) / 600, 9) AS e FROM dist"))
register(
    "local_efficiency",
    lambda s, d: r9(R.local_efficiency(G.partners(s, d), G.nations(s, d)), "e"),
    with_("und node", """, ego AS (SELECT a.src AS ego, e.src, e.dst FROM und e JOIN und a ON a.dst = e.src JOIN und b ON b.dst = e.dst AND b.src = a.src),
reach AS (SELECT ego, src, dst, 1 AS d FROM ego UNION SELECT r.ego, r.src, e.dst, d + 1 FROM reach r JOIN ego e ON r.dst = e.src AND r.ego = e.ego WHERE d < 25),
dd AS (SELECT ego, src, dst, min(d) AS d FROM reach WHERE src <> dst GROUP BY 1, 2, 3), k AS (SELECT src, count(*) AS k FROM und GROUP BY 1)
SELECT node, round(coalesce((SELECT sum(1 / d) FROM dd WHERE ego = node) / nullif((SELECT k * (k - 1) FROM k WHERE k.src = node), 0), 0), 9) AS e FROM node""", True),
)
_WALK = """, walk AS (SELECT src, dst, 1 AS q, 1.0 AS n FROM top), w2 AS (SELECT a.src, b.dst, 2 AS q, count(*) AS n FROM top a JOIN top b ON a.dst = b.src GROUP BY 1, 2), w3 AS (SELECT a.src, b.dst, 3 AS q, sum(n) AS n FROM w2 a JOIN top b ON a.dst = b.src GROUP BY 1, 2)
SELECT src, dst, q, CAST(n AS BIGINT) AS n FROM (SELECT * FROM walk UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3)"""
register("walks", lambda s, d: R.walks(G.excess_trade(s, d), 3), with_("top", _WALK))
_PATH = """, path AS (SELECT [src, dst] AS p FROM top UNION ALL SELECT list_append(p, dst) FROM path JOIN top ON src = p[-1] WHERE p[1] <> p[-1] AND len(p) < 5 AND (dst = p[1] OR NOT list_contains(p, dst))), pn AS (SELECT p[1] AS src, p[-1] AS dst, CAST(len(p) - 1 AS INTEGER) AS q, count(*) AS n FROM path GROUP BY 1, 2, 3)"""
register("simple_paths", lambda s, d: R.simple_paths(G.excess_trade(s, d), G.nations(s, d), 4), with_("top", _PATH + "\nSELECT * FROM pn", True))
register(
    "cycle_probability",
    lambda s, d: r9(R.cycle_probability(R.simple_paths(G.excess_trade(s, d), G.nations(s, d), 4)), "fcyc", "pcyc"),
    with_("top", _PATH + ", c AS (SELECT q, coalesce(sum(n) FILTER (WHERE src = dst), 0) AS c, sum(n) AS n FROM pn GROUP BY 1)\nSELECT q, round(c / n, 9) AS fcyc, round(coalesce(c / lag(n - c) OVER (ORDER BY q), 0), 9) AS pcyc FROM c", True),
)
register(
    "components",
    lambda s, d: R.components(X.threshold_absolute(G.copart(s, d), 2), G.read(s, d, "part").select(F.col("p_partkey").alias("node"))),
    with_("copart", """, c2 AS (SELECT src, dst FROM copart WHERE w >= 2), reach AS (SELECT p_partkey AS src, p_partkey AS dst FROM part UNION SELECT reach.src, c2.dst FROM reach JOIN c2 ON reach.dst = c2.src), c AS (SELECT src AS node, min(dst) AS comp FROM reach GROUP BY 1)
SELECT node, comp, count(*) OVER (PARTITION BY comp) AS size FROM c""", True),
)
register(
    "number_of_components",
    lambda s, d: R.components(X.threshold_absolute(G.copart(s, d), 2), G.read(s, d, "part").select(F.col("p_partkey").alias("node"))).agg(F.count_distinct("comp").alias("n")),
    with_("copart", """, c2 AS (SELECT src, dst FROM copart WHERE w >= 2), reach AS (SELECT p_partkey AS src, p_partkey AS dst FROM part UNION SELECT reach.src, c2.dst FROM reach JOIN c2 ON reach.dst = c2.src)
SELECT count(DISTINCT comp) AS n FROM (SELECT min(dst) AS comp FROM reach GROUP BY src)""", True),
)
_PEEL = ", p0 AS (SELECT src, dst, w FROM {g})" + "".join(f", p{i + 1} AS (SELECT e.* FROM p{i} e JOIN (SELECT n FROM {{ends{i}}} GROUP BY 1 HAVING {{x}} >= {{k}}) a ON a.n = src JOIN (SELECT n FROM {{ends{i}}} GROUP BY 1 HAVING {{x}} >= {{k}}) b ON b.n = dst)" for i in range(12)) + "\nSELECT src, dst, w FROM p12"


def _peel(names: str, g: str, k: int, x: str = "count(*)", directed: bool = False) -> str:
    ends = {f"ends{i}": f"(SELECT src AS n, w FROM p{i}" + (f" UNION ALL SELECT dst, w FROM p{i}" if directed else "") + ")" for i in range(12)}
    return with_(names, _PEEL.format(g=g, k=k, x=x, **ends))


register("kcore_bu", lambda s, d: R.core(G.partners(s, d), G.nations(s, d), 4), _peel("und", "und", 4))
register("kcore_bd", lambda s, d: R.core(G.excess_trade(s, d), G.nations(s, d), 5), _peel("top", "top", 5, directed=True))
register("score_wu", lambda s, d: R.core(G.partners(s, d), G.nations(s, d), 800, True), _peel("und", "und", 800, "sum(w)"))
register("coreness_bu", lambda s, d: R.coreness(G.partners(s, d), G.nations(s, d)))
register("weighted_distances", lambda s, d: r9(R.weighted_distances(X.invert(G.excess_trade(s, d)), G.nations(s, d)).select("src", "dst", "d"), "d"), with_("top node", """, p AS (SELECT node AS src, node AS dst, 0.0::DOUBLE AS d, [node] AS p FROM node UNION ALL SELECT p.src, t.dst, d + 1 / w, list_append(p, t.dst) FROM p JOIN top t ON t.src = p.dst WHERE NOT list_contains(p, t.dst) AND len(p) < 8)
SELECT src, dst, round(min(d), 9) AS d FROM p GROUP BY 1, 2""", True))  # fmt: skip
register("simrank", lambda s, d: r9(R.simrank(G.partners(s, d), G.nations(s, d)), "s"))
register("pagerank", lambda s, d: r9(R.pagerank(G.excess_trade(s, d), G.nations(s, d), 0.5, eps=1e-11), "r"), with_("top node", """, c AS (SELECT dst, sum(w) AS s FROM top GROUP BY 1), l AS (SELECT t.src, t.dst, w / s AS p FROM top t JOIN c USING (dst)), x0 AS (SELECT node, 1 / 25 AS r FROM node)""" + "".join(f", x{i + 1} AS MATERIALIZED (SELECT node, 0.5 * coalesce((SELECT sum(p * r) FROM l JOIN x{i} z ON z.node = l.dst WHERE l.src = n.node), 0) + 0.02 AS r FROM node n)" for i in range(36)) + "\nSELECT node, round(r / (SELECT sum(r) FROM x36), 9) AS r FROM x36"))
register("eigenvector", lambda s, d: R.eigenvector(X.normalize(G.partners(s, d)), G.nations(s, d), 1e-7).select("node", F.round("v", 5).alias("v")))
register("betweenness_bin", lambda s, d: r9(R.betweenness(G.partners(s, d), G.nations(s, d))[0], "b"), _sql("und node", "und", """, sp AS (SELECT src, dst, 1 AS d, 1::DOUBLE AS n FROM und), c1 AS (SELECT node AS src, node AS dst, 0 AS d, 1::DOUBLE AS n FROM node)""" + "".join(f", c{i + 1} AS MATERIALIZED (SELECT c.src, e.dst, {i} AS d, sum(n) AS n FROM c{i} c JOIN und e ON e.src = c.dst JOIN dist x ON x.src = c.src AND x.dst = e.dst AND x.d = {i} GROUP BY 1, 2)" for i in range(1, 7)) + """, sg AS (""" + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(1, 8)) + """)
SELECT node, round(coalesce((SELECT sum(a.n * b.n / t.n) FROM sg a JOIN sg b ON b.src = a.dst JOIN sg t ON t.src = a.src AND t.dst = b.dst AND t.d = a.d + b.d WHERE a.dst = node AND a.src <> node AND b.dst <> node), 0), 9) AS b FROM node"""))  # fmt: skip
register("edge_betweenness_bin", lambda s, d: r9(R.betweenness(G.excess_trade(s, d), G.nations(s, d))[1], "b"))
#: x: the range of every edge a-b, by a search that leaves the edge out
RANGES = ", r AS (SELECT src AS a, dst AS b, src AS here, CAST(0 AS BIGINT) AS d FROM top UNION SELECT a, b, t.dst, d + 1 FROM r JOIN top t ON t.src = r.here WHERE d < 25 AND NOT (t.src = a AND t.dst = b)), x AS (SELECT a, b, min(d) FILTER (WHERE here = b) AS range FROM r GROUP BY 1, 2)"
register("edge_range", lambda s, d: R.edge_range(G.excess_trade(s, d)), with_("top", RANGES + "\nSELECT a AS src, b AS dst, range FROM x", True))
register("backbone", lambda s, d: R.backbone(G.partners(s, d), G.nations(s, d), 3.0))
register("maximum_spanning_forest", lambda s, d: R.maximum_spanning_forest(G.copart(s, d), G.read(s, d, "part").select(F.col("p_partkey").alias("node"))))
_CODE = """, near AS (SELECT src, dst FROM top UNION SELECT dst, src FROM top), t3 AS (SELECT DISTINCT list_sort([a.src, a.dst, b.dst]) AS t FROM near a JOIN near b ON a.src = b.src AND a.dst < b.dst),
m AS (SELECT t[1] AS u, t[2] AS v, t[3] AS x FROM t3), has AS (SELECT DISTINCT src, dst FROM top)
SELECT u, v, x, CAST(""" + " + ".join(f"CASE WHEN EXISTS (SELECT 1 FROM has WHERE src = {a} AND dst = {b}) THEN {1 << i} ELSE 0 END" for i, (a, b) in enumerate(("uv", "vu", "ux", "xu", "vx", "xv"))) + " AS BIGINT) AS code FROM m"
register("motif3_codes", lambda s, d: R.motif_codes(G.excess_trade(s, d)), with_("top", _CODE))
register("motif3", lambda s, d: R.motifs3(G.excess_trade(s, d)), with_("top", ", k AS (" + "WITH " + _CODE[2:] + "), cl AS (SELECT * FROM (VALUES " + ", ".join(map(str, R.motif3_classes())) + ") AS v(code, class))\nSELECT node, CAST(class AS BIGINT) AS class, count(*) AS n FROM (SELECT unnest([u, v, x]) AS node, code FROM k) JOIN cl USING (code) GROUP BY 1, 2"))

# weighted paths, and similarity over several steps
_LENGTHS = """, p AS (SELECT node AS src, node AS dst, 0.0::DOUBLE AS d, [node] AS p FROM node UNION ALL SELECT p.src, t.dst, d + 1 / w, list_append(p, t.dst) FROM p JOIN top t ON t.src = p.dst WHERE NOT list_contains(p, t.dst) AND len(p) < 8), dw AS (SELECT src, dst, min(d) AS d FROM p GROUP BY 1, 2)"""
register("efficiency_wei", lambda s, d: r9(R.efficiency_weighted(G.excess_trade(s, d), G.nations(s, d)), "e"), with_("top node", _LENGTHS + "\nSELECT round(sum(1 / d) / 600, 9) AS e FROM dw WHERE src <> dst", True))
_LOCAL = """, e AS (SELECT src, dst, w / (SELECT max(w) FROM {g}) AS w FROM {g}), near AS (SELECT ego, x, sum(cbrt(w)) AS c, count(*) AS a FROM (SELECT src AS ego, dst AS x, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY 1, 2),
own AS (SELECT n.ego, e.src, e.dst, 1 / w AS len FROM e JOIN near n ON n.x = e.src JOIN near m ON m.ego = n.ego AND m.x = e.dst),
p AS (SELECT ego, x AS src, x AS dst, 0.0::DOUBLE AS d, [x] AS p FROM near UNION ALL SELECT p.ego, p.src, o.dst, d + o.len, list_append(p, o.dst) FROM p JOIN own o ON o.ego = p.ego AND o.src = p.dst WHERE NOT list_contains(p, o.dst) AND len(p) < 8),
dd AS (SELECT ego, src, dst, min(d) AS d FROM p WHERE src <> dst GROUP BY 1, 2, 3), s AS (SELECT dd.ego, sum(a.c * b.c * cbrt(1 / d)) AS x FROM dd JOIN near a ON a.ego = dd.ego AND a.x = dd.src JOIN near b ON b.ego = dd.ego AND b.x = dd.dst GROUP BY 1),
k AS (SELECT ego, sum(a) * sum(a) - sum(a * a) AS k FROM near GROUP BY 1)
SELECT node, round(coalesce((SELECT x FROM s WHERE ego = node) / nullif((SELECT k FROM k WHERE ego = node), 0), 0), 9) AS e FROM node"""
register("local_efficiency_wei", lambda s, d: r9(R.local_efficiency_weighted(X.normalize(G.partners(s, d)), G.nations(s, d)), "e"), with_("und node", _LOCAL.format(g="und"), True))
register("local_efficiency_wei_dir", lambda s, d: r9(R.local_efficiency_weighted(X.normalize(G.excess_trade(s, d)), G.nations(s, d)), "e"), with_("top node", _LOCAL.format(g="top"), True))
register("betweenness_wei", lambda s, d: r9(R.betweenness_weighted(X.invert(G.excess_trade(s, d)), G.nations(s, d))[0], "b"))
register("edge_betweenness_wei", lambda s, d: r9(R.betweenness_weighted(X.invert(G.excess_trade(s, d)), G.nations(s, d))[1], "b"))
register("connecting_threshold", lambda s, d: R.connecting_threshold(G.mirrored(G.without_loops(G.trade(s, d))), G.nations(s, d)), with_("trade node", """, m AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM trade WHERE src <> dst UNION ALL SELECT dst, src, w FROM trade WHERE src <> dst) GROUP BY 1, 2),
t AS (SELECT DISTINCT w AS thr FROM m), reach AS (SELECT thr, (SELECT min(node) FROM node) AS node FROM t UNION SELECT r.thr, m.dst FROM reach r JOIN m ON m.src = r.node AND m.w >= r.thr)
SELECT max(thr) AS thr FROM (SELECT thr FROM reach GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM node))""", True))  # fmt: skip
register("matching_und", lambda s, d: r9(T.matching_und(G.copart(s, d)), "m"), with_("copart", """, k AS (SELECT src, count(*) AS k FROM copart GROUP BY 1), n AS (SELECT a.src, b.src AS dst, count(*) AS n FROM copart a JOIN copart b ON a.dst = b.dst AND a.src <> b.src GROUP BY 1, 2)
SELECT n.src, n.dst, round(2 * n / (k.k - CASE WHEN c.src IS NULL THEN 0 ELSE 1 END + n), 9) AS m FROM n JOIN k ON k.src = n.dst LEFT JOIN copart c ON c.src = n.src AND c.dst = n.dst"""))  # fmt: skip
register("topological_overlap", lambda s, d: r9(T.topological_overlap(G.partners(s, d), 2), "overlap"), with_("und", """, near AS (SELECT src, dst FROM und UNION SELECT a.src, b.dst FROM und a JOIN und b ON a.dst = b.src WHERE a.src <> b.dst), k AS (SELECT src, count(*) AS k FROM near GROUP BY 1),
x AS (SELECT p.src AS a, q.src AS b, (SELECT count(*) FROM near m JOIN near n ON m.dst = n.dst WHERE m.src = p.src AND n.src = q.src) AS n, (SELECT count(*) FROM und WHERE src = p.src AND dst = q.src) AS t, greatest(p.k, q.k) AS k FROM k p JOIN k q ON p.src < q.src)
SELECT a, b, round((n + t) / (k - t + 1), 9) AS overlap FROM x WHERE n + t > 0"""))  # fmt: skip
