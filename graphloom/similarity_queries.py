"""Registered queries of spectral communities, similarity of graphs, null models and generators, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog import oracle_sql, register
from graphloom.operators import null_models as Z
from graphloom.operators import paths as R
from graphloom.operators import similarity as Y
from graphloom.operators import spatial as D
from graphloom.operators import spectral as S
from graphloom.operators import wedges as T
from graphloom.plans import graphs as G
from graphloom.plans.graphs import with_
from graphloom.queries import r9

_whole = lambda s, d: G.mirrored(G.without_loops(G.trade(s, d)))


def _years(s, d, odd: int):
    """Undirected: quantity that two nations traded in odd or in even years."""
    lines = G.without_loops(G._lines(s, d)).where(F.year("o_orderdate") % 2 == odd)
    half = lines.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("l_quantity").alias("w"))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


_YEARS = "".join(
    f", h{k} AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(q) AS w FROM lines WHERE src <> dst AND year(day) % 2 = {k} GROUP BY 1, 2), e{k} AS (SELECT a AS src, b AS dst, w FROM h{k} UNION ALL SELECT b, a, w FROM h{k})" for k in (1, 0)
)

# spectral bisection has no SQL; tests hold it against dense matrices and take each level's modularity again in SQL
register("bisect_und", lambda s, d: S.bisect(G.partners(s, d), G.nations(s, d)))
register("bisect_dir", lambda s, d: S.bisect(G.trade(s, d), G.nations(s, d)))
register("subgraph_centrality", lambda s, d: S.subgraph_centrality(G.partners(s, d), G.nations(s, d), 1e-12).select("node", F.round("c", 6).alias("c")), with_("und node", ", m0 AS (SELECT node AS src, node AS dst, 1.0::DOUBLE AS x FROM node)" + "".join(
    f", m{i + 1} AS MATERIALIZED (SELECT m.src, u.dst, sum(x) / {i + 1} AS x FROM m{i} m JOIN und u ON u.src = m.dst GROUP BY 1, 2)" for i in range(60)) + "\nSELECT src AS node, round(sum(x), 6) AS c FROM (" + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(61)) + ") WHERE src = dst GROUP BY 1"))

_TOGETHER = """, n AS (SELECT p.comm AS a, p3.comm AS b, count(*) AS n FROM p JOIN p3 USING (node) GROUP BY 1, 2), f AS (SELECT sum(n * (n - 1) / 2) AS f FROM n),
s1 AS (SELECT sum(k * (k - 1) / 2) AS s, count(*) AS m FROM (SELECT count(*) AS k FROM p GROUP BY comm)), s2 AS (SELECT sum(k * (k - 1) / 2) AS s, count(*) AS m FROM (SELECT count(*) AS k FROM p3 GROUP BY comm))"""
register(
    "comodularity",
    lambda s, d: r9(Y.comodularity(_years(s, d, 1), _years(s, d, 0), G.regions(s, d), G.parity(s, d)), "f_f", "g_e", "h_e", "h_h"),
    with_("lines p p3", _YEARS + _TOGETHER + """, u AS (SELECT a, b, bool_or(k = 1) AS i1, bool_or(k = 0) AS i2 FROM (SELECT a, b, 1 AS k FROM h1 UNION ALL SELECT a, b, 0 FROM h0) GROUP BY 1, 2),
t AS (SELECT u.*, x.comm = y.comm AS t1, v.comm = z.comm AS t2 FROM u JOIN p x ON x.node = a JOIN p y ON y.node = b JOIN p3 v ON v.node = a JOIN p3 z ON z.node = b)
SELECT round((SELECT f FROM f) / (s1.s + s2.s - (SELECT f FROM f)), 9) AS f_f, round(coalesce((SELECT count(*) FILTER (WHERE t1 AND t2) / count(*) FROM t), 0), 9) AS g_e, round(coalesce((SELECT count(*) FILTER (WHERE t1 AND t2 AND i1 AND i2) / count(*) FROM t), 0), 9) AS h_e,
  round(coalesce((SELECT count(*) FILTER (WHERE t1 AND t2 AND i1 AND i2) / nullif(count(*) FILTER (WHERE (t1 OR t2) AND i1 AND i2), 0) FROM t), 0), 9) AS h_h, s1.m + s2.m - 1 AS p FROM s1, s2"""),
)
register(
    "comodularity_ratio",
    lambda s, d: r9(Y.comodularity_ratio(G.regions(s, d), G.parity(s, d)), "ratio"),
    with_("p p3", _TOGETHER + """, a AS (SELECT CAST(count(*) AS DOUBLE) AS h FROM p GROUP BY comm), b AS (SELECT CAST(count(*) AS DOUBLE) AS g FROM p3 GROUP BY comm), n0 AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM p)
SELECT round((SELECT f FROM f) / (s1.s + s2.s - (SELECT f FROM f)) / (SELECT sum(h * h * g * g / (n ** 3 * (h + g) - n * h * g)) FROM a, b, n0), 9) AS ratio FROM s1, s2"""),
)
_Q = "(SELECT sum(CASE WHEN a.comm = b.comm THEN w ELSE 0 END) / (SELECT sum(w) FROM {e}) - (SELECT sum(k * k) FROM (SELECT sum(w) AS k FROM {e} JOIN {p} ON node = src GROUP BY comm)) / (SELECT sum(w) FROM {e}) ** 2 FROM {e} JOIN {p} a ON a.node = src JOIN {p} b ON b.node = dst)"
register(
    "cross_modularity",
    lambda s, d: r9(Y.cross_modularity(_years(s, d, 1), _years(s, d, 0), G.regions(s, d), G.parity(s, d)), "similarity"),
    with_("lines p p3", _YEARS + f"\nSELECT round(({_Q.format(e='e1', p='p3')} + {_Q.format(e='e0', p='p')}) / ({_Q.format(e='e1', p='p')} + {_Q.format(e='e0', p='p3')}), 9) AS similarity"),
)
register(
    "entropic_similarity",
    lambda s, d: r9(Y.entropic_similarity(G.regions(s, d), G.parity(s, d)), "similarity"),
    with_("p p3", """, n AS (SELECT p.comm AS a, p3.comm AS b, count(*) AS n FROM p JOIN p3 USING (node) GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM n), h AS (SELECT -sum(n / t * ln(n / t)) AS h FROM n, t),
ha AS (SELECT -sum(k / t * ln(k / t)) AS h FROM (SELECT sum(n) AS k FROM n GROUP BY a), t), hb AS (SELECT -sum(k / t * ln(k / t)) AS h FROM (SELECT sum(n) AS k FROM n GROUP BY b), t)
SELECT round(1 - (2 * h.h - ha.h - hb.h) / ln(t), 9) AS similarity FROM h, ha, hb, t"""),
)
register("degenerate_partitions", lambda s, d: Y.degenerate_partitions(G.change(s, d), G.nations(s, d), 20))
register("cross_modularity_degenerate", lambda s, d: Y.cross_modularity_degenerate(_years(s, d, 1), _years(s, d, 0), G.nations(s, d), 20))
register("similarity_test", lambda s, d: Y.similarity_test(_years(s, d, 1), _years(s, d, 0), G.nations(s, d), 100))

# null models: what they must keep is held against the graph they come from
_held = lambda e, keys: e.groupBy(*keys, F.col("src").alias("node")).agg(F.count_if(F.col("w") > 0).alias("pos"), F.count_if(F.col("w") < 0).alias("neg"))


def _null_strengths(s, d):
    old = G.change(s, d)
    new = Z.null_model(old, G.nations(s, d)).drop("run")
    moved = new.join(old, ["src", "dst", "w"], "left_anti").agg((F.count(F.lit(1)) > 0).alias("changed"))
    weights = new.where("src < dst").groupBy("w").count().exceptAll(old.where("src < dst").groupBy("w").count()).agg((F.count(F.lit(1)) == 0).alias("kept"))
    near = Z.strength_correlation(old, new.withColumn("run", F.lit(1)), G.nations(s, d)).agg((F.min("r") > 0.7).alias("near"))
    return _held(new, []).join(F.broadcast(moved)).join(F.broadcast(weights)).join(F.broadcast(near))


register("null_strengths_und", _null_strengths, with_("change", "\nSELECT src AS node, count(*) FILTER (WHERE w > 0) AS pos, count(*) FILTER (WHERE w < 0) AS neg, true AS changed, true AS kept, true AS near FROM change GROUP BY 1"))


def _delivered(s, d):
    """Degrees of parts (out) and suppliers (in, numbered below zero) in what was ordered from whom."""
    e = G.read(s, d, "lineitem").select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst")).distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("k_in"), F.lit(1).alias("k_out")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("k_in"), F.lit(0).alias("k_out")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.k_in").alias("k_in"), F.sum("x.k_out").alias("k_out"))


def _given_degrees(s, d):
    e = Z.graph_of_degrees(_delivered(s, d)).distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("k_in"), F.lit(1).alias("k_out")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("k_in"), F.lit(0).alias("k_out")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.k_in").alias("k_in"), F.sum("x.k_out").alias("k_out"))


register("given_degrees", _given_degrees, """WITH e AS (SELECT DISTINCT l_partkey AS src, -1 - l_suppkey AS dst FROM lineitem)
SELECT node, CAST(sum(i) AS BIGINT) AS k_in, CAST(sum(o) AS BIGINT) AS k_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1""")


def _monthly(s, d):
    """Quantity that the customers of a nation ordered, by nation and month."""
    return G._lines(s, d).groupBy(F.col("src").alias("node"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month")).agg(F.sum("l_quantity").alias("x"))


def _null_covariance(s, d):
    x = _monthly(s, d)
    y = x.select(F.col("node").alias("other"), "month", F.col("x").alias("y"))
    corr = x.join(y, "month").where("node <> other").groupBy(F.col("node").alias("src"), F.col("other").alias("dst")).agg(F.corr("x", "y").alias("w"))
    return Z.null_covariance(corr, x.groupBy("node").agg(F.stddev("x").alias("sd")))


register("null_covariance", _null_covariance)
register("randomised_degrees", lambda s, d: D.randomise(G.partners(s, d), G.nations(s, d), 0.5).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg")), with_("und", "\nSELECT src AS node, count(*) AS deg FROM und GROUP BY 1"))

# generators on the parts: what can be held against SQL is the number of edges and that no pair is there twice
_parts = lambda s, d: G.read(s, d, "part").select(F.col("p_partkey").alias("node"))
_counted = lambda e: e.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src", "dst").alias("pairs"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))
_COUNTED = "SELECT 5 * count(*) AS edges, 5 * count(*) AS pairs, 0::BIGINT AS loops FROM part"
register("toeplitz", lambda s, d: _counted(D.toeplitz_edges(_parts(s, d), 5 * _parts(s, d).count(), 20.0)), _COUNTED)
register("even_clusters", lambda s, d: _counted(D.even_clusters(_parts(s, d), 5 * _parts(s, d).count(), 2)), _COUNTED)
register("sampled_path_length", lambda s, d: r9(D.sampled_path_length(G.partners(s, d), G.nations(s, d)), "median"), with_("und node", """, reach AS (SELECT src, dst, 1 AS d FROM und UNION SELECT reach.src, e.dst, d + 1 FROM reach JOIN und e ON reach.dst = e.src WHERE d < 25), dist AS (SELECT src, dst, min(d) AS d FROM reach WHERE src <> dst GROUP BY 1, 2),
m AS (SELECT node, coalesce((SELECT sum(d) / (count(*) + 1) FROM dist WHERE src = node), 0) AS m FROM node) SELECT count(*) AS sources, round(median(m), 9) AS median FROM m""", True))  # fmt: skip
register("sampled_path_length_parts", lambda s, d: D.sampled_path_length(G.copart(s, d), _parts(s, d)))
register("module_order", lambda s, d: D.module_order(_whole(s, d), G.regions(s, d)), with_("trade p", """, w AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM trade WHERE src <> dst UNION ALL SELECT dst, src, w FROM trade WHERE src <> dst) GROUP BY 1, 2),
e AS (SELECT w.*, a.comm AS c1, b.comm AS c2 FROM w JOIN p a ON a.node = src JOIN p b ON b.node = dst), n AS (SELECT comm, count(*) AS n FROM p GROUP BY 1),
x AS (SELECT c1, round(sum(w / (a.n * b.n)), 9) AS x FROM (SELECT c1, c2, sum(w) AS w FROM e WHERE c1 <> c2 GROUP BY 1, 2) JOIN n a ON a.comm = c1 JOIN n b ON b.comm = c2 GROUP BY 1),
m AS (SELECT comm, row_number() OVER (ORDER BY coalesce(x, 0) DESC, comm) AS module FROM n LEFT JOIN x ON c1 = comm),
l AS (SELECT src, round(sum(CASE WHEN b.module < a.module THEN w ELSE -w END), 9) AS lean FROM e JOIN m a ON a.comm = c1 JOIN m b ON b.comm = c2 WHERE abs(a.module - b.module) = 1 GROUP BY 1)
SELECT node, p.comm, module, row_number() OVER (ORDER BY module, coalesce(lean, 0) DESC, node) AS place FROM p JOIN m USING (comm) LEFT JOIN l ON src = node"""))  # fmt: skip
register("edges_by_simrank", lambda s, d: r9(D.edges_by_simrank(G.partners(s, d), G.nations(s, d)), "s").select("src", "dst", "s", "rank"))
register("nested_modularity", lambda s, d: D.nested_modularity(_whole(s, d), G.regions(s, d)))

_sql = oracle_sql()
_LAMBDA = """, reach AS (SELECT src, dst, 1 AS d FROM {g} UNION SELECT reach.src, e.dst, d + 1 FROM reach JOIN {g} e ON reach.dst = e.src WHERE d < 25), dist AS (SELECT src, dst, min(d) AS d FROM reach WHERE src <> dst GROUP BY 1, 2) SELECT avg(d) AS l FROM dist"""
for _k, _weighted in (("bd", False), ("wd", True), ("bu", False), ("wu", True)):
    _dir = _k[1] == "d"
    _graph = G.excess_trade if _dir else G.partners
    _cluster = (lambda e, v, w: T.clustering_dir(e, v, w)) if _dir else (lambda e, v, w: T.clustering_und(e, v, w))
    _c = _sql[f"clustering_{_k}"] if _k != "bu" else with_("und node", """, k AS (SELECT src, count(*) AS k FROM und GROUP BY 1), t AS (SELECT a.src AS node, count(*) AS t FROM und a JOIN und b ON a.src = b.src AND a.dst < b.dst JOIN und c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1)
SELECT node, CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END AS c FROM node LEFT JOIN k ON src = node LEFT JOIN t USING (node)""")
    register(
        f"small_world_{_k}",
        lambda s, d, graph=_graph, cluster=_cluster, w=_weighted: D.small_world(cluster(graph(s, d), G.nations(s, d), w), R.breadth_distances(graph(s, d))).select(F.round("s", 7).alias("s")),
        f"SELECT round((SELECT avg(coalesce(c, 0)) FROM ({_c})) / (SELECT l FROM ({with_('top' if _dir else 'und', _LAMBDA.format(g='top' if _dir else 'und'), True)})), 7) AS s",
    )
