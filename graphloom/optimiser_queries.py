"""Registered queries of move gains and of motifs, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog import register
from graphloom.operators import motifs as M
from graphloom.operators import optimisers as O
from graphloom.operators import partitions as P
from graphloom.operators import weights as X
from graphloom.plans import graphs as G
from graphloom.plans.graphs import with_

# The oracle makes every move and takes the quality of the whole partition that results.
_MOVES = """, cand AS (SELECT v, d FROM (SELECT src AS v, b.comm AS d FROM {g} JOIN p b ON b.node = dst WHERE src <> dst UNION SELECT dst, b.comm FROM {g} JOIN p b ON b.node = src WHERE src <> dst) JOIN p ON p.node = v WHERE d <> p.comm),
mv AS (SELECT v, d, node, CASE WHEN node = v THEN d ELSE comm END AS comm FROM cand, p UNION ALL SELECT -1, -1, node, comm FROM p),
ee AS (SELECT a.v, a.d, a.comm AS c1, b.comm AS c2, greatest(w, 0) AS p, greatest(-w, 0) AS q FROM {g} JOIN mv a ON a.node = src JOIN mv b ON b.node = dst AND a.v = b.v AND a.d = b.d),
s AS (SELECT v, d, c1 AS comm, sum(CASE WHEN c1 = c2 THEN p ELSE 0 END) AS ip, sum(CASE WHEN c1 = c2 THEN q ELSE 0 END) AS iq, sum(p) AS op, sum(q) AS oq, 0 AS np, 0 AS nq FROM ee GROUP BY 1, 2, 3 UNION ALL SELECT v, d, c2, 0, 0, 0, 0, sum(p), sum(q) FROM ee GROUP BY 1, 2, 3),
z AS (SELECT v, d, comm, count(*) AS n FROM mv GROUP BY 1, 2, 3),
c AS (SELECT z.v, z.d, z.comm, z.n, coalesce(sum(ip), 0) AS ip, coalesce(sum(iq), 0) AS iq, coalesce(sum(op), 0) AS op, coalesce(sum(oq), 0) AS oq, coalesce(sum(np), 0) AS np, coalesce(sum(nq), 0) AS nq FROM z LEFT JOIN s ON s.v = z.v AND s.d = z.d AND s.comm = z.comm GROUP BY 1, 2, 3, 4),
t AS (SELECT sum(greatest(w, 0)) AS tp, sum(greatest(-w, 0)) AS tq, (SELECT count(*) FROM p) AS tn FROM {g}), f AS ({f})
SELECT v AS node, d AS comm, round(quality - (SELECT quality FROM f WHERE v = -1), {r}) AS gain FROM f WHERE v >= 0"""
_SUM = "SELECT v, d, sum({0}) AS quality FROM c, t GROUP BY 1, 2"
_KL = "CASE WHEN a > 0 THEN a * ln(a / b) ELSE 0 END + CASE WHEN a < 1 THEN (1 - a) * ln((1 - a) / (1 - b)) ELSE 0 END"
#: method: graph, its SQL name, gamma, digits, quality of all communities (v, d, quality)
_GAINS = {
    "modularity": (G.trade, "trade", 1.0, 9, _SUM.format("ip / tp - op * np / (tp * tp)")),
    "configuration": (G.trade, "trade", 0.5, 5, _SUM.format("ip - 0.5 * op * np / tp")),
    "cpm": (G.trade, "trade", 800.0, 5, _SUM.format("ip - 800 * n * n")),
    "significance": (lambda s, d: X.binarize(G.partners(s, d)), "(SELECT src, dst, 1.0::DOUBLE AS w FROM und)", 1.0, 7, f"SELECT v, d, sum(k * ({_KL})) AS quality FROM (SELECT v, d, n * (n - 1) AS k, ip / nullif(n * (n - 1), 0) AS a, tp / (tn * (tn - 1)) AS b FROM c, t) GROUP BY 1, 2"),
    "surprise": (lambda s, d: X.binarize(G.partners(s, d)), "(SELECT src, dst, 1.0::DOUBLE AS w FROM und)", 1.0, 7, f"SELECT v, d, tp * ({_KL}) AS quality FROM (SELECT v, d, tp, sum(ip) / tp AS a, sum(n * (n - 1)) / (tn * (tn - 1)) AS b FROM c, t GROUP BY v, d, tp, tn)"),
    "sta": (G.change, "change", 1.0, 9, _SUM.format("(ip - op * np / tp) / tp - (iq - oq * nq / tq) / (tp + tq)")),
    "gja": (G.change, "change", 1.0, 9, _SUM.format("(ip - op * np / tp) / (tp + tq) - (iq - oq * nq / tq) / (tp + tq)")),
}
for _m, (_graph, _g, _gamma, _r, _f) in _GAINS.items():
    _names = {"trade": "trade p", "change": "change p"}.get(_g, "und p")
    register(
        f"move_gains_{_m}",
        lambda s, d, m=_m, graph=_graph, gamma=_gamma, r=_r: O.move_gains(graph(s, d), G.regions(s, d), m, gamma).select("node", "comm", F.round("gain", r).alias("gain")),
        with_(_names, _MOVES.format(g=_g, f=_f, r=_r)),
    )

# The same for joins of two communities: v and d are their names.
_JOINS = _MOVES.replace(_MOVES[: _MOVES.index("ee AS")], """, cand AS (SELECT DISTINCT least(a.comm, b.comm) AS v, greatest(a.comm, b.comm) AS d FROM {g} JOIN p a ON a.node = src JOIN p b ON b.node = dst WHERE a.comm <> b.comm),
mv AS (SELECT v, d, node, CASE WHEN comm = d THEN v ELSE comm END AS comm FROM cand, p UNION ALL SELECT -1, -1, node, comm FROM p),
""").replace("v AS node, d AS comm", "v AS a, d AS b")
for _m in ("modularity", "surprise", "sta"):
    _graph, _g, _gamma, _r, _f = _GAINS[_m]
    register(
        f"merge_gains_{_m}",
        lambda s, d, m=_m, graph=_graph, gamma=_gamma, r=_r: O.merge_gains(graph(s, d), G.regions(s, d), m, gamma).select("a", "b", F.round("gain", r).alias("gain")),
        with_({"trade": "trade p", "change": "change p"}.get(_g, "und p"), _JOINS.format(g=_g, f=_f, r=_r)),
    )

# Optimisers have no SQL; tests hold them against known communities and against all single moves.
_share = lambda s, d: X.normalize(G.mirrored(G.without_loops(G.trade(s, d))))
_plain = lambda s, d: X.binarize(G.partners(s, d))
register("louvain_dir", lambda s, d: O.optimise(G.trade(s, d), G.nations(s, d)))
register("louvain_sign", lambda s, d: O.optimise(G.change(s, d), G.nations(s, d), "sta"))
register("finetune_und", lambda s, d: O.finetune(_share(s, d), G.regions(s, d)))
register("finetune_dir", lambda s, d: O.finetune(G.trade(s, d), G.regions(s, d)))
register("finetune_sign", lambda s, d: O.finetune(G.change(s, d), G.regions(s, d), "sta"))
register("probtune_sign", lambda s, d: O.finetune(G.change(s, d), G.regions(s, d), "sta", jump=0.3))
register("best_cpm", lambda s, d: O.best_of(_share(s, d), G.nations(s, d), "cpm", 0.5))
register("best_significance", lambda s, d: O.best_of(_plain(s, d), G.nations(s, d), "significance"))
register("best_surprise", lambda s, d: O.best_of(_plain(s, d), G.nations(s, d), "surprise"))
register("agglomerate_surprise", lambda s, d: O.agglomerate(_plain(s, d), G.nations(s, d)))
register("resolutions_cpm", lambda s, d: O.resolutions(_share(s, d), G.nations(s, d), "cpm", 0.0, 1.0, 0.5))

register("from_communities", lambda s, d: P.to_communities(G.trade(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), G.regions(s, d)), with_("trade p", "\nSELECT dst AS node, comm, sum(w) AS s FROM trade JOIN p ON p.node = src GROUP BY 1, 2"))


def _motif_sql(size: int, functional: bool) -> str:
    order, nodes = M.arcs(size), [f"n{i}" for i in range(size)]
    grow, last = "", "s2"
    for k in range(3, size + 1):
        grow += f", s{k} AS (SELECT DISTINCT list_sort(list_append(t, dst)) AS t FROM (SELECT t, unnest(t) AS x FROM {last}) JOIN near ON src = x WHERE NOT list_contains(t, dst))"
        last = f"s{k}"
    weights = ", ".join(f"a{k}.w AS w{k}" for k in range(len(order)))
    joins = " ".join(f"LEFT JOIN e a{k} ON a{k}.src = t[{a + 1}] AND a{k}.dst = t[{b + 1}]" for k, (a, b) in enumerate(order))
    code = " + ".join(f"CASE WHEN w{k} IS NULL THEN 0 ELSE {1 << k} END" for k in range(len(order)))
    has = lambda k: f"sub & {1 << k} <> 0"
    logs = " + ".join(f"CASE WHEN {has(k)} THEN ln(w{k}) ELSE 0 END" for k in range(len(order)))
    sums = " + ".join(f"CASE WHEN {has(k)} THEN w{k} ELSE 0 END" for k in range(len(order)))
    return with_("top", f""", e AS (SELECT src, dst, w / (SELECT max(w) FROM top) AS w FROM top), near AS (SELECT src, dst FROM top UNION SELECT dst, src FROM top), s2 AS (SELECT [src, dst] AS t FROM near WHERE src < dst){grow},
m AS (SELECT {", ".join(f"t[{i + 1}] AS {n}" for i, n in enumerate(nodes))}, {weights} FROM {last} {joins}), k AS (SELECT *, {code} AS code FROM m),
known AS (SELECT * FROM (VALUES {", ".join(map(str, sorted(M.classes(size).items())))}) AS v(sub, class)),
lib AS (SELECT code, sub, class FROM (SELECT DISTINCT code FROM k) JOIN known ON {"sub & ~code = 0" if functional else "sub = code"}),
x AS (SELECT {", ".join(nodes)}, class, exp(({logs}) / bit_count(sub)) AS i, ({sums}) / bit_count(sub) AS a FROM k JOIN lib USING (code))
SELECT node, CAST(class AS BIGINT) AS class, count(*) AS n, round(sum(i), 9) AS intensity, round(sum(i / a), 9) AS coherence FROM (SELECT unnest([{", ".join(nodes)}]) AS node, class, i, a FROM x) GROUP BY 1, 2""")


for _name, _size, _kind in (("motif3_structural", 3, False), ("motif3_functional", 3, True), ("motif4_structural", 4, False), ("motif4_functional", 4, True)):
    register(
        _name,
        lambda s, d, size=_size, kind=_kind: M.motifs(X.normalize(G.excess_trade(s, d)), size, kind).select("node", "class", "n", F.round("intensity", 9).alias("intensity"), F.round("coherence", 9).alias("coherence")),
        _motif_sql(_size, _kind),
    )
