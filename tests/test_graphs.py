"""Operators on graphs with known answers."""

import math

import pytest

from graphloom.functions.components import connected_components
from graphloom.operators import partitions as P
from graphloom.operators import paths as R
from graphloom.operators import wedges as T
from graphloom.operators import weights as X


def graph(spark, pairs, mirror=True):
    rows = {(a, b) for a, b in pairs} | ({(b, a) for a, b in pairs} if mirror else set())
    nodes = sorted({x for p in rows for x in p})
    return spark.createDataFrame([(a, b, 1.0) for a, b in sorted(rows)], "src bigint, dst bigint, w double"), spark.createDataFrame([(n,) for n in nodes], "node bigint")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def cliques(k, n):
    """A ring of k cliques of n nodes."""
    own = [(c * n + i, c * n + j) for c in range(k) for i in range(n) for j in range(i)]
    return own + [(c * n, ((c + 1) % k) * n + 1) for c in range(k)]


def test_complete_graph(spark):
    e, v = graph(spark, [(i, j) for i in range(5) for j in range(i)])
    assert all(c == 1 for _, c in rows(T.clustering_und(e, v)))
    assert rows(T.transitivity_und(e)) == [(1.0,)]
    assert rows(X.density(e, v, False))[0][0] == 1
    assert rows(R.efficiency(R.distances(e, v), v)) == [(1.0,)]
    assert all(b == 0 for _, b in rows(R.betweenness(e, v)[0]))
    assert rows(R.coreness(e, v)) == [(i, 4) for i in range(5)]


def test_star_and_path(spark):
    e, v = graph(spark, [(0, i) for i in range(1, 6)])
    assert dict(rows(R.betweenness(e, v)[0]))[0] == 20  # all ordered pairs of leaves
    assert rows(R.breadth(e, 1))[0] == (0, 1, 1)
    e, v = graph(spark, [(i, i + 1) for i in range(5)])
    assert dict(((a, b), d) for a, b, d in rows(R.distances(e, v)))[0, 5] == 5
    d = {(a, b): (x, h) for a, b, x, h in rows(R.weighted_distances(e, v))}
    assert d[0, 5] == (5.0, 5)


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    e = spark.createDataFrame(path, "src bigint, dst bigint")
    got = dict(rows(connected_components(e)))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100}
    assert connected_components(e.limit(0)).count() == 0


def test_cliques(spark):
    e, v = graph(spark, cliques(4, 5))
    p = v.selectExpr("node", "node div 5 AS comm")
    inside, total = 4 * 20, 4 * 20 + 8
    assert rows(P.modularity(e, p))[0][0] == pytest.approx(inside / total - 4 * ((total / 4) / total) ** 2)
    assert rows(P.surprise_parameters(e, p)) == [(40, 40, 44, 190)]
    tail = sum(math.comb(40, j) * math.comb(150, 44 - j) for j in range(40, 41)) / math.comb(190, 44)
    assert rows(P.surprise(e, p))[0][0] == pytest.approx(-math.log10(tail))
    same = rows(P.compare(p, p))[0]
    assert same[0] == pytest.approx(1) and same[3] == pytest.approx(0) and same[5] == pytest.approx(1)
    one = v.selectExpr("node", "0L AS comm")
    assert rows(P.compare(one, one))[0][0] == 1


def test_spanning_forest(spark):
    e = spark.createDataFrame([(0, 1, 3.0), (1, 2, 2.0), (0, 2, 1.0), (3, 4, 1.0)], "src bigint, dst bigint, w double")
    v = spark.createDataFrame([(i,) for i in range(6)], "node bigint")
    assert rows(R.maximum_spanning_forest(e, v)) == [(0, 1, 3.0), (1, 2, 2.0), (3, 4, 1.0)]


def test_directed_cycle(spark):
    e, v = graph(spark, [(0, 1), (1, 2), (2, 0)], mirror=False)
    assert len({c for _, c in R.motif3_classes()}) == 16
    assert {n for *_, n in rows(R.motifs3(e))} == {1}
    assert all(fc == 0.5 for _, fc, _ in rows(T.flow_coefficient(e, v)))
    assert {(a, b): d for a, b, d in rows(R.breadth_distances(e))}[0, 0] == 3


def test_empty(spark):
    e = spark.createDataFrame([], "src bigint, dst bigint, w double")
    v = spark.createDataFrame([(1,), (2,)], "node bigint")
    assert rows(X.degrees_dir(e, v)) == [(1, 0, 0, 0), (2, 0, 0, 0)]
    assert rows(T.clustering_und(e, v)) == [(1, 0.0), (2, 0.0)]
    assert rows(R.components(e, v)) == [(1, 1, 1), (2, 2, 1)]
    assert rows(X.strengths_und(e, v)) == [(1, 0.0), (2, 0.0)]


def test_louvain_finds_cliques(spark):
    from graphloom.operators import communities as M
    from graphloom.operators import random_graphs as A

    e = A.ring_of_cliques(spark, 4, 4)
    v = e.selectExpr("src AS node").distinct()
    assert rows(M.best_partition(e, v)) == [(i, i // 4 * 4) for i in range(16)]


def test_random_graphs(spark):
    from graphloom.operators import random_graphs as A

    v = spark.createDataFrame([(i,) for i in range(0, 40, 2)], "node bigint")
    for directed, k in ((True, 30), (True, 300), (False, 40)):
        e = rows(A.random_edges(v, k, 3, directed))
        assert len(set(e)) == len(e) == k * (1 if directed else 2) and all(a != b for a, b, _ in e)
    e = A.random_edges(v, 60, 5, False)
    new = rows(A.rewire(e, 3, directed=False, connected=True))
    assert {(b, a) for a, b, _ in new} == {(a, b) for a, b, _ in new} and new != rows(e)
    assert rows(X.degrees_und(A.rewire(e, 3, directed=False), v)) == rows(X.degrees_und(e, v))


def test_formats(spark, tmp_path):
    from graphloom.sources import formats as S

    names = tmp_path / "names.txt"
    names.write_text("DG L\r\nCA1 L\r\nCA3 R\n")
    assert rows(S.read_names(spark, str(names), 3)) == [(0, "DG "), (1, "CA1"), (2, "CA3")]
    places = tmp_path / "places.txt"
    places.write_text("# name side x y\nDG L 1.5 2\nCA1 R -1 0\n")
    assert rows(S.read_coordinates(spark, str(places))) == [("CA1 R", -1.0, 0.0), ("DG L", 1.5, 2.0)]


def test_network_statistic(spark):
    from graphloom.operators import populations as N

    strong = [(i, 0, 1, 10.0 + i % 3 if i < 8 else 1.0 + i % 3) for i in range(16)] + [(i, 1, 2, 9.0 + i % 2 if i < 8 else 2.0 + i % 2) for i in range(16)]
    cells = spark.createDataFrame(strong + [(i, 3, 4, 1.0 + i % 3) for i in range(16)], "subject bigint, src bigint, dst bigint, w double")
    groups = spark.createDataFrame([(i, int(i >= 8)) for i in range(16)], "subject bigint, grp int")
    got = N.nbs(cells, groups, 3.0, 20).collect()
    assert [r.edges for r in got] == [2] and got[0].p <= 0.1


def test_similarity_reaches_its_fixpoint(spark, sf_dir):
    from graphloom import path_queries  # noqa: F401  (registers)
    from graphloom.catalog import queries
    from graphloom.plans import graphs as G

    e, n = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3)])
    with pytest.raises(RuntimeError):
        R.simrank(e, n, max_steps=3)
    s = {(x.a, x.b): x.s for x in queries()["simrank"](spark, sf_dir).collect()}
    near: dict[int, list[int]] = {}
    for x in G.partners(spark, sf_dir).where("src <> dst").collect():
        near.setdefault(x.src, []).append(x.dst)
    for a in near:
        for b in near:
            want = 1 if a == b else 0.9 * sum(s.get((x, y), 0) for x in near[a] for y in near[b]) / (len(near[a]) * len(near[b]))
            assert abs(s.get((a, b), 0) - want) < 1e-4


def test_weighted_betweenness(spark):
    """Against all simple paths of a small graph with ties."""
    arcs = {(0, 1): 1, (1, 2): 1, (0, 2): 2, (2, 3): 1, (1, 3): 2, (3, 4): 3, (2, 4): 4, (4, 0): 1, (5, 0): 2, (3, 5): 1, (4, 5): 9}
    e = spark.createDataFrame([(a, b, float(w)) for (a, b), w in arcs.items()], "src bigint, dst bigint, w double")
    v = spark.createDataFrame([(i,) for i in range(7)], "node bigint")
    node, edge, inverse, ordered = dict.fromkeys(range(7), 0.0), dict.fromkeys(arcs, 0.0), 0.0, 42
    for s in range(7):
        paths = {}
        todo = [(s,)]
        while todo:
            p = todo.pop()
            todo += [(*p, b) for (a, b) in arcs if a == p[-1] and b not in p]
            if len(p) > 1:
                paths.setdefault(p[-1], []).append((sum(arcs[x] for x in zip(p, p[1:])), p))
        for found in paths.values():
            best = min(found)[0]
            inverse += 1 / best
            short = [p for n, p in found if n == best]
            for p in short:
                for x in p[1:-1]:
                    node[x] += 1 / len(short)
                for x in zip(p, p[1:]):
                    edge[x] += 1 / len(short)
    got_node, got_edge = R.betweenness_weighted(e, v)
    assert {n: pytest.approx(b) for n, b in rows(got_node)} == node
    assert {(a, b): pytest.approx(x) for a, b, x in rows(got_edge)} == {k: x for k, x in edge.items() if x}
    assert rows(R.efficiency_weighted(X.invert(e), v))[0][0] == pytest.approx(inverse / ordered)


def test_weighted_local_efficiency_of_equal_weights(spark):
    """With unit weights and neighbours one edge apart it is the clustering coefficient."""
    e, v = graph(spark, [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4)])
    assert rows(R.local_efficiency_weighted(e, v)) == [(n, pytest.approx(c)) for n, c in rows(T.clustering_und(e, v))]


def test_unsettled_loops_raise(spark):
    e, _ = graph(spark, [(i, i + 1) for i in range(6)])
    with pytest.raises(RuntimeError):
        R.breadth_distances(e, max_steps=3)


def test_components_of_a_small_graph_take_no_rounds(spark, monkeypatch):
    from graphloom.functions import components

    tables = []
    monkeypatch.setattr(components, "stored", lambda df, name, put=components.stored: tables.append(name) or put(df, name))
    n = 12_000
    e = spark.range(n).selectExpr("(id * 7919) % 12001 AS src", "((id + 1) * 7919) % 12001 AS dst")  # a path through all
    got = connected_components(e.union(e.select("dst", "src")))
    assert got.agg({"comp": "max"}).first()[0] == 0 and got.count() == n + 1
    assert len(tables) <= 2
