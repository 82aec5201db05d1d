"""Spectral bisection and subgraph centrality against dense matrices."""

import math

import duckdb
import numpy as np
import pytest

from graphloom.operators import random_graphs as A
from graphloom.operators import spectral as S


def graph(spark, rows):
    return spark.createDataFrame([(*r, 1.0) if len(r) == 2 else r for r in rows], "src bigint, dst bigint, w double")


def mirrored(rows):
    return [(a, b, *w) for a, b, *w in rows] + [(b, a, *w) for a, b, *w in rows]


def nodes_of(spark, n):
    return spark.createDataFrame([(i,) for i in range(n)], "node bigint")


def modularity(rows, comm, gamma=1.0):
    total, inside, out, into = sum(r[2] for r in rows), 0.0, {}, {}
    for a, b, w in rows:
        inside += w * (comm[a] == comm[b])
        out[comm[a]], into[comm[b]] = out.get(comm[a], 0) + w, into.get(comm[b], 0) + w
    return inside / total - gamma * sum(x * into.get(c, 0) for c, x in out.items()) / total**2


@pytest.mark.parametrize("dense", [1000, 12])
def test_bisection_finds_cliques(spark, dense):
    e = A.ring_of_cliques(spark, 6, 4).persist()
    rows = [tuple(r) for r in e.collect()]
    tree = S.bisect(e, nodes_of(spark, 24), dense=dense, krylov=6).toPandas()
    last = tree[tree.level == tree.level.max()].set_index("node").comm.to_dict()
    assert last == {i: i // 6 * 6 for i in range(24)}
    con = duckdb.connect()
    con.register("tree", tree)
    edges = e.toPandas()  # noqa: F841
    q = con.sql("""WITH total AS (SELECT sum(w) AS t FROM edges), x AS (SELECT a.level, a.comm AS c1, b.comm AS c2, w FROM edges JOIN tree a ON a.node = src JOIN tree b ON b.node = dst AND a.level = b.level),
        c AS (SELECT level, c1 AS c, sum(CASE WHEN c1 = c2 THEN w ELSE 0 END) AS i, sum(w) AS k FROM x GROUP BY 1, 2) SELECT level, sum(i / t - k * k / t / t) FROM c, total GROUP BY 1 ORDER BY 1""").fetchall()
    assert all(b > a + 1e-9 for (_, a), (_, b) in zip(q[:-1], q[1:], strict=True)) and len(q) > 2
    assert math.isclose(q[-1][1], modularity(rows, last))


def test_bisection_of_directed_graphs_with_loops_and_lone_nodes(spark):
    r = np.random.default_rng(3)
    block = [i // 7 for i in range(21)]
    rows = [(int(a), int(b), float(r.integers(1, 5))) for a in range(21) for b in range(21) if r.random() < (0.7 if block[a] == block[b] else 0.06)]
    e = graph(spark, rows)
    found = {}
    for dense in (1000, 15):
        got = {x.node: x.comm for x in S.spectral(e, nodes_of(spark, 23), dense=dense, krylov=6).collect()}
        assert set(got) == set(range(23))
        found[dense] = modularity(rows, got)
        assert all(c == min(n for n in got if got[n] == c) for c in got.values())
    planted = modularity(rows, dict(enumerate(block)))
    assert min(found.values()) >= planted - 1e-9
    none = S.bisect(e.limit(0), nodes_of(spark, 3)).collect()
    assert {(x.level, x.node, x.comm) for x in none} == {(0, 0, 0), (0, 1, 0), (0, 2, 0)}


def test_halves_are_at_least_the_signs_of_the_leading_vector():
    r = np.random.default_rng(8)
    for n in (2, 5, 9):
        for _ in range(30):
            b = r.normal(size=(n, n))
            b = b + b.T
            b -= np.diag(b.sum(axis=1))
            side, q = S._halves(b)
            assert np.isclose(side @ b @ side, q)
            lead = np.where(np.linalg.eigh(b)[1][:, -1] >= 0, 1.0, -1.0)
            assert q >= lead @ b @ lead - 1e-9
            for i in range(n):  # no single move helps
                other = side.copy()
                other[i] *= -1
                assert other @ b @ other <= q + 1e-9


def test_subgraph_centrality(spark):
    r = np.random.default_rng(1)
    rows = [(a, b, 2.0) for a in range(14) for b in range(a) if r.random() < 0.3]
    a = np.zeros((16, 16))
    for x, y, _ in rows:
        a[x, y] = a[y, x] = 1
    values, vectors = np.linalg.eigh(a)
    want = (vectors**2) @ np.exp(values)
    e = graph(spark, mirrored(rows) + [(3, 3, 1.0)])
    got = {x.node: x.c for x in S.subgraph_centrality(e, nodes_of(spark, 16)).collect()}
    assert set(got) == set(range(16)) and all(abs(got[i] - want[i]) < 1e-8 * want[i] for i in got)
    some = S.subgraph_centrality(e, nodes_of(spark, 16), 1e-3, nodes_of(spark, 2)).collect()
    assert {x.node for x in some} == {0, 1} and all(want[x.node] - 1e-3 - 1e-9 <= x.c <= want[x.node] + 1e-9 for x in some)
    assert [x.c for x in S.subgraph_centrality(e.limit(0), nodes_of(spark, 2)).collect()] == [1.0, 1.0]


def test_the_rest_of_the_series_is_below_the_bound():
    for most in (0.5, 3.0, 12.0):
        for eps in (1e-3, 1e-9):
            k = S.terms_for(most, eps)
            rest = math.exp(most) - sum(most**i / math.factorial(i) for i in range(k + 1))
            assert rest <= eps + 1e-12 * math.exp(most)
