"""Ranges, eccentricities, peeling, paired tests, constrained rewiring and clique benchmarks on small graphs."""

import itertools
import math
import random

import pytest

from graphloom.operators import paths as R
from graphloom.operators import populations as N
from graphloom.operators import random_graphs as A


def graph(spark, arcs):
    nodes = sorted({x for a in arcs for x in a[:2]} | {99})
    return spark.createDataFrame([(a, b, float(w[0]) if w else 1.0) for a, b, *w in arcs], "src bigint, dst bigint, w double"), spark.createDataFrame([(n,) for n in nodes], "node bigint")


def both(pairs):
    return [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_ranges_and_shortcuts(spark):
    # a triangle with a tail; the edge of the tail has no other way
    e, _ = graph(spark, both([(0, 1), (1, 2), (2, 0), (2, 3)]))
    got = {(a, b): (r, s) for a, b, r, s in rows(R.shortcuts(e))}
    assert got[0, 1] == (2, False) and got[2, 3] == (None, True)
    assert rows(R.range_summary(R.shortcuts(e))) == [(2.0, 0.25)]
    assert rows(R.range_summary(R.shortcuts(e.limit(0)))) == [(None, None)]


def test_eccentricity_and_path_length(spark):
    e, v = graph(spark, [(0, 1), (1, 2)])
    d = R.distances(e, v)
    assert rows(R.eccentricity(d, v)) == [(0, 2), (1, 1), (2, 0), (99, 0)]
    # three pairs of length 1, 1, 2 and four of length 0; 12 ordered pairs
    assert rows(R.charpath(d, v)) == [(4 / 7, pytest.approx(2.5 / 12), 0, 2)]


def test_peel_levels(spark):
    # a triangle with a path of two hung on it: the far end goes first
    e, v = graph(spark, both([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)]))
    assert rows(R.peel_levels(e, v, 2)) == [(0, 0), (1, 0), (2, 0), (3, 2), (4, 1), (99, None)]
    assert {x for _, x in rows(R.peel_levels(e, v, 9))} == {1, None}
    assert rows(R.peel_levels(e.limit(0), v.where("node = 99"), 2)) == [(99, None)]


def test_local_efficiency_of_directed_edges(spark):
    """Against matrices: symmetrised roots of weights and of inverse distances among the neighbours."""
    draw = random.Random(5)
    w = {(a, b): draw.randint(1, 8) / 8 for a in range(7) for b in range(7) if a != b and draw.random() < 0.4}
    root = lambda x: x ** (1 / 3)
    want = {}
    for u in range(7):
        near = [v for v in range(7) if (u, v) in w or (v, u) in w]
        d = {(a, b): 0.0 if a == b else 1 / w[a, b] if (a, b) in w else math.inf for a in near for b in near}
        for k, a, b in itertools.product(near, near, near):
            d[a, b] = min(d[a, b], d[a, k] + d[k, b])
        s = {v: root(w.get((u, v), 0)) + root(w.get((v, u), 0)) for v in near}
        k = [((u, v) in w) + ((v, u) in w) for v in near]
        top = sum(s[a] * s[b] * (root(1 / d[a, b]) + root(1 / d[b, a])) for a in near for b in near if a != b) / 2
        low = sum(k) ** 2 - sum(x * x for x in k)
        want[u] = top / low if low else 0.0
    e, v = graph(spark, [(a, b, x) for (a, b), x in w.items()])
    assert dict(rows(R.local_efficiency_weighted(e, v))) == {**{n: pytest.approx(x) for n, x in want.items()}, 99: 0.0}


def test_paired_statistic(spark):
    """A shift inside every pair that the spread between pairs hides from the unpaired test."""
    cells, pairs = [], []
    for p in range(8):
        pairs.append((p, p, 100 + p))
        for edge in ((0, 1), (1, 2)):
            cells += [(p, *edge, 50.0 * p + 12 + p % 3), (100 + p, *edge, 50.0 * p + 1 + p % 2)]
        cells += [(p, 4, 5, 7.0 + p % 2), (100 + p, 4, 5, 7.0 + (p // 2) % 2)]
    cells = spark.createDataFrame(cells, "subject bigint, src bigint, dst bigint, w double")
    pairs = spark.createDataFrame(pairs, "pair bigint, a bigint, b bigint")
    groups = pairs.selectExpr("a AS subject", "0 AS grp").union(pairs.selectExpr("b", "1"))
    assert N.nbs(cells, groups, 3.0, 10).count() == 0
    got = N.nbs_paired(cells, pairs, 3.0, 40).collect()
    assert [r.edges for r in got] == [2] and got[0].p <= 0.1
    diff = [11 + p % 3 - p % 2 for p in range(8)]
    mean = sum(diff) / 8
    t = mean / math.sqrt(sum((x - mean) ** 2 for x in diff) / 7) * math.sqrt(8)
    one = pairs.selectExpr("*", "1 AS sign")
    assert {(a, b): x for a, b, x in rows(N.paired_t(cells, one, [], "right"))}[0, 1] == pytest.approx(t)
    assert {(a, b): x for a, b, x in rows(N.paired_t(cells, one, [], "left"))}[0, 1] == pytest.approx(-t)


@pytest.mark.parametrize("directed", [True, False])
def test_rewiring_avoids_places(spark, directed):
    draw = random.Random(2)
    pairs = [(a, b) for a in range(20) for b in range(a) if draw.random() < 0.25]
    e, _ = graph(spark, pairs if directed else both(pairs))
    shut = A.cliques(spark.range(20).selectExpr("id AS node", "id % 4 AS comm"))
    new = A.rewire(e, 4, directed=directed, avoid=shut)
    old, got, no = set(rows(e.select("src", "dst"))), set(rows(new.select("src", "dst"))), set(rows(shut.select("src", "dst")))
    assert got != old and not (got - old) & no
    for i in (0, 1):
        assert sorted(x[i] for x in got) == sorted(x[i] for x in old)
    with pytest.raises(ValueError):
        A.rewire(e, 1, by_sign=True, avoid=shut)


def test_ring_of_groups(spark):
    parts = spark.createDataFrame([(0, 7), (1, 7), (2, 7), (3, 5), (4, 5), (5, 9)], "node bigint, comm bigint")
    # sizes 1 (comm 9), 2 (comm 5), 3 (comm 7)
    want = set(both([(0, 1), (0, 2), (1, 2), (3, 4), (5, 3), (4, 0), (2, 5)]))
    assert set(rows(A.ring_of_groups(parts).select("src", "dst"))) == want and A.ring_of_groups(parts).count() == len(want)
    one = parts.where("comm = 5")
    assert set(rows(A.ring_of_groups(one).select("src", "dst"))) == {(3, 4), (4, 3)}
    assert A.ring_of_groups(parts.limit(0)).isEmpty()


def test_cliques_hang_on_the_giant_component(spark):
    nodes = spark.range(60).withColumnRenamed("id", "node")
    parts = spark.range(100, 112).selectExpr("id AS node", "id div 4 AS comm")
    got = rows(A.cliques_on_random(nodes, parts, 40).select("src", "dst"))
    near = {}
    for a, b in got:
        near.setdefault(a, set()).add(b)
    assert len(got) == len(set(got)) and all((b, a) in set(got) for a, b in got)
    assert all({x for x in near[n] if x >= 100} == {x for x in range(100, 112) if x // 4 == n // 4} - {n} for n in range(100, 112))
    assert [n for n in range(100, 112) if any(x < 100 for x in near[n])] == [100, 104, 108]
    seen, todo = set(), [100]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += near[n]
    assert seen == set(near)  # one component
