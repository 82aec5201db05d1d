"""Neighbour lists that are joined in tasks: against brute force in many blocks, and without shuffles of wedges."""

import itertools
import math
import random

import pytest

from graphloom.functions import neighbour_lists
from graphloom.operators import wedges as T


def mirrored(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for x, y in pairs for a, b in ((x, y), (y, x))], "src bigint, dst bigint, w double")


def shuffled(df):
    """The most rows that an exchange of the query wrote."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
        else:
            rows = plan.metrics().get("shuffleRecordsWritten")
            most = max(most, rows.get().value() if rows.isDefined() else 0)
            todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return most


@pytest.fixture
def graph(spark, monkeypatch):
    """Random edges and a hub; lists of few entries a block, so that there are many blocks."""
    monkeypatch.setattr(neighbour_lists, "ENTRIES", 60)
    rng = random.Random(5)
    ids = [10**12 * rng.randint(-3, 3) + i for i in range(40)]
    pairs = {tuple(sorted(rng.sample(ids, 2))) for _ in range(150)} | {tuple(sorted((ids[0], v))) for v in ids[1:]}
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in ids}
    return ids, pairs, near


@pytest.fixture
def sides(spark):
    """Complete between two sides: no triangle, many wedges; joins by shuffles, plans as they stand."""
    fixed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in fixed}
    for k, v in fixed.items():
        spark.conf.set(k, v)
    yield [(a, 1000 + b) for a in range(150) for b in range(150)]
    for k, v in before.items():
        spark.conf.set(k, v)


def test_edge_overlap(spark, graph):
    _, pairs, near = graph
    got = {(r.src, r.dst): r.overlap for r in T.edge_neighbour_overlap(mirrored(spark, pairs)).collect()}
    assert set(got) == pairs | {(b, a) for a, b in pairs}
    for (a, b), x in got.items():
        n = len(near[a] & near[b])
        rest = len(near[a]) + len(near[b]) - n - 2
        assert x == (n / rest if rest else None)


def test_edge_overlap_shuffles_no_wedges(spark, sides):
    df = T.edge_neighbour_overlap(mirrored(spark, sides)).where("overlap > 0")
    assert shuffled(df) < 30_000 and not df.count()


def test_neighbour_scores(spark, graph):
    _, pairs, near = graph
    got = {(r.a, r.b): r for r in T.neighbour_scores(mirrored(spark, pairs)).collect()}
    assert set(got) == pairs
    for (a, b), r in got.items():
        both = near[a] & near[b]
        assert r.jaccard == len(both) / len(near[a] | near[b]) and r.pa == len(near[a]) * len(near[b])
        assert math.isclose(r.ra, sum(1 / len(near[v]) for v in both), abs_tol=1e-12)
        assert math.isclose(r.aa, sum(1 / math.log(len(near[v])) for v in both), abs_tol=1e-12)


def test_neighbour_scores_shuffle_no_wedges(spark, sides):
    df = T.neighbour_scores(mirrored(spark, sides)).where("ra > 0")
    assert shuffled(df) < 30_000 and df.count() == 0


def test_matching_und(spark, graph):
    ids, pairs, near = graph
    got = {(r.src, r.dst): r.m for r in T.matching_und(mirrored(spark, pairs)).collect()}
    want = {}
    for a, b in itertools.permutations(ids, 2):
        if n := len(near[a] & near[b]):
            want[a, b] = 2 * n / (len(near[b]) - (a in near[b]) + n)
    assert got == want


def test_matching_und_shuffles_no_wedges(spark, sides):
    df = T.matching_und(mirrored(spark, sides))
    assert shuffled(df) < 10_000 and df.count() == 2 * 150 * 149


def test_clustering(spark, graph):
    ids, pairs, near = graph
    nodes = spark.createDataFrame([(v,) for v in [*ids, -7]], "node bigint")
    got = {r.node: r.c for r in T.clustering_und(mirrored(spark, pairs), nodes).collect()}
    assert len(got) == len(ids) + 1 and got[-7] == 0
    for v in ids:
        k, t = len(near[v]), sum(tuple(sorted(p)) in pairs for p in itertools.combinations(near[v], 2))
        assert got[v] == (2 * t / (k * (k - 1)) if k > 1 else 0)


def test_clustering_shuffles_no_wedges(spark, sides):
    nodes = spark.createDataFrame([(a,) for a, _ in sides], "node bigint").distinct()
    df = T.clustering_und(mirrored(spark, sides), nodes).where("c > 0")
    assert shuffled(df) < 30_000 and df.count() == 0


def test_transitivity(spark, graph):
    ids, pairs, near = graph
    t = sum({tuple(sorted(p)) for p in itertools.combinations(x, 2)} <= pairs for x in itertools.combinations(ids, 3))
    assert math.isclose(T.transitivity_und(mirrored(spark, pairs)).first().t, 6 * t / sum(len(n) * (len(n) - 1) for n in near.values()))


def test_transitivity_shuffles_no_wedges(spark, sides):
    df = T.transitivity_und(mirrored(spark, sides))
    assert shuffled(df) < 30_000 and df.first().t == 0
