"""Similarity of graphs, null models, drawn generators and orders against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import communities as M
from graphloom.operators import null_models as Z
from graphloom.operators import optimisers as O
from graphloom.operators import paths as R
from graphloom.operators import partitions as P
from graphloom.operators import random_graphs as A
from graphloom.operators import similarity as Y
from graphloom.operators import spatial as D


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src bigint, dst bigint, w double")


def mirror(rows):
    return [x for a, b, w in rows for x in ((a, b, w), (b, a, w))]


def nodes_of(spark, n):
    return spark.createDataFrame([(i,) for i in range(n)], "node bigint")


def blocks(seed, n, size, inside=0.8, between=0.1):
    r = np.random.default_rng(seed)
    return [(a, b, float(r.integers(1, 4))) for a in range(n) for b in range(a) if r.random() < (inside if a // size == b // size else between)]


def test_comodularity_counts_pairs(spark):
    r = random.Random(3)
    one, two = ([r.randrange(3) for _ in range(12)] for _ in range(2))
    e1, e2 = blocks(1, 12, 4), blocks(2, 12, 3)
    f = either = e = g = h = hh = 0
    s1, s2 = {(b, a) for a, b, _ in e1}, {(b, a) for a, b, _ in e2}
    for x in itertools.combinations(range(12), 2):
        t1, t2 = one[x[0]] == one[x[1]], two[x[0]] == two[x[1]]
        f, either = f + (t1 and t2), either + (t1 or t2)
        if x in s1 | s2:
            e, g = e + 1, g + (t1 and t2)
        if x in s1 & s2:
            h, hh = h + (t1 and t2), hh + (t1 or t2)
    p = [spark.createDataFrame(list(enumerate(c)), "node bigint, comm bigint") for c in (one, two)]
    got = Y.comodularity(edges_of(spark, mirror(e1)), edges_of(spark, mirror(e2)), *p).first()
    assert tuple(got) == pytest.approx((f / either, g / e, h / e, h / hh, len(set(one)) + len(set(two)) - 1))
    sizes = [[c.count(k) for k in set(c)] for c in (one, two)]
    scale = sum(a * a * b * b / (12**3 * (a + b) - 12 * a * b) for a in sizes[0] for b in sizes[1])
    assert Y.comodularity_ratio(*p).first()[0] == pytest.approx(f / either / scale)


def test_runs_are_optimised_apart(spark):
    rows = {0: mirror(blocks(5, 12, 4, 1.0, 0.05)), 1: mirror(blocks(6, 12, 6, 1.0, 0.05)), 2: []}
    e = spark.createDataFrame([(k, a, b, w) for k, x in rows.items() for a, b, w in x], "run bigint, src bigint, dst bigint, w double")
    runs = spark.createDataFrame([(k, i) for k in rows for i in range(12)], "run bigint, node bigint")
    best = O.best_of_runs(e, runs).persist()
    for k in (0, 1):
        g, p = edges_of(spark, rows[k]), best.where(F.col("run") == k).select("node", "comm")
        planted = spark.createDataFrame([(i, i // (4, 6)[k]) for i in range(12)], "node bigint, comm bigint")
        assert P.modularity(g, p).first()[0] >= P.modularity(g, planted).first()[0] - 1e-9
        assert O.move_gains(g, p).where("gain > 1e-9").isEmpty()
    assert {x.comm for x in best.where("run = 2").collect()} == set(range(12))


def test_degenerate_partitions_and_similarity(spark):
    rows = mirror(blocks(7, 12, 4, 0.9, 0.15))
    e, v = edges_of(spark, rows), nodes_of(spark, 12)
    parts = Y.degenerate_partitions(e, v, 4, cap=0.5, cutoff=0.8).toPandas()
    assert set(parts.run) == {1, 2, 3, 4} and len(parts) == 48
    best = P.modularity(e, O.best_of(e, v)).first()[0]
    for _, g in parts.groupby("run"):
        q = P.modularity(e, spark.createDataFrame(g[["node", "comm"]])).first()[0]
        assert 0.75 * best <= q <= best + 0.05
    got = Y.cross_modularity_degenerate(e, e, v, 3).collect()
    assert len(got) == 3 and all(x.similarity > 0.8 for x in got)
    rate = Y.degenerate_rate(spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.9)], "run bigint, similarity double"), 0.7).first()
    assert rate.mean == pytest.approx(0.7) and rate.p == pytest.approx(2 / 3)


def test_equal_graphs_are_more_alike_than_shuffled_ones(spark):
    e, v = edges_of(spark, mirror(blocks(8, 12, 4, 1.0, 0.1))), nodes_of(spark, 12)
    got = Y.similarity_test(e, e, v, 4, swaps=1, steps=2).first()
    assert got.similarity == pytest.approx(1.0) and got.p <= 0.25


@pytest.mark.parametrize("directed", [False, True])
def test_null_model_keeps_degrees_weights_and_strengths(spark, directed):
    r = np.random.default_rng(4)
    size = np.exp(r.normal(0, 1.0, 16))
    rows = [(a, b, float((-1) ** (r.random() < 0.3) * (size[a] * size[b] * r.uniform(0.8, 1.2) + 0.01))) for a in range(16) for b in range(16 if directed else a) if a != b and r.random() < 0.5]
    rows = rows if directed else mirror(rows)
    e, v = edges_of(spark, rows), nodes_of(spark, 16)
    new = Z.null_model(e, v, runs=2, swaps=2, steps=3, directed=directed).persist()
    count = lambda x, end: sorted((t[end], t[2] > 0) for t in x)
    for run in (1, 2):
        got = [(x.src, x.dst, x.w) for x in new.where(F.col("run") == run).collect()]
        assert count(got, 0) == count(rows, 0) and count(got, 1) == count(rows, 1)
        assert sorted(x[2] for x in got) == pytest.approx(sorted(x[2] for x in rows))
        assert len({x[:2] for x in got}) == len(got) and all(a != b for a, b, _ in got)
        assert {x[:2] for x in got} != {x[:2] for x in rows}
    assert all(x.r > 0.7 for x in Z.strength_correlation(e, new, v).where("sign > 0").collect())


def test_graph_of_degrees(spark):
    r = random.Random(6)
    e = {(r.randrange(30), r.choice([0, 1, 2, r.randrange(30)])) for _ in range(250)}
    e = {x for x in e if x[0] != x[1]}  # hubs, so that loops and copies come up
    k = [(i, sum(b == i for _, b in e), sum(a == i for a, _ in e)) for i in range(30)]
    got = [(x.src, x.dst) for x in Z.graph_of_degrees(spark.createDataFrame(k, "node bigint, k_in bigint, k_out bigint")).collect()]
    assert len(set(got)) == len(got) == len(e) and all(a != b for a, b in got)
    assert [(i, sum(b == i for _, b in got), sum(a == i for a, _ in got)) for i in range(30)] == k
    with pytest.raises(ValueError):
        Z.graph_of_degrees(spark.createDataFrame([(1, 1, 2)], "node bigint, k_in bigint, k_out bigint"))


def test_graph_of_degrees_that_is_nearly_full(spark):
    r = random.Random(4)
    full = [(i, -1 - j) for i in range(60) for j in range(8)]
    e = set(full) - set(r.sample(full, 24))
    k = [(n, sum(b == n for _, b in e), sum(a == n for a, _ in e)) for n in sorted({x for p in full for x in p})]
    got = [(x.src, x.dst) for x in Z.graph_of_degrees(spark.createDataFrame(k, "node bigint, k_in bigint, k_out bigint"), max_rounds=40).collect()]
    assert len(set(got)) == len(got) == len(e)
    assert [(n, sum(b == n for _, b in got), sum(a == n for a, _ in got)) for n, _, _ in k] == k


def test_null_covariance_has_the_moments(spark):
    r = np.random.default_rng(2)
    n = 60
    x = r.normal(0.3, 1, (n, 1)) + r.normal(0, 1, (n, 40)) + 0.9 * r.normal(0, 1, (1, 40))
    cov, sd = np.cov(x), x.std(axis=1, ddof=1)
    corr = np.corrcoef(x)
    e = edges_of(spark, [(a, b, corr[a, b]) for a in range(n) for b in range(n) if a != b])
    got = Z.null_covariance(e, spark.createDataFrame([(i, float(s)) for i, s in enumerate(sd)], "node bigint, sd double")).where("src < dst").toPandas()
    up = cov[np.triu_indices(n, 1)]
    assert len(got) == len(up) and got["cov"].mean() == pytest.approx(up.mean(), abs=0.5 * up.std()) and 0.5 < got["cov"].std() / up.std() < 2
    assert got["w"].abs().max() <= 1 + 1e-9


def test_drawn_edges(spark):
    v = nodes_of(spark, 200)
    got = D.toeplitz_edges(v, 900, 4.0).toPandas()
    assert len(got) == len(got.drop_duplicates()) == 900 and (got.src != got.dst).all()
    d = (got.src - got.dst).abs()
    assert 2 < d.mean() < 5 and d.max() < 25
    few = D.toeplitz_edges(nodes_of(spark, 5), 20, 50.0).toPandas()  # all pairs there are
    assert len(few.drop_duplicates()) == 20
    with pytest.raises(ValueError):
        D.toeplitz_edges(nodes_of(spark, 5), 21, 50.0)
    even = D.even_clusters(nodes_of(spark, 30), 30 * 3 + 100, 2).toPandas()
    inside = even[even.src // 4 == even.dst // 4]
    assert len(even.drop_duplicates()) == len(even) == 190 and len(inside) == 7 * 12 + 2 and (even.src != even.dst).all()
    assert len(D.even_clusters(nodes_of(spark, 8), 3, 2).toPandas()) == 24


def test_sampled_path_length(spark):
    e, v = edges_of(spark, mirror(blocks(9, 20, 5, 0.7, 0.05))), nodes_of(spark, 22)
    got = D.sampled_path_length(e, v).first()
    dist = {(x.src, x.dst): x.d for x in R.breadth_distances(e).where("src <> dst").collect()}
    mean = [sum(d for (a, _), d in dist.items() if a == i) / (1 + sum(a == i for a, _ in dist)) for i in range(22)]
    assert tuple(got) == (22, pytest.approx(float(np.median(mean))))
    some = D.sampled_path_length(e, v, 1.0, 0.5, 0.5).first()
    assert some.sources == D.sample_size(1.0, 0.5, 0.5) < 22 and 0 < some.median < max(mean) + 1
    assert D.sample_size(0.5, 0.15, 0.05) == math.ceil(8 * math.log(40) * 0.85**2 / 0.15**2)


@pytest.mark.parametrize("share", [0.15, 0.85])
def test_randomised_graphs_keep_degrees(spark, share):
    r = np.random.default_rng(5)
    rows = mirror([(a, b, 1.0) for a in range(16) for b in range(a) if r.random() < share])
    got = [(x.src, x.dst) for x in D.randomise(edges_of(spark, rows), nodes_of(spark, 16), 0.3).collect()]
    old = [(a, b) for a, b, _ in rows]
    assert len(set(got)) == len(got) and sorted(a for a, _ in got) == sorted(a for a, _ in old)
    assert set(got) != set(old) and {(b, a) for a, b in got} == set(got)


def test_coreness_is_what_peeling_leaves(spark):
    rows = blocks(11, 18, 6, 0.8, 0.2) + [(19, 0, 1.0)]
    near = {i: {b if a == i else a for a, b, _ in rows if i in (a, b)} for i in range(21)}
    want, left, k = {}, set(near), 0
    while left:
        weak = [i for i in left if len(near[i] & left) <= k]
        if weak:
            want.update(dict.fromkeys(weak, k))
            left -= set(weak)
        else:
            k += 1
    assert {x.node: x.core for x in R.coreness(edges_of(spark, mirror(rows)), nodes_of(spark, 21)).collect()} == want


def test_consensus_and_nested_modularity(spark):
    e, v = A.ring_of_cliques(spark, 5, 3), nodes_of(spark, 16)
    got = {x.node: x.comm for x in M.consensus(e, v, 0.5, 4).collect()}
    assert got == {i: i // 5 * 5 for i in range(15)} | {15: 15}
    halves = spark.createDataFrame([(i, i // 10) for i in range(15)], "node bigint, comm bigint")
    inner = {x.comm: (x.communities, x.q) for x in D.nested_modularity(e, halves).collect()}
    assert inner[0][0] == 2 and inner[0][1] > 0.3 and inner[1] == (1, pytest.approx(0.0))


def test_surprise_is_a_hypergeometric_tail(spark):
    e = edges_of(spark, mirror(blocks(12, 15, 5, 0.8, 0.2)))
    p = spark.createDataFrame([(i, i // 5) for i in range(15)], "node bigint, comm bigint")
    mi, pi, m, total = P.surprise_parameters(e, p).first()
    tail = sum(math.comb(pi, j) * math.comb(total - pi, m - j) for j in range(mi, min(m, pi) + 1)) / math.comb(total, m)
    assert P.surprise(e, p).first()[0] == pytest.approx(-math.log10(tail), rel=1e-9)


def test_null_model_of_even_strengths(spark):
    """A complete graph whose strengths hardly differ; which places are taken first must not outweigh them."""
    rng = random.Random(3)
    level = [rng.uniform(0.97, 1.03) for _ in range(20)]
    e = [(a, b, 1000 * level[a] * level[b] * rng.uniform(0.95, 1.05)) for a in range(20) for b in range(a)]
    edges = spark.createDataFrame(e + [(b, a, w) for a, b, w in e], "src bigint, dst bigint, w double")
    nodes = spark.range(20).withColumnRenamed("id", "node")
    new = Z.null_model(edges, nodes)
    assert Z.strength_correlation(edges, new, nodes).first()["r"] > 0.9
