"""Move gains against whole qualities, motifs against brute force."""

import itertools
import random

import pytest

from graphloom.operators import motifs as M
from graphloom.operators import optimisers as O
from graphloom.operators import partitions as P


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def signed(spark):
    draw = random.Random(3)
    pairs = {(a, b): draw.choice([-2.0, -1.0, 1.0, 1.0, 3.0]) for a in range(9) for b in range(a) if draw.random() < 0.6}
    e = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()] + [(b, a, w) for (a, b), w in pairs.items()], "src bigint, dst bigint, w double")
    return e, spark.createDataFrame([(i, i % 3) for i in range(9)], "node bigint, comm bigint")


@pytest.mark.parametrize("method", ["modularity", "surprise", "sta", "neg"])
def test_gains_are_differences_of_qualities(spark, method):
    e, p = signed(spark)
    e = e if method in O.SIGNED else e.where("w > 0").selectExpr("src", "dst", "1D AS w")
    before = O.quality(e, p, method).first()[0]
    gains = rows(O.move_gains(e, p, method))
    assert gains
    for node, comm, gain in random.Random(1).sample(gains, 4):
        after = O.quality(e, p.selectExpr("node", f"CASE WHEN node = {node} THEN {comm} ELSE comm END AS comm"), method).first()[0]
        assert gain == pytest.approx(after - before, abs=1e-9)


def test_qualities_agree(spark):
    e, p = signed(spark)
    up = e.where("w > 0").selectExpr("src", "dst", "1D AS w")
    assert O.quality(up, p).first()[0] == pytest.approx(P.modularity(up, p).first()[0])
    assert O.quality(up, p, "cpm", 0.3).first()[0] == pytest.approx(P.cpm(up, p, 0.3).first()[0])
    assert O.quality(up, p, "significance").first()[0] == pytest.approx(P.significance(up, p).first()[0])
    assert O.quality(e, p, "sta").first()[0] == pytest.approx(P.modularity_sign(e, p).first()[0])


def test_no_edges(spark):
    e = spark.createDataFrame([], "src bigint, dst bigint, w double")
    v = spark.createDataFrame([(1,), (2,)], "node bigint")
    assert rows(O.move_gains(e, v.selectExpr("node", "node AS comm"))) == []
    assert M.motifs(e).isEmpty()


def test_motif_classes():
    assert len(set(M.classes(3).values())) == 13
    assert len(set(M.classes(4).values())) == 199


@pytest.mark.parametrize(("size", "functional"), [(3, False), (3, True), (4, False), (4, True)])
def test_motifs(spark, size, functional):
    draw = random.Random(size)
    w = {(a, b): draw.randint(1, 8) / 8 for a in range(7) for b in range(7) if a != b and draw.random() < 0.4}
    of, want = M.classes(size), {}
    for t in itertools.combinations(range(7), size):
        bits = [(1 << k, w[t[a], t[b]]) for k, (a, b) in enumerate(M.arcs(size)) if (t[a], t[b]) in w]
        for n in range(1, len(bits) + 1) if functional else [len(bits)]:
            for part in itertools.combinations(bits, n):
                kind = of.get(sum(b for b, _ in part))
                if kind is None:
                    continue
                product = 1.0
                for _, x in part:
                    product *= x
                i = product ** (1 / n)
                for node in t:
                    old = want.get((node, kind), (0, 0.0, 0.0))
                    want[node, kind] = (old[0] + 1, old[1] + i, old[2] + i / (sum(x for _, x in part) / n))
    e = spark.createDataFrame([(a, b, x) for (a, b), x in w.items()], "src bigint, dst bigint, w double")
    got = {(r.node, r["class"]): (r.n, r.intensity, r.coherence) for r in M.motifs(e, size, functional).collect()}
    assert got.keys() == want.keys()
    for k, x in want.items():
        assert got[k] == pytest.approx(x)


def cliques(spark):
    from graphloom.operators.random_graphs import ring_of_cliques

    e = ring_of_cliques(spark, 4, 4)
    return e, e.select(e.src.alias("node")).distinct()


@pytest.mark.parametrize("method", ["modularity", "significance", "surprise", "cpm", "sta"])
def test_optimisers_find_cliques(spark, method):
    e, v = cliques(spark)
    assert rows(O.best_of(e, v, method, 0.5 if method == "cpm" else 1.0)) == [(i, i // 4 * 4) for i in range(16)]


def test_agglomeration_finds_cliques(spark):
    e, v = cliques(spark)
    assert rows(O.agglomerate(e, v)) == [(i, i // 4 * 4) for i in range(16)]


@pytest.mark.parametrize("method", ["surprise", "neg"])
def test_merge_gains(spark, method):
    e, p = signed(spark)
    e = e if method in O.SIGNED else e.where("w > 0").selectExpr("src", "dst", "1D AS w")
    before = O.quality(e, p, method).first()[0]
    for a, b, gain in rows(O.merge_gains(e, p, method)):
        after = O.quality(e, p.selectExpr("node", f"CASE WHEN comm = {b} THEN {a} ELSE comm END AS comm"), method).first()[0]
        assert gain == pytest.approx(after - before, abs=1e-9)


@pytest.mark.parametrize("jump", [0.0, 0.5])
def test_finetuned_partitions_rest(spark, jump):
    e, p = signed(spark)
    arcs = e.where("w > 0 AND (src + 2 * dst) % 3 > 0")
    for g, method in ((e, "sta"), (arcs, "modularity")):
        q = O.finetune(g, p, method, jump=jump)
        assert O.quality(g, q, method).first()[0] >= O.quality(g, p, method).first()[0]
        assert O.move_gains(g, q, method).where("gain > 1e-9").isEmpty()


def test_levels_rise_and_rest(spark):
    from graphloom.operators.partitions import partition_at_level

    e, _ = signed(spark)
    v = spark.range(10).selectExpr("id AS node")  # node 9 has no edges
    tree = O.optimise(e, v, "smp")
    levels = [r[0] for r in tree.select("level").distinct().orderBy("level").collect()]
    q = [O.quality(e, partition_at_level(tree, n), "smp").first()[0] for n in levels]
    assert q == sorted(q)
    assert O.move_gains(e, partition_at_level(tree, 0), "smp").where("gain > 1e-9").isEmpty()
    assert (9, 9) in rows(partition_at_level(tree, levels[-1]))
    assert rows(O.optimise(e.limit(0), v)) == [(0, i, i) for i in range(10)]


def test_resolutions(spark):
    e, v = cliques(spark)
    got = rows(O.resolutions(e, v, "cpm", 0.0, 1.5, 0.5))
    assert got[0][:2] == (0.0, 1)
    assert got[-1][:2] == (1.5, 16)
    assert all(a[3] >= b[3] for a, b in zip(got, got[1:]))


def test_signs_change_places_in_a_complete_graph(spark):
    from graphloom.operators.random_graphs import rewire

    draw = random.Random(5)
    half = [(a, b, draw.choice([-1.0, 1.0]) * draw.randint(1, 9)) for b in range(12) for a in range(b)]
    e = spark.createDataFrame(half + [(b, a, w) for a, b, w in half], "src bigint, dst bigint, w double")
    new = rewire(e, 4, directed=False, by_sign=True)
    signs = lambda df: rows(df.groupBy("src").agg({"*": "count"}).join(df.where("w < 0").groupBy("src").count(), "src", "left"))
    assert signs(new) == signs(e)
    assert sorted(w for *_, w in rows(new)) == sorted(w for *_, w in rows(e))
    assert {(a, b): w for a, b, w in rows(new)} == {(b, a): w for a, b, w in rows(new)}
    assert rows(new) != rows(e)
