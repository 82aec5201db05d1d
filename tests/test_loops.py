"""Loops read their graph once, and searches from many sources against brute force."""

import random
import statistics

from pyspark.sql import functions as F

from graphloom.operators import paths as R
from graphloom.operators import spatial as D


def read_once(spark, tmp_path, run):
    """How often the rows of a path graph are read."""
    e = [(a, b, 1.0) for i in range(6) for a, b in ((i, i + 1), (i + 1, i))]
    spark.createDataFrame(e, "src bigint, dst bigint, w double").write.parquet(str(tmp_path / "e"))
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    edges = spark.read.parquet(str(tmp_path / "e")).mapInArrow(counted, "src bigint, dst bigint, w double")
    run(edges, spark.range(7).select(F.col("id").alias("node"))).collect()
    return reads.value / len(e)


def test_edges_by_simrank_reads_its_graph_once(spark, tmp_path):
    assert read_once(spark, tmp_path, lambda e, v: D.edges_by_simrank(e, v, 0.5)) == 1


def test_sampled_path_length_of_all_nodes(spark, monkeypatch):
    monkeypatch.setattr(R, "WORDS", 1)  # several blocks of sources
    rng = random.Random(2)
    pairs = {(rng.randrange(150), rng.randrange(150)) for _ in range(260)}
    near = {v: {b for a, b in pairs if a == v and b != v} for v in range(150)}
    means = []
    for v in range(150):
        d, front = {v: 0}, [v]
        while front:
            front = sorted({b for a in front for b in near[a]} - set(d))
            d |= dict.fromkeys(front, max(d.values()) + 1)
        means.append(sum(d.values()) / len(d))
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src bigint, dst bigint, w double")
    row = D.sampled_path_length(edges, spark.range(150).select(F.col("id").alias("node"))).first()
    assert (row.sources, row.median) == (150, statistics.median(means))


def test_searches_from_many_sources_hold_a_row_for_each_node(spark, monkeypatch):
    kept = []
    real = R.stored
    monkeypatch.setattr(R, "stored", lambda df, name: kept.append(real(df, name)) or kept[-1])
    e = [(a, b, 1.0) for a in range(30) for b in range(30) if a != b]
    D.sampled_path_length(spark.createDataFrame(e, "src bigint, dst bigint, w double"), spark.range(30).select(F.col("id").alias("node"))).collect()
    assert len(kept) and max(t.count() for t in kept if "dst" not in t.columns or "d" in t.columns) <= 30


def test_simrank_reads_its_graph_once(spark, tmp_path):
    assert read_once(spark, tmp_path, lambda e, v: R.simrank(e, v, eps=0.3)) == 1


def test_eigenvector_reads_its_graph_once(spark, tmp_path):
    assert read_once(spark, tmp_path, lambda e, v: R.eigenvector(e, v, 0.05)) == 1
