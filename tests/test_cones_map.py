"""Threshold joins by cones, neighbour-graph maps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import cones
from vellum.operators.vectors import soft_tags


def brute_tags(x, c, keys, threshold):
    cos = (x @ c.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None])
    return [sorted(keys[j] for j in np.flatnonzero(row >= threshold)) for row in cos]


@pytest.mark.parametrize("shared_bytes", [cones.SHARED_BYTES, 0])
@pytest.mark.parametrize("threshold", [0.25, 0.9, -1.0])
def test_tags_equal_all_pairs(spark, shared_bytes, threshold):
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(150, 5)), rng.normal(size=(70, 5))
    c[40:60] = c[40] * np.arange(1, 21)[:, None]  # one direction, many lengths
    keys = [f"k{i:02d}" for i in range(70)]
    docs = spark.createDataFrame([(i, v.tolist(), "kept") for i, v in enumerate(x)]
                                 + [(900, None, "a"), (901, [0.0] * 5, "b"), (902, [1.0, float("nan"), 0.0, 0.0, 0.0], "c"),
                                    (903, [1.0, None, 0.0, 0.0, 0.0], "d"), (904, [1.0, 2.0], "e"), (905, [1.0] * 6, "f")], "id long, v array<double>, key string")
    cent = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, c, strict=True)] + [("zero", [0.0] * 5), ("none", None), ("short", [1.0])],
                                 "k string, c array<double>")
    got = cones.tags_within(docs, cent, "v", "k", "c", threshold, "id", "tags", "cost", shared_bytes, 8)
    assert got.columns == ["id", "v", "key", "tags", "cost"]
    rows = {r.id: r for r in got.collect()}
    assert [rows[i].tags for i in range(150)] == brute_tags(x, c, keys, threshold)
    assert all(rows[i].tags == [] for i in range(900, 906)) and rows[900].key == "a" and len(rows) == 156


def test_tags_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    cent = spark.createDataFrame([(7, [1.0, 0.0])], "k int, c array<double>")
    assert soft_tags(docs, cent.limit(0), "v", "k", "c", doc="id").collect()[0].subtopics == []
    assert soft_tags(docs.limit(0), cent, "v", "k", "c", doc="id").collect() == []
    assert soft_tags(docs, cent, "v", "k", "c", doc="id").collect()[0].subtopics == [7]
    for size in (cones.SHARED_BYTES, -1):
        got = cones.tags_within(docs, cent.limit(0), "v", "k", "c", 0.25, "id", "t", "n", size).collect()
        assert [(r.id, r.t) for r in got] == [(1, [])]


@pytest.mark.parametrize("shared_bytes", [cones.SHARED_BYTES, 0])
def test_few_centroids_are_compared(spark, shared_bytes):
    """Topics in 40 families, in as many dimensions as encoders have: a document meets a
    small share of the 2,000 centroids."""
    rng = np.random.default_rng(4)
    family = rng.normal(size=(40, 256))
    c = family[np.arange(2000) % 40] + 0.1 * rng.normal(size=(2000, 256))
    x = family[rng.integers(0, 40, 400)] + 0.3 * rng.normal(size=(400, 256))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    cent = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "k long, c array<double>")
    got = cones.tags_within(docs, cent, "v", "k", "c", 0.25, "id", "tags", "cost", shared_bytes, 64)
    rows = sorted(got.collect())
    assert [r.tags for r in rows] == brute_tags(x, c, list(range(2000)), 0.25)
    share = sum(r.cost for r in rows) / (len(x) * len(c))
    print("share of centroids compared:", shared_bytes, share)
    assert share < 0.25


def test_tags_do_not_move_the_documents(spark):
    """Beside a small centroid table nothing is shuffled on the documents' side."""
    docs = spark.range(100).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    cent = spark.createDataFrame([(1, [1.0, 0.0])], "k int, c array<double>")
    plan = soft_tags(docs, cent, "v", "k", "c", doc="id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def brute_graph(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    p = np.zeros_like(d)
    for i, row in enumerate(d):
        near = np.lexsort((np.arange(len(x)), row))[:k]
        near = near[np.isfinite(row[near])]
        p[i, near] = [np.exp(-(row[j] / row[near[-1]]) ** 2) if row[j] > 0 else 1.0 for j in near]
    return p + p.T - p * p.T


def brute_matrix(w):
    root = np.sqrt(w.sum(axis=1))
    return (np.eye(len(w)) + w / np.outer(root, root)) / 2.0


def test_graph_and_map_equal_a_dense_decomposition(spark):
    """Three joined groups: edges, eigenvalues, and coordinates up to their signs."""
    from vellum.operators.graph_map import neighbour_graph, spectral_map
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(40, 3)) + c for c in ([0, 0, 0], [3.5, 0, 0], [0, 4.5, 0])])
    x[5] = x[4]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None)], "id long, v array<double>")
    edges = neighbour_graph(df, "id", "v", 8)
    want = brute_graph(x, 8)
    got = np.zeros_like(want)
    for r in edges.collect():
        got[r.a, r.b] = r.w
    assert np.abs(got - want).max() < 1e-9
    out, value = spectral_map(edges, 2, steps=100, every=10, tolerance=1e-8)
    all_values, vectors = np.linalg.eigh(brute_matrix(want))
    assert all_values[-2] < 1 - 1e-6  # one component, so the first is the known one
    assert np.abs(np.array(value) - all_values[[-2, -3]]).max() < 1e-6
    coords = {r.id: r.coords for r in out.collect()}
    mine = np.array([coords[i] for i in range(len(x))])
    assert len(coords) == len(x) and np.abs(np.abs(mine.T @ vectors[:, [-2, -3]]) - np.eye(2)).max() < 1e-3


def test_map_of_crowds_and_empty_graphs(spark, monkeypatch):
    """A hundred copies read one point, whose edges lie in several buckets; no points; parts."""
    from vellum.operators import graph_map
    rng = np.random.default_rng(7)
    x = np.concatenate([np.ones((100, 2)), rng.normal(size=(30, 2)) * 3])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    edges = graph_map.neighbour_graph(df, "id", "v", 3).cache()
    want = brute_matrix(brute_graph(x, 3))
    block = {}
    for crowd in (10, graph_map.CROWD):
        monkeypatch.setattr(graph_map, "CROWD", crowd)
        out, _ = graph_map.spectral_map(edges, 2, steps=3, extra=0, every=3, tolerance=-1.0)
        block[crowd] = np.array([r.coords for r in out.orderBy("id").collect()])
    assert np.allclose(np.abs(block[10]), np.abs(block[graph_map.CROWD]), atol=1e-8) and block[10].shape == (130, 2)
    # one application of the matrix, by hand
    points, ready = graph_map._write_edges(edges)
    stepped = graph_map._step(points.withColumn("x", F.array(F.col("id").cast("double"))), ready, 1)
    got = {r.id: r.x[0] for r in stepped.collect()}
    assert np.allclose([got[i] for i in range(130)], want @ np.arange(130.0))
    none, value = graph_map.spectral_map(edges.limit(0), 2, steps=2)
    assert none.count() == 0 and len(value) == 2
    assert graph_map.neighbour_graph(df.limit(1), "id", "v", 3).count() == 0


def test_steps_leave_the_edges_in_place(spark):
    """A step reads the bucketed edges without an exchange of them."""
    from vellum.operators import graph_map
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 0.5), (2, 1, 0.5)], "a long, b long, w double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        points, ready = graph_map._write_edges(edges)
        read = points.select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
        plan = ready.join(read, ["b", "copy"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scan = next(line for line in plan.splitlines() if "Scan" in line and "edges_" in line)
    assert "Bucketed: true" in scan and plan.count("Exchange") == 1
