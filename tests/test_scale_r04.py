"""Searches that measure less: one for several k, single precision first, lists before cells."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators import density, density_tree, knn, pivots
from vellum.plans import catalog


def _floats(spark, x, label=0):
    schema = T._parse_datatype_string("vec_id long, embedding array<float>, label int")
    return spark.createDataFrame([(i, v.tolist(), label if isinstance(label, int) else int(label[i])) for i, v in enumerate(x)], schema)


def test_score_table_searches_once(spark, tmpdir_path, monkeypatch):
    rng = np.random.default_rng(1)
    x, label = rng.normal(size=(90, 6)).astype(np.float32), rng.integers(0, 3, 90)
    _floats(spark, x, label).write.parquet(os.path.join(tmpdir_path, "embeddings.parquet"))
    calls, join = [], knn.knn_join
    monkeypatch.setattr(knn, "knn_join", lambda *a, **kw: calls.append(a) or join(*a, **kw))
    got = {r.model: r.accuracy for r in catalog.score_table(spark, tmpdir_path).collect()}
    assert len(calls) == 1
    d = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    for k in (1, 3, 5):
        votes = label[np.argsort(d, axis=1, kind="stable")[:, :k]]
        pred = np.array([np.bincount(v, minlength=3).argmax() for v in votes])
        assert got[f"knn_k{k}"] == pytest.approx((pred == label).mean(), abs=1e-4)


def test_single_precision_leaves_out_no_near_pair():
    rng = np.random.default_rng(2)
    plain = rng.normal(size=(400, 24))
    clump = np.concatenate([plain[:200], plain[0] + 1e-4 * rng.normal(size=(200, 24))])
    for x in (plain, plain * 1e-3 + 1e4, clump, plain * 1e25, plain * 1e-25, plain.astype(np.float32)):
        q = x[::7].astype(np.float64)
        d = np.sqrt(((q[:, None] - x[None].astype(np.float64)) ** 2).sum(-1))
        limit = np.sort(d, axis=1)[:, 5]
        order = rng.permutation(len(x))
        rough = pivots.Rough(q, x, order)
        slack = pivots.SLACK * (1.0 + float(np.abs(x).max()) * 24 ** 0.5)  # as `Cells.slack`
        i, j = rough.pairs(np.arange(len(q)), 100, 400, limit, slack)
        found, here = set(zip(i.tolist(), j.tolist(), strict=True)), set(order[100:].tolist())
        assert found >= {(a, b) for a, b in zip(*np.nonzero(d <= limit[:, None]), strict=True) if b in here}
        if x is plain:
            assert rough.kind == np.float32 and len(found) < 2 * 6 * len(q)


def test_floats_stay_floats_and_a_tile_sends_one_row(spark):
    x = np.random.default_rng(3).normal(size=(300, 8)).astype(np.float32)
    df = _floats(spark, x).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.lit("").alias("g"), F.lit(0).alias("label"))
    placed, _ = pivots.place(df, 20)
    assert placed.schema["vec"].dataType == T.ArrayType(T.FloatType())
    schema = T._parse_datatype_string("qid long, tid long, dist double, label int")
    lists, _ = knn.pruned_lists(df.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "tid"), 4, schema, True, 20)
    got = {r.qid: [n.tid for n in r.neighbors] for r in lists.collect()}
    for i in range(len(x)):
        d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(axis=1))
        d[i] = np.inf
        assert got[i] == np.argsort(d, kind="stable")[:4].tolist()


def _plain_cut(x, eps, size, samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, samples - 1]
    a, b = np.nonzero((np.maximum(np.maximum(core[:, None], core[None]), d) <= eps) & ~np.eye(len(x), dtype=bool))
    root = density._forest(len(x), a, b)
    n = np.bincount(root, minlength=len(x))[root]
    return np.where(n >= max(2, size), root, -1)


def test_lists_settle_most_points_and_the_rest_search(spark, monkeypatch):
    """A small clump's lists hold only itself; its pairs with other clumps have to be searched."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.uniform(0, 12, (150, 2)), [5.0, 30.0] + 0.05 * rng.normal(size=(30, 2)),
                        [5.9, 30.0] + 0.05 * rng.normal(size=(20, 2)), [40.0, 40.0] + 0.05 * rng.normal(size=(4, 2))])
    configs = [(1.0, 3, 3), (1.0, 30, 3), (0.5, 3, 5), (1.0, 3, 5)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    asked, visits = [], pivots.visits
    monkeypatch.setattr(pivots, "visits", lambda q, *a: asked.append(q.count()) or visits(q, *a))
    got = density.density_clusters(df, "id", "v", configs).collect()
    for n, config in enumerate(configs):
        mine = {r.id: r.cluster for r in got if r.cfg == n}
        assert [mine[i] for i in range(len(x))] == _plain_cut(x, *config).tolist(), config
    assert len(asked) == 1 and 0 < asked[0] <= 60 + 30


def test_components_in_one_task_and_in_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(c, int(a), int(b)) for c in (0, 1) for a, b in rng.integers(0, 80, (70 if c else 40, 2))]
    edges = spark.createDataFrame(rows, "cfg int, node long, root long")
    one, rounds, mixed = ({(r.cfg, r.node): r.comp for r in density.connected_components(edges, n).collect()} for n in (1000, 0, 50))
    assert one == rounds == mixed and len(one) == len({(c, v) for c, *ab in rows for v in ab})


def test_sure_edges_are_the_trees():
    """With whole lists all edges of the tree; none where something lighter may be missing."""
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(60, 2)), 1)  # ties
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    a, b = np.triu_indices(60, 1)
    order = np.lexsort((b, a, d[a, b]))
    a, b = a[order], b[order]
    w = d[a, b]
    comp, taken = density_tree._sure(np.full(60, np.inf), a, b, w)
    up, want = np.arange(60), []
    for i, j, v in zip(a, b, w, strict=True):
        if up[i] != up[j]:
            up[up == up[i]] = up[j]
            want.append(v)
    assert len(taken) == 59 and (comp == 0).all() and np.sort(w[taken]).tolist() == want
    least = np.array([np.sort(r)[1] for r in d])
    assert not len(density_tree._sure(np.nextafter(least, -1.0), a, b, w)[1])


def test_tree_after_and_without_the_listed_rounds(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(40, 2)), 9 + rng.normal(size=(30, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    used, rounds = [], density_tree._listed_rounds
    monkeypatch.setattr(density_tree, "_listed_rounds", lambda *a: used.append(1) or rounds(*a))
    first = sorted(r.w for r in density_tree.spanning_tree(df, "id", "v", 3).collect())
    monkeypatch.setattr(density_tree, "LISTED_EDGES", 0)
    second = sorted(r.w for r in density_tree.spanning_tree(df, "id", "v", 3).collect())
    assert used == [1] and len(first) == 69 and first == pytest.approx(second)
