"""Iterative and vector operators against brute force on planted data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import density, hierarchy as H
from vellum.operators.knn import knn_classify
from vellum.operators.vectors import centroids


def _naive_average_linkage(d, th):
    """Textbook greedy average linkage: merge the closest pair while < th."""
    clusters = [[i] for i in range(len(d))]
    while len(clusters) > 1:
        best = None
        for a in range(len(clusters)):
            for b in range(a + 1, len(clusters)):
                l = np.mean([d[i, j] for i in clusters[a] for j in clusters[b]])
                if best is None or l < best[0]:
                    best = (l, a, b)
        if best[0] >= th:
            break
        _, a, b = best
        clusters[a] = clusters[a] + clusters[b]
        del clusters[b]
    return sorted(sorted(c) for c in clusters)


def _planted_centroids(seed=7):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(4, 8))
    pts = []
    for g in range(4):
        for _ in range(5):
            pts.append(base[g] + 0.15 * rng.normal(size=8))
    return np.array(pts)


def _centroid_frame(spark, x):
    xn = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.clip(1 - xn @ xn.T, 0, 2)
    np.fill_diagonal(d, 0)
    return d, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, centroid array<double>")


@pytest.mark.parametrize("local", [H.LOCAL_CLUSTERS, 3])
def test_average_linkage_matches_naive(spark, monkeypatch, local):
    monkeypatch.setattr(H, "LOCAL_CLUSTERS", local)
    x = _planted_centroids()
    d, cent = _centroid_frame(spark, x)
    ths = [0.05, 0.2, 0.5, 0.9, 1.3]
    if local == 3:
        tree = H.dendrogram(cent, "item").collect()
        assert len(tree) == len(x) - 1 and all(r.new < r.old for r in tree)
    a = H.average_linkage(cent, "item", ths).collect()
    for th in ths:
        got = {}
        for r in a:
            if abs(r.th - th) < 1e-12:
                got.setdefault(r.cluster, []).append(r.item)
        assert sorted(sorted(v) for v in got.values()) == _naive_average_linkage(d, th), th


def test_scores_and_choice(spark):
    x = _planted_centroids()
    d, cent = _centroid_frame(spark, x)
    sc = {r.th: r for r in H.sweep(cent, "item", [0.2, 0.5, 1.9]).collect()}

    def score(labels):
        labs = np.array(labels)
        intra, inter = [], []
        for c in np.unique(labs):
            idx = np.where(labs == c)[0]
            oth = np.where(labs != c)[0]
            if len(idx) > 1:
                intra.append(d[np.ix_(idx, idx)].mean())
            if len(oth):
                inter.append(d[np.ix_(idx, oth)].mean())
        if len(np.unique(labs)) < 2 or not intra or not inter:
            return -1.0
        return float(np.mean(inter) - np.mean(intra))
    for th in (0.2, 0.5, 1.9):
        cl = _naive_average_linkage(d, th)
        lab = np.zeros(len(d), int)
        for k, c in enumerate(cl):
            lab[c] = k
        assert abs(sc[th].score - score(lab)) < 1e-9 and sc[th].n_clusters == len(cl)
    # rule 1 needs 8..15 clusters: with 4 groups none qualifies → closest to 11.5 among positive
    choice = H.choose_threshold(H.sweep(cent, "item", [0.2, 0.5])).first()
    assert choice.rule in ("closest_to_mid", "in_range", "fallback")
    # no positive score at all → fallback 0.20
    none = spark.createDataFrame([(0.1, -1.0, 1), (0.3, -0.5, 3)], "th double, score double, n_clusters long")
    assert H.choose_threshold(none).first().th == 0.20


def test_chain_of_merges_ends(spark):
    """Each merge makes the next one possible: as many rounds as items."""
    angle = np.cumsum(np.linspace(0.02, 0.05, 25))
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    d, cent = _centroid_frame(spark, x)
    got = {}
    for r in H.average_linkage(cent, "item", [0.01]).collect():
        got.setdefault(r.cluster, []).append(r.item)
    assert sorted(sorted(v) for v in got.values()) == _naive_average_linkage(d, 0.01)


def test_knn_with_forty_copies(spark):
    """Ties go to the smallest ids however many rows are equally near."""
    rows = [(i, [1.0, 1.0], 0) for i in range(20, 60)] + [(i, [float(i), -5.0], 1) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    from vellum.operators import knn
    for size in (16 << 20, 0):
        nb = knn.knn_join(df, df, 3, qid="id", tid="id", qvec="v", tvec="v", label="label", exclude_self=True,
                          shared_train_bytes=size)
        got = {r.id: [n.tid for n in r.neighbors] for r in nb.collect()}
        assert got[50] == [20, 21, 22] and got[20] == [21, 22, 23] and got[21] == [20, 22, 23]


def test_knn_matches_bruteforce(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    lab = rng.integers(0, 3, size=60)
    df = spark.createDataFrame([(i, x[i].tolist(), int(lab[i])) for i in range(60)],
                               "id long, v array<float>, label int")
    got = {r.id: (r.pred, r.confidence) for r in knn_classify(
        df, df, 3, qid="id", tid="id", qvec="v", tvec="v", label="label", exclude_self=True).collect()}
    xd = x.astype(np.float64)
    for i in range(60):
        dist = np.sqrt(((xd - xd[i]) ** 2).sum(1))
        dist[i] = np.inf
        order = np.lexsort((np.arange(60), dist))[:3]
        vals, cnt = np.unique(lab[order], return_counts=True)
        assert got[i][0] == vals[np.argmax(cnt)]
        assert abs(got[i][1] - np.float32(1 / (1 + dist[order[0]]))) < 1e-6


def test_knn_cells_same_result(spark):
    """Pivots and many small cells must not change the answer."""
    from vellum.operators import knn
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 4))
    df = spark.createDataFrame([(i, x[i].tolist(), i % 4) for i in range(80)], "id long, v array<double>, label int")
    a = knn.knn_join(df, df, 4, qid="id", tid="id", qvec="v", tvec="v", label="label", exclude_self=True)
    b = knn.knn_join(df, df, 4, qid="id", tid="id", qvec="v", tvec="v", label="label", exclude_self=True,
                     shared_train_bytes=0, cell_rows=7)
    ra = {r.id: [n.tid for n in r.neighbors] for r in a.collect()}
    rb = {r.id: [n.tid for n in r.neighbors] for r in b.collect()}
    assert ra == rb


def test_knn_cells_with_groups_copies_and_short_tables(spark):
    """Groups without rows, fewer rows than neighbours, copies over many cells, text ids."""
    from vellum.operators import knn
    rng = np.random.default_rng(8)
    rows = [(f"r{i}", f"g{i % 3}", rng.normal(size=3).tolist(), i % 5) for i in range(150)]
    rows += [(f"c{i}", "g1", [0.5, 0.5, 0.5], 7) for i in range(60)] + [("one", "alone", [1.0, 2.0, 3.0], 1)]
    rows += [("none", "g1", None, 1), ("no group", None, [0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "id string, g string, v array<double>, label int")
    queries = df.unionByName(spark.createDataFrame([("q", "empty", [0.0, 0.0, 0.0], 1)], df.schema))
    got = {}
    for size in (16 << 20, 0):
        nb = knn.knn_join(queries.filter("v IS NOT NULL"), df.filter("v IS NOT NULL"), 4, qid="id", tid="id", qvec="v", tvec="v",
                          label="label", qgroup="g", tgroup="g", exclude_self=True, shared_train_bytes=size, cell_rows=6)
        got[size] = {r.id: [(n.tid, n.label, round(n.dist, 9)) for n in r.neighbors] for r in nb.collect()}
    assert got[0] == {k: v for k, v in got[16 << 20].items() if k != "no group"} and "one" not in got[0] and len(got[0]) == 210
    assert [t for t, *_ in got[0]["c5"]] == ["c0", "c1", "c10", "c11"]
    none = knn.knn_join(df, df.limit(0), 4, qid="id", tid="id", qvec="v", tvec="v", label="label", shared_train_bytes=-1)
    assert none.count() == 0


def test_knn_cells_measure_few_pairs_of_clustered_vectors(spark):
    from pyspark.sql import types as T
    from vellum.operators import knn
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(40, 16)) * 4
    x = centre[rng.integers(0, 40, 4000)] + 0.4 * rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)], "id long, vec array<double>, label int, g string")
    schema = T._parse_datatype_string("qid long, tid long, dist double, label int")
    best, pairs = knn.pruned_candidates(df.select(F.col("id").alias("qid"), "vec", "g"),
                                        df.select(F.col("id").alias("tid"), "vec", "label", "g"), 5, schema, True, 256)
    measured = sum(r.pairs for r in pairs.collect())
    assert measured < 0.2 * len(x) ** 2
    got = {}
    for r in best.collect():
        got.setdefault(r.qid, []).append((r.dist, r.tid))
    for i in range(0, len(x), 97):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert [t for _, t in sorted(got[i])] == np.argsort(d, kind="stable")[:5].tolist()


def test_density_recovers_blobs(spark):
    rng = np.random.default_rng(11)
    centers = np.array([[0, 0], [10, 10], [0, 10]], float)
    pts = [c + 0.3 * rng.normal(size=2) for c in centers for _ in range(20)]
    pts += [np.array([50.0, 50.0]), np.array([-40.0, 20.0])]   # two isolated points
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, v array<double>")
    out = {r.id: r.cluster for r in density.density_clusters(df, "id", "v", [(2.0, 5, 3)]).collect()}
    groups = [set(out[i] for i in range(g * 20, g * 20 + 20)) for g in range(3)]
    assert all(len(g) == 1 and -1 not in g for g in groups)
    assert len({next(iter(g)) for g in groups}) == 3
    assert out[60] == -1 and out[61] == -1
    sc = density.grid_scores(density.density_clusters(df, "id", "v", [(2.0, 5, 3)])).first()
    assert sc.n_clusters == 3 and sc.n_outliers == 2


def test_centroids(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 5.0])], "g int, v array<float>")
    got = {r.g: r.centroid for r in centroids(df, "g", "v").collect()}
    assert got == {1: [2.0, 3.0], 2: [5.0, 5.0]}


def test_pca_lengths_equal_a_dense_decomposition(spark, sf):
    from vellum.plans.catalog import pca_reduce
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    top = np.linalg.eigh(np.cov(x.T))[1][:, -10:]
    want = dict(zip([r.vec_id for r in rows], np.linalg.norm(x @ top, axis=1), strict=True))
    got = pca_reduce(spark, sf).collect()
    assert len(got) == len(rows) and all(r.dim == 10 and abs(r.length - want[r.vec_id]) < 1e-5 for r in got)


def test_forest_and_strips(spark):
    """Components from minima along edges, on chains that cross strips."""
    rng = np.random.default_rng(2)
    n = 400
    a, b = rng.integers(0, n, 500), rng.integers(0, n, 500)
    root = density._forest(n, a, b)
    assert (root[a] == root[b]).all() and (root <= np.arange(n)).all() and (root[root] == root).all()
    pts = [(i, [float(i), 0.0]) for i in range(1200)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    out = density.density_clusters(df, "id", "v", [(1.5, 5, 2), (0.5, 2, 2)])
    assert {r.cluster for r in out.filter("cfg = 0").collect()} == {0}
    assert {r.cluster for r in out.filter("cfg = 1").collect()} == {-1}
