"""The density tree against a plain version on small tables."""

import numpy as np
import pytest

from vellum.operators import density_tree as dt


def plain_tree(x, samples):
    """Weights under which each two points come together, by Prim's order."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, samples - 1]
    w = np.round(np.maximum(np.maximum(core[:, None], core[None]), d), dt.DIGITS)
    order, link = [0], [0.0]
    best = w[0].copy()
    best[0] = np.inf
    while len(order) < n:
        i = int(best.argmin())
        link.append(float(best[i]))
        order.append(i)
        best = np.minimum(best, w[i])
        best[order] = np.inf
    return order, link


def plain_clusters(x, samples, m, method, epsilon=0.0):
    order, link = plain_tree(x, samples)
    rate = lambda v: 1.0 / max(v, dt.LEAST_WEIGHT)
    tree = {}  # key -> [parent, birth, points, exits]

    def grow(key, lo, hi):
        if lo == hi:
            return
        top = max(link[lo + 1:hi + 1])
        cuts = [lo, *(p for p in range(lo + 1, hi + 1) if link[p] == top), hi + 1]
        parts = [(a, z - 1) for a, z in zip(cuts, cuts[1:], strict=False)]
        large = [p for p in parts if p[1] - p[0] + 1 >= m]
        for a, z in parts:
            if (a, z) not in large:
                tree[key][3] += [(order[i], top) for i in range(a, z + 1)]
        for a, z in large:
            child = key
            if len(large) > 1:
                child = (min(order[a:z + 1]), z - a + 1)
                tree[child] = [key, top, order[a:z + 1], []]
            grow(child, a, z)

    root = (0, len(x))
    label = np.full(len(x), -1)
    if len(x) < m:
        return label
    tree[root] = [None, None, list(range(len(x))), []]
    grow(root, 0, len(x) - 1)
    kids = {k: [c for c in tree if tree[c][0] == k] for k in tree}
    stable = {}
    for k, (_, birth, _, exits) in tree.items():
        born = 0.0 if birth is None else rate(birth)
        stable[k] = round(sum(rate(w) - born for _, w in exits) + sum(c[1] * (rate(tree[c][1]) - born) for c in kids[k]), dt.DIGITS)
    picked = set()
    if method == "leaf":
        for k in tree:
            if not kids[k] and k != root:
                if tree[k][1] < epsilon:
                    while tree[k][0] != root:
                        k = tree[k][0]
                        if tree[k][1] > epsilon:
                            break
                picked.add(k)
    else:
        def value(k):
            below = sum(value(c) for c in kids[k])
            if k != root and (not kids[k] or below <= stable[k]):
                picked.add(k)
            return max(stable[k], below)
        value(root)
    for k in sorted(picked, key=lambda k: k[1]):  # larger ones last
        label[tree[k][2]] = k[0]
    return label


def blobs(seed, n=40):
    rng = np.random.default_rng(seed)
    centre = np.array([[0, 0], [3, 0], [3.5, 1.2], [9, 9], [9, 11]], float)
    x = np.concatenate([c + s * rng.normal(size=(n, 2)) for c, s in zip(centre, (0.3, 0.4, 0.2, 0.5, 0.6), strict=True)])
    x = np.concatenate([x, rng.uniform(-5, 15, (25, 2)), np.repeat([[20.0, 20.0]], 12, axis=0)])
    x[100:104] = x[99]
    return np.round(x, 2)  # ties


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)


@pytest.mark.parametrize("local", [dt.LOCAL_EDGES, 25])
def test_trees_equal_the_plain_version(spark, local):
    x = blobs(2)
    df = frame(spark, x)
    tree = dt.spanning_tree(df, "id", "v", 3, cell_rows=20)
    weights = [r.w for r in tree.collect()]
    assert sorted(weights) == pytest.approx(sorted(plain_tree(x, 3)[1][1:]))
    sizes = (5, 12)
    clusters, exits = dt.condense(df, tree, sizes, local_edges=local)
    for method, epsilon in (("leaf", 0.0), ("leaf", 0.6), ("eom", 0.0)):
        for rows in ((dt.TREE_ROWS, 0) if local == 25 else (dt.TREE_ROWS,)):
            out = dt.select(clusters, exits, method, epsilon, tree_rows=rows).collect()
            assert len(out) == len(x) * len(sizes)
            for m in sizes:
                got = {r.id: r.cluster for r in out if r.m == m}
                want = plain_clusters(x, 3, m, method, epsilon)
                assert [got[i] for i in range(len(x))] == want.tolist(), (method, epsilon, m, rows)
                assert len(set(want)) > 2


def test_small_tables_and_bad_vectors(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, None), (4, [float("nan")])], "id long, v array<double>")
    out = dt.cluster_tree(df, "id", "v", [2, 5], 2)
    assert {(r.m, r.id, r.cluster) for r in out.collect()} == {(m, i, -1) for m in (2, 5) for i in (1, 2, 3, 4)}
    assert dt.cluster_tree(df.limit(0), "id", "v", [2], 2).count() == 0
    assert dt.cluster_tree(df.filter("id = 1"), "id", "v", [2], 2).collect()[0].cluster == -1
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(50)], "id long, v array<double>")
    assert {r.cluster for r in dt.cluster_tree(same, "id", "v", [5], 3).collect()} == {-1}  # no split, no cluster
    with pytest.raises(ValueError):
        dt.condense(same, same, [1])
    with pytest.raises(ValueError):
        dt.select(same, same, "best")
