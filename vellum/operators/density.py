"""Density clustering with noise (V3) and its parameter sweep (V4).

A single-ε cut of the mutual-reachability graph (the re-aimed core of the
original density clustering):

1. core distance of a point = distance to its (min_samples − 1)-th nearest
   other point (the point itself counts as the first sample), from exact
   neighbour lists;
2. i ~ j when max(core_i, core_j, d_ij) ≤ ε.  A list that ends beyond ε holds all
   of its point's pairs, so the lists' pairs make the first components.  Points whose
   lists end within ε search the cells within ε for pairs with other components,
   unless they are in the largest one: the others' searches reach it;
3. a search emits only a *star forest* of components (each → the smallest of
   those that it meets), so the output is bounded by the rows, never by the pairs,
   and connectivity is exact;
4. connected components: up to `LOCAL_EDGES` edges in one task, more by min-label
   propagation with pointer jumping, the label table cut from its lineage (table
   in ``spark.checkpoint.dir``) each round;
5. components smaller than ``min_cluster_size`` and isolated points → −1.

Every configuration of a sweep is a column value (``cfg``), so all of them
advance in the same jobs; those that differ in the cluster size share their cut.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vellum.operators import pivots
from vellum.operators.knn import knn_join
from vellum.session import cut_lineage, drop_lineage_table


STRIP_CELLS = 1 << 20        # numbers of a distance matrix held at once
PAIRS = 65_536               # pairs measured directly at once
LISTED = 8                   # least length of the neighbour lists
LOCAL_EDGES = 1 << 23        # edges of a configuration whose components one task finds


def _neighbour_lists(points: DataFrame, id_col: str, vec: str, k: int) -> DataFrame:
    """(_id, neighbors): the ``k`` nearest other points."""
    p = points.select(F.col(id_col).alias("_id"), F.col(vec).alias("_v"), F.lit(0).alias("_l"))
    return knn_join(p, p, k, qid="_id", tid="_id", qvec="_v", tvec="_v", label="_l", exclude_self=True)


def _cores(min_samples: Sequence[int]):
    return F.array(*[(F.lit(0.0) if m <= 1 else F.try_element_at("neighbors", F.lit(m - 1))["dist"])
                     for m in min_samples])


def core_distances(points: DataFrame, id_col: str, vec: str, min_samples: Sequence[int]) -> DataFrame:
    """(id, vec, cores) with ``cores[i]`` the core distance for ``min_samples[i]``
    (NULL when the table has too few points)."""
    nb = _neighbour_lists(points, id_col, vec, max(1, max(min_samples) - 1))
    return (points.select(F.col(id_col).alias("_id"), F.col(vec).alias("vec"))
                  .join(nb, "_id", "left").select(F.col("_id").alias(id_col), "vec", _cores(min_samples).alias("cores")))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, by minima along edges and
    pointer doubling until nothing changes."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            nxt = new[new]
            if (nxt == new).all():
                break
            new = nxt
        new = np.minimum(new, new[root])
        if (new == root).all():
            return root
        root = new


class _Stars:
    """The stars so far of some nodes, 0 to n: bounded by the nodes, not by the edges."""

    def __init__(self, n: int):
        self.root, self.used = np.arange(n), np.zeros(n, bool)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.used[a] = self.used[b] = True
        a, b = self.root[a], self.root[b]
        apart = a != b
        if apart.any():
            some, ends = np.unique(np.concatenate([a[apart], b[apart]]), return_inverse=True)
            half, now = len(ends) // 2, np.arange(len(self.root))
            now[some] = some[_forest(len(some), ends[:half], ends[half:])]
            self.root = now[self.root]


def _core_matrix(column) -> np.ndarray:
    return np.array([[np.inf if v is None else float(v) for v in c] for c in column])


def _forest_kernel(configs: Sequence[tuple[int, float, int]]):
    """configs: (cfg id, eps, index into cores).  Distances come from matrix
    products in strips; pairs near a radius are measured by differences."""
    def kernel(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(t):
            qm = np.stack(q["vec"].to_numpy()).astype(np.float64)
            tm = np.stack(t["vec"].to_numpy()).astype(np.float64)
            qid, tid = q["qid"].to_numpy(), t["tid"].to_numpy()
            qc, tc = _core_matrix(q["cores"]), _core_matrix(t["cores"])
            uniq, inv = np.unique(np.concatenate([qid, tid]), return_inverse=True)
            nodes = [(uniq, inv[:len(qid)], inv[len(qid):])] * len(configs)
            stars = _linked(configs, qm, tm, qc, tc, nodes, _strips(qm, tm, max(e for _, e, _ in configs)))
            out = [pd.DataFrame({"cfg": cfg, "node": node, "root": root}) for cfg, node, root in stars]
        if not out:
            return pd.DataFrame({"cfg": pd.Series([], dtype="int32"), "node": pd.Series([], dtype="int64"),
                                 "root": pd.Series([], dtype="int64")})
        return pd.concat(out, ignore_index=True)
    return kernel


def _strips(qm: np.ndarray, tm: np.ndarray, radius: float):
    """(rows of ``qm``, rows of ``tm``) of the pairs near or within the radius, strip by strip."""
    tn = np.einsum("ij,ij->i", tm, tm)
    strip = max(1, STRIP_CELLS // len(tm))
    for at in range(0, len(qm), strip):
        x = qm[at:at + strip]
        xn = np.einsum("ij,ij->i", x, x)
        d2 = x @ tm.T
        d2 *= -2.0
        d2 += xn[:, None]
        d2 += tn
        i, j = np.divmod(np.flatnonzero(d2 <= radius * radius + 1e-9 * (1 + xn.max() + tn.max())), len(tm))
        yield i + at, j


def _linked(configs, qm, tm, qc, tc, nodes, pairs):
    """(cfg, node, root): stars of the edges among ``pairs`` (rows of queries, rows of points);
    ``nodes`` are, for each configuration, the sorted names and the places of both sides in them."""
    stars = [_Stars(len(names)) for names, _, _ in nodes]

    def join(i, j):
        diff = qm[i] - tm[j]
        d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        for (_, eps, ci), (_, of_q, of_t), star in zip(configs, nodes, stars, strict=True):
            a, b = of_q[i], of_t[j]
            ok = (a != b) & (np.maximum(np.maximum(qc[i, ci], tc[j, ci]), d) <= eps)
            star.add(a[ok], b[ok])

    waiting, held = [], 0
    for i, j in pairs:
        for s in range(0, len(i), PAIRS):
            waiting.append((i[s:s + PAIRS], j[s:s + PAIRS]))
            held += len(waiting[-1][0])
            if held >= PAIRS:
                join(*(np.concatenate(c) for c in zip(*waiting, strict=True)))
                waiting, held = [], 0
    if waiting:
        join(*(np.concatenate(c) for c in zip(*waiting, strict=True)))
    for (cfg, _, _), (names, _, _), star in zip(configs, nodes, stars, strict=True):
        some = np.flatnonzero(star.used)
        if len(some):
            yield cfg, names[some], names[star.root[some]]


def _edge_ends(cfg: pa.Scalar, a: np.ndarray, b: np.ndarray, names: list[str], schema: pa.Schema) -> pa.Table:
    """(cfg, node, smallest node of its component) of the nodes of some edges."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = _forest(len(nodes), ends[:len(a)], ends[len(a):])
    return pa.Table.from_arrays([pa.array([cfg] * len(nodes) if isinstance(cfg, str) else np.full(len(nodes), cfg), schema.types[0]),
                                 pa.array(nodes, schema.types[1]), pa.array(nodes[root], schema.types[2])], names=names)


def connected_components(edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """(cfg, node, comp) with comp = smallest node id reachable, for every
    node that appears in ``edges`` (cfg, node, root)."""
    local_edges = LOCAL_EDGES if local_edges is None else local_edges
    edges = cut_lineage(edges.select("cfg", "node", "root"))
    per = edges.groupBy("cfg").agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(per.filter(F.col("n") > local_edges).select("cfg"))
    out = T.StructType([edges.schema["cfg"], edges.schema["node"], T.StructField("comp", edges.schema["node"].dataType)])
    schema = to_arrow_schema(out)

    def solve(key, table):
        return _edge_ends(key[0].as_py(), table["node"].to_numpy(), table["root"].to_numpy(), out.names, schema)

    some, rest = (edges, None) if large.isEmpty() else (edges.join(F.broadcast(large), "cfg", kind) for kind in ("left_anti", "left_semi"))
    lab = cut_lineage(some.groupBy("cfg").applyInArrow(solve, out))
    if rest is not None:
        lab = lab.unionByName(_components_in_rounds(rest))
    return lab


def _components_in_rounds(edges: DataFrame) -> DataFrame:
    """`connected_components` for edges of any number."""
    e = edges.select("cfg", F.col("node").alias("a"), F.col("root").alias("b"))
    e = cut_lineage(e.unionByName(e.select("cfg", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = cut_lineage(e.select("cfg", F.col("a").alias("node")).distinct()
                       .withColumn("comp", F.col("node")))
    while True:
        nbr = (e.join(lab.select("cfg", F.col("node").alias("b"), F.col("comp").alias("cb")), ["cfg", "b"])
                .groupBy("cfg", "a").agg(F.min("cb").alias("m")))
        step = (lab.join(nbr.select("cfg", F.col("a").alias("node"), "m"), ["cfg", "node"], "left")
                   .select("cfg", "node", F.least("comp", F.coalesce("m", "comp")).alias("comp")))
        # pointer jumping: adopt the label of the label
        jump = (step.join(step.select("cfg", F.col("node").alias("comp"), F.col("comp").alias("cc")),
                          ["cfg", "comp"], "left")
                    .select("cfg", "node", F.least("comp", F.coalesce("cc", "comp")).alias("comp")))
        new = cut_lineage(jump)
        changed = (new.join(lab.select("cfg", "node", F.col("comp").alias("old")), ["cfg", "node"])
                      .filter(F.col("comp") != F.col("old")).limit(1).count())
        drop_lineage_table(lab)
        lab = new
        if changed == 0:
            break
    drop_lineage_table(e)
    return lab


def density_clusters(points: DataFrame, id_col: str, vec: str,
                     configs: Sequence[tuple[float, int, int]]) -> DataFrame:
    """(cfg, id, cluster) for configs (eps, min_cluster_size, min_samples);
    a cluster's id is its smallest member id, −1 for noise."""
    ms = sorted({c[2] for c in configs})
    cuts = sorted({(float(eps), ms.index(m)) for eps, _, m in configs})
    k = max(LISTED, max(ms) - 1)
    lists = cut_lineage(_neighbour_lists(points, id_col, vec, k))
    # the last distance of a list that may not hold all near points
    end = F.when(F.size("neighbors") >= k, F.element_at("neighbors", -1)["dist"]).otherwise(float("inf"))
    known = cut_lineage(lists.select(F.col("_id").alias("id"), F.transform(_cores(ms), lambda c: F.coalesce(c, F.lit(float("inf")))).alias("cores"),
                                     end.alias("end")))
    a, b = (known.select(F.col("id").alias(e), F.col("cores").alias(f"c_{e}")) for e in "ab")
    near = (lists.select(F.col("_id").alias("a"), F.explode("neighbors").alias("n")).select("a", F.col("n.tid").alias("b"), F.col("n.dist").alias("d"))
            .filter(F.col("d") <= cuts[-1][0]).join(a, "a").join(b, "b"))
    within = lambda eps, ci: F.greatest(F.col("c_a")[ci], F.col("c_b")[ci], "d") <= eps
    held = F.array_compact(F.array(*[F.when(within(eps, ci), F.lit(i)) for i, (eps, ci) in enumerate(cuts)]))
    comp = connected_components(near.filter("a != b").select(F.explode(held).alias("cfg"), F.col("a").alias("node"), F.col("b").alias("root")))
    # a row's component in each cut: itself, if it has no edge
    of = comp.groupBy(F.col("node").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("cfg", "comp"))).alias("of"))
    rows = points.select(F.col(id_col).alias("id"), F.col(vec).alias("vec")).join(known, "id", "left").join(of, "id", "left")
    comps = F.array(*[F.coalesce(F.try_element_at("of", F.lit(i)), "id") for i in range(len(cuts))])
    rows = cut_lineage(rows.select("id", "vec", "cores", "end", comps.alias("comps")))
    largest = dict(comp.groupBy("cfg", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("cfg").agg(F.max_by("comp", F.struct("n", "comp"))).collect())
    found = _searched(rows, cuts, largest)
    each = rows.select("id", F.posexplode("comps").alias("cut", "comp"))
    if found is not None:
        merged = connected_components(found).select(F.col("cfg").alias("cut"), F.col("node").alias("comp"), F.col("comp").alias("now"))
        each = each.join(merged, ["cut", "comp"], "left").select("id", "cut", F.coalesce("now", "comp").alias("comp"))
    each = cut_lineage(each)
    sizes = each.distinct().groupBy("cut", "comp").agg(F.count(F.lit(1)).alias("size"))
    use = F.create_map(*[x for i, (eps, ci) in enumerate(cuts) for x in (F.lit(i), F.array(*[
        F.struct(F.lit(n).alias("cfg"), F.lit(max(2, size)).alias("least"))  # a point without an edge is no cluster
        for n, (e, size, m) in enumerate(configs) if (float(e), ms.index(m)) == (eps, ci)]))])
    x = each.join(sizes, ["cut", "comp"], "left").withColumn("use", F.explode(use[F.col("cut")]))
    keep = F.coalesce(F.col("size") >= F.col("use.least"), F.lit(False))
    label = F.when(keep, F.col("comp").cast("long")).otherwise(F.lit(-1).cast("long"))
    return x.select("use.cfg", F.col("id").alias(id_col), label.alias("cluster"))


def _searched(rows: DataFrame, cuts: Sequence[tuple[float, int]], largest: dict) -> DataFrame | None:
    """(cfg, node, root): edges between the lists' components of each cut, or None if no
    point has to search."""
    asks = [F.coalesce((F.col("cores")[ci] <= eps) & (F.col("end") <= eps) & (F.col("comps")[i] != F.lit(largest[i])), F.lit(False))
            if i in largest else F.lit(False) for i, (eps, ci) in enumerate(cuts)]
    r = F.greatest(*[F.when(ask, F.lit(eps)).otherwise(F.lit(-1.0)) for ask, (eps, _) in zip(asks, cuts, strict=True)], F.lit(-1.0))
    able = F.coalesce(F.exists(F.array(*[F.col("cores")[ci] <= eps for eps, ci in cuts]), lambda x: x), F.lit(False))
    rows = rows.filter(able & F.col("id").isNotNull()).select("id", F.lit("").alias("g"), "vec", "cores", "comps", r.alias("r"), F.array(*asks).alias("asks"))
    if rows.filter("r >= 0").isEmpty():
        return None
    only = {f"only{i}": F.when(F.min(F.col("comps")[i]) == F.max(F.col("comps")[i]), F.min(F.col("comps")[i])) for i in range(len(cuts))}
    placed, cells = pivots.place(rows, extra=only)
    for name in only:
        cells.extra[name] = np.array(cells.extra[name], object)
    configs = [(i, eps, ci) for i, (eps, ci) in enumerate(cuts)]
    schema = T.StructType([T.StructField("cfg", T.IntegerType()), T.StructField("node", rows.schema["id"].dataType),
                           T.StructField("root", rows.schema["id"].dataType)])
    arrow, slack = to_arrow_schema(schema), cells.slack
    table = lambda column: column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def skip(at, some, cell, c):
        """Cells whose points are all of the query's own component, in each cut that it asks for."""
        asking, own = (at[n].flatten().to_numpy(zero_copy_only=False).reshape(len(at[n]), -1) for n in ("asks", "comps"))
        out = np.ones(len(some), bool)
        for i in range(own.shape[1]):
            out &= ~asking[some, i] | np.asarray(c.extra[f"only{i}"][cell] == own[some, i], bool)
        return out

    def kernel(queries: pa.Table, points: pa.Table, vectors) -> pa.Table:
        out = []
        if queries.num_rows and points.num_rows:
            qm, tm = pivots.matrix(queries["vec"]), pivots.matrix(points["vec"], floats=True)
            qc, tc, q_of, t_of = (table(t[c]) for c in ("cores", "comps") for t in (queries, points))
            nodes = []
            for i in range(len(cuts)):
                names, inv = np.unique(np.concatenate([q_of[:, i], t_of[:, i]]), return_inverse=True)
                nodes.append((names, inv[:len(qm)], inv[len(qm):]))
            limit = queries["r"].to_numpy()
            close = (pairs for _, _, pairs in pivots.near_batches(queries, points, qm, tm, vectors, limit, slack))
            out = [pa.Table.from_arrays([pa.array(np.full(len(node), cfg, np.int32)), pa.array(node, arrow.types[1]), pa.array(root, arrow.types[2])],
                                        schema=arrow) for cfg, node, root in _linked(configs, qm, tm, qc, tc, nodes, close)]
        return pa.concat_tables(out) if out else arrow.empty_table()

    asking = placed.filter("r >= 0").select("id", "g", pivots.numbers(placed).alias("vec"), "cores", "comps", "r", "asks")
    visiting = cut_lineage(pivots.visits(asking, cells, 0, 0, None, skip))
    return cut_lineage(pivots.meet_tiles(visiting, placed.drop("r", "asks"), cells, kernel, schema))


def grid_scores(clusters: DataFrame) -> DataFrame:
    """V4 score per cfg: n_clusters / (1 + outliers / n)."""
    return clusters.groupBy("cfg").agg(
        F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"),
        F.count_if(F.col("cluster") == -1).alias("n_outliers"),
        F.count(F.lit(1)).alias("n")).withColumn(
        "score", F.col("n_clusters") / (1 + F.col("n_outliers") / F.col("n")))


def best_config(scores: DataFrame) -> DataFrame:
    """The first configuration with the strictly best score."""
    return scores.orderBy(F.col("score").desc(), F.col("cfg").asc()).limit(1)


# V2 -------------------------------------------------------------------------------
def pca_reduce(df: DataFrame, vec: str, k: int, out: str = "reduced") -> DataFrame:
    """L2-normalise, then project on the top-k principal components
    (pyspark.ml PCA: one distributed covariance pass)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from vellum.operators.vectors import l2_normalize
    v = df.withColumn("_v", array_to_vector(l2_normalize(vec))).filter(F.col("_v").isNotNull())
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    return model.transform(v).withColumn(out, vector_to_array("_p")).drop("_v", "_p")
