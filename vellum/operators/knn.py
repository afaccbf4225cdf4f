"""Exact k-nearest-neighbour join and classification.

A training table of a few megabytes (counted first) is broadcast and the queries
are streamed against it where they are.  Larger ones go through the cells of
`vellum.operators.pivots`: a query visits only the cells of its group that the
triangle inequality leaves, in rounds of shrinking radius, and the numpy kernel
measures only the rows of a cell's rings that the radius reaches.  Of equal training
vectors the k smallest ids are enough, so copies add no work.  A ranked window keeps
the best ``k`` candidates of a query, in each task first; the vote and confidence are
array expressions on that short list, without a further shuffle.

`block_grid` cuts two tables into cells that meet pairwise, for kernels that need
every pair (density forests).

Ties are broken by (distance, training id), votes by (count desc, label asc).
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vellum.functions.text import confidence
from vellum.operators import pivots
from vellum.session import cut_lineage, drop_lineage_table

TRAIN_BLOCK_BYTES = 64 << 20   # training vectors held by one task
QUERY_BLOCK_ROWS = 2048        # queries scored by one task
MAX_GROUP_STATS_BROADCAST = 100_000
SHARED_TRAIN_BYTES = 16 << 20  # training tables up to this are broadcast after a count
EXACT_BYTES = 32 << 20         # vectors of the pairs measured directly at once
WAITING_ROWS = 1 << 18         # candidates that wait to be ranked


def nearest_rows(qid, qm, tid, tm, lab, k: int, exclude_self: bool):
    """(query row, tid, dist, label) of the k nearest rows of each query, by distance
    and id; arrays side by side."""
    by_id = np.argsort(tid, kind="stable")  # places in order of id, for ties
    tm, tid, lab = tm[by_id], tid[by_id], lab[by_id]
    tn = np.einsum("ij,ij->i", tm, tm)
    m, at_once = min(k, len(tid)), pivots.fitting(EXACT_BYTES, tm)
    for s in range(0, len(qm), 512):
        qc = qm[s:s + 512]
        qi = qid[s:s + 512]
        d2 = np.einsum("ij,ij->i", qc, qc)[:, None] + tn[None, :] - 2.0 * (qc @ tm.T)
        if exclude_self:
            d2[qi[:, None] == tid[None, :]] = np.inf
        # every row as near as the k-th, up to rounding, is measured again by
        # direct differences, so ties go to the smallest id however many there are
        kth = np.partition(d2, m - 1, axis=1)[:, m - 1]
        slack = 1e-9 * (1.0 + np.einsum("ij,ij->i", qc, qc) + tn.max())
        rows, cand = np.nonzero(d2 <= (kth + slack)[:, None])
        for a in range(0, len(rows), at_once):
            r, c = rows[a:a + at_once], cand[a:a + at_once]
            diff = qc[r] - tm[c]
            d2[r, c] = np.einsum("ij,ij->i", diff, diff)
        if exclude_self:
            d2[qi[:, None] == tid[None, :]] = np.inf
        dist = np.sqrt(np.maximum(d2[rows, cand], 0.0))
        order = np.lexsort((cand, dist, rows))
        first = np.searchsorted(rows, np.arange(len(qc)))  # nonzero lists rows in order
        nth = np.arange(len(order)) - first[rows[order]]
        order = order[(nth < k) & np.isfinite(dist[order])]
        yield s + rows[order], tid[cand[order]], dist[order], lab[cand[order]]


def _kernel_factory(k: int, exclude_self: bool):
    def kernel(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        cols = ["qid", "tid", "dist", "label"]
        if len(q) == 0 or len(t) == 0:
            return pd.DataFrame({c: [] for c in cols})
        qm = np.stack(q["vec"].to_numpy()).astype(np.float64)
        tm = np.stack(t["vec"].to_numpy()).astype(np.float64)
        qid = q["qid"].to_numpy()
        parts = [pd.DataFrame({"qid": qid[rows], "tid": tid, "dist": dist, "label": lab}) for rows, tid, dist, lab in
                 nearest_rows(qid, qm, t["tid"].to_numpy(), tm, t["label"].to_numpy(), k, exclude_self)]
        return pd.concat(parts, ignore_index=True)

    return kernel


def _against_shared(spark, train: DataFrame, kern):
    """Worker function: queries of any partition against the whole training table,
    whose size the caller has checked; the queries do not move."""
    groups = spark.sparkContext.broadcast({g: p.drop(columns="g") for g, p in train.toPandas().groupby("g")})

    def run(batches):
        for b in batches:
            for g, q in b.groupby("g"):
                t = groups.value.get(g)
                if t is not None:
                    for at in range(0, len(q), 512):
                        yield kern(q.iloc[at:at + 512], t)

    return run


def block_grid(q: DataFrame, t: DataFrame, *, train_block_bytes: int = TRAIN_BLOCK_BYTES,
               query_block_rows: int = QUERY_BLOCK_ROWS,
               grouped: bool = True) -> tuple[DataFrame, DataFrame]:
    """Assign rows of ``q`` (qid, vec, g) and ``t`` (tid, vec, …, g) to grid
    cells (g, qb, tb): per group, query blocks bound rows per task and
    training blocks bound bytes per task; each (query, train) pair of a
    group meets in exactly one cell."""
    nqb = F.greatest(F.lit(1), F.ceil(F.col("nq") / query_block_rows)).cast("int")
    ntb = F.greatest(F.lit(1), F.ceil(F.col("nt") * F.col("dim") * 8 / train_block_bytes)).cast("int")
    if not grouped:
        # one group: the block counts are two scalars (scalar subqueries), no join
        nq = q.select(F.count(F.lit(1)).alias("nq"))
        nt = t.select(F.count(F.lit(1)).alias("nt"), F.max(F.size("vec")).alias("dim"))
        qb_n = nq.select(nqb).scalar()
        tb_n = nt.select(ntb).scalar()
        qx = q.withColumn("nqb", qb_n).withColumn("ntb", tb_n)
        tx = t.withColumn("nqb", qb_n).withColumn("ntb", tb_n)
    else:
        qs = q.groupBy("g").agg(F.count(F.lit(1)).alias("nq"))
        ts = t.groupBy("g").agg(F.count(F.lit(1)).alias("nt"), F.max(F.size("vec")).alias("dim"))
        stats = qs.join(ts, "g", "inner").select("g", nqb.alias("nqb"), ntb.alias("ntb"))
        n_groups = stats.count()
        stats = F.broadcast(stats) if n_groups <= MAX_GROUP_STATS_BROADCAST else stats
        qx = q.join(stats, "g", "inner")
        tx = t.join(stats, "g", "inner")
    qx = (qx.withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("nqb")).cast("int"))
            .withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("ntb") - 1)))
            .drop("nqb", "ntb"))
    tx = (tx.withColumn("tb", F.pmod(F.xxhash64("tid"), F.col("ntb")).cast("int"))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nqb") - 1)))
            .drop("nqb", "ntb"))
    return qx, tx


def knn_join(queries: DataFrame, train: DataFrame, k: int, *, qid: str, tid: str,
             qvec: str, tvec: str, label: str, qgroup: str | None = None,
             tgroup: str | None = None, exclude_self: bool = False,
             shared_train_bytes: int = SHARED_TRAIN_BYTES,
             cell_rows: int = pivots.CELL_ROWS) -> DataFrame:
    """Exact top-k neighbours: one row per query with ``neighbors`` =
    array<struct<dist, tid, label>> sorted by (dist, tid).

    Queries without any candidate in their group get no row (callers left
    join).  ``qgroup``/``tgroup`` restrict neighbours to the same group.
    """
    spark = queries.sparkSession
    label_type = train.schema[label].dataType
    qid_type = queries.schema[qid].dataType
    tid_type = train.schema[tid].dataType
    qg = F.col(qgroup).cast("string") if qgroup else F.lit("")
    tg = F.col(tgroup).cast("string") if tgroup else F.lit("")
    q = queries.select(F.col(qid).alias("qid"), F.col(qvec).alias("vec"), qg.alias("g"))
    t = train.select(F.col(tid).alias("tid"), F.col(tvec).alias("vec"), F.col(label).alias("label"),
                     tg.alias("g"))

    schema = T.StructType([T.StructField("qid", qid_type), T.StructField("tid", tid_type),
                           T.StructField("dist", T.DoubleType()), T.StructField("label", label_type)])
    n_train, dim = t.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if n_train * ((dim or 0) * 8 + 64) <= shared_train_bytes:
        cand = q.mapInPandas(_against_shared(spark, t, _kernel_factory(k, exclude_self)), schema)
        found = _neighbour_lists(cand, k)
    else:
        found = pruned_lists(q, t, k, schema, exclude_self, cell_rows)[0]
    return found.withColumnRenamed("qid", qid)


def nearest_k(cand: DataFrame, k: int) -> DataFrame:
    """The k nearest candidates of each query: a ranked window keeps k rows per query
    in each task before the shuffle, so what meets for a query does not grow."""
    nearest = Window.partitionBy("qid").orderBy("dist", "tid")
    return cand.withColumn("_r", F.row_number().over(nearest)).filter(F.col("_r") <= k).drop("_r")


def _neighbour_lists(cand: DataFrame, k: int) -> DataFrame:
    return (nearest_k(cand, k).groupBy("qid")
            .agg(F.array_sort(F.collect_list(F.struct("dist", "tid", "label"))).alias("neighbors")))


def _within(qid, qm, tid, tm, pairs, limit, slack, exclude_self):
    """Parts of (query row, point row, dist) of the pairs within the queries' limits."""
    i, j = pairs
    at_once = pivots.fitting(EXACT_BYTES, tm)
    for a in range(0, len(i), at_once):
        q, t = i[a:a + at_once], j[a:a + at_once]
        if exclude_self:
            other = np.asarray(qid[q] != tid[t], bool)
            q, t = q[other], t[other]
        diff = qm[q] - tm[t]
        dist = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        held = dist <= limit[q] + slack
        yield q[held], t[held], dist[held]


def _shortened(found, parts, by_id, limit, k: int):
    """The k nearest of each query among ``found`` and ``parts``; lists of k shorten its limit."""
    q, t, dist = (np.concatenate(c) for c in zip(found, *parts, strict=True))
    order = np.lexsort((by_id[t], dist, q))
    q, t, dist = q[order], t[order], dist[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    last = np.flatnonzero((nth == k - 1) & np.isfinite(dist))
    limit[q[last]] = np.minimum(limit[q[last]], dist[last])
    held = (nth < k) & np.isfinite(dist)
    return q[held], t[held], dist[held]


def pruned_candidates(q: DataFrame, t: DataFrame, k: int, schema: T.StructType, exclude_self: bool,
                      cell_rows: int = pivots.CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """(the k nearest rows of each query, the pairs measured in each round), by `pruned_lists`."""
    lists, measured = pruned_lists(q, t, k, schema, exclude_self, cell_rows)
    return lists.select("qid", F.explode("neighbors").alias("n")).select("qid", "n.tid", "n.dist", "n.label"), measured


def pruned_lists(q: DataFrame, t: DataFrame, k: int, schema: T.StructType, exclude_self: bool,
                 cell_rows: int = pivots.CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """((qid, neighbors), the pairs measured in each round), by the cells of
    `vellum.operators.pivots`.  A query has one row for a tile, with its k nearest there."""
    need = k + int(exclude_self)
    # of equal vectors only so many smallest ids can be neighbours
    copies = Window.partitionBy("g", "vec").orderBy("tid")
    t = (t.filter("vec IS NOT NULL AND g IS NOT NULL").withColumn("_n", F.row_number().over(copies))
         .filter(F.col("_n") <= need).drop("_n"))
    placed, cells = pivots.place(cut_lineage(t.withColumnRenamed("tid", "id")), cell_rows)
    q = q.filter("vec IS NOT NULL AND g IS NOT NULL").select(F.col("qid").alias("id"), "g", pivots.numbers(q).alias("vec"))
    one = T.StructType([schema["dist"], schema["tid"], schema["label"]])
    out = T.StructType([schema["qid"], T.StructField("found", T.ArrayType(one)), T.StructField("measured", T.LongType())])
    arrow, slack = to_arrow_schema(out), cells.slack
    names, (dist_type, tid_type, label_type) = one.names, (f.type for f in to_arrow_schema(one))

    def kernel(queries: pa.Table, points: pa.Table, vectors) -> pa.Table:
        found, waiting, held, measured = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], [], 0, 0
        if queries.num_rows and points.num_rows:
            qid, tid = queries["id"].to_numpy(), points["id"].to_numpy()
            qm, tm = pivots.matrix(queries["vec"]), pivots.matrix(points["vec"], floats=True)
            limit = queries["r"].to_numpy().copy()
            by_id = np.empty(len(tid), np.int64)  # places in order of id, for ties
            by_id[np.argsort(tid, kind="stable")] = np.arange(len(tid))
            for some, near, close in pivots.near_batches(queries, points, qm, tm, vectors, limit, slack):
                measured += len(some) * len(near)
                before = len(waiting)
                if close is None:
                    own = tm[near].astype(np.float64, copy=False)
                    for rows, _, dist, at in nearest_rows(qid[some], qm[some], tid[near], own, near, k, exclude_self):
                        waiting.append((some[rows], at, dist))
                else:
                    waiting += _within(qid, qm, tid, tm, close, limit, slack, exclude_self)
                held += sum(len(p[0]) for p in waiting[before:])
                if held >= WAITING_ROWS:
                    found, waiting, held = _shortened(found, waiting, by_id, limit, k), [], 0
            found = _shortened(found, waiting, by_id, limit, k)
        q_at, t_at, dist = found
        rows, first = np.unique(q_at, return_index=True)
        ends = pa.array(np.append(first, len(q_at)), pa.int32())
        taken = lambda c, kind: points[c].take(pa.array(t_at)).combine_chunks().cast(kind)
        near = pa.StructArray.from_arrays([pa.array(dist, dist_type), taken("id", tid_type),
                                           taken("label", label_type)], names)
        table = pa.Table.from_arrays([queries["id"].take(pa.array(rows)), pa.ListArray.from_arrays(ends, near),
                                      pa.nulls(len(rows), pa.int64())], names=arrow.names)
        count = pa.Table.from_arrays([pa.nulls(1, arrow.types[0]), pa.nulls(1, arrow.types[1]), pa.array([measured], pa.int64())], schema=arrow)
        return pa.concat_tables([table.cast(arrow), count])

    best, measured = None, []
    for nth, (first, last) in enumerate(((None, None), *pivots.ROUNDS)):
        if best is None:
            asking = q.withColumn("r", F.lit(float("inf")))
        else:
            radius = best.select(F.col("qid").alias("id"), F.try_element_at("neighbors", F.lit(k))["dist"].alias("r"))
            asking = (q.join(radius, "id", "left")
                      .withColumn("r", F.coalesce("r", F.lit(float("inf")))))
        visiting = cut_lineage(pivots.visits(asking, cells, need, first, last))
        if nth and visiting.isEmpty():
            continue
        met = cut_lineage(pivots.meet_tiles(visiting, placed, cells, kernel, out))
        measured.append(met.filter("measured IS NOT NULL").agg(F.sum("measured").alias("pairs")).withColumn("round", F.lit(nth)))
        lists = met.filter("qid IS NOT NULL AND measured IS NULL").select("qid", F.col("found").alias("neighbors"))
        lists = lists if best is None else best.unionByName(lists)
        best = cut_lineage(lists.groupBy("qid").agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("neighbors"))), 1, k).alias("neighbors")))
        drop_lineage_table(visiting)
    return best, functools.reduce(DataFrame.unionByName, measured)


def vote(neighbors: str = "neighbors"):
    """Majority label of the neighbour list; ties → smallest label."""
    labels = F.array_distinct(F.transform(neighbors, lambda x: x["label"]))
    scored = F.transform(labels, lambda lb: F.struct(
        (-F.size(F.filter(neighbors, lambda x: x["label"] == lb))).alias("c"), lb.alias("label")))
    return F.array_min(scored)["label"]


def knn_classify(queries: DataFrame, train: DataFrame, k: int = 3, *, qid: str, tid: str,
                 qvec: str, tvec: str, label: str, exclude_self: bool = False,
                 qgroup: str | None = None, tgroup: str | None = None,
                 pred: str = "pred", conf: str = "confidence", lists: DataFrame | None = None) -> DataFrame:
    """K1: majority vote of the k nearest (Euclidean) and 1/(1+d₁) confidence.  ``lists`` are
    neighbours that `knn_join` found for the same arguments and a ``k`` as large at least."""
    nb = lists
    if nb is None:
        nb = knn_join(queries, train, k, qid=qid, tid=tid, qvec=qvec, tvec=tvec, label=label,
                      exclude_self=exclude_self, qgroup=qgroup, tgroup=tgroup)
    else:
        nb = nb.withColumn("neighbors", F.slice("neighbors", 1, k))
    return nb.select(qid, vote("neighbors").alias(pred),
                     confidence(F.col("neighbors")[0]["dist"]).alias(conf))


# K3 ------------------------------------------------------------------------------
def standardize(df: DataFrame, vec: str, out: str | None = None, with_mean: bool = True) -> DataFrame:
    """Per-dimension z-scores (population std, as scikit-learn's scaler),
    statistics from one aggregate, applied as an array expression."""
    out = out or vec
    e = df.select(F.posexplode(vec).alias("pos", "x"))
    st = (e.groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mu"),
                               F.stddev_pop(F.col("x").cast("double")).alias("sd"))
            .agg(F.array_sort(F.collect_list(F.struct("pos", "mu", "sd"))).alias("st")))
    return df.withColumn("_st", st.scalar()).withColumn(out, F.zip_with(F.col(vec), "_st", lambda x, p: (
        (x.cast("double") - (p["mu"] if with_mean else F.lit(0.0))) /
        F.when(p["sd"] == 0, F.lit(1.0)).otherwise(p["sd"])))).drop("_st")


def block_counts(n_rows: int, dim: int, train_block_bytes: int = TRAIN_BLOCK_BYTES) -> int:
    return max(1, math.ceil(n_rows * dim * 8 / train_block_bytes))
