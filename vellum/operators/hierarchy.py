"""Topic hierarchy over cluster centroids.

Average linkage of cosine distances needs no table of pairs: with S the sum of a
cluster's L2-normalised centroids and n their number, the mean distance between
the members of X and Y is ``1 − S_X·S_Y / (n_X n_Y)``.  Average linkage is reducible,
so merging every pair that is mutually nearest, round after round, yields the same
tree as the textbook greedy algorithm (ties aside).  `dendrogram` runs the merges
once, up to the highest threshold, and records each with its height; any threshold's
clusters follow from it by doubling the pointers to the cluster that took one in
(`cut_tree`), all thresholds in the same joins.

A merge leaves the nearest cluster of all others in place, unless that was one of the
two, so a round searches again only for those and for the new clusters.  Up to
`LOCAL_CLUSTERS` clusters (counted first) are merged in one task; more go round by
round, by a blocked nearest-cluster search and joins on cluster ids.  Their state is
one row per cluster, (S, n), in a table in the folder of ``spark.checkpoint.dir``.

The H4 scores come from the same sums: the mean distance inside a cluster is
``1 − (|S|² + z) / n²`` (z zero vectors, whose distance to themselves is 0) and that
to all others ``1 − S·(T − S) / (n (N − n))``, T and N over all clusters.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import clean_topic_name
from vellum.operators.vectors import centroid_distances, checked_broadcast, dot, norm2
from vellum.session import cut_lineage, drop_lineage_table

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
SWEEP = tuple(round(0.10 + 0.01 * i, 2) for i in range(31))   # 0.10 … 0.40
TARGET_MIN_CLUSTERS = 8
TARGET_MAX_CLUSTERS = 15
FALLBACK_THRESHOLD = 0.20
MANUAL_THRESHOLD = 0.18
SOFT_SIMILARITY = 0.25
# End of fixed values.
# ---------------------------------------------------------------------------

BLOCK_CLUSTERS = 4096  # clusters of a block, about
LOCAL_CLUSTERS = 2048  # clusters that one task merges: some 32 MB of distances
LINK_DIGITS = 12  # linkages are compared after rounding, so float noise cannot flip ties


def pair_table(cent: DataFrame, key: str, vec: str = "centroid") -> DataFrame:
    """(a, b, dist) cosine distances for all ordered pairs a ≠ b (H2)."""
    return centroid_distances(cent, key, vec)


def unit_items(cent: DataFrame, key: str, vec: str = "centroid") -> DataFrame:
    """(item, u): the L2-normalised vector of each centroid (zero stays zero)."""
    n = norm2(vec)
    return cent.select(F.col(key).alias("item"), F.transform(
        F.col(vec), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))).alias("u"))


def _nearest_kernel(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
    """For each cluster its nearest other one among a block's, ties to the smaller id."""
    out = {"x": [], "l": [], "y": []}
    if len(q) and len(t):
        t = t.sort_values("tid")
        tid, m = t["tid"].to_numpy(), np.stack(t["vec"].to_numpy())
        for at in range(0, len(q), 512):
            part = q.iloc[at:at + 512]
            link = np.round(1.0 - np.stack(part["vec"].to_numpy()) @ m.T, LINK_DIGITS)
            link[part["qid"].to_numpy()[:, None] == tid[None, :]] = np.inf
            best = link.argmin(axis=1)
            least = link[np.arange(len(part)), best]
            ok = np.isfinite(least)
            for name, values in zip(out, (part["qid"].to_numpy(), least, tid[best]), strict=True):
                out[name].append(values[ok])
    return pd.DataFrame({k: np.concatenate(v) if v else [] for k, v in out.items()})


def nearest_clusters(asking: DataFrame, state: DataFrame, rows: int) -> DataFrame:
    """(x, l, y): the nearest other cluster of ``state`` for each of ``asking``."""
    mean = F.transform("s", lambda v: v / F.col("n"))
    key = state.schema["cluster"].dataType.simpleString()
    blocks = -(-rows // BLOCK_CLUSTERS) or 1
    own = F.pmod(F.xxhash64("cluster"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    qx = asking.select(own.alias("qb"), F.col("cluster").alias("qid"), mean.alias("vec")).withColumn("tb", every)
    tx = state.select(own.alias("tb"), F.col("cluster").alias("tid"), mean.alias("vec")).withColumn("qb", every)
    found = (qx.select("qb", "tb", "qid", "vec").groupBy("qb", "tb")
             .cogroup(tx.select("qb", "tb", "tid", "vec").groupBy("qb", "tb"))
             .applyInPandas(lambda a, b: _nearest_kernel(a, b), f"x {key}, l double, y {key}"))
    return found.groupBy("x").agg(F.min(F.struct("l", "y")).alias("m")).select("x", "m.l", "m.y")


def _merge_locally(items: pd.DataFrame, limit: float) -> pd.DataFrame:
    """Merges of a bounded table of items, all rounds."""
    items = items.sort_values("item")
    ids = items["item"].to_numpy()
    total = np.stack(items["u"].to_numpy()).astype(np.float64)
    count, live = np.ones(len(ids)), np.ones(len(ids), bool)
    link = np.round(1.0 - total @ total.T, LINK_DIGITS)
    np.fill_diagonal(link, np.inf)
    near = link.argmin(axis=1)  # the first of equals has the smallest id
    out = {"old": [], "new": [], "height": []}
    while True:
        x = np.flatnonzero(live & (near[near] == np.arange(len(ids))) & (np.arange(len(ids)) < near))
        x = x[link[x, near[x]] <= limit]
        if not len(x):
            return pd.DataFrame(out)
        y = near[x]
        for name, values in zip(out, (ids[y], ids[x], link[x, y]), strict=True):
            out[name] += values.tolist()
        total[x] += total[y]
        count[x] += count[y]
        live[y] = False
        link[y], link[:, y] = np.inf, np.inf
        mean = total / count[:, None]
        fresh = np.round(1.0 - mean[x] @ mean.T, LINK_DIGITS)
        fresh[:, ~live] = np.inf
        fresh[np.arange(len(x)), x] = np.inf
        link[x], link[:, x] = fresh, fresh.T
        again = np.flatnonzero(live & np.isin(near, np.concatenate((x, y))))
        again = np.union1d(again, x)
        near[again] = link[again].argmin(axis=1)


def dendrogram(cent: DataFrame, key: str, limit: float = 2.0, vec: str = "centroid") -> DataFrame:
    """(old, new, height): each merge up to a height of ``limit``; the merged cluster
    keeps the smaller id, ``new``."""
    items = cut_lineage(unit_items(cent, key, vec))
    kind = items.schema["item"].dataType.simpleString()
    rows = items.count()
    if rows <= LOCAL_CLUSTERS:
        return cut_lineage(items.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
            lambda part: _merge_locally(part, limit), f"old {kind}, new {kind}, height double"))
    state = cut_lineage(items.select(F.col("item").alias("cluster"), F.col("u").alias("s"), F.lit(1.0).alias("n")))
    near = cut_lineage(nearest_clusters(state, state, rows))
    steps = []
    while True:
        pair = near.groupBy(F.least("x", "y").alias("new"), F.greatest("x", "y").alias("old"))
        merges = cut_lineage(pair.agg(F.count(F.lit(1)).alias("sides"), F.min("l").alias("height"))
                             .filter((F.col("sides") == 2) & (F.col("height") <= limit)).select("old", "new", "height"))
        merged = merges.count()
        if not merged:
            break
        steps.append(merges)
        rows -= merged
        moved = state.join(merges.select(F.col("old").alias("cluster"), "new"), "cluster", "left").withColumn(
            "cluster", F.coalesce("new", "cluster"))
        both = moved.groupBy("cluster").agg(F.collect_list("s").alias("all"), F.sum("n").alias("n"))
        add = F.aggregate(F.slice("all", 2, 1), F.col("all")[0],
                          lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        new_state = cut_lineage(both.select("cluster", add.alias("s"), "n"))
        touched = merges.select(F.explode(F.array("old", "new")).alias("c"))
        kept = (near.join(touched, F.col("x") == F.col("c"), "left_anti").join(touched, F.col("y") == F.col("c"), "left_anti"))
        asking = new_state.join(kept.select(F.col("x").alias("cluster")), "cluster", "left_anti")
        new_near = cut_lineage(kept.unionByName(nearest_clusters(asking, new_state, rows)))
        for old in (state, near):
            drop_lineage_table(old)
        state, near = new_state, new_near
    if not steps:
        return merges
    return cut_lineage(functools.reduce(DataFrame.unionByName, steps))


def cut_tree(tree: DataFrame, items: DataFrame, thresholds: Sequence[float], strict: bool = True) -> DataFrame:
    """(th, item, cluster) of a `dendrogram`: merges below a threshold hold (or at it,
    when ``strict`` is False); ``items`` has the column item."""
    jumps = [cut_lineage(tree.select(F.col("old").alias("node"), F.col("new").alias("to"), "height"))]
    while True:  # twice as far, with the highest merge on the way
        first, then = jumps[-1], jumps[-1].select(F.col("node").alias("at"), F.col("to").alias("end"), F.col("height").alias("h"))
        step = first.join(then, F.col("to") == F.col("at")).select(
            "node", F.col("end").alias("to"), F.greatest("height", "h").alias("height"))
        step = cut_lineage(step)
        if step.isEmpty():
            break
        jumps.append(step)
    out = items.select(F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("th"), "item",
                       F.col("item").alias("cluster"))
    for jump in reversed(jumps):
        reach = (F.col("height") < F.col("th")) if strict else (F.col("height") <= F.col("th"))
        out = (out.join(jump, (F.col("cluster") == F.col("node")) & reach, "left")
               .select("th", "item", F.coalesce("to", "cluster").alias("cluster")))
    return cut_lineage(out)


def average_linkage(cent: DataFrame, key: str, thresholds: Sequence[float], vec: str = "centroid",
                    strict: bool = True) -> DataFrame:
    """(th, item, cluster) with ``cluster`` = smallest member id.

    Clusters merge while their average linkage is ``< th`` (``<= th`` when
    ``strict`` is False).
    """
    tree = dendrogram(cent, key, max(thresholds), vec)
    return cut_tree(tree, cent.select(F.col(key).alias("item")), thresholds, strict)


def label_clusters(assign: DataFrame) -> DataFrame:
    """A cluster's label is its smallest member id: no ranking over all rows."""
    return assign.withColumn("label", F.col("cluster"))


def _array_sum(df: DataFrame, keys: list[str], vec: str, *aggs) -> DataFrame:
    """Element-wise sum of arrays per key."""
    e = df.select(*keys, F.posexplode(vec).alias("pos", "x"))
    sums = (e.groupBy(*keys, "pos").agg(F.sum("x").alias("x")).groupBy(*keys)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("s")))
    return sums.join(df.groupBy(*keys).agg(*aggs), keys)


def clustering_scores(cent: DataFrame, key: str, assign: DataFrame, vec: str = "centroid") -> DataFrame:
    """H4 per threshold: mean inter-cluster distance − mean intra-cluster
    distance (diagonal zeros included, clusters of size > 1 only); −1 when
    fewer than two clusters or no multi-member cluster."""
    items = unit_items(cent, key, vec)
    zero = F.sum((norm2("u") == 0).cast("double")).alias("z")
    count = F.count(F.lit(1)).cast("double").alias("n")
    per = _array_sum(assign.join(items, "item"), ["th", "cluster"], "u", count, zero)
    total = _array_sum(items.withColumn("all", F.lit(1)), ["all"], "u", count).select(
        F.col("s").alias("t"), F.col("n").alias("n_all"))
    x = per.withColumn("all", F.lit(1)).join(total.withColumn("all", F.lit(1)), "all")
    inside = 1.0 - (dot("s", "s") + F.col("z")) / (F.col("n") * F.col("n"))
    others = F.col("n_all") - F.col("n")
    outside = 1.0 - (dot("s", "t") - dot("s", "s")) / (F.col("n") * others)
    s = x.groupBy("th").agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.avg(F.when(others > 0, outside)).alias("inter"),
        F.avg(F.when(F.col("n") > 1, inside)).alias("intra"))
    score = (F.when((F.col("n_clusters") < 2) | F.col("intra").isNull() | F.col("inter").isNull(), F.lit(-1.0))
              .otherwise(F.col("inter") - F.col("intra")))
    return s.select("th", score.alias("score"), "n_clusters")


def choose_threshold(scores: DataFrame, lo: int = TARGET_MIN_CLUSTERS, hi: int = TARGET_MAX_CLUSTERS,
                     fallback: float = FALLBACK_THRESHOLD) -> DataFrame:
    """H5 as one row (th, rule): best score with lo ≤ n ≤ hi; else the
    positive-score threshold closest to the middle; else the fallback.
    Ties go to the smallest threshold."""
    mid = (lo + hi) / 2.0
    pos = scores.filter(F.col("score") > 0)
    in_range = (F.col("n_clusters") >= lo) & (F.col("n_clusters") <= hi)
    ranked = pos.select(
        "th",
        F.when(in_range, F.lit(1)).otherwise(F.lit(2)).alias("tier"),
        F.when(in_range, -F.col("score")).otherwise(F.abs(F.col("n_clusters") - mid)).alias("key"))
    best = ranked.agg(F.min(F.struct("tier", "key", "th")).alias("b"))
    return best.select(
        F.coalesce(F.col("b.th"), F.lit(fallback)).alias("th"),
        F.when(F.col("b.tier") == 1, "in_range").when(F.col("b.tier") == 2, "closest_to_mid")
         .otherwise("fallback").alias("rule"))


def sweep(cent: DataFrame, key: str, thresholds: Sequence[float] = SWEEP, vec: str = "centroid") -> DataFrame:
    """(th, score, n_clusters) for every threshold of the sweep."""
    return clustering_scores(cent, key, average_linkage(cent, key, thresholds, vec), vec)


# H6 / A2 -------------------------------------------------------------------------
def topic_keywords(assign_at: DataFrame, names: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """main topic → sorted distinct names of its member clusters."""
    x = assign_at.join(names, cluster, "left")
    return x.groupBy("main_topic").agg(F.array_sort(F.collect_set("name")).alias("names"))


# H7 / J6 -------------------------------------------------------------------------
def assign_main_topics(docs: DataFrame, cluster_to_main: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return docs.join(checked_broadcast(cluster_to_main), cluster, "left")


# H8 / W2 / J7 --------------------------------------------------------------------
def merge_report(assign_at: DataFrame, sizes: DataFrame, topic: str = "topic") -> DataFrame:
    """Per merged group: main = largest member topic (smaller id on ties), members sorted."""
    x = assign_at.join(sizes, topic, "left").withColumn("size", F.coalesce("size", F.lit(0)))
    return x.groupBy("cluster").agg(
        F.max_by(topic, F.struct("size", -F.col(topic))).alias("main"),
        F.array_sort(F.collect_list(topic)).alias("members"))


def reassign_topics(docs: DataFrame, report: DataFrame, topic: str = "topic") -> DataFrame:
    """Each document's topic → its group's main topic; outliers stay −1."""
    m = report.select(F.explode("members").alias(topic), F.col("main").alias("main_topic"))
    x = docs.join(checked_broadcast(m), topic, "left")
    return x.withColumn("main_topic", F.when(F.col(topic) == -1, F.lit(-1)).otherwise(F.col("main_topic")))


def labelled_documents(reassigned: DataFrame, labels: DataFrame, topic: str = "topic") -> DataFrame:
    """H8: documents with the labels of their main topic and of their own topic;
    outliers are labelled ``Outlier``.  ``labels``: (topic, label)."""
    out = reassigned
    for col, name in (("main_topic", "main_topic_label"), (topic, "subtopic_label")):
        names = labels.select(F.col(topic).alias(col), F.col("label").alias(name))
        text = F.when(F.col(col) == -1, F.lit("Outlier")).otherwise(F.col(name))
        out = out.join(names, col, "left").withColumn(name, text)
    return out


# H9 / J8 / T9 --------------------------------------------------------------------
def merged_topic_table(merged: DataFrame, cards: DataFrame) -> DataFrame:
    """merged (merged_cluster_id, subclusters) + cards (name, keywords) →
    (merged_cluster_id, subclusters, keywords) with keywords concatenated in
    member order and deduplicated keeping first occurrence."""
    ex = merged.select("merged_cluster_id", F.posexplode("subclusters").alias("spos", "name"))
    kw = cards.groupBy("name").agg(F.min("keywords").alias("keywords"))
    j = ex.join(checked_broadcast(kw), "name", "left")
    items = j.select("merged_cluster_id", "spos", F.posexplode_outer("keywords").alias("kpos", "kw"))
    agg = items.groupBy("merged_cluster_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kw").isNotNull(), F.struct("spos", "kpos", "kw")))).alias("_k"))
    ordered = agg.select("merged_cluster_id",
                         F.array_distinct(F.transform("_k", lambda s: s["kw"])).alias("keywords"))
    return merged.join(ordered, "merged_cluster_id", "left")


def missing_subclusters(merged: DataFrame, cards: DataFrame) -> DataFrame:
    """J8 report: member names that have no card."""
    ex = merged.select("merged_cluster_id", F.explode("subclusters").alias("name"))
    return ex.join(cards.select("name"), "name", "left_anti")


# H10 / J3–J5 ---------------------------------------------------------------------
def final_topic_table(docs: DataFrame, cards: DataFrame, merged: DataFrame) -> DataFrame:
    """documents (cluster_id, name …) → + subtopic, merged_cluster_id,
    main_topic_name (cleaned).  A name of several merged
    clusters belongs to the smallest id."""
    sub = checked_broadcast(cards.select("cluster_id", "subtopic").dropDuplicates(["cluster_id"]))
    m = checked_broadcast(merged.select(F.explode("subclusters").alias("name"), "merged_cluster_id")
                          .groupBy("name").agg(F.min("merged_cluster_id").alias("merged_cluster_id")))
    main = checked_broadcast(merged.select("merged_cluster_id",
                                           clean_topic_name("main_topic").alias("main_topic_name"))
                             .dropDuplicates(["merged_cluster_id"]))
    return (docs.join(sub, "cluster_id", "left").join(m, "name", "left")
                .join(main, "merged_cluster_id", "left"))


def unresolved_count(final: DataFrame) -> DataFrame:
    return final.agg(F.count_if(F.col("main_topic_name").isNull()).alias("n_unresolved"),
                     F.count(F.lit(1)).alias("n_rows"))
