"""Topic job (H11): centroids → threshold sweep → merge → names → tags.

A composition of the hierarchy operators; every step is a DataFrame job.
Only one scalar crosses to the driver: the chosen threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import keyword_label
from vellum.operators import hierarchy as H
from vellum.operators.filters import drop_outliers
from vellum.operators.labels import cluster_cards
from vellum.operators.vectors import centroids, soft_tags
from vellum.session import cut_lineage


@dataclass
class TopicResult:
    threshold: float
    scores: DataFrame | None
    assignment: DataFrame      # cluster_id, main_topic
    cards: DataFrame           # cluster_id, keywords, name, size
    topics: DataFrame          # main_topic, names
    tagged: DataFrame          # documents + main_topic + subtopics
    merged: DataFrame          # merged_cluster_id, subclusters, keywords, main_topic


def topic_hierarchy(docs: DataFrame, *, cluster: str = "cluster_id", vec: str = "embedding",
                    doc: str = "doc_id", text: str = "full_text", auto_tune: bool = True,
                    manual_threshold: float = H.MANUAL_THRESHOLD,
                    subtopic_similarity: float = H.SOFT_SIMILARITY,
                    thresholds=H.SWEEP) -> TopicResult:
    d = drop_outliers(docs, cluster)
    cent = cut_lineage(centroids(d, cluster, vec))
    scores, th = None, float(manual_threshold)
    tree = H.dendrogram(cent, cluster, max([*thresholds, H.FALLBACK_THRESHOLD]) if auto_tune else th)
    items = cent.select(F.col(cluster).alias("item"))
    if auto_tune:
        scores = cut_lineage(H.clustering_scores(cent, cluster, H.cut_tree(tree, items, thresholds)))
        th = float(H.choose_threshold(scores).first()["th"])
    assign = H.label_clusters(H.cut_tree(tree, items, [th])).select(
        F.col("item").alias(cluster), F.col("label").alias("main_topic"))
    cards = cut_lineage(cluster_cards(d, cluster, doc, text))  # a row a cluster, read by every table below
    topics = H.topic_keywords(assign, cards.select(cluster, "name"), cluster)
    tagged = soft_tags(H.assign_main_topics(d, assign, cluster), cent, vec, cluster,
                       threshold=subtopic_similarity, doc=doc)
    merged_members = (assign.join(cards.select(cluster, "name"), cluster)
                            .groupBy(F.col("main_topic").alias("merged_cluster_id"))
                            .agg(F.array_sort(F.collect_list("name")).alias("subclusters")))
    merged = H.merged_topic_table(merged_members, cards)
    merged = cut_lineage(merged.withColumn("main_topic", keyword_label("keywords")))
    return TopicResult(th, scores, assign, cards, topics, tagged, merged)
