"""Query catalogue: one DataFrame-returning callable per operator family.

Each entry takes ``(spark, sf_dir)`` and reads the driver's Parquet tables,
so its work grows with them.  The matching DuckDB SQL lives in
``vellum.plans.oracle``; column names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import filters as flt
from vellum.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents_as_records(spark: SparkSession, sf: str) -> DataFrame:
    """Carrier: a document's first line is its title, its text the abstract."""
    return table(spark, sf, "documents", "doc_id", "text", "lang", "source").select(
        "doc_id", tx.first_line("text").alias("title"), F.col("text").alias("abstract"),
        F.col("lang").alias("title_lang"), F.col("lang").alias("abstract_lang"), "source")


# 1. cleaning stage -------------------------------------------------------------
@register
def clean_funnel(spark, sf):
    c = flt.clean_stage(documents_as_records(spark, sf))
    return (c.groupBy(F.col("title_lang").alias("lang"), "split", "type", "dropped_by")
             .agg(F.count(F.lit(1)).alias("n_docs"),
                  F.sum(F.length("clean_abstract")).cast("bigint").alias("clean_chars")))


@register
def informative_reason(spark, sf):
    d = documents_as_records(spark, sf)
    return d.select("doc_id", flt.informative_reason("abstract").alias("reason"))


@register
def english_split_counts(spark, sf):
    d = documents_as_records(spark, sf)
    en, other = flt.split_english(d)
    return (en.select(F.lit("english").alias("side"), "doc_id")
              .unionByName(other.select(F.lit("other").alias("side"), "doc_id"))
              .groupBy("side").agg(F.count(F.lit(1)).alias("n_docs")))


def marked_title():
    """Titles of which some name a diagnostic, and some are missing."""
    kind = F.pmod("doc_id", F.lit(9))
    return (F.when(kind == 1, F.concat(F.lit(" LHD #"), F.col("doc_id").cast("string")))
            .when(kind == 2, F.concat(F.lit("the lhd  Probe "), "title")).when(kind == 3, F.lit(None))
            .when(kind == 4, F.concat(F.lit("lhdx"), "title")).otherwise(F.col("title")))


@register
def doc_type_counts(spark, sf):
    d = documents_as_records(spark, sf).withColumn("title", marked_title())
    return (d.withColumn("type", flt.document_type("title"))
             .groupBy("type").agg(F.count(F.lit(1)).alias("n_docs")))


@register
def boilerplate_filter(spark, sf):
    start = F.element_at(F.array(*[F.lit(x) for x in ("Type ", "typed ", "", "目次 ", "")]),
                         (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    d = documents_as_records(spark, sf).withColumn(
        "clean_abstract", tx.clean_abstract(F.concat(start, "abstract")))
    return (d.withColumn("boilerplate", flt.is_boilerplate("clean_abstract"))
             .groupBy("boilerplate").agg(F.count(F.lit(1)).alias("n_docs")))


@register
def lang_code_map(spark, sf):
    d = table(spark, sf, "documents", "lang")
    return (d.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
             .withColumn("m2m_code", tx.lang_code_norm("lang")))


@register
def class_name_norm(spark, sf):
    p = table(spark, sf, "part", "p_type", "p_name")
    return (p.select(tx.norm_class(F.concat_ws(" & ", "p_type", "p_name")).alias("norm"))
             .groupBy("norm").agg(F.count(F.lit(1)).alias("n")))


@register
def full_text_id(spark, sf):
    d = documents_as_records(spark, sf)
    ft = tx.full_text("title", "abstract")
    return d.select("doc_id", tx.text_id(ft).alias("emb_id"), F.length(ft).alias("n_chars"))


@register
def topic_name_clean(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    raw = F.concat(F.lit("**"), F.col("text"), F.lit("** *(note)*"))
    return c.select("conv_id", "turn",
                    tx.clean_topic_name(tx.strip_think(
                        F.concat(F.lit("<think>\nplan\n</think>"), raw))).alias("topic_name"))


@register
def ordered_distinct_terms(spark, sf):
    """Terms of a conversation in first-use order (turn, then position)."""
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    toks = c.select("conv_id", "turn", F.posexplode(
        F.regexp_extract_all(F.lower("text"), F.lit(tx.WORD + "+"), 0)).alias("pos", "term"))
    first = toks.groupBy("conv_id", "term").agg(F.min(F.struct("turn", "pos")).alias("at"))
    return (first.groupBy("conv_id")
                 .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))),
                                               lambda x: x["term"]), " ").alias("terms")))


@register
def schema_conform_union(spark, sf):
    from vellum.sources.schema import conform
    target = "id long, origin string, title string, url string, lang string, n_chars long"
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.lit("documents").alias("origin"),
        tx.first_line("text").alias("title"), "lang", "n_chars")
    p = table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.lit("pages").alias("origin"), "url",
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("lang"))
    return conform(d, target).unionByName(conform(p, target))


@register
def stable_sample(spark, sf):
    from vellum.operators.sample import stable_sample as ss
    return ss(table(spark, sf, "documents", "doc_id", "lang"), 100, key="doc_id", seed=42)


# 2. profiling ------------------------------------------------------------------
def documents_with_labels(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf, "labels", "doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "left")


@register
def duplicate_rows(spark, sf):
    from vellum.operators.profile import duplicate_rows as dup
    return dup(table(spark, sf, "documents", "text", "lang", "source", "n_chars"))


@register
def null_profile(spark, sf):
    from vellum.operators.profile import null_profile as npf
    return npf(documents_with_labels(spark, sf))


@register
def value_counts_top(spark, sf):
    from vellum.operators.profile import value_counts
    return value_counts(table(spark, sf, "part", "p_type"), "p_type", 20)


@register
def value_counts_bottom(spark, sf):
    from vellum.operators.profile import value_counts
    return value_counts(table(spark, sf, "events", "event_type"), "event_type", 3, ascending=True)


@register
def null_share_by_group(spark, sf):
    from vellum.operators.profile import null_share_by_group as nsg
    return nsg(documents_with_labels(spark, sf), "quality", "lang")


@register
def describe_numeric(spark, sf):
    from vellum.operators.profile import describe
    li = table(spark, sf, "lineitem", "l_quantity", "l_discount", "l_tax")
    return describe(li, ["l_quantity", "l_discount", "l_tax"])


@register
def histogram_fixed(spark, sf):
    from vellum.operators.profile import histogram
    return histogram(table(spark, sf, "events", "value"), "value", 40)


@register
def box_stats_top_groups(spark, sf):
    from vellum.operators.profile import box_stats
    return box_stats(table(spark, sf, "part", "p_brand", "p_retailprice"), "p_retailprice", "p_brand", 15)


@register
def pearson_matrix(spark, sf):
    from vellum.operators.profile import pearson_matrix as pm
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return pm(table(spark, sf, "lineitem", *cols), cols).withColumn("corr", F.round("corr", 6))


@register
def year_histogram(spark, sf):
    from vellum.operators.profile import year_histogram as yh
    o = table(spark, sf, "orders", "o_orderdate").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"))
    return yh(o, "publication_date")


@register
def timestamp_ranges(spark, sf):
    from vellum.operators.profile import timestamp_range
    e = table(spark, sf, "events", "ts", "props").select(
        "ts", F.concat(F.lit("2024-"), F.get_json_object("props", "$.k")).alias("created_at"))
    return timestamp_range(e, ["ts", "created_at"])


@register
def coverage_ratio(spark, sf):
    from vellum.operators.profile import coverage
    return coverage(documents_with_labels(spark, sf), "quality")


@register
def list_item_counts(spark, sf):
    from vellum.operators.profile import list_item_counts as lic
    d = table(spark, sf, "documents", "text").select(
        F.regexp_extract_all(F.lower("text"), F.lit(tx.WORD + "+"), 0).alias("tokens"))
    return lic(d, "tokens", 20)


@register
def list_literal_items(spark, sf):
    """T11 + A13: list-literal strings parsed, exploded and counted."""
    from vellum.operators.profile import list_item_counts as lic
    p = table(spark, sf, "part", "p_name", "p_type").select(
        F.when(F.col("p_type") == "SMALL", F.col("p_type"))
         .otherwise(F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit("','")), F.lit("']")))
         .alias("topics"))
    return lic(p.select(tx.parse_list_literal("topics").alias("topics")), "topics", 20)


@register
def text_length_profile(spark, sf):
    """Q4: abstract lengths clipped at their 99th percentile, 50 equal bins."""
    from vellum.operators.profile import exact_quantiles, histogram
    d = table(spark, sf, "documents", "text").select(F.length("text").alias("len"))
    p99 = exact_quantiles(d.withColumn("k", F.lit(1)), "k", "len", [0.99]).select(F.col("q")[0]).scalar()
    return histogram(d.select(F.least(F.col("len").cast("double"), p99).alias("len")), "len", 50)


@register
def value_inspector(spark, sf):
    from vellum.operators.profile import value_shares
    a = value_shares(table(spark, sf, "part", "p_type"), "p_type").withColumn("column", F.lit("p_type"))
    b = value_shares(table(spark, sf, "events", "event_type"), "event_type").withColumn(
        "column", F.lit("event_type"))
    return a.unionByName(b)


@register
def lang_mix(spark, sf):
    from vellum.operators.profile import value_shares
    return value_shares(table(spark, sf, "documents", "lang"), "lang")


@register
def cluster_sizes(spark, sf):
    from vellum.operators.profile import group_sizes
    return group_sizes(table(spark, sf, "embeddings", "label"), "label")


@register
def names_per_group(spark, sf):
    n = table(spark, sf, "nation", "n_name", "n_regionkey")
    return n.groupBy("n_regionkey").agg(
        F.array_join(F.array_sort(F.collect_set("n_name")), ", ").alias("names"))


@register
def group_label_position(spark, sf):
    from vellum.operators.profile import group_positions
    e = table(spark, sf, "embeddings", "embedding", "label").select(
        "label", F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"))
    return group_positions(e, "label", "x", "y").select(
        "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# 3. vectors, kNN, evaluation ---------------------------------------------------------
def embeddings_with_classes(spark, sf):
    from vellum.plans import classes
    e = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    return e.join(F.broadcast(classes.label_main(spark)), "label", "left")


@register
def knn_main(spark, sf):
    """Leave-one-out 3-NN over the whole embeddings table."""
    from vellum.operators.knn import knn_classify
    e = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    p = knn_classify(e, e, 3, qid="vec_id", tid="vec_id", qvec="embedding", tvec="embedding",
                     label="label", exclude_self=True, pred="pred_label")
    return p.join(e.select("vec_id", "label"), "vec_id", "inner")


def two_stage_predictions(spark, sf):
    from vellum.operators.routing import two_stage
    from vellum.plans import classes
    e = embeddings_with_classes(spark, sf)
    return two_stage(e, e, classes.routes(spark), classes.id_to_name(spark), qid="vec_id", tid="vec_id",
                     qvec="embedding", tvec="embedding", main_label="main_class", sub_label="label",
                     exclude_self=True)


@register
def knn_two_stage(spark, sf):
    return two_stage_predictions(spark, sf)


def predictions_with_metadata(spark, sf):
    """Predictions joined to publication metadata on the document key."""
    d = table(spark, sf, "documents", "doc_id", "source", "lang").select(
        F.col("doc_id").alias("vec_id"), F.col("source").alias("journal"), F.col("lang").alias("publisher"))
    return two_stage_predictions(spark, sf).join(d, "vec_id", "inner")


@register
def prediction_metadata_join(spark, sf):
    return predictions_with_metadata(spark, sf).select(
        "vec_id", "journal", "publisher", "lcc_main_name_pred", "lcc_name_pred")


def predictions_with_truth(spark, sf):
    from vellum.operators.evaluate import attach_truth
    from vellum.plans import classes
    return attach_truth(predictions_with_metadata(spark, sf), classes.journal_truth(spark),
                        classes.publisher_truth(spark))


@register
def truth_coverage(spark, sf):
    from vellum.operators.evaluate import truth_coverage as tc
    return tc(predictions_with_truth(spark, sf))


@register
def classification_report(spark, sf):
    from vellum.operators.evaluate import classification_report as cr
    return cr(knn_main(spark, sf), "label", "pred_label")


@register
def classification_report_main(spark, sf):
    """M2 on the combined journal/publisher truth."""
    from vellum.operators.evaluate import classification_report as cr
    return cr(predictions_with_truth(spark, sf), "gt_main", "lcc_main_name_pred")


@register
def confusion_long(spark, sf):
    from vellum.operators.evaluate import confusion_long as cl
    return cl(predictions_with_truth(spark, sf), "gt_main", "lcc_main_name_pred")


def journal_rows(spark, sf):
    """Written once: accuracy, low groups and shares all read this table."""
    from vellum.session import cut_lineage
    p = predictions_with_truth(spark, sf).filter(F.col("truth_source") == "journal")
    return cut_lineage(p.select("journal", "gt_main", "gt_sub", "lcc_main_name_pred", "lcc_name_pred"))


def accuracy_by_journal(rows):
    from vellum.operators.evaluate import group_accuracy as ga
    return ga(rows, "journal", "gt_main", "lcc_main_name_pred", "gt_sub", "lcc_name_pred")


@register
def group_accuracy(spark, sf):
    return accuracy_by_journal(journal_rows(spark, sf))


@register
def low_performers(spark, sf):
    from vellum.operators.evaluate import low_performers as lp
    return lp(group_accuracy(spark, sf))


@register
def wrong_destinations(spark, sf):
    from vellum.operators.evaluate import low_performers as lp, prediction_shares
    rows = journal_rows(spark, sf)
    return prediction_shares(rows, "journal", "gt_main", "lcc_main_name_pred", groups=lp(accuracy_by_journal(rows)))


@register
def wrong_destinations_sub(spark, sf):
    from vellum.operators.evaluate import low_performers as lp, prediction_shares
    rows = journal_rows(spark, sf)
    return prediction_shares(rows, "journal", "gt_sub", "lcc_name_pred", groups=lp(accuracy_by_journal(rows)))


@register
def low_performer_summary(spark, sf):
    from vellum.operators.evaluate import low_performer_summary as lps
    rows = journal_rows(spark, sf)
    return lps(rows, accuracy_by_journal(rows), "journal", "gt_main", "lcc_main_name_pred")


@register
def score_table(spark, sf):
    """M8: accuracy / macro-F1 / weighted-F1 of leave-one-out kNN for k = 1, 3, 5."""
    from vellum.operators.evaluate import score_table as st
    from vellum.operators.knn import knn_classify, knn_join
    from vellum.session import cut_lineage
    e = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    same = dict(qid="vec_id", tid="vec_id", qvec="embedding", tvec="embedding", label="label", exclude_self=True)
    lists = cut_lineage(knn_join(e, e, 5, **same))  # the nearest 1 and 3 are among the nearest 5
    runs = []
    for k in (1, 3, 5):
        p = knn_classify(e, e, k, **same, pred="pred_label", lists=lists)
        runs.append((f"knn_k{k}", p.join(e.select("vec_id", "label"), "vec_id")))
    return st(runs, "label", "pred_label")


@register
def knn_scaled(spark, sf):
    """K3: standardised features before the kNN (rows-only check)."""
    from vellum.operators.knn import knn_classify, standardize
    e = standardize(table(spark, sf, "embeddings", "vec_id", "embedding", "label"), "embedding")
    return knn_classify(e, e, 3, qid="vec_id", tid="vec_id", qvec="embedding", tvec="embedding",
                        label="label", exclude_self=True, pred="pred_label")


@register
def centroids(spark, sf):
    from vellum.operators.vectors import centroids as cen
    c = cen(table(spark, sf, "embeddings", "embedding", "label"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@register
def centroid_distances(spark, sf):
    from vellum.operators.vectors import centroid_distances as cd, centroids as cen
    c = cen(table(spark, sf, "embeddings", "embedding", "label"), "label", "embedding")
    return cd(c, "label").withColumn("dist", F.round("dist", 6))


@register
def soft_subtopics(spark, sf):
    from vellum.operators.vectors import centroids as cen, soft_tags
    e = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    c = cen(e, "label", "embedding")
    t = soft_tags(e, c, "embedding", "label", threshold=0.25, doc="vec_id")
    return t.select("vec_id", F.array_join("subtopics", ",").alias("subtopics"))


@register
def id_vector_lookup(spark, sf):
    """Text id → vector; of an id's vectors the last one counts; documents
    without a vector are listed with a null."""
    from vellum.operators.vector_store import look_up, write_store
    d = table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", tx.text_id("text").alias("emb_id"))
    v = (table(spark, sf, "embeddings", "vec_id", "embedding")
         .join(d.select(F.col("doc_id").alias("vec_id"), "emb_id"), "vec_id"))
    found = look_up(d, write_store(v, "emb_id", "embedding", "vec_id"), "emb_id", "embedding")
    return found.select("doc_id", "emb_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x0"),
                        F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"))


@register
def missing_vectors(spark, sf):
    """Documents with no vector, by language (left anti join)."""
    d = table(spark, sf, "documents", "doc_id", "lang")
    v = table(spark, sf, "embeddings", "vec_id").select(F.col("vec_id").alias("doc_id"))
    return (d.join(v, "doc_id", "left_anti").groupBy("lang")
             .agg(F.count(F.lit(1)).alias("n_missing")))


# 4. labelling --------------------------------------------------------------------------
@register
def tfidf_terms(spark, sf):
    """L1–L3 + W4: top-10 TF-IDF terms per language group of documents."""
    from vellum.operators.labels import tfidf_term_scores
    from vellum.operators.labels import SCORE_DIGITS
    from pyspark.sql import Window
    d = table(spark, sf, "documents", "doc_id", "text", "lang")
    sc = tfidf_term_scores(d, "lang", "doc_id", "text")
    ok = sc.filter(~F.col("term").rlike(r"^\p{Nd}+$") & (F.length("term") > 1))
    r = F.row_number().over(Window.partitionBy("lang").orderBy(
        F.round("score", SCORE_DIGITS).desc(), F.col("term").desc()))
    return (ok.withColumn("rank", r).filter(F.col("rank") <= 10)
              .select("lang", "rank", "term", F.round("score", 6).alias("score")))


@register
def cluster_cards(spark, sf):
    """L4 + T8: cluster cards with documents grouped by source."""
    from vellum.operators.labels import cluster_cards as cc
    d = table(spark, sf, "documents", "doc_id", "text", "source")
    c = cc(d, "source", "doc_id", "text")
    return c.select("source", F.array_join("keywords", ",").alias("keywords"), "name", "size")


@register
def topic_terms_class_tfidf(spark, sf):
    """Class-based TF-IDF labels, documents grouped by source."""
    from vellum.operators.labels import class_tfidf
    d = table(spark, sf, "documents", "text", "source")
    return class_tfidf(d, "source", "text").select("source", "label")


# 5. hierarchy ---------------------------------------------------------------------------
def clustered_documents(spark, sf):
    """Documents with a vector (J9 on the id) and a cluster id: the
    embedding label refined by source gives ~20 clusters per label."""
    e = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    d = table(spark, sf, "documents", "doc_id", "text", "source")
    cid = (F.col("label") * 100 + F.regexp_extract("source", r"(\d+)$", 1).cast("int")).alias("cluster_id")
    return (e.join(d, e.vec_id == d.doc_id, "inner")
             .select("doc_id", "embedding", cid, tx.full_text(tx.first_line("text"), "text").alias("full_text")))


def document_centroids(spark, sf):
    """~200 cluster centroids of the documents with a vector."""
    from vellum.operators.vectors import centroids as cen
    from vellum.session import cut_lineage
    return cut_lineage(cen(clustered_documents(spark, sf), "cluster_id", "embedding"))


#: The job's sweep, and wider thresholds at which clusters of the driver's vectors merge.
LINK_THRESHOLDS = (*(round(0.10 + 0.01 * i, 2) for i in range(31)), 0.6, 0.7, 0.8, 0.9, 1.0)


@register
def merge_average_linkage(spark, sf):
    """H3 over the document clusters: label = smallest member cluster."""
    from vellum.operators.hierarchy import average_linkage, label_clusters
    a = average_linkage(document_centroids(spark, sf), "cluster_id", LINK_THRESHOLDS)
    return label_clusters(a).select("th", F.col("item").alias("cluster_id"), "label")


@register
def threshold_scores(spark, sf):
    """H4 over a sweep in which clusters merge."""
    from vellum.operators.hierarchy import sweep
    return (sweep(document_centroids(spark, sf), "cluster_id", LINK_THRESHOLDS)
            .withColumn("score", F.round("score", 6)))


@register
def threshold_choice(spark, sf):
    """H5: chosen threshold and the rule that chose it."""
    from vellum.operators.hierarchy import choose_threshold, sweep
    scores = sweep(document_centroids(spark, sf), "cluster_id", LINK_THRESHOLDS)
    return choose_threshold(scores.withColumn("score", F.round("score", 6)))


def topic_result(spark, sf):
    from vellum.plans.topics import topic_hierarchy
    return topic_hierarchy(clustered_documents(spark, sf), auto_tune=False, manual_threshold=0.9)


@register
def topic_tags(spark, sf):
    """Hard main topic and soft sub-topics per document."""
    t = topic_result(spark, sf).tagged
    return t.select("doc_id", "cluster_id", "main_topic", F.array_join("subtopics", ",").alias("subtopics"))


@register
def topic_tags_auto(spark, sf):
    """H5/H11 with the threshold that the sweep chooses."""
    from vellum.plans.topics import topic_hierarchy
    t = topic_hierarchy(clustered_documents(spark, sf), auto_tune=True, thresholds=LINK_THRESHOLDS).tagged
    return t.select("doc_id", "cluster_id", "main_topic", F.array_join("subtopics", ",").alias("subtopics"))


@register
def merged_topic_table(spark, sf):
    """H6/H9: merged clusters with member names and ordered-distinct keywords."""
    m = topic_result(spark, sf).merged
    return m.select("merged_cluster_id", F.array_join("subclusters", " | ").alias("subclusters"),
                    F.array_join("keywords", ",").alias("keywords"), "main_topic")


@register
def final_topic_table(spark, sf):
    """H10 (J3–J5): document → sub-topic → merged id → cleaned main topic."""
    from vellum.operators.hierarchy import final_topic_table as ftt
    r = topic_result(spark, sf)
    docs = r.tagged.join(r.cards.select("cluster_id", "name"), "cluster_id", "left")
    cards = r.cards.select("cluster_id", F.col("name").alias("subtopic"))
    merged = r.merged.withColumn("main_topic", F.concat(F.lit("**"), F.col("main_topic"), F.lit("**\nnote")))
    return ftt(docs, cards, merged).select("doc_id", "cluster_id", "subtopic", "merged_cluster_id",
                                           "main_topic_name")


@register
def reassign_topics(spark, sf):
    """topics = labels; merge at 1.0; main = largest member topic."""
    from vellum.operators.hierarchy import (average_linkage, merge_report, reassign_topics as rt)
    from vellum.operators.vectors import centroids as cen
    c = cen(table(spark, sf, "embeddings", "embedding", "label"), "label", "embedding")
    a = average_linkage(c, "label", [1.0]).select(F.col("item").alias("topic"), "cluster")
    e = table(spark, sf, "embeddings", "vec_id", "label").select("vec_id", F.col("label").alias("topic"))
    sizes = e.groupBy("topic").agg(F.count(F.lit(1)).alias("size"))
    rep = merge_report(a, sizes)
    return rt(e, rep).select("vec_id", "topic", "main_topic")


#: Documents of a cluster whose card is kept in the report below.
CARD_SIZE = 3


@register
def keyword_join_report(spark, sf):
    """Member names of the merged topics without a card, where small clusters'
    cards are not kept."""
    from vellum.operators.hierarchy import missing_subclusters
    r = topic_result(spark, sf)
    return missing_subclusters(r.merged, r.cards.filter(F.col("size") >= CARD_SIZE)).select("merged_cluster_id", "name")


# 6. ingest -------------------------------------------------------------------------------
@register
def ingest_rdf(spark, sf):
    """Documents rendered as RDF records, parsed back into the
    publications table (validity flag + XPath extraction)."""
    from vellum.sources.rdf import documents_as_rdf, parse_records
    d = table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    p = parse_records(documents_as_rdf(d))
    lists = {"authors", "affiliations", "topics", "related_titles"}
    shown = {"abstract": F.length("abstract").alias("abstract_chars"),
             "error": F.substring_index("error", ":", 1).alias("error")}
    return p.select(*[F.array_join(c, ";").alias(c) if c in lists else shown.get(c, F.col(c)) for c in p.columns])


# 7. language ---------------------------------------------------------------------------
def language_predictions(spark, sf):
    from vellum.operators.lang import detect_held_out
    d = table(spark, sf, "documents", "doc_id", "text", "lang")
    fold = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 2
    pred = detect_held_out(d.withColumn("fold", fold), "doc_id", "text", "lang", "fold", 2)
    return pred.join(d.select("doc_id", "lang"), "doc_id")


@register
def language_id(spark, sf):
    """G1: every document scored by the trigram profile of the other half of
    the labelled table."""
    return language_predictions(spark, sf).select("doc_id", "lang", "pred_lang")


@register
def language_id_report(spark, sf):
    """G1 + M2: per-language precision/recall of the detector."""
    from vellum.operators.evaluate import classification_report as cr
    return cr(language_predictions(spark, sf), "lang", "pred_lang")


def tag_with_language(code, texts):
    return "[" + code + "] " + texts


@register
def language_routed(spark, sf):
    """Non-English supported rows through a per-language batch function."""
    from vellum.operators.lang import language_routed as lr
    d = documents_as_records(spark, sf).select("doc_id", "title", "abstract", F.col("title_lang").alias("lang"))
    r = lr(d, "lang", ["title", "abstract"], tag_with_language)
    return r.select("doc_id", F.md5("title_en").alias("title_en_md5"), F.md5("abstract_en").alias("abstract_en_md5"))


# 8. embedding and small sinks ---------------------------------------------------------
@register
def text_embeddings(spark, sf):
    """One hashed-trigram vector per distinct full-text id."""
    from vellum.operators.embed import embed
    d = documents_as_records(spark, sf).select(
        tx.text_id(tx.full_text("title", "abstract")).alias("emb_id"),
        tx.full_text("title", "abstract").alias("full_text"))
    v = embed(d, "emb_id", "full_text")
    strongest = F.array_position("embedding", F.array_max("embedding")).cast("int") - 1
    return v.select("emb_id", F.size("embedding").alias("dim"), "_dim_ok",
                    F.size(F.filter("embedding", lambda x: x != 0)).alias("n_active"),
                    F.when(F.array_max("embedding") > 0, strongest).otherwise(-1).alias("strongest"))


@register
def dataset_fingerprint(spark, sf):
    """Order-free fingerprint of the text ids."""
    from vellum.operators.embed import fingerprint
    d = documents_as_records(spark, sf).select(tx.text_id(tx.full_text("title", "abstract")).alias("emb_id"))
    return fingerprint(d, "emb_id")


@register
def ordered_fingerprint(spark, sf):
    """Fingerprint of the texts in order of their ids, changed by any move."""
    from vellum.operators.embed import ordered_fingerprint as of
    d = table(spark, sf, "documents", "doc_id", "text")
    return of(d, "text", ["doc_id"]).unionByName(of(d.withColumn("doc_id", -F.col("doc_id")), "text", ["doc_id"]))


@register
def run_summary(spark, sf):
    """Clusters and outliers of the clustered documents."""
    from vellum.sources.files import run_summary as rs
    return rs(clustered_documents(spark, sf), config="label x source")


# 9. reduction and density ---------------------------------------------------------------
@register
def pca_reduce(spark, sf):
    """V2: 10-D PCA of the normalised embeddings; a vector's length in the subspace
    does not depend on the components' signs."""
    from vellum.operators.density import pca_reduce as pr
    from vellum.operators.vectors import norm2
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    return pr(e, "embedding", 10).select("vec_id", F.size("reduced").alias("dim"),
                                         F.round(norm2("reduced"), 6).alias("length"))


#: Neighbours of the map's graph; steps of power iteration.
MAP_NEIGHBOURS, MAP_STEPS = 10, 20


def map_edges(spark, sf):
    from vellum.operators.graph_map import neighbour_graph
    return neighbour_graph(table(spark, sf, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", MAP_NEIGHBOURS)


@register
def neighbour_graph(spark, sf):
    """V2: weighted edges of the embeddings' neighbour graph, both directions."""
    return map_edges(spark, sf).withColumn("w", F.round("w", 6))


def graph_map(spark, sf, dims):
    """Coordinates after a set number of steps; a point's length in the space that they span
    depends neither on signs nor on the choice of its axes."""
    from vellum.operators.graph_map import spectral_map
    from vellum.operators.vectors import norm2
    coords, _ = spectral_map(map_edges(spark, sf), dims, steps=MAP_STEPS, extra=0, tolerance=-1.0)
    return coords.select(F.col("id").alias("vec_id"), F.size("coords").alias("dim"), F.round(norm2("coords"), 6).alias("length"))


@register
def graph_map_2d(spark, sf):
    """The embeddings' map in the plane."""
    return graph_map(spark, sf, 2)


@register
def graph_map_10d(spark, sf):
    """V2: ten coordinates, as clustering takes them."""
    return graph_map(spark, sf, 10)


DENSITY_GRID = [(eps, size, ms) for eps in (0.9, 1.0, 1.1) for size in (5, 10) for ms in (3, 5)]


@register
def density_clusters(spark, sf):
    """V3: density clusters over the embeddings for every grid configuration."""
    from vellum.operators.density import density_clusters as dc
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    return dc(e, "vec_id", "embedding", DENSITY_GRID)


@register
def density_grid(spark, sf):
    """V4: score per configuration (first strict best = best_config)."""
    from vellum.operators.density import grid_scores
    return grid_scores(density_clusters(spark, sf)).withColumn("score", F.round("score", 6))


#: Least cluster sizes of a tree; the selections of the two jobs that cluster.
TREE_SIZES, TREE_SAMPLES, LEAF_EPSILON = (3, 4, 6), 3, 1.0


def density_tree(spark, sf, method, epsilon=0.0):
    from vellum.operators.density_tree import cluster_tree
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    return cluster_tree(e, "vec_id", "embedding", TREE_SIZES, TREE_SAMPLES, method, epsilon)


@register
def density_leaf(spark, sf):
    """V3: leaves of the condensed tree, climbing to births above the epsilon."""
    return density_tree(spark, sf, "leaf", LEAF_EPSILON)


@register
def density_eom(spark, sf):
    """The condensed tree's most stable clusters."""
    return density_tree(spark, sf, "eom")


@register
def density_tree_grid(spark, sf):
    """V4: score of each least cluster size, all read from one tree."""
    from vellum.operators.density import grid_scores
    found = density_tree(spark, sf, "leaf").withColumnRenamed("m", "cfg")
    return grid_scores(found).withColumn("score", F.round("score", 6))


@register
def knn_cells(spark, sf):
    """K1/W1 by pivots whatever the table's size: the 5 nearest other vectors."""
    from vellum.operators.knn import knn_join
    e = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    nb = knn_join(e, e, 5, qid="vec_id", tid="vec_id", qvec="embedding", tvec="embedding", label="label",
                  exclude_self=True, shared_train_bytes=0, cell_rows=256)
    return nb.select("vec_id", F.posexplode("neighbors").alias("pos", "n")).select(
        "vec_id", (F.col("pos") + 1).alias("rank"), F.col("n.tid").alias("neighbor"), F.round("n.dist", 6).alias("dist"))


@register
def profile_by_month(spark, sf):
    """States of the orders by month, written, merged by year and read again."""
    from vellum.operators.profile_state import merge_states, profile_state, read_profile
    from vellum.session import cut_lineage
    o = table(spark, sf, "orders", "o_orderdate", "o_totalprice", "o_custkey", "o_orderstatus")
    o = o.withColumn("month", F.date_format("o_orderdate", "yyyy-MM")).withColumn(
        "o_custkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")))
    state = cut_lineage(profile_state(o, ["o_totalprice", "o_custkey", "o_orderstatus"], ["month"]))
    yearly = read_profile(merge_states(state.withColumn("year", F.substring("month", 1, 4)), ["year"]))
    return yearly.select("year", "column", "n_rows", "n_null", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"),
                         F.round("mean", 4).alias("mean"), F.round("std", 3).alias("std"))


#: Values that a month's state lists; values of a year.
FREQUENT_OF_MONTH, FREQUENT_OF_YEAR = 12, 20


@register
def frequent_by_month(spark, sf):
    """A4/Q6: frequent customers and priorities of each year from the months' written states,
    with the bounds of their counts."""
    from vellum.operators.profile_state import frequent_state, merge_frequent
    from vellum.session import cut_lineage
    o = table(spark, sf, "orders", "o_orderdate", "o_custkey", "o_orderpriority")
    o = o.withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    state = cut_lineage(frequent_state(o, ["o_custkey", "o_orderpriority"], ["month"], FREQUENT_OF_MONTH))
    return merge_frequent(state.withColumn("year", F.substring("month", 1, 4)), ["month"], ["year"], FREQUENT_OF_YEAR)


# 10. remaining profile and report queries ----------------------------------------------
@register
def column_profile(spark, sf):
    """Shape of every driver table (columns from the schema, rows counted)."""
    from vellum.sources.tables import TABLES
    out = None
    for t in TABLES:
        df = table(spark, sf, t)
        r = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(t).alias("table"), F.lit(len(df.columns)).cast("long").alias("n_columns"), "n_rows")
        out = r if out is None else out.unionByName(r)
    return out


@register
def head_tail(spark, sf):
    """O1/O2: the ten largest and ten smallest orders by total price."""
    o = table(spark, sf, "orders", "o_orderkey", "o_totalprice")
    head = o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10).withColumn("end", F.lit("head"))
    tail = o.orderBy(F.col("o_totalprice").asc(), "o_orderkey").limit(10).withColumn("end", F.lit("tail"))
    return head.unionByName(tail)


@register
def vector_health(spark, sf):
    """Vectors flagged missing / wrong_dim / nan / zero (64-d expected)."""
    from vellum.operators.vectors import vector_health as vh
    zero, nan = (F.lit(x).cast("float") for x in (0.0, float("nan")))
    v = (F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 63))
         .when(F.col("vec_id") % 13 == 0, F.transform("embedding", lambda x: zero))
         .when(F.col("vec_id") % 17 == 0, F.lit(None))
         .when(F.col("vec_id") % 19 == 0, F.transform("embedding", lambda x, i: F.when(i == 3, nan).otherwise(x)))
         .otherwise(F.col("embedding")))
    e = table(spark, sf, "embeddings", "vec_id", "embedding").withColumn("embedding", v)
    return (vh(e, "embedding", 64).groupBy("vector_problem")
              .agg(F.count(F.lit(1)).alias("n")))


@register
def confidence_profile(spark, sf):
    """Q3 (A7/A8): kNN confidence described and binned into 40 bins."""
    from vellum.operators.profile import histogram
    p = knn_main(spark, sf)
    return histogram(p.select(F.col("confidence").cast("double").alias("confidence")), "confidence", 40) \
        .select("bin", "count", F.round("bin_lo", 6).alias("bin_lo"), F.round("bin_hi", 6).alias("bin_hi"))


# 11. whole reports -----------------------------------------------------------------------
@register
def clean_text_pages(spark, sf):
    """T1/T2 over raw pages, whose texts hold tags, entities and dollar signs."""
    p = table(spark, sf, "pages", "page_id", "html").select("page_id", tx.clean_abstract("html").alias("t"))
    return p.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


@register
def table_overview(spark, sf):
    """Rows, duplicates, types and nulls of the labelled documents."""
    from vellum.operators.profile import overview
    return overview(documents_with_labels(spark, sf))


@register
def publication_profile(spark, sf):
    """Coverage, errors and categories of the parsed publications."""
    from vellum.operators.profile import metadata_profile
    from vellum.sources.rdf import documents_as_rdf, parse_records
    d = table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    return metadata_profile(parse_records(documents_as_rdf(d)), ["journal", "publisher", "volume", "publication_date"])


@register
def confidence_by_class(spark, sf):
    """Q3: kNN confidence described for each predicted class."""
    from vellum.operators.profile import describe_by
    return describe_by(knn_main(spark, sf), "confidence", "pred_label")


@register
def prediction_profile(spark, sf):
    """Q10: coverage and categories of the prediction columns."""
    from vellum.operators.profile import metadata_profile
    p = predictions_with_truth(spark, sf)
    kept = p.select("lcc_main_name_pred", "lcc_name_pred", "sub_model_used", "truth_source",
                    F.when(F.col("gt_main").isNull(), F.lit("no truth: none found")).alias("error"))
    return metadata_profile(kept, ["lcc_main_name_pred", "lcc_name_pred", "truth_source"])


@register
def list_profile(spark, sf):
    """List detection and item counts of array, literal and plain columns."""
    from vellum.operators.profile import list_profile as lp
    d = table(spark, sf, "part", "p_name", "p_type").select(
        F.split("p_name", " ").alias("words"), "p_type",
        F.concat(F.lit("[' "), F.replace("p_name", F.lit(" "), F.lit("', '")), F.lit("', ' ']")).alias("literal"))
    return lp(d, ["words", "literal", "p_type"])


@register
def known_languages(spark, sf):
    """rows whose language codes are both known."""
    d = documents_as_records(spark, sf).select("doc_id", tx.lang_code_norm(
        F.when(F.col("title_lang") != "es", F.col("title_lang"))).alias("title_lang"), "abstract_lang")
    return flt.drop_null_lang(d).groupBy("title_lang").agg(F.count(F.lit(1)).alias("n_docs"))


@register
def named_documents(spark, sf):
    """Cluster names on documents, outliers without one."""
    from vellum.operators.labels import attach_names
    d = table(spark, sf, "documents", "doc_id", "source").withColumn(
        "cluster_id", F.when(F.col("doc_id") % 10 == 0, F.lit(-1)).otherwise(F.pmod("doc_id", F.lit(7))))
    cards = table(spark, sf, "nation", "n_nationkey", "n_name").select(
        F.col("n_nationkey").cast("long").alias("cluster_id"), F.col("n_name").alias("name")).filter("cluster_id < 6")
    return attach_names(d, cards, "cluster_id").select("doc_id", "cluster_id", "name")


@register
def excluded_ids(spark, sf):
    """A list of ids with comments and blanks is written, read back and
    left out."""
    import uuid
    from vellum.session import checkpoint_dir
    from vellum.sources.files import drop_ids, read_id_list
    d = table(spark, sf, "documents", "doc_id", "lang")
    line = (F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("  "), F.col("doc_id").cast("string"), F.lit("\t")))
            .when(F.col("doc_id") % 7 == 1, F.concat(F.lit("#"), F.col("doc_id").cast("string")))
            .otherwise(F.lit("   ")))
    path = f"{checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    d.select(line.alias("value")).write.text(path)
    ids = read_id_list(spark, path).select(F.col("id").cast("long").alias("id"))
    return drop_ids(d, ids, "doc_id").select("doc_id", "lang")


@register
def topic_documents(spark, sf):
    """H8: documents with the labels of their main topic and own topic."""
    from vellum.operators.hierarchy import labelled_documents
    d = reassign_topics(spark, sf).withColumn("topic", F.when(F.col("vec_id") % 25 == 0, F.lit(-1)).otherwise(
        F.col("topic"))).withColumn("main_topic", F.when(F.col("topic") == -1, F.lit(-1)).otherwise(F.col("main_topic")))
    labels = table(spark, sf, "embeddings", "label").distinct().select(
        F.col("label").alias("topic"), F.concat(F.lit("topic "), F.col("label").cast("string")).alias("label"))
    return labelled_documents(d, labels).select("vec_id", "topic", "main_topic", "main_topic_label", "subtopic_label")
