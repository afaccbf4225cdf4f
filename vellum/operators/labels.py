"""Cluster labelling with TF-IDF terms.

Per-cluster TF-IDF where each cluster's documents are the corpus (smooth
idf ``ln((1+n)/(1+df)) + 1``, raw counts, L2 row norm, scores summed over
the cluster's documents), over all terms or, if ``max_features`` is given,
the cluster's most frequent ones, then the top terms skipping digit-only and one-character
tokens.  Everything is explode → groupBy on (cluster, doc, term): partial
aggregation everywhere, no per-cluster Python.

Stop words: the default English list of ``StopWordsRemover``, kept as plain
data in ``functions/stopwords.py``.  It is not the same list as the original
job's library (documented difference).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.stopwords import ENGLISH
from vellum.functions.text import WORD, col, is_blank, keyword_label
from vellum.operators.filters import is_outlier
from vellum.session import cut_lineage

TOKEN_RE = WORD + "+"
SCORE_DIGITS = 9  # scores are compared after rounding, so float-sum order cannot flip ties


def english_stop_words() -> tuple[str, ...]:
    return ENGLISH


def tokens(text: str | Column, stop_words: tuple[str, ...] | None = None) -> Column:
    """Lower-case word tokens (``\\w+`` runs), stop words removed."""
    t = F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN_RE), 0)
    if stop_words:
        stop = F.array(*[F.lit(w) for w in stop_words])
        t = F.filter(t, lambda x: ~F.array_contains(stop, x))
    return t


def tfidf_term_scores(df: DataFrame, group: str, doc: str, text: str,
                      max_features: int | None = None, stop_words=None) -> DataFrame:
    """(group, term, score): summed L2-normalised TF-IDF per cluster."""
    sw = english_stop_words() if stop_words is None else stop_words
    docs = df.filter(~is_blank(text)).select(group, doc, text)
    # texts move, not their terms, which are many times their bytes: terms are then
    # counted where they are.  The outer explode leaves out the planner's filter, which
    # would cut each text twice more.  Stop words are a hashed set test (InSet), not a
    # per-token scan of the list inside a lambda.  A table: two branches read the counts
    rows = docs.repartition(group, doc).select(group, doc, F.explode_outer(tokens(text)).alias("term"))
    tf = cut_lineage(rows.filter(F.col("term").isNotNull() & ~F.col("term").isin(list(sw)))
                     .groupBy(group, doc, "term").agg(F.count(F.lit(1)).alias("tf")))
    vocab = tf.groupBy(group, "term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    if max_features:
        vocab = most_frequent(vocab, group, max_features)
    n_docs = docs.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    idf = (vocab.join(n_docs, group, "inner")
           .select(group, "term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf")))
    w = (tf.filter(F.col(doc).isNotNull()).join(idf, [group, "term"], "inner")
           .select(group, doc, "term", (F.col("tf") * F.col("idf")).alias("w")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(group, doc)))
    return (w.withColumn("norm", norm)
             .groupBy(group, "term").agg(F.sum(F.col("w") / F.col("norm")).alias("score")))


def most_frequent(vocab: DataFrame, group: str, n: int) -> DataFrame:
    """The ``n`` most frequent terms of each group (ties by term): the count at
    the border comes from the histogram of counts, and only the terms at the
    border are ranked."""
    counts = vocab.groupBy(group, "cf").agg(F.count(F.lit(1)).alias("terms"))
    above = Window.partitionBy(group).orderBy(F.col("cf").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("room", n - F.coalesce(F.sum("terms").over(above), F.lit(0)))
    open_counts = counts.filter("room > 0").select(group, "cf", "terms", "room")
    j = vocab.join(open_counts, [group, "cf"], "inner")
    whole = j.filter("terms <= room")
    border = j.filter("terms > room").withColumn("_r", F.row_number().over(
        Window.partitionBy(group).orderBy("term"))).filter("_r <= room").drop("_r")
    return whole.unionByName(border).select(group, "term", "cf", "df")


def top_terms(scores: DataFrame, group: str, n: int = 10) -> DataFrame:
    """(group, keywords): top ``n`` terms by score, skipping digit-only and
    one-character terms; ties by term descending."""
    ok = scores.filter(~F.col("term").rlike(r"^\p{Nd}+$") & (F.length("term") > 1))
    r = F.row_number().over(Window.partitionBy(group).orderBy(
        F.round("score", SCORE_DIGITS).desc(), F.col("term").desc()))
    top = ok.withColumn("_r", r).filter(F.col("_r") <= n)
    return top.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]).alias("keywords"))


def cluster_cards(df: DataFrame, cluster: str, doc: str, text: str, n_terms: int = 10,
                  max_features: int | None = None, stop_words=None) -> DataFrame:
    """L4: (cluster_id, keywords, name, size) for every non-outlier cluster
    that has at least one non-null text; ``["unknown"]`` when nothing is left."""
    src = df.filter(~is_outlier(cluster))
    sizes = (src.filter(F.col(text).isNotNull()).groupBy(cluster)
                .agg(F.count(F.lit(1)).alias("size")))
    kw = top_terms(tfidf_term_scores(src, cluster, doc, text, max_features, stop_words), cluster, n_terms)
    cards = (sizes.join(kw, cluster, "left")
                  .withColumn("keywords", F.coalesce("keywords", F.array(F.lit("unknown")))))
    return cards.select(cluster, "keywords", keyword_label("keywords").alias("name"), "size")


def attach_names(df: DataFrame, cards: DataFrame, cluster: str) -> DataFrame:
    """Left join of cluster names onto documents (cards are one row per cluster)."""
    return df.join(cards.select(cluster, "name"), cluster, "left")


# Class-based TF-IDF -------------------------------------------------------------
def class_tfidf(df: DataFrame, cls: str, text: str, n_words: int = 3) -> DataFrame:
    """Per class: c-TF-IDF = (tf / class total) · ln(1 + A / f_t) with A the
    mean words per class and f_t the term's frequency over all classes;
    tokens of two or more word characters, no stop list.  Label is
    ``<class>_<w1>_<w2>_<w3>``; outlier class −1 is labelled too, by id."""
    toks = df.select(cls, F.explode(F.regexp_extract_all(F.lower(col(text)), F.lit(WORD + "{2,}"), 0))
                     .alias("term"))
    tf = cut_lineage(toks.groupBy(cls, "term").agg(F.count(F.lit(1)).alias("tf")))  # read by three branches
    tot = tf.groupBy(cls).agg(F.sum("tf").alias("tot"))
    avg_words = tot.select(F.avg("tot")).scalar()
    ft = tf.groupBy("term").agg(F.sum("tf").alias("ft"))
    w = (tf.join(tot, cls).join(ft, "term")
           .withColumn("score", F.col("tf") / F.col("tot") * F.log(1 + avg_words / F.col("ft"))))
    r = F.row_number().over(Window.partitionBy(cls).orderBy(
        F.round("score", SCORE_DIGITS).desc(), F.col("term").asc()))
    top = w.withColumn("_r", r).filter(F.col("_r") <= n_words)
    words = top.groupBy(cls).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]).alias("words"))
    return words.select(cls, "words", F.concat_ws("_", F.col(cls).cast("string"),
                                                  F.array_join("words", "_")).alias("label"))
