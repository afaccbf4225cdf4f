"""Evaluation of predictions against weak truth.

Everything is grouped counting: the (truth, prediction) pair table has at
most classes² rows, so per-class metrics, confusion shares and summaries
are computed on that small table after one partial aggregation of the
(possibly huge) prediction table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.vectors import checked_broadcast
from vellum.session import cut_lineage


# M1 / J10 / U1 -------------------------------------------------------------------
def attach_truth(pred: DataFrame, journal_truth: DataFrame, publisher_truth: DataFrame,
                 journal: str = "journal", publisher: str = "publisher") -> DataFrame:
    """Truth from the journal map, else from the publisher map (one pass).

    Both maps have columns (key, gt_main, gt_sub); they are broadcast only
    after a size check.
    """
    j = checked_broadcast(journal_truth.select(F.col("key").alias(journal),
                                               F.col("gt_main").alias("_jm"), F.col("gt_sub").alias("_js")))
    p = checked_broadcast(publisher_truth.select(F.col("key").alias(publisher),
                                                 F.col("gt_main").alias("_pm"), F.col("gt_sub").alias("_ps")))
    x = pred.join(j, journal, "left").join(p, publisher, "left")
    return (x.withColumn("truth_source", F.when(F.col("_jm").isNotNull(), "journal")
                         .when(F.col("_pm").isNotNull(), "publisher"))
             .withColumn("gt_main", F.coalesce("_jm", "_pm"))
             .withColumn("gt_sub", F.when(F.col("_jm").isNotNull(), F.col("_js")).otherwise(F.col("_ps")))
             .withColumn("publisher_hit", F.col("_pm").isNotNull())
             .drop("_jm", "_js", "_pm", "_ps"))


def truth_coverage(with_truth: DataFrame, journal: str = "journal",
                   publisher: str = "publisher") -> DataFrame:
    """Rows, journal-truth rows, publisher-truth rows (overlap included) and combined."""
    n = F.count(F.lit(1))
    return (with_truth.agg(n.alias("n_rows"),
                           F.count_if(F.col("truth_source") == "journal").alias("n_journal"),
                           F.count_if(F.col("publisher_hit")).alias("n_publisher"),
                           F.count_if(F.col("truth_source").isNotNull()).alias("n_combined"))
            .withColumn("pct_combined", F.round(F.col("n_combined") * 100.0 / F.col("n_rows"), 1)))


# M2 ------------------------------------------------------------------------------
def pair_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, pred, n) after dropping NULL predictions.

    The result has at most classes² rows and feeds several aggregates, so it
    is materialised once (a small table in the checkpoint folder) instead of
    re-running the upstream prediction plan for every use."""
    pc = (df.filter(F.col(pred).isNotNull() & F.col(truth).isNotNull())
            .groupBy(F.col(truth).cast("string").alias("t"), F.col(pred).cast("string").alias("p"))
            .agg(F.count(F.lit(1)).alias("n")))
    return cut_lineage(pc)


def _safe_div(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _row(name: str, p: str, r: str, f: str):
    return F.struct(F.lit(name).alias("cls"), F.col(p).cast("double").alias("precision"),
                    F.col(r).cast("double").alias("recall"), F.col(f).cast("double").alias("f1"),
                    F.col("n").alias("support"))


def classification_report(df: DataFrame, truth: str, pred: str, digits: int = 6) -> DataFrame:
    """Per-class precision/recall/F1/support plus accuracy, macro and weighted
    averages; classes = truth ∪ predictions; zero division → 0."""
    pc = pair_counts(df, truth, pred)
    sup = pc.groupBy(F.col("t").alias("cls")).agg(F.sum("n").alias("support"))
    prd = pc.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    tp = pc.filter(F.col("t") == F.col("p")).select(F.col("t").alias("cls"), F.col("n").alias("tp"))
    per = (sup.join(prd, "cls", "full").join(tp, "cls", "left")
              .select("cls", F.coalesce("support", F.lit(0)).alias("support"),
                      F.coalesce("predicted", F.lit(0)).alias("predicted"),
                      F.coalesce("tp", F.lit(0)).alias("tp")))
    per = (per.withColumn("precision", _safe_div(F.col("tp"), F.col("predicted")))
              .withColumn("recall", _safe_div(F.col("tp"), F.col("support")))
              .withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"),
                                          F.col("precision") + F.col("recall"))))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  _safe_div(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
                  _safe_div(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
                  _safe_div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"))
    summary = tot.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("cls"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), _safe_div(F.col("tp"), F.col("n")).cast("double").alias("f1"),
                 F.col("n").alias("support")),
        _row("macro avg", "mp", "mr", "mf"), _row("weighted avg", "wp", "wr", "wf"))))
    rows = per.select("cls", "precision", "recall", "f1", "support").unionByName(summary)
    return rows.select(F.col("cls").alias("class"), *[F.round(c, digits).alias(c) for c in
                                                        ("precision", "recall", "f1")],
                       F.col("support").cast("long").alias("support"))


# M3 ------------------------------------------------------------------------------
def confusion_long(df: DataFrame, truth: str, pred: str, digits: int = 6) -> DataFrame:
    """Counts per (truth, prediction) with predictions outside the truth
    classes folded into 'Other', and the share of each truth row."""
    pc = pair_counts(df, truth, pred)
    classes = pc.select(F.col("t").alias("p")).distinct().withColumn("_known", F.lit(True))
    folded = (pc.join(checked_broadcast(classes), "p", "left")
                .withColumn("p", F.when(F.col("_known"), F.col("p")).otherwise(F.lit("Other")))
                .groupBy("t", "p").agg(F.sum("n").alias("n")))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("t"))
    return folded.select(F.col("t").alias("true_class"), F.col("p").alias("pred_class"),
                         F.col("n").cast("long").alias("n"), F.round(share, digits).alias("share"))


# M4 ------------------------------------------------------------------------------
def _hit(pred: str, truth: str):
    return F.coalesce(F.col(pred) == F.col(truth), F.lit(False)).cast("double")


def group_accuracy(df: DataFrame, group: str, gt_main: str, pred_main: str,
                   gt_sub: str, pred_sub: str) -> DataFrame:
    """Per group: n, truth, main and sub accuracy (NULL prediction = wrong), rounded to 3."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_papers"), F.first(gt_main, True).alias("gt_main"),
        F.first(gt_sub, True).alias("gt_sub"),
        F.round(F.avg(_hit(pred_main, gt_main)), 3).alias("acc_main"),
        F.round(F.avg(_hit(pred_sub, gt_sub)), 3).alias("acc_sub"))


# M5 / M6 / F10 / W3 -------------------------------------------------------------
def low_performers(acc: DataFrame, threshold: float = 0.70) -> DataFrame:
    return acc.filter(F.col("acc_main") < threshold)


def prediction_shares(df: DataFrame, group: str, truth: str, pred: str,
                      groups: DataFrame | None = None) -> DataFrame:
    """Where each group's papers go: % of non-null predictions (rounded 1)
    per predicted class, with a hit flag."""
    src = df.filter(F.col(pred).isNotNull())
    if groups is not None:
        src = src.join(checked_broadcast(groups.select(group)), group, "left_semi")
    g = src.groupBy(group, F.col(pred).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"), F.first(truth, True).alias("truth"))
    pct = F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(group)), 1)
    return g.select(group, "predicted", pct.alias("pct"),
                    F.coalesce(F.col("predicted") == F.col("truth"), F.lit(False)).alias("hit"))


# M7 ------------------------------------------------------------------------------
def low_performer_summary(df: DataFrame, acc: DataFrame, group: str, gt_main: str,
                          pred_main: str) -> DataFrame:
    """Per low group: most frequent wrong prediction and its share among
    wrong non-null predictions ('—' and 0 when there is none)."""
    low = low_performers(acc)
    wrong = (df.join(checked_broadcast(low.select(group)), group, "left_semi")
               .filter(F.col(pred_main).isNotNull() & ~F.coalesce(F.col(pred_main) == F.col(gt_main), F.lit(False)))
               .groupBy(group, F.col(pred_main).alias("w")).agg(F.count(F.lit(1)).alias("n")))
    top = wrong.groupBy(group).agg(
        F.min_by("w", F.struct(-F.col("n"), F.col("w"))).alias("top_wrong_pred"),
        (F.max("n") * 100.0 / F.sum("n")).alias("top_wrong_pct"))
    return (low.join(top, group, "left")
               .select(group, "n_papers", "gt_main", "acc_main", "acc_sub",
                       F.coalesce("top_wrong_pred", F.lit("—")).alias("top_wrong_pred"),
                       F.round(F.coalesce("top_wrong_pct", F.lit(0.0)), 1).alias("top_wrong_pct")))


# M8 ------------------------------------------------------------------------------
def score_row(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """accuracy, macro-F1, weighted-F1 as one row."""
    r = classification_report(df, truth, pred)
    return r.agg(F.max(F.when(F.col("class") == "accuracy", F.col("f1"))).alias("accuracy"),
                 F.max(F.when(F.col("class") == "macro avg", F.col("f1"))).alias("f1_macro"),
                 F.max(F.when(F.col("class") == "weighted avg", F.col("f1"))).alias("f1_weighted"))


def score_table(preds: Sequence[tuple[str, DataFrame]], truth: str, pred: str) -> DataFrame:
    out = None
    for name, df in preds:
        r = score_row(df, truth, pred).select(F.lit(name).alias("model"), "*")
        out = r if out is None else out.unionByName(r)
    return out
