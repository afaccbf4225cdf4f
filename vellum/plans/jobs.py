"""Stage jobs composed from the operators (entry points A and C of the
original system; B is ``vellum.plans.topics.topic_hierarchy``).

``clean_job``: file source → validity flag + XPath projection → F1/F2 →
T1 → language detection (title and clean abstract) → F3 → F5, materialised
once in the checkpoint folder, then two writes: English scientific papers
and the other-language rows (diagnostic reports are returned, not written,
as the original discards them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import filters as flt
from vellum.operators.lang import detect
from vellum.session import cut_lineage
from vellum.sources.rdf import ingest


def clean_job(spark: SparkSession, root: str, profile: DataFrame, out_english: str,
              out_other: str, pattern: str = "*.rdf") -> dict[str, int]:
    pubs = ingest(spark, root, pattern).filter(F.col("error").isNull())
    a = flt.annotate_informative(pubs).filter(F.col("dropped_by").isNull()).drop("dropped_by")
    from vellum.functions.text import clean_abstract
    a = a.withColumn("clean_abstract", clean_abstract("abstract"))
    tl = detect(a, profile, "file", "title", out="title_lang")
    al = detect(a, profile, "file", "clean_abstract", out="abstract_lang")
    staged = cut_lineage(a.join(tl, "file", "left").join(al, "file", "left")
                          .withColumn("type", flt.document_type("title")))
    english, other = flt.split_english(staged)
    sci = english.filter(F.col("type") == "scientific_paper")
    sci.write.mode("overwrite").parquet(out_english)
    other.write.mode("overwrite").parquet(out_other)
    return {"kept": staged.count(), "english_scientific": sci.count(), "other": other.count(),
            "english_not_scientific": english.filter(F.col("type") != "scientific_paper").count()}


def classify_job(vectors: DataFrame, train: DataFrame, metadata: DataFrame, routes: DataFrame,
                 id_map: DataFrame, journal_truth: DataFrame, publisher_truth: DataFrame, *,
                 id_col: str, vec: str, main_label: str, sub_label: str, k: int = 3,
                 exclude_self: bool = False) -> dict[str, DataFrame]:
    """Entry point C: two-stage kNN → join publication metadata (journal,
    publisher) on the id → weak truth → reports.  Returns DataFrames; the
    prediction table is materialised once because every report reads it."""
    from vellum.operators import evaluate as ev
    from vellum.operators.routing import two_stage
    pred = two_stage(vectors, train, routes, id_map, qid=id_col, tid=id_col, qvec=vec, tvec=vec,
                     main_label=main_label, sub_label=sub_label, k_main=k, k_sub=k,
                     exclude_self=exclude_self)
    pred = cut_lineage(pred.join(metadata, id_col, "inner"))
    truth = ev.attach_truth(pred, journal_truth, publisher_truth)
    journal_rows = truth.filter(F.col("truth_source") == "journal")
    acc = ev.group_accuracy(journal_rows, "journal", "gt_main", "lcc_main_name_pred", "gt_sub", "lcc_name_pred")
    return {
        "predictions": pred,
        "coverage": ev.truth_coverage(truth),
        "report_main": ev.classification_report(truth, "gt_main", "lcc_main_name_pred"),
        "report_sub": ev.classification_report(truth, "gt_sub", "lcc_name_pred"),
        "confusion_main": ev.confusion_long(truth, "gt_main", "lcc_main_name_pred"),
        "journal_accuracy": acc,
        "low_performers": ev.low_performer_summary(journal_rows, acc, "journal", "gt_main", "lcc_main_name_pred"),
    }
