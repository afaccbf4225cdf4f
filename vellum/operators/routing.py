"""Two-stage classification (K2, T4, T15): main class, then a sub-class
chosen by the route of the predicted main class.

Routes (a small table keyed by the normalised class name):
* ``single`` — the class has one sub-class: constant, confidence 1.0,
  ``sub_model_used = 'direct_map'``;
* ``sub`` — a kNN restricted to training rows of that main class (the grid
  kNN keys its cells by the class, so one huge class is split into blocks);
  integer predictions are decoded through the id → name map, unknown ids
  are kept as they are;
* no route — ``no_submodel:<CLASS>``, NULL prediction and confidence.

Rows are matched by key throughout; nothing depends on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import norm_class
from vellum.operators.knn import knn_classify
from vellum.operators.vectors import checked_broadcast


def two_stage(queries: DataFrame, train: DataFrame, routes: DataFrame, id_map: DataFrame,
              *, qid: str, tid: str, qvec: str, tvec: str, main_label: str, sub_label: str,
              k_main: int = 3, k_sub: int = 3, exclude_self: bool = False) -> DataFrame:
    """Returns qid, lcc_main_name_pred, main_knn_confidence, lcc_name_pred,
    sub_knn_confidence, sub_model_used."""
    s1 = knn_classify(queries, train, k_main, qid=qid, tid=tid, qvec=qvec, tvec=tvec,
                      label=main_label, exclude_self=exclude_self,
                      pred="lcc_main_name_pred", conf="main_knn_confidence")
    s1 = s1.withColumn("main_norm", norm_class("lcc_main_name_pred"))
    r = checked_broadcast(routes)
    routed = s1.join(r, "main_norm", "left")

    sub_q = (routed.filter(F.col("kind") == "sub").select(qid, "main_norm")
                   .join(queries.select(qid, qvec), qid, "inner"))
    sub_t = train.select(F.col(tid).alias("_tid"), F.col(tvec).alias("_tvec"),
                         F.col(sub_label).alias("_sub"), norm_class(main_label).alias("_tnorm"))
    s2 = knn_classify(sub_q, sub_t, k_sub, qid=qid, tid="_tid", qvec=qvec, tvec="_tvec",
                      label="_sub", exclude_self=exclude_self, qgroup="main_norm", tgroup="_tnorm",
                      pred="_sub_pred", conf="_sub_conf")
    ids = checked_broadcast(id_map.select("main_norm", F.col("id").alias("_sub_pred"), "name"))
    out = (routed.join(s2, qid, "left")
                 .join(ids, ["main_norm", "_sub_pred"], "left"))
    kind = F.col("kind")
    return out.select(
        qid, "lcc_main_name_pred", "main_knn_confidence",
        F.when(kind == "single", F.col("single_subclass"))
         .when(kind == "sub", F.coalesce(F.col("name"), F.col("_sub_pred").cast("string")))
         .alias("lcc_name_pred"),
        F.when(kind == "single", F.lit(1.0).cast("float")).when(kind == "sub", F.col("_sub_conf"))
         .alias("sub_knn_confidence"),
        F.when(kind == "single", F.lit("direct_map")).when(kind == "sub", F.col("main_norm"))
         .otherwise(F.concat(F.lit("no_submodel:"), F.col("main_norm"))).alias("sub_model_used"))
