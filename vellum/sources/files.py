"""Small file sources and sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import ustrip


# S8 ---------------------------------------------------------------------------------
def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Read CSV (header), Parquet or JSON by extension; Excel is refused clearly."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".csv":
        return spark.read.option("header", "true").csv(path)
    if ext in (".parquet", ".pq", ""):
        return spark.read.parquet(path)
    if ext in (".json", ".jsonl"):
        return spark.read.json(path)
    if ext in (".xlsx", ".xls"):
        raise ValueError(f"Excel files are not readable by Spark: convert {path} to CSV or Parquet")
    raise ValueError(f"unsupported file type: {ext or '(none)'}")


# S9 ---------------------------------------------------------------------------------
def write_topic_map(df: DataFrame, path: str, key: str = "main_topic", names: str = "names") -> None:
    df.select(F.col(key).cast("long").alias("main_topic"), F.col(names).alias("names")).write.mode(
        "overwrite").json(path)


def read_topic_map(spark: SparkSession, path: str) -> DataFrame:
    """(main_topic, name) pairs from the JSON map written above."""
    m = spark.read.schema("main_topic long, names array<string>").json(path)
    return m.select("main_topic", F.explode("names").alias("name"))


# S10 --------------------------------------------------------------------------------
def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids from a text file: one per line, '#' comment lines and blanks skipped."""
    t = spark.read.text(path)
    return (t.filter(~F.col("value").startswith("#"))
             .select(ustrip("value").alias("id")).filter(F.col("id") != "").distinct())


def drop_ids(df: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    return df.join(ids.withColumnRenamed("id", col), col, "left_anti")


# S11 --------------------------------------------------------------------------------
def run_summary(clustered: DataFrame, cluster: str = "cluster_id", config: str | None = None) -> DataFrame:
    """One row: clusters (outliers excluded), outliers, rows, and the config."""
    is_out = F.coalesce(F.col(cluster).cast("string") == "-1", F.lit(False))
    return clustered.agg(
        F.count_distinct(F.when(~is_out, F.col(cluster))).alias("n_clusters"),
        F.count_if(is_out).alias("n_outliers"),
        F.count(F.lit(1)).alias("n_rows")).withColumn("config", F.lit(config))


def write_summary(summary: DataFrame, path: str) -> None:
    summary.withColumn("timestamp", F.current_timestamp()).coalesce(1).write.mode("append").json(path)
