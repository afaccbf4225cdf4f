"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(master: str | None = None, app: str = "vellum",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE, UTC and Arrow enabled.

    On a cluster the master and memory come from ``spark-submit``; the
    explicit master is for local runs and tests only.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    parts = shuffle_partitions or os.environ.get("VELLUM_SHUFFLE_PARTITIONS")
    if parts:  # else the cluster's own setting holds
        b = b.config("spark.sql.shuffle.partitions", str(parts))
    b = (b.config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    if master and master.startswith("local"):
        if memory := os.environ.get("VELLUM_DRIVER_MEMORY"):
            b = b.config("spark.driver.memory", memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names that folder; we only invent one when it is unset and
    the session is local (tests, laptops).  A machine-local temp folder is
    never used on a cluster: there we fail loudly instead.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not is_local(spark):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set; iterative jobs need a shared "
                "checkpoint folder on a cluster")
        path = tempfile.mkdtemp(prefix="vellum-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cut_lineage(df: DataFrame, use_table: bool = True) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and return a frame
    that reads it back: lineage is cut and the data survives executor loss.

    By default a Parquet table under ``spark.checkpoint.dir`` is written (it
    keeps statistics for the planner and measured faster in long iterative
    loops); ``use_table=False`` uses ``DataFrame.checkpoint`` instead.  A
    local checkpoint is never used.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark)
    if not use_table:
        return df.checkpoint(eager=True)
    path = f"{base.rstrip('/')}/vellum-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._vellum_table = path  # lets iterative loops drop superseded rounds
    return out


def drop_lineage_table(df: DataFrame | None) -> None:
    """Delete the table behind a frame returned by ``cut_lineage`` once no
    frame still reads it (iterative loops call this for superseded rounds,
    so a long loop does not pile tables up in the shared folder)."""
    path = getattr(df, "_vellum_table", None) if df is not None else None
    if not path:
        return
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
