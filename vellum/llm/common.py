"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch that a worker handles at once.
BATCH_BYTES = 4 << 20
#: Words are runs of anything but these bytes (space, tab to carriage return).
SPACES = " \t\n\u000b\f\r"
A_TO_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text (null: null)."""
    spaced = F.translate(text, SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def fold(part: Column, n_folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n_folds`` (null id: 1)."""
    return F.coalesce(F.pmod(F.crc32(part.cast("string")), F.lit(n_folds)), F.lit(1))


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text, null as empty: workers then split and hash bytes
    without decoding."""
    return F.coalesce(text, F.lit("")).cast("binary")


def worker_cache(key: str, build: Callable):
    """Value that a Python worker builds once and keeps over its tasks."""
    home = sys.modules.setdefault("_vellum_worker_cache", types.ModuleType("_vellum_worker_cache"))
    if key not in home.__dict__:
        home.__dict__[key] = build()
    return home.__dict__[key]


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session now sends workers at most `BATCH_BYTES` at a time (a
    smaller limit stays): rows of texts have no common length, and Spark's default
    of 64 MB is held several times over in each task."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key, "64m").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    if not 0 < int(now.rstrip("kmg") or 0) * unit <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def map_batches(df: DataFrame, inputs: list[str], outputs: T.StructType, keep: list[str],
                make: Callable[[], Callable]) -> DataFrame:
    """Append ``outputs`` to the ``keep`` columns, Arrow batch by Arrow batch.

    ``make()`` runs once in each task and returns a function from the input
    arrays to the list of output arrays; its attribute ``close``, if any, is called
    at the task's end, so that idle workers hold little.  Rows stay in their
    partition.  A kept
    column that has an output's name is replaced by the output.
    """
    keep = [c for c in keep if c not in outputs.names]
    source = df.select(*[F.col(f"`{c}`") for c in keep],
                       *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([df.schema[c] for c in keep] + outputs.fields)
    n_keep, n_in, names = len(keep), len(inputs), schema.names
    out_types = [arrow_type(f.dataType) for f in outputs.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        func = make()
        for whole in batches:
            for b in slices(whole):
                cols = [b.column(i) for i in range(n_keep)]
                got = func(*[b.column(n_keep + i) for i in range(n_in)])
                cols += [g if isinstance(g, pa.Array) else pa.array(g, t)
                         for g, t in zip(got, out_types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        if close := getattr(func, "close", None):
            close()
        pa.default_memory_pool().release_unused()

    return bounded_batches(source).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes, so that long texts do not meet
    in a worker's memory as Python objects."""
    step = max(1, size * batch.num_rows // max(1, batch.nbytes))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def running_start(df: DataFrame, group: list[str], order: list[Column], size: Column, out: str,
                  part: Column) -> DataFrame:
    """Sum of ``size`` over a group's rows before each row, without a task per group.

    ``part`` maps a row to one of a few thousand numbers that never fall along
    ``order``.  Windows run inside (group, part); the parts' totals, a few
    thousand rows a group, give each part its start.
    """
    key, part_key = [F.col(g) for g in group], F.col("__part")
    d = df.withColumns({"__part": part, "__size": size})
    totals = d.groupBy(*group, "__part").agg(F.sum("__size").alias("__total"))
    before = Window.partitionBy(*key).orderBy(part_key).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
                           part_key.alias("__p"),
                           F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    inside = (Window.partitionBy(*key, part_key).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = d.withColumn("__local", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    cond = part_key == F.col("__p")
    for s in same:
        cond = cond & s
    return (local.join(starts, cond)
            .withColumn(out, F.col("__base") + F.col("__local"))
            .drop("__part", "__size", "__local", "__base", "__p", "__total",
                  *[f"__g{i}" for i in range(len(group))]))
