"""Vectors kept by id, so that look-ups move only the rows that ask.

The store is a bucketed table: the last vector of each id, as the given order has it,
is chosen when the store is written, and rows lie in buckets by the id's hash, sorted
within.  A look-up is a join on the id: the asking rows are shuffled to the buckets and
the vectors stay where they are.  Buckets follow from the vectors' bytes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import checkpoint_dir

BUCKET_BYTES = 128 << 20


def write_store(vectors: DataFrame, key: str, vec: str, order: str, name: str | None = None,
                path: str | None = None, buckets: int | None = None) -> str:
    """Write the last vector of each ``key`` and return the table's name.  Without a
    name and a path the store lies in the shared checkpoint folder."""
    spark = vectors.sparkSession
    name = name or f"vectors_{uuid.uuid4().hex}"
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    if buckets is None:
        rows, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
        buckets = max(1, -(-rows * (dim or 0) * 4 // BUCKET_BYTES))
    last = vectors.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(vec, order).alias(vec))
    (last.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    return name


def look_up(rows: DataFrame, name: str, key: str, vec: str) -> DataFrame:
    """``rows`` with the vector of their ``key``, null where the store has none."""
    return rows.join(rows.sparkSession.table(name).select(key, vec), key, "left")
