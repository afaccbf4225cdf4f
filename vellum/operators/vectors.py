"""Vector analytics on ``array<float>`` columns.

Vectors stay a column keyed by an id; nothing is addressed by position.
Centroids are a grouped element-wise mean (``Summarizer``-free: a
``posexplode`` → ``groupBy(group, pos)`` → ordered re-collect, all partial
aggregation).  Pairwise work is limited to *centroid* tables, whose size is
the number of clusters and is checked before any broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000  # key tables above this are shuffled, not broadcast
BROADCAST_BYTES = 64 << 20    # centroid vectors above this are joined, not broadcast
BLOCK_ROWS = 2048             # centroids of a block, about
SALTS = 64


def col(c):
    return F.col(c) if isinstance(c, str) else c


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two equal-length arrays, in double precision."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm2(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(a: str | Column) -> Column:
    n = norm2(a)
    return F.when(n > 0, F.transform(col(a), lambda x: x.cast("double") / n))


def cosine_similarity(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (norm2(a) * norm2(b))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """1 − cos, clipped to [0, 2] like the usual pairwise-distance helpers."""
    return F.least(F.greatest(F.lit(1.0) - cosine_similarity(a, b), F.lit(0.0)), F.lit(2.0))


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double"))
                                         * (x.cast("double") - y.cast("double"))),
                              F.lit(0.0), lambda acc, v: acc + v))


# E3 ------------------------------------------------------------------------------
def vector_health(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Flag why a vector is unusable: wrong_dim, nan, zero; NULL when healthy."""
    v = F.col(vec)
    return df.withColumn("vector_problem", F.when(v.isNull(), "missing")
                         .when(F.size(v) != dim, "wrong_dim")
                         .when(F.exists(v, lambda x: F.isnan(x)), "nan")
                         .when(norm2(v) == 0, "zero"))


# A1 / H1 -------------------------------------------------------------------------
def centroids(df: DataFrame, group: str, vec: str, out: str = "centroid") -> DataFrame:
    """Element-wise mean vector per group (double precision)."""
    e = df.select(group, F.posexplode(vec).alias("pos", "x"))
    m = e.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return (m.groupBy(group)
             .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_p"),
                  )
             .select(group, F.transform("_p", lambda s: s["x"]).alias(out)))


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it is proven small; otherwise leave it to a shuffle join."""
    n = df.count()
    return F.broadcast(df) if n <= max_rows else df


# H2 / J12 ------------------------------------------------------------------------
def _with_blocks(df: DataFrame, cent: DataFrame, key: str, vec: str) -> DataFrame:
    """Every row of ``df`` once for each block of centroids, with the block as the
    array ``_all`` of (k, v).  Blocks hold about `BLOCK_ROWS` centroids each; the
    table of blocks is broadcast if its bytes are few, else joined on block and salt,
    so that rows spread over tasks."""
    n, dim = cent.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    blocks = max(1, -(-n // BLOCK_ROWS))
    packed = (cent.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).groupBy("_b")
              .agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vec).alias("v")))).alias("_all")))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = df.withColumn("_b", every)
    if n * (dim or 0) * 8 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(packed), "_b").drop("_b")
    salted = packed.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # a hash of the row, not a random number: a repeated task deals its rows alike
    rows = rows.withColumn("_s", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    return rows.join(salted, ["_b", "_s"]).drop("_b", "_s")


def centroid_distances(cent: DataFrame, key: str, vec: str = "centroid",
                       include_diagonal: bool = False) -> DataFrame:
    """Cosine distance for every ordered pair of centroids (a, b).

    The output *is* all pairs (the operator's definition); the input is a
    centroid table, one row per cluster.
    """
    pairs = F.transform("_all", lambda c: F.struct(c["k"].alias("b"), cosine_distance(vec, c["v"]).alias("dist")))
    out = _with_blocks(cent, cent, key, vec).select(F.col(key).alias("a"), F.inline(pairs))
    return out if include_diagonal else out.filter(F.col("a") != F.col("b"))


# J11 / H7 ------------------------------------------------------------------------
def soft_tags(docs: DataFrame, cent: DataFrame, doc_vec: str, key: str,
              cent_vec: str = "centroid", threshold: float = 0.25,
              out: str = "subtopics", doc: str = "doc_id") -> DataFrame:
    """Ids of every centroid with cosine similarity ≥ threshold, per document
    (in centroid-id order; an empty list when none qualifies), by the tree of
    `vellum.operators.cones`.  ``doc`` is unique."""
    from vellum.operators.cones import tags_within
    return tags_within(docs, cent, doc_vec, key, cent_vec, threshold, doc, out, "_cost").drop("_cost")


# J1 ------------------------------------------------------------------------------
def lookup_vectors(rows: DataFrame, vectors: DataFrame, key: str, vec: str,
                   order: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their vector, rows without one).  Of several vectors of a key the
    last by ``order`` counts; the second frame is the list of misses."""
    last = vectors.groupBy(key).agg(F.max_by(vec, order).alias(vec))
    return rows.join(last, key, "inner"), rows.join(vectors.select(key), key, "left_anti")
