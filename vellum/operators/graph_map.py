"""Map of a neighbour graph: few coordinates for each point.

`neighbour_graph` joins each point to its k nearest ones, weighs an edge by a Gaussian of
the distance over the point's own scale (that of its k-th neighbour), and unites both
directions as probabilities, a + b - ab.  `spectral_map` finds the leading eigenvectors
of the graph's lazy normalised adjacency (I + D^-1/2 W D^-1/2) / 2, whose values lie in
[0, 1]: near vectors' coordinates are near each other, and clusters fall apart.

The vectors are a block of columns, one row a point, and a step of power iteration is a
join of the edge table with that block and a sum for each point.  Between joins only the
block's Gram matrix (columns x columns numbers) meets at the driver: it makes the columns
orthonormal again, and at the end turns them into eigenvectors (Rayleigh-Ritz).  The
first eigenvector is known (the square roots of the degrees) and is kept out from the
start.  Edges are written once, bucketed by the point that they read, so they do not move
in a step.  A point that a large part of all edges read (the smallest id of many
copies) has its edges, and copies of its row, in as many buckets as they need.

The starting block hashes ids, so the result is the same on every run.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.knn import knn_join
from vellum.session import checkpoint_dir, cut_lineage, drop_lineage_table

EDGES_A_BUCKET = 4_000_000
CROWD = 65_536  # edges that read a point from one bucket, about


def neighbour_graph(df: DataFrame, id_col: str, vec: str, k: int) -> DataFrame:
    """(a, b, w), each edge in both directions.  Points without a vector, and a table of
    one point, have no edges.  Neighbours at distance 0 weigh 1."""
    known = df.filter(F.col(vec).isNotNull() & F.col(id_col).isNotNull()).withColumn("_l", F.lit(0))
    near = knn_join(known, known, k, qid=id_col, tid=id_col, qvec=vec, tvec=vec, label="_l", exclude_self=True)
    scale = F.element_at("neighbors", -1)["dist"]
    at = near.select(F.col(id_col).alias("a"), scale.alias("scale"), F.explode("neighbors").alias("n"))
    one = at.select("a", F.col("n")["tid"].alias("b"), F.when(F.col("n")["dist"] > 0, F.exp(
        -F.pow(F.col("n")["dist"] / F.col("scale"), 2))).otherwise(1.0).alias("p"))
    both = cut_lineage(one)
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "p"))
    # p + q - pq of the one or two directions that there are; greatest first, so both rows round alike
    p, q = F.max("p"), F.when(F.count(F.lit(1)) > 1, F.min("p")).otherwise(0.0)
    return both.groupBy("a", "b").agg((p + q - p * q).alias("w"))


def start_value(id_col: str, column: int) -> Column:
    """A number in [-0.5, 0.5) from the id's digest."""
    digits = F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{column}"))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 2.0 ** 32 - 0.5


def _gram(rows: DataFrame, left: list[Column], right: list[Column]) -> np.ndarray:
    """Products of columns, summed over all rows: one aggregate of a few numbers."""
    sums = rows.agg(*[F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(right)]).first()
    return np.array([v or 0.0 for v in sums]).reshape(len(left), len(right))


def _times(columns: list[Column], m: np.ndarray) -> Column:
    """Columns times a small matrix, as one array."""
    return F.array(*[reduce(Column.__add__, [c * float(v) for c, v in zip(columns, m[:, j], strict=True)]) for j in range(m.shape[1])])


def _orthonormal(block: DataFrame, columns: list[Column]) -> Column:
    """The block's columns without the known first eigenvector, ``root``, and orthonormal;
    columns that the others span already become zero."""
    gram = _gram(block, columns, columns)
    known = gram[0] / gram[0, 0] if gram[0, 0] else gram[0]
    rest = gram[1:, 1:] - np.outer(known[1:], gram[0, 1:])
    value, vector = np.linalg.eigh((rest + rest.T) / 2.0)
    held = value > max(value.max(initial=0.0), 0.0) * 1e-14
    turn = vector @ np.diag(np.where(held, 1.0 / np.sqrt(np.where(held, value, 1.0)), 0.0))
    return _times(columns, np.concatenate([-known[None, 1:] @ turn, turn]))


def _write_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points with ``root``, of the degree, and ``copies``, the buckets that their readers
    fill; the matrix as edges (a, b, copy, w) with the numbers of a, bucketed by what they
    read)."""
    spark = edges.sparkSession
    degree = edges.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("d"), F.count(F.lit(1)).alias("n"))
    points = cut_lineage(degree.select("id", F.sqrt("d").alias("root"), F.ceil((F.col("n") + 1) / CROWD).cast("int").alias("copies")))
    a = points.select(F.col("id").alias("a"), "root", F.col("copies").alias("copies"))
    b = points.select(F.col("id").alias("b"), F.col("root").alias("read_root"), F.col("copies").alias("read_copies"))
    own = points.select(F.col("id").alias("a"), F.col("id").alias("b"), "root", "copies",
                        F.col("copies").alias("read_copies"), F.lit(0.5).alias("w"))
    ready = (edges.join(a, "a").join(b, "b").withColumn("w", F.col("w") / (F.col("root") * F.col("read_root")) / 2.0)
             .drop("read_root").unionByName(own))
    ready = cut_lineage(ready.withColumn("copy", F.pmod(F.xxhash64("a"), F.col("read_copies")).cast("int")).drop("read_copies"))
    buckets = max(1, -(-ready.count() // EDGES_A_BUCKET))
    name = f"edges_{uuid.uuid4().hex}"
    (ready.repartition(buckets, "b", "copy").write.format("parquet").option("path", f"{checkpoint_dir(spark).rstrip('/')}/{name}")
     .bucketBy(buckets, "b", "copy").sortBy("b", "copy").saveAsTable(name))
    return points, spark.table(name)


def _step(block: DataFrame, edges: DataFrame, columns: int) -> DataFrame:
    """The matrix times the block (id, root, copies, x)."""
    read = block.select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "x")
    sums = [F.sum(F.col("w") * F.col("x")[i]).alias(f"s{i}") for i in range(columns)]
    return (edges.join(read, ["b", "copy"]).groupBy(F.col("a").alias("id"), "root", "copies").agg(*sums)
            .select("id", "root", "copies", F.array(*[f"s{i}" for i in range(columns)]).alias("x")))


def spectral_map(edges: DataFrame, dims: int, steps: int = 200, extra: int = 4, every: int = 5,
                 tolerance: float = 1e-9) -> tuple[DataFrame, list[float]]:
    """((id, coords), eigenvalues): ``dims`` unit eigenvectors by falling value, after the
    first; signs are free.  ``edges`` are rows (a, b, w) in both directions.

    The block has ``extra`` more columns, which speed up the last of those asked for; it is
    made orthonormal each ``every`` steps, and the steps end when no eigenvalue asked for
    moves by more than ``tolerance``, or before ``steps`` are exceeded.  In a graph of fewer points than
    columns the coordinates that are left are 0.
    """
    columns = dims + extra
    x, y = ([F.col(c)[i] for i in range(columns)] for c in ("x", "y"))
    points, ready = _write_edges(edges)
    raw = cut_lineage(points.withColumn("x", F.array(*[start_value("id", j) for j in range(columns)])))
    before, done = None, 0
    while True:
        block = raw.withColumn("x", _orthonormal(raw, [F.col("root"), *x]))
        image = _step(block, ready, columns).select("id", F.col("x").alias("y"))
        both = cut_lineage(block.join(image, "id"))
        drop_lineage_table(raw)
        ritz = _gram(both, x, y)
        value, turn = np.linalg.eigh((ritz + ritz.T) / 2.0)
        value, turn = value[::-1], turn[:, ::-1]
        settled = before is not None and np.abs(value[:dims] - before).max(initial=0.0) <= tolerance
        if settled or done + every > steps:
            return both.select("id", _times(x, turn[:, :dims]).alias("coords")), [float(v) for v in value[:dims]]
        before = value[:dims]
        ahead = both.select("id", "root", "copies", F.col("y").alias("x"))
        for _ in range(every - 1):
            ahead = _step(ahead, ready, columns)
        raw = cut_lineage(ahead)
        drop_lineage_table(both)
        done += every
