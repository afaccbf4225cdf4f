"""Threshold join on cosine similarity by a tree of cones.

Centroids are unit vectors, halved again and again by two that lie far apart.  A node
is a cone: the direction of its members' mean and the widest angle of a member to it.
Angles between directions obey the triangle inequality, so a document whose angle to a
node's direction exceeds the node's angle by more than arccos(threshold) has no tag in
the whole subtree, and skips it.  Members of the leaves that are left are measured.

A centroid table whose bytes are few (counted first) is sent to every task with its
tree: documents stay where they are, and nothing is shuffled.  Beyond that size the
centroids are parted by `vellum.operators.pivots`; the tree holds the pivots, whose
angles take in all of their parts' members, and documents meet the cells that the walk
leaves, in tasks of bounded size on both sides.

Vectors that are null, zero, shorter than the longest centroid or longer, or hold null or
non-finite entries have no direction: as documents they get no tags, as centroids they tag
nothing.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators import pivots
from vellum.session import cut_lineage

SHARED_BYTES = 64 << 20  # centroids up to this are sent to every task
LEAF_ROWS = 8            # members of a leaf, at most
ROOTS = 8                # pivots beside the square root of the centroids
SLACK = 1e-6             # radians; angles are good to about 1e-8


@dataclass
class Cones:
    """Nodes of the tree: direction, widest angle, the members ``order[start:stop]``,
    and the place of the first of two children (-1: a leaf)."""

    centre: np.ndarray
    angle: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    child: np.ndarray
    order: np.ndarray


def angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def build(x: np.ndarray, reach: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Cones:
    """The tree over directions ``x``, of which each stands for all within the angle
    ``reach`` of it."""
    order = np.arange(len(x))
    spans, centre, angle, child = ([(0, len(x))] if len(x) else []), [], [], []
    for start, stop in spans:  # grows as nodes are halved
        mine = order[start:stop]
        mean = x[mine].sum(axis=0)
        length = np.linalg.norm(mean)
        mean = mean / length if length > 1e-9 else x[mine[0]]  # opposite members have no mean
        apart = angles(x[mine] @ mean)
        centre.append(mean)
        angle.append(float((apart + reach[mine]).max()))
        if stop - start <= leaf_rows:
            child.append(-1)
            continue
        a = x[mine[apart.argmax()]]
        to_a = x[mine] @ a
        b = x[mine[to_a.argmin()]]
        nearer = to_a >= x[mine] @ b
        half = int(nearer.sum())
        if half in (0, len(mine)):  # equal members
            half = len(mine) // 2
        else:
            order[start:stop] = np.concatenate([mine[nearer], mine[~nearer]])
        child.append(len(spans))
        spans += [(start, start + half), (start + half, stop)]
    ends = np.array(spans, np.int64).reshape(-1, 2)
    return Cones(np.array(centre).reshape(len(spans), x.shape[1]), np.array(angle), ends[:, 0], ends[:, 1], np.array(child, np.int64), order)


def walk(tree: Cones, x: np.ndarray, limit: float) -> tuple[list, np.ndarray]:
    """[(rows of x, members)] for the leaves that may hold members within ``limit`` of
    those rows, and the directions that each row was compared with."""
    found, cost = [], np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))] if len(tree.child) and len(x) else []
    while todo:
        node, rows = todo.pop()
        cost[rows] += 1
        rows = rows[angles(x[rows] @ tree.centre[node]) - tree.angle[node] <= limit + SLACK]
        first = tree.child[node]
        if len(rows) and first < 0:
            found.append((rows, tree.order[tree.start[node]:tree.stop[node]]))
        elif len(rows):
            todo += [(first, rows), (first + 1, rows)]
    return found, cost


def has_direction(vec: str, dim: int | None = None) -> Column:
    x = F.col(vec)
    length = F.lit(True) if dim is None else F.size(x) == dim
    return F.coalesce(x.isNotNull() & length & F.forall(x, lambda e: e.isNotNull() & (F.abs(e) < float("inf")))
                      & F.exists(x, lambda e: e != 0), F.lit(False))


def _shared(docs: DataFrame, cent: DataFrame, doc_vec: str, dim: int, threshold: float, out: str, cost: str) -> DataFrame:
    """``docs`` with their tags, beside every column that they have."""
    table = cent.orderBy("key").toArrow()  # within the bytes that the caller has counted
    x = unit(pivots.matrix(table["vec"]))
    shared = docs.sparkSession.sparkContext.broadcast(
        {"keys": table["key"].combine_chunks(), "x": x, "tree": asdict(build(x, np.zeros(len(x))))})
    limit, nth = float(angles(np.float64(threshold))), docs.columns.index(doc_vec)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(cent.schema["key"].dataType)),
                           T.StructField(cost, T.LongType())])
    usable = docs.withColumn("_ok", has_direction(doc_vec, dim))

    def tag(batches):
        keys, x, tree = shared.value["keys"], shared.value["x"], Cones(**shared.value["tree"])
        for b in batches:
            if not b.num_rows:
                continue
            held = np.flatnonzero(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False))
            v = unit(pivots.matrix(b.column(nth).take(pa.array(held))))
            leaves, work = walk(tree, v, limit)
            at, member = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for rows, mine in leaves:
                work[rows] += len(mine)
                r, c = np.nonzero(v[rows] @ x[mine].T >= threshold)
                at.append(held[rows[r]])
                member.append(mine[c])
            at, member = np.concatenate(at), np.concatenate(member)
            by = np.lexsort((member, at))  # keys are sorted, so members are in their order
            ends = np.searchsorted(at[by], np.arange(b.num_rows + 1))
            tags = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys.take(pa.array(member[by])))
            counted = np.zeros(b.num_rows, np.int64)
            counted[held] = work
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], tags, pa.array(counted)], names=schema.names)

    return usable.mapInArrow(tag, schema)


def _parted(docs: DataFrame, cent: DataFrame, doc_vec: str, doc: str, dim: int, threshold: float, out: str, cost: str,
            cell_rows: int) -> DataFrame:
    """(doc, tags, directions compared with), by the cells of `vellum.operators.pivots`."""
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, e: s + e * e))
    points = cent.withColumn("vec", F.transform("vec", lambda e: e.cast("double")))
    points = points.select(F.col("key").alias("id"), F.lit("").alias("g"), F.transform("vec", lambda e: e / length).alias("vec"))
    placed, cells = pivots.place(points, cell_rows, roots=ROOTS)  # small parts have narrow cones
    wide = np.zeros(len(cells.pivots))
    low, high = (2.0 * np.arcsin(np.clip(d / 2.0, 0.0, 1.0)) for d in (cells.low, cells.high))  # chords to angles
    np.maximum.at(wide, cells.part, high)
    pivot = unit(cells.pivots)
    by_part = np.argsort(cells.part, kind="stable")
    first = np.searchsorted(cells.part[by_part], np.arange(len(pivot) + 1))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({
        "tree": asdict(build(pivot, wide, 1)), "pivot": pivot, "low": low, "high": high, "first": first, "by_part": by_part,
        "part": cells.part, "ring": cells.ring, "block": cells.block})  # at most MAX_CELLS rows of numbers
    limit = float(angles(np.float64(threshold)))
    q = docs.filter(has_direction(doc_vec, dim)).select(F.col(doc).alias("id"), F.lit("").alias("g"),
                                                   F.col(doc_vec).cast("array<double>").alias("vec"))
    where = T.StructType([*q.schema.fields, *[T.StructField(c, T.IntegerType()) for c in pivots.KEY[1:]],
                          T.StructField("cost", T.LongType())])

    def visit(batches):
        s = shared.value
        tree = Cones(**s["tree"])
        for b in batches:
            v = unit(pivots.matrix(b.column(2)))
            leaves, work = walk(tree, v, limit)
            for rows, mine in leaves:
                for p in mine:
                    apart = angles(v[rows] @ s["pivot"][p])
                    work[rows] += 1
                    for c in s["by_part"][s["first"][p]:s["first"][p + 1]]:
                        in_reach = rows[(apart - s["high"][c] <= limit + SLACK) & (s["low"][c] - apart <= limit + SLACK)]
                        if len(in_reach):
                            n = len(in_reach)
                            yield pivots.with_columns(b.take(pa.array(in_reach)), {
                                **{k: pa.array(np.full(n, s[k][c]), pa.int32()) for k in pivots.KEY[1:]}, "cost": pa.array(np.zeros(n, np.int64))})
            # what the walk cost goes along in a row without a cell
            yield pivots.with_columns(b, {**{k: pa.nulls(b.num_rows, pa.int32()) for k in pivots.KEY[1:]}, "cost": pa.array(work)})

    visiting = cut_lineage(q.mapInArrow(visit, where))
    hit = T.StructType([T.StructField("id", q.schema["id"].dataType), T.StructField("key", cent.schema["key"].dataType),
                        T.StructField("cost", T.LongType())])

    def kernel(queries: pa.Table, members: pa.Table) -> pa.Table:
        n = queries.num_rows if members.num_rows else 0
        v, x = unit(pivots.matrix(queries["vec"])), unit(pivots.matrix(members["vec"]))
        r, c = np.nonzero(v @ x.T >= threshold) if n else (np.zeros(0, np.int64),) * 2
        found = pa.table([queries["id"].take(pa.array(r)), members["id"].take(pa.array(c)), pa.array(np.zeros(len(r), np.int64))],
                         names=hit.names)
        counted = pa.table([queries["id"].slice(0, n), pa.nulls(n, found.schema.field("key").type),
                            pa.array(np.full(n, members.num_rows, np.int64))], names=hit.names)
        return pa.concat_tables([found, counted])

    met = pivots.meet(visiting.filter("part IS NOT NULL").drop("cost"), placed, kernel, hit)
    walked = visiting.filter("part IS NULL").select("id", F.lit(None).cast(hit["key"].dataType).alias("key"), "cost")
    # collect_list skips the null keys of the rows that carry costs only
    return met.unionByName(walked).groupBy(F.col("id").alias(doc)).agg(
        F.array_sort(F.collect_list("key")).alias(out), F.sum("cost").alias(cost))


def tags_within(docs: DataFrame, cent: DataFrame, doc_vec: str, key: str, cent_vec: str, threshold: float, doc: str,
                out: str, cost: str, shared_bytes: int = SHARED_BYTES, cell_rows: int = pivots.CELL_ROWS) -> DataFrame:
    """``docs`` with ``out``, the keys of all centroids of at least ``threshold`` cosine
    similarity, in order, and ``cost``, the directions that a document was compared
    with (nodes of the tree and members of its leaves).  ``doc`` is unique."""
    cent = cent.filter(has_direction(cent_vec)).select(F.col(key).alias("key"), F.col(cent_vec).alias("vec"))
    n, dim = cent.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    dim = dim or 0
    cent = cent.filter(F.size("vec") == dim)
    if n * (dim * 8 + 64) <= shared_bytes:
        return _shared(docs, cent, doc_vec, dim, threshold, out, cost)
    found = _parted(docs, cent, doc_vec, doc, dim, threshold, out, cost, cell_rows)
    none = F.array().cast(found.schema[out].dataType)
    return docs.join(found, doc, "left").withColumns({out: F.coalesce(out, none), cost: F.coalesce(cost, F.lit(0))})
