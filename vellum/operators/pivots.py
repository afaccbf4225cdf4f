"""Exact neighbour search without all pairs: pivots, annuli, shrinking radii.

Points are parted by their nearest pivot (a bounded sample of the points), and a
part's points by their distance to it into rings of about ``cell_rows``; a ring
that is still too large (copies) is cut by hash.  Each of these cells is described by
its pivot and its least and largest distance: a row of numbers, at most `MAX_CELLS`,
which every task gets.  By the triangle inequality a point of a cell is at least as
far from a query as

* the query's distance to the pivot leaves to the ring, and
* (d(q, p)^2 - d(q, n)^2) / (2 d(p, n)), with n the query's own nearest pivot, since
  the cell's points are nearer to p than to n,

so a query visits only the cells whose bound is within its radius, in order of that
bound and in rounds: first the cells that hold enough points, then a few more, then
all that the radius found so far still leaves.  Within a cell the ring does the same
for single points.

Where a radius is known, a product in single precision with a bound of its error tells which
pairs are worth measuring; distances themselves are always taken from differences of doubles.

Cells whose pivots lie near each other form a tile of about ``TILE_CELLS`` full cells.
A query is sent once to a tile, with one bit for each of its cells: where vectors have
so many dimensions that a radius reaches most cells, a query still moves once for tens
of thousands of points and not once for each cell.  Queries of a tile (or of a cell, in
`meet`) are dealt to as many tasks as they need, each with the tile's points, so neither
a crowded cell nor a popular one fills a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.session import cut_lineage

MAX_PIVOTS = 2048
MAX_CELLS = 200_000     # cells, about: their numbers travel to every task
CELL_ROWS = 4096        # points of a cell, about
RINGS = 64              # rings of a part
TILE_CELLS = 64         # full cells whose points make a tile
MAX_TILE_CELLS = 1024   # cells of a tile: each is a bit of a row
QUERY_ROWS = 4096       # queries that meet a cell in one task
TILE_QUERIES = 32_768   # queries that meet a tile in one task, at most
TILE_BYTES = 128 << 20  # points of a tile, at most, unless it is one cell: long vectors make smaller tiles
QUERY_BYTES = 64 << 20  # queries that meet a tile in one task, at most
TILE_TASKS = 64         # tasks that a round is cut into, if they have `QUERY_ROWS` queries
BATCH_PAIRS = 1 << 18   # pairs measured at once
AT_ONCE = 1 << 21       # bounds that a task holds at once
KEY = ["g", "part", "ring", "block"]
#: Cells of the rounds after the first, in order of their bounds.
ROUNDS = ((0, 8), (8, None))
SLACK = 1e-7
MANY_CLOSE = 1 / 64     # share of a batch's pairs from which single precision is too coarse


def matrix(column, floats: bool = False) -> np.ndarray:
    """Rows of equal length as a table of doubles, or of ``floats`` if they are; read only, as
    numbers in one piece are not copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()  # which copies one, too
    if isinstance(column, pa.ChunkedArray):  # several chunks, or none
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if not floats or flat.dtype != np.float32:
        flat = flat.astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, good to `SLACK` of the vectors' length."""
    d2 = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(d2, 0.0))


def fitting(most: int, vectors: np.ndarray) -> int:
    """Rows as long as these that fit into ``most`` bytes; one at least."""
    return max(1, most // (8 * max(1, vectors.shape[1])))


def nearby(x: np.ndarray) -> np.ndarray:
    """Rows in an order that keeps near ones together: halves by two far rows, again and again."""
    out, todo = [np.zeros(0, np.int64)], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= 2:
            out.append(rows)
            continue
        y = x[rows]
        to_a = ((y - y[((y - y.mean(axis=0)) ** 2).sum(axis=1).argmax()]) ** 2).sum(axis=1)
        to_b = ((y - y[to_a.argmax()]) ** 2).sum(axis=1)
        order, half = rows[np.argsort(to_a - to_b, kind="stable")], len(rows) // 2
        todo += [order[half:], order[:half]]
    return np.concatenate(out)


@dataclass
class Cells:
    """Pivots and, for each cell, its key and numbers."""

    pivots: np.ndarray
    ids: list = field(default_factory=list)   # the pivots' ids
    group: np.ndarray = field(default=None)
    part: np.ndarray = field(default=None)
    ring: np.ndarray = field(default=None)
    block: np.ndarray = field(default=None)
    low: np.ndarray = field(default=None)
    high: np.ndarray = field(default=None)
    rows: np.ndarray = field(default=None)
    tile: np.ndarray = field(default=None)    # the cell's tile, and its place there
    nth: np.ndarray = field(default=None)
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        self._between = self._by_group = None

    def make_tiles(self, tile_rows: int) -> None:
        """Cells in order of group and of near pivots, cut into tiles of about ``tile_rows``
        or, of long vectors, `TILE_BYTES`."""
        tile_rows = min(tile_rows, fitting(TILE_BYTES, self.pivots))
        rank = np.empty(len(self.pivots), np.int64)
        rank[nearby(self.pivots)] = np.arange(len(rank))
        group = np.unique(self.group.astype(str), return_inverse=True)[1] if len(self.group) else self.part
        self.tile, self.nth = np.zeros(len(self.part), np.int32), np.zeros(len(self.part), np.int32)
        tile = held = nth = 0
        for c in np.lexsort((self.block, self.ring, rank[self.part], group)).tolist():
            if nth and (held + self.rows[c] > tile_rows or nth >= MAX_TILE_CELLS):
                tile, held, nth = tile + 1, 0, 0
            self.tile[c], self.nth[c] = tile, nth
            held, nth = held + int(self.rows[c]), nth + 1

    @property
    def slack(self) -> float:
        return SLACK * (1.0 + float(np.abs(self.pivots).max(initial=0.0)) * math.sqrt(max(1, self.pivots.shape[1])))

    def of_group(self, g) -> np.ndarray:
        if self._by_group is None:
            order = np.argsort(self.group, kind="stable")
            names, first = np.unique(self.group[order], return_index=True)
            self._by_group = dict(zip(names.tolist(), np.split(order, first[1:]), strict=False))  # no names, no groups
        return self._by_group.get(g, np.zeros(0, np.int64))

    def bounds(self, to_pivots: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """(queries, cells): no point of the cell is nearer to the query."""
        if self._between is None:
            self._between = distances(self.pivots, self.pivots)
        part = self.part[cells]
        d = to_pivots[:, part]
        near = to_pivots.argmin(axis=1)
        own = to_pivots[np.arange(len(d)), near][:, None]
        apart = self._between[near][:, part]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (d * d - own * own) / (2.0 * apart), 0.0)
        return np.maximum(np.maximum(d - self.high[cells], self.low[cells] - d), np.maximum(plane, 0.0))


def numbers(rows: DataFrame, vec: str = "vec"):
    """The vectors as doubles, or as floats if they are that: half the bytes to move."""
    kind = rows.schema[vec].dataType
    return F.col(vec) if kind.elementType == T.FloatType() else F.col(vec).cast("array<double>")


def with_columns(batch: pa.RecordBatch, extra: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], names=[*batch.schema.names, *extra])


def place(points: DataFrame, cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS,
          extra: dict | None = None, roots: int = 1) -> tuple[DataFrame, Cells]:
    """Points (id, g, vec, ...) with the key of their cell and ``dp``, their distance to
    its pivot, as a table of the shared folder; and the cells.  ``extra`` are further
    aggregates of a cell; pivots are ``roots`` times the square root of the points."""
    points = points.withColumn("vec", numbers(points))
    n, groups = points.agg(F.count(F.lit(1)), F.approx_count_distinct("g")).first()
    wanted = max(1, min(max_pivots, roots * math.isqrt(n), MAX_CELLS // (2 * max(1, groups))))
    sample = (points.select("id", "vec").orderBy(F.xxhash64("vec"), "id").limit(4 * wanted)
              .dropDuplicates(["vec"]).orderBy(F.xxhash64("vec", F.lit(1))).limit(wanted).toArrow())
    cells = Cells(matrix(sample["vec"]), sample["id"].to_pylist())
    pivots = cells.pivots
    schema = T.StructType([*points.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("dp", T.DoubleType())])

    def assign(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(b.schema.get_field_index("vec")))
                near = distances(x, pivots).argmin(axis=1)
                own = np.sqrt(((x - pivots[near]) ** 2).sum(axis=1))
                yield with_columns(b, {"part": pa.array(near, pa.int32()), "dp": pa.array(own)})

    placed = cut_lineage(points.mapInArrow(assign, schema)) if n else points.withColumns(
        {"part": F.lit(0), "dp": F.lit(0.0)})
    size = max(min(cell_rows, fitting(TILE_BYTES, pivots)), 2 * n // MAX_CELLS)
    steps = [i / RINGS for i in range(1, RINGS)]
    parts = placed.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("dp", steps, 1000).alias("cuts"))
    # of a large part every m-th cut; a ring that is still too large is cut by hash
    rings = F.least(F.ceil(F.col("n") / size), F.lit(RINGS)).cast("int")
    mine = F.transform(F.sequence(F.lit(1), F.greatest(rings - 1, F.lit(1))), lambda i: F.element_at("cuts", F.floor(i * RINGS / rings).cast("int")))
    parts = parts.select("g", "part", F.when(rings > 1, mine).otherwise(F.array().cast("array<double>")).alias("cuts"),
                         F.ceil(F.col("n") / (size * rings)).cast("int").alias("blocks"))
    placed = placed.join(F.broadcast(parts), ["g", "part"])  # at most MAX_CELLS rows
    ring = F.size(F.filter("cuts", lambda c: c < F.col("dp"))).cast("int")
    placed = cut_lineage(placed.withColumns({"ring": ring, "block": F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")})
                         .drop("cuts", "blocks"))
    extra = extra or {}
    found = placed.groupBy(*KEY).agg(F.min("dp").alias("low"), F.max("dp").alias("high"), F.count(F.lit(1)).alias("rows"),
                                     *[a.alias(c) for c, a in extra.items()]).orderBy(*KEY).toArrow()
    array = lambda c: found[c].to_numpy()
    cells.group, cells.part, cells.ring, cells.block = (array(c) for c in KEY)
    cells.low, cells.high, cells.rows = array("low"), array("high"), array("rows")
    cells.extra = {c: array(c) for c in extra}
    cells.make_tiles(TILE_CELLS * cell_rows)
    return placed, cells


def visits(queries: DataFrame, cells: Cells, need: int, first: int | None, last: int | None,
           skip: Callable | None = None) -> DataFrame:
    """Rows of ``queries`` (id, g, vec, r, ...) for each ``tile`` with a cell that they
    visit; ``cells`` has a bit for each cell of the tile.

    A round takes the cells ``first`` to ``last`` after those with ``need`` points, as
    far as their bounds are within ``r``; a first of None takes those themselves.
    ``skip(batch, rows, cells)`` tells which (query, cell) are left out.
    """
    spark = queries.sparkSession
    # at most MAX_CELLS rows of numbers, as a dict: workers have no copy of the package
    shared = spark.sparkContext.broadcast({f.name: getattr(cells, f.name) for f in fields(cells)})
    keep = queries.columns
    schema = T.StructType([*queries.schema.fields, T.StructField("tile", T.IntegerType()), T.StructField("cells", T.BinaryType())])

    def run(batches):
        c = Cells(**shared.value)
        width = np.bincount(c.tile)
        tiles_of = {}
        for b in batches:
            at = {name: b.column(i) for i, name in enumerate(keep)}
            if not b.num_rows:
                continue
            x, r = matrix(at["vec"]), at["r"].to_numpy(zero_copy_only=False)
            g = np.array(at["g"].to_pylist(), object)
            for name in dict.fromkeys(g.tolist()):
                rows, mine = np.flatnonzero(g == name), c.of_group(name)
                if name not in tiles_of:
                    tiles_of[name] = [(t, np.flatnonzero(c.tile[mine] == t)) for t in np.unique(c.tile[mine]).tolist()]
                step = max(1, AT_ONCE // max(1, max(len(mine), len(c.pivots))))
                for i in range(0, len(rows) if len(mine) else 0, step):
                    part = rows[i:i + step]
                    bound = c.bounds(distances(x[part], c.pivots), mine)
                    order = np.argsort(bound, axis=1, kind="stable")
                    upto = np.cumsum(c.rows[mine][order], axis=1)
                    # cells that hold `need` points
                    start = np.minimum((upto < need).sum(axis=1) + (need > 0), len(mine))[:, None]
                    place_ = np.arange(len(mine))[None]
                    if first is None:
                        take = place_ < start
                    else:
                        take = place_ >= start + first
                        if last is not None:
                            take &= place_ < start + last
                        take &= np.take_along_axis(bound, order, 1) <= r[part][:, None] + c.slack
                    taken = np.zeros_like(take)
                    np.put_along_axis(taken, order, take, 1)
                    if skip is not None:
                        q, nth = np.nonzero(taken)
                        if len(q):
                            taken[q, nth] = ~skip(at, part[q], mine[nth], c)
                    for tile, columns in tiles_of[name]:
                        some = np.flatnonzero(taken[:, columns].any(axis=1))
                        if len(some):
                            bits = np.zeros((len(some), width[tile]), bool)
                            bits[:, c.nth[mine[columns]]] = taken[np.ix_(some, columns)]
                            yield with_columns(b.take(pa.array(part[some])), {
                                "tile": pa.array(np.full(len(some), tile, np.int32)),
                                "cells": pa.array([v.tobytes() for v in np.packbits(bits, axis=1)], pa.binary())})

    return queries.mapInArrow(run, schema)


def meet_tiles(visiting: DataFrame, placed: DataFrame, cells: Cells, kernel: Callable, schema,
               query_rows: int | None = None) -> DataFrame:
    """``kernel(queries, points, pivots)`` on Arrow tables for each tile that is visited, for
    `near_batches`; ``visiting`` is a table of the shared folder."""
    spark = visiting.sparkSession
    shared = spark.sparkContext.broadcast(cells.pivots)
    query_rows = query_rows or min(TILE_QUERIES, fitting(QUERY_BYTES, cells.pivots), max(QUERY_ROWS, visiting.count() // TILE_TASKS))
    per = visiting.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("tasks"))
    at = pa.table({"g": pa.array(cells.group.tolist(), pa.string()), **{c: pa.array(getattr(cells, c), pa.int32()) for c in
                                                                        (*KEY[1:], "tile", "nth")}})
    # at most MAX_CELLS rows each
    at = F.broadcast(spark.createDataFrame(at).join(F.broadcast(per), "tile"))
    q = visiting.join(F.broadcast(per), "tile").withColumn("task", F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int")).drop("tasks")
    t = (placed.join(at, KEY).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
         .drop("tasks", "g", "ring", "block"))
    return (q.groupBy("tile", "task").cogroup(t.groupBy("tile", "task"))
            .applyInArrow(lambda queries, points: kernel(queries, points, shared.value), schema))


def meet(visiting: DataFrame, placed: DataFrame, kernel: Callable, schema, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``kernel(queries, points)`` on Arrow tables for each cell that is visited;
    ``visiting`` is a table of the shared folder."""
    per = visiting.groupBy(*KEY).agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("tasks"))
    per = F.broadcast(per)  # at most MAX_CELLS rows
    q = visiting.join(per, KEY).withColumn("task", F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int")).drop("tasks")
    t = placed.join(per, KEY).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    return q.groupBy(*KEY, "task").cogroup(t.groupBy(*KEY, "task")).applyInArrow(kernel, schema)


class Rough:
    """Which pairs of rows of two tables may lie within a distance of each other, by products
    in single precision (double, if the numbers do not fit into that) of the rows less the
    middle of the points; none that does is left out."""

    def __init__(self, qm: np.ndarray, tm: np.ndarray, order: np.ndarray):
        self.qm, self.tm, self.order = qm, tm, order
        self.room = np.zeros(0)  # of the products, and of what is within: fresh pages cost more than the product
        with np.errstate(all="ignore"):
            middle = tm.mean(axis=0, dtype=np.float64)
            if not np.isfinite(middle).all():
                middle = np.zeros(tm.shape[1])
            for self.kind in (np.float32, np.float64):
                self.x, self.xn = self._side(qm, None, middle)
                self.y, yn = self._side(tm, order, middle)
                self.far = math.sqrt(yn.max(initial=0.0))
                most = max(self.xn.max(initial=0.0), self.far ** 2)
                if 1e-25 < most < 1e25:
                    break
            self.y[:, -1] = -0.5 * yn
        self.x[:, -1] = 1.0

    def _side(self, rows, order, middle):
        """Rows and a column to fill, and the squares of their lengths as rounded."""
        n = len(rows) if order is None else len(order)
        out, squares = np.empty((n, len(middle) + 1), self.kind), np.empty(n)
        for i in range(0, n, 8192):
            s = slice(i, i + 8192)
            out[s, :-1] = rows[s if order is None else order[s]] - middle
            held = out[s, :-1].astype(np.float64, copy=False)
            squares[s] = np.einsum("ij,ij->i", held, held)
        return out, squares

    def pairs(self, rows: np.ndarray, low: int, high: int, limit: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows of queries, rows of points) of the pairs of ``rows`` and the points from place
        ``low`` to ``high`` whose distance may be within the ``limit`` of the query."""
        unit, xn = float(np.finfo(self.kind).eps), self.xn[rows]
        reach = np.sqrt(xn) + self.far
        with np.errstate(all="ignore"):
            # rounded rows, then the product's sums: each at most this far off
            wide = limit + slack + unit * reach
            least = 0.5 * (xn - wide * wide) - (self.x.shape[1] + 4) * unit * reach * reach
            least = np.nextafter(least.astype(self.kind), self.kind(-np.inf))
        shape = (len(rows), high - low)
        cells = shape[0] * shape[1]
        if len(self.room) < cells:
            self.room, self.within = np.empty(cells, self.kind), np.empty(cells, bool)
        product, within = self.room[:cells].reshape(shape), self.within[:cells]
        np.matmul(self.x[rows], self.y[low:high].T, out=product)
        np.greater_equal(product, least[:, None], out=within.reshape(shape))
        found = np.flatnonzero(within)
        if self.kind == np.float32 and len(found) > MANY_CLOSE * cells:
            i, j = close_pairs(self.qm[rows], self.tm[self.order[low:high]].astype(np.float64, copy=False), limit, slack)
        else:
            i, j = np.divmod(found, max(1, high - low))
        return rows[i], self.order[low + j]


def near_batches(queries: pa.Table, points: pa.Table, qm: np.ndarray, tm: np.ndarray, pivots: np.ndarray, limit: np.ndarray,
                 slack: float, pairs: int = BATCH_PAIRS):
    """(rows of queries, rows of points, close pairs): for each cell of a tile, batches of the
    queries that visit it, of like distance to the pivot, and the points whose own distance
    leaves them within the queries' ``limit``, which may shrink on the way; about ``pairs``
    at once.  ``close pairs`` are the rows of those that may be within the limit, None if no
    query has a limit yet."""
    if not queries.num_rows or not points.num_rows:
        return
    nth, part, dp = (points[c].to_numpy() for c in ("nth", "part", "dp"))
    bits = np.unpackbits(np.stack([np.frombuffer(v, np.uint8) for v in queries["cells"].to_pylist()]), axis=1)
    order = np.lexsort((dp, nth))
    qn, rough = np.einsum("ij,ij->i", qm, qm), None
    ends = np.flatnonzero(np.diff(nth[order])) + 1
    for first, last in zip([0, *ends.tolist()], [*ends.tolist(), len(order)], strict=True):
        some, pivot = np.flatnonzero(bits[:, nth[order[first]]]), pivots[part[order[first]]]
        if not len(some):
            continue
        x = qm if len(some) == len(qm) else qm[some]
        dq = np.sqrt(np.maximum(qn[some] + pivot @ pivot - 2.0 * (x @ pivot), 0.0))
        by_ring, own = np.argsort(dq, kind="stable"), dp[order[first:last]]
        at = max(64, pairs // (last - first))
        for i in range(0, len(some), at):
            rows = by_ring[i:i + at]
            batch = some[rows]
            low = first + np.searchsorted(own, (dq[rows] - limit[batch]).min() - slack)
            high = first + np.searchsorted(own, (dq[rows] + limit[batch]).max() + slack, "right")
            if low >= high:
                continue
            if np.isinf(limit[batch]).all():
                yield batch, order[low:high], None
            else:
                rough = rough or Rough(qm, tm, order)
                yield batch, order[low:high], rough.pairs(batch, low, high, limit[batch], slack)


def close_pairs(x: np.ndarray, y: np.ndarray, limit: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of pairs whose distance may be within the ``limit`` of the row of ``x``: one
    product and one comparison a pair, so what lies farther costs little."""
    d2 = x @ y.T
    d2 *= -2.0
    d2 += np.einsum("ij,ij->i", y, y)
    within = d2 <= ((limit + slack) ** 2 - np.einsum("ij,ij->i", x, x) + slack)[:, None]
    return np.divmod(np.flatnonzero(within), max(1, len(y)))
