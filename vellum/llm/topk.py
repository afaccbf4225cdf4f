"""Exact top-k search by term-at-a-time accumulation (operator 6).

Vectors become sparse rows of whole weights, floor(scale * x): a term is a
component's place.  Queries and candidates are cut into blocks, and a task takes
a query block and a candidate block, so no side is broadcast and no block grows
with the table.  It builds the block's postings, term by term, and for each term
scatters query weight times posting weights into a dense array of scores.  A
partition of the scores finds the k-th best; everything at least as good is
sorted by score and id, and the blocks' winners are merged.

Edge cases: vectors that are null or hold a null or non-finite component take no
part, nor do rows with a null id; an empty vector scores 0 with everything;
vectors of unequal length share the terms that both have; repeated rows are separate
queries and separate candidates, but no row is a candidate for a query of its own id;
ties go to the smaller id; fewer than k candidates give all; very long vectors are
more terms; extra columns, of any name, are not read; empty tables give an empty
result.  A weight must fit 31 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import cut_lineage

SCALE = 256
BLOCK = 1024     # candidates in a block
QUERIES = 512    # queries in a block
AT_ONCE = 64     # queries whose score arrays are held at once


def postings(block: pa.Table, scale: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """(ids, row keys, term -> (rows, weights)) of a block, in order of id."""
    order = np.lexsort((block["key"].to_numpy(), block["id"].to_numpy()))
    block = block.take(pa.array(order))
    vectors = block["vector"].combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks)
    sizes = np.diff(vectors.offsets.to_numpy())
    rows = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    scaled = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if scaled.size and np.abs(scaled).max() >= 1 << 31:
        raise ValueError("a weight does not fit 31 bits")
    weights = scaled.astype(np.int64)
    used = np.flatnonzero(weights)
    used = used[np.argsort(places[used], kind="stable")]
    terms, starts = np.unique(places[used], return_index=True)
    lists = {int(t): (rows[part], weights[part])
             for t, part in zip(terms, np.split(used, starts[1:]), strict=True)} if len(used) else {}
    return block["id"].to_numpy(), block["key"].to_numpy(), lists


def accumulate(queries: dict, at: int, n: int, candidates: dict, n_candidates: int) -> np.ndarray:
    """Score arrays of the queries ``at`` to ``at + n``, one term at a time."""
    scores = np.zeros((n, n_candidates), np.int64)
    for term, (q_rows, q_weights) in queries.items():
        if term not in candidates:
            continue
        lo, hi = np.searchsorted(q_rows, (at, at + n))
        rows, weights = candidates[term]
        mine = q_rows[lo:hi] - at
        if not len(mine):
            continue
        add = np.multiply.outer(q_weights[lo:hi], weights)
        if len(rows) == n_candidates and len(mine) == n:
            scores += add
        elif len(rows) == n_candidates:
            scores[mine] += add
        else:
            scores[np.ix_(mine, rows)] += add
    return scores


def best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best scores, ties by place (ids ascend), without ``own``."""
    others = np.flatnonzero(ids != own)
    s = scores[others]
    if len(s) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        others = others[s >= least]
        s = scores[others]
    return others[np.argsort(-s, kind="stable")[:k]]


def _top_of_block(queries: pa.Table, candidates: pa.Table, k: int, scale: int) -> pa.Table:
    q_ids, q_keys, q_lists = postings(queries, scale)
    c_ids, _, c_lists = postings(candidates, scale)
    found: list[tuple] = []
    for at in range(0, len(q_ids), AT_ONCE):
        n = min(AT_ONCE, len(q_ids) - at)
        scores = accumulate(q_lists, at, n, c_lists, len(c_ids))
        for j in range(n):
            top = best(c_ids, scores[j], q_ids[at + j], k)
            found += [(q_ids[at + j], q_keys[at + j], i, x)
                      for i, x in zip(c_ids[top], scores[j][top], strict=True)]
    cols = list(zip(*found, strict=True)) or [()] * 4
    return pa.table({name: pa.array([int(v) for v in c], pa.int64()) for name, c in
                     zip(("query_id", "query_key", "vec_id", "score"), cols, strict=True)})


def whole(vector: Column) -> Column:
    """True for a vector without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def top_k(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id",
          vector: str = "embedding", scale: int = SCALE, block: int = BLOCK,
          queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each query row.

    ``is_query`` is a condition on the column ``id``.
    """
    v = F.col(f"`{vector}`")
    rows = (df.filter(F.col(f"`{vec_id}`").isNotNull() & whole(v))
            .select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("vector"))
            .withColumn("key", F.monotonically_increasing_id()))
    rows = cut_lineage(rows)  # keeps the keys as they are
    asked = rows.filter(is_query)
    n_blocks = max(1, -(-rows.count() // block))
    n_queries = max(1, -(-asked.count() // queries))
    mine, other = F.xxhash64("key"), F.xxhash64("key", F.lit("query"))  # query blocks do not follow candidate blocks
    left = (asked.withColumn("q", F.pmod(other, F.lit(n_queries)).cast("int"))
            .withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    right = (rows.withColumn("c", F.pmod(mine, F.lit(n_blocks)).cast("int"))
             .withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))))

    def pair(queries_in: pa.Table, candidates_in: pa.Table) -> pa.Table:
        return _top_of_block(queries_in, candidates_in, k, scale)

    found = (left.groupBy("c", "q").cogroup(right.groupBy("c", "q"))
             .applyInArrow(pair, "query_id long, query_key long, vec_id long, score long"))
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
