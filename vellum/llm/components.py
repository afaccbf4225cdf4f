"""Connected components of an edge table by contraction.

Each round points every node at its smallest neighbour if that is smaller than
the node, follows the pointers to their roots by doubling, and rewrites the
edges between roots.  A node that is no local minimum disappears, so at least
half of the nodes that still have an edge go in each round.  All states are
tables in the shared checkpoint folder; the driver sees only whether rows are
left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import cut_lineage, drop_lineage_table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge; the root is the smallest
    node of its component.  Repeated edges, loops and null ends are allowed."""
    live = cut_lineage(_ordered(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    total = None
    while not live.isEmpty():
        roots = _to_roots(live.groupBy("u").agg(F.min("v").alias("p")))
        lookup = roots.select(F.col("u").alias("n"), F.col("p").alias("r"))
        if total is None:
            merged = roots.select("u", "p")
        else:
            moved = (total.join(lookup, F.col("p") == F.col("n"), "left")
                     .select("u", F.coalesce("r", "p").alias("p")))
            merged = moved.unionByName(roots.select("u", "p"))  # a root that now moves was no row of total
        new_total = cut_lineage(merged)
        step = (live.join(lookup, F.col("u") == F.col("n"), "left")
                .select(F.coalesce("r", "u").alias("u"), "v")
                .join(lookup, F.col("v") == F.col("n"), "left")
                .select("u", F.coalesce("r", "v").alias("v")))
        new_live = cut_lineage(_ordered(step))
        for old in (live, total, roots):
            drop_lineage_table(old)
        live, total = new_live, new_total
    if total is None:
        total = live.select("u", F.col("v").alias("p"))
    else:
        drop_lineage_table(live)
    # the smallest nodes are roots of others but have no row of their own
    own = total.select("p").distinct().select(F.col("p").alias("node"), F.col("p").alias("root"))
    return total.select(F.col("u").alias("node"), F.col("p").alias("root")).unionByName(own)


def _ordered(e: DataFrame) -> DataFrame:
    return (e.filter(F.col("u") != F.col("v"))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _to_roots(parent: DataFrame) -> DataFrame:
    """Pointer doubling until every pointer ends at a root."""
    parent = cut_lineage(parent)
    while True:
        up = parent.select(F.col("u").alias("n"), F.col("p").alias("q"))
        nxt = cut_lineage(parent.join(up, F.col("p") == F.col("n"), "left")
                          .select("u", F.coalesce("q", "p").alias("p"),
                                  F.col("q").isNotNull().alias("moved")))
        drop_lineage_table(parent)
        if nxt.filter("moved").isEmpty():
            return nxt
        parent = nxt
