"""Cluster tree by density (V3, V4, L5): spanning tree, condensed tree, selection.

The mutual reachability of two points is the largest of their core distances and
their own distance.  Its minimum spanning tree holds every level of the density
clustering, so one tree serves all cluster sizes and selections.

`spanning_tree` runs Boruvka rounds.  The first ones need no search: a component whose
cheapest listed edge is no heavier than anything that its points' neighbour lists leave out
picks that; up to `LISTED_EDGES` edges, one task goes on until there is none.  A component's cheapest edge so far comes from
its points' neighbour lists and from the pivots of `vellum.operators.pivots`; points
that could still have a cheaper one, as their lists end nearer than that, visit the
cells within that radius, but none whose points are all of their own component.  The
largest component never searches: the others' edges reach it.  Known edges count for
both their components, so that ties cannot close a circle.

`condense` cuts the tree from its heaviest edges down; edges of one weight go at once.
A part of at least ``min_size`` points is a cluster; where several such parts appear
they are its children, and points of smaller parts leave it at that weight.  Subtrees of
over `LOCAL_EDGES` edges are split at their median weight: the components below it
become the points of the tree above and, if they are large enough, subtrees of their
own; the rest is solved subtree by subtree.

`select` takes the leaves (climbing to the ancestor that is born above ``epsilon``)
or, by ``stability``, the set of clusters that do not overlap whose points stay longest,
in units of 1 / weight.  The root, which is everything, is never a cluster.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators import pivots
from vellum.operators.density import _forest, connected_components
from vellum.operators.knn import knn_join
from vellum.session import cut_lineage, drop_lineage_table

NEIGHBOURS = 8          # least length of the neighbour lists
DIGITS = 9              # weights are compared after rounding, so float noise cannot flip ties
HELD_EDGES = 1 << 18    # edges that a search keeps before it drops all but the cheapest
LISTED_EDGES = 1 << 23  # edges of the neighbour lists that one task takes
LOCAL_EDGES = 1 << 20   # edges of a subtree that one task solves
TREE_ROWS = 1 << 20     # clusters of trees whose selection a task makes for each; more go round by round
LEAST_WEIGHT = 1e-6     # weights under it count as it where their reciprocal is taken
EDGE = ["w", "lo", "hi"]


# spanning tree -----------------------------------------------------------------------
def _listed(points: DataFrame, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """(id, vec, core, bound) and the neighbour lists' edges (lo, hi, w).  No point that
    is missing from a point's list has a lower mutual reachability than ``bound``."""
    k = max(NEIGHBOURS, min_samples - 1)
    own = points.withColumn("l", F.lit(0))
    lists = cut_lineage(knn_join(own, own, k, qid="id", tid="id", qvec="vec", tvec="vec", label="l", exclude_self=True))
    last = F.try_element_at("neighbors", F.lit(-1))["dist"]
    core = (F.lit(0.0) if min_samples <= 1 else
            F.coalesce(F.try_element_at("neighbors", F.lit(min_samples - 1))["dist"], last))
    far = F.when(F.size("neighbors") >= k, last).otherwise(float("inf"))
    known = lists.select("id", core.alias("core"), F.greatest(core, far).alias("bound"), "neighbors")
    rows = cut_lineage(points.join(known.drop("neighbors"), "id"))
    cores = known.select(F.col("id").alias("b"), F.col("core").alias("core_b"))
    pairs = (known.select(F.col("id").alias("a"), "core", F.explode("neighbors").alias("n"))
             .select("a", "core", F.col("n.tid").alias("b"), F.col("n.dist").alias("d")).join(cores, "b"))
    edges = pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"),
                         F.greatest("core", "core_b", "d").alias("w")).groupBy("lo", "hi").agg(F.min("w").alias("w"))
    return rows, cut_lineage(edges)


def _sure(bound: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(component of each point, picked edges): Boruvka rounds on edges in order of weight
    and ends, of components whose cheapest edge weighs no more than any that is missing."""
    comp, picked, live = np.arange(len(bound)), [], np.arange(len(w))
    while True:
        live = live[comp[a[live]] != comp[b[live]]]
        least, first = np.full(len(bound), np.inf), np.full(len(bound), len(w))
        np.minimum.at(least, comp, bound)
        for ends in (a, b):  # of equal places the last one stays, which is the cheapest edge
            near = np.full(len(bound), len(w))
            near[comp[ends[live[::-1]]]] = live[::-1]
            np.minimum(first, near, out=first)
        some = np.flatnonzero(first < len(w))
        taken = np.unique(first[some[w[first[some]] <= least[some]]])
        if not len(taken):
            return comp, np.concatenate(picked) if picked else taken
        picked.append(taken)
        roots, ends = np.unique(comp[np.concatenate([a[taken], b[taken]])], return_inverse=True)
        now = np.arange(len(bound))
        now[roots] = roots[_forest(len(roots), ends[:len(taken)], ends[len(taken):])]
        comp = now[comp]


def _listed_rounds(rows: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, comp), (lo, hi, w)): components and tree edges of the rounds without a search."""
    from pyspark.sql.pandas.types import to_arrow_schema
    id_type = rows.schema["id"].dataType
    out = T.StructType([*(T.StructField(c, id_type) for c in ("id", "comp", "lo", "hi")), T.StructField("w", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def solve(points, edges):
        ids, bound = points["id"].to_numpy(), points["bound"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, bound = ids[order], bound[order]
        a, b, w = np.searchsorted(ids, edges["lo"].to_numpy()), np.searchsorted(ids, edges["hi"].to_numpy()), edges["w"].to_numpy()
        order = np.lexsort((b, a, w))
        a, b, w = a[order], b[order], w[order]
        comp, taken = _sure(bound, a, b, w)
        none = lambda n, at: pa.nulls(n, arrow.types[at])
        named = lambda at: pa.array(ids[at], arrow.types[0])
        n, m = len(ids), len(taken)
        return pa.concat_tables([
            pa.Table.from_arrays([named(np.arange(n)), named(comp), none(n, 2), none(n, 3), none(n, 4)], schema=arrow),
            pa.Table.from_arrays([none(m, 0), none(m, 1), named(a[taken]), named(b[taken]), pa.array(w[taken])], schema=arrow)])

    one = F.lit(0).alias("all")
    found = cut_lineage(rows.select(one, "id", "bound").groupBy("all").cogroup(listed.select(one, *EDGE).groupBy("all"))
                        .applyInArrow(lambda points, edges: solve(points, edges), out))
    return found.filter("id IS NOT NULL").select("id", "comp"), found.filter("id IS NULL").select(*EDGE)


def whole(id_col: str, vec: str):
    """True for a row with an id and a vector of numbers."""
    v = F.col(f"`{vec}`")
    return (F.col(f"`{id_col}`").isNotNull() & v.isNotNull()
            & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(False)))


def _cheapest(found: pd.DataFrame) -> pd.DataFrame:
    """The first edge of each component, in order of weight and ends."""
    return found.sort_values(["comp", *EDGE]).drop_duplicates("comp")


def _edge_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("comp", id_type), T.StructField("w", T.DoubleType()), T.StructField("lo", id_type),
                         T.StructField("hi", id_type), T.StructField("other", id_type)])


def _edge_table(comp, w, a, b, other) -> pd.DataFrame:
    a, b = np.asarray(a), np.asarray(b)
    first = a < b
    return pd.DataFrame({"comp": comp, "w": np.asarray(w, np.float64), "lo": np.where(first, a, b),
                         "hi": np.where(first, b, a), "other": other})


def _to_pivots(mine: DataFrame, now: DataFrame, cells: pivots.Cells, schema: T.StructType) -> DataFrame:
    """For each component of ``mine``, in each task, its cheapest edge to a pivot of another."""
    at = {r["id"]: r for r in now.join(F.broadcast(now.sparkSession.createDataFrame(
        [(i,) for i in cells.ids], T.StructType([now.schema["id"]]))), "id").select("id", "core", "comp").collect()}
    ids = np.array(cells.ids, object if now.schema["id"].dataType == T.StringType() else None)
    core = np.array([at[i]["core"] for i in cells.ids])
    comp = np.array([at[i]["comp"] for i in cells.ids], ids.dtype)
    vectors = cells.pivots

    def run(batches):
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))
            x, mine, own, who = pivots.matrix(col("vec")), col("core").to_numpy(), col("comp").to_numpy(zero_copy_only=False), \
                col("id").to_numpy(zero_copy_only=False)
            for i in range(0, len(x), 1024):
                s = slice(i, i + 1024)
                w = np.maximum(np.maximum(pivots.distances(x[s], vectors), mine[s, None]), core[None])
                w[own[s, None] == comp[None]] = np.inf
                near = w.argmin(axis=1)
                ok = np.flatnonzero(np.isfinite(w[np.arange(len(near)), near]))
                q, p = ok + i, near[ok]
                exact = np.sqrt(((x[q] - vectors[p]) ** 2).sum(axis=1))
                out = _edge_table(own[q], np.maximum(np.maximum(exact, mine[q]), core[p]), who[q], ids[p], comp[p])
                yield from pa.Table.from_pandas(_cheapest(out), schema=arrow, preserve_index=False).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    return mine.select("id", "vec", "core", "comp").mapInArrow(run, schema)


def _search(asking: DataFrame, now: DataFrame, cells: pivots.Cells, schema: T.StructType) -> DataFrame:
    """Cheapest edges within ``r`` of the asking points, one for a component and tile."""
    def skip(at, rows, cell, c):
        own = at["comp"].to_numpy(zero_copy_only=False)[rows]
        r = at["r"].to_numpy()[rows]
        return (c.extra["only"][cell] == own) | (c.extra["core"][cell] > r)

    visiting = cut_lineage(pivots.visits(asking, cells, 0, 0, None, skip))
    slack = cells.slack

    def kernel(queries: pa.Table, points: pa.Table, vectors) -> pa.Table:
        best, held = [], 0
        if queries.num_rows and points.num_rows:
            column = lambda t, c: t[c].to_numpy()
            qid, qcore, qcomp, limit = (column(queries, c) for c in ("id", "core", "comp", "r"))
            tid, tcore, tcomp = (column(points, c) for c in ("id", "core", "comp"))
            qm, tm = pivots.matrix(queries["vec"]), pivots.matrix(points["vec"], floats=True)
            group, limit = np.unique(qcomp, return_inverse=True)[1], limit.copy()
            least = np.full(len(group), np.inf)  # of each component, by its number
            for _, _, (q, t) in pivots.near_batches(queries, points, qm, tm, vectors, limit, slack):
                other = np.asarray(qcomp[q] != tcomp[t], bool)
                q, t = q[other], t[other]
                for i in range(0, len(q), 65_536):
                    a, b = q[i:i + 65_536], t[i:i + 65_536]
                    w = np.maximum(np.maximum(qcore[a], tcore[b]), np.sqrt(((qm[a] - tm[b]) ** 2).sum(axis=1)))
                    ok = w <= limit[a] + slack
                    a, b, w = a[ok], b[ok], w[ok]
                    if len(a):
                        best.append(_cheapest(_edge_table(qcomp[a], w, qid[a], tid[b], tcomp[b])))
                        np.minimum.at(least, group[a], w)
                        np.minimum(limit, least[group], out=limit)
                        held += len(best[-1])
                        if held > HELD_EDGES:
                            best = [_cheapest(pd.concat(best))]
                            held = 0
        out = _cheapest(pd.concat(best)) if best else pd.DataFrame({c: [] for c in schema.names})
        return pa.Table.from_pandas(out, schema=arrow, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    return pivots.meet_tiles(visiting, now, cells, kernel, schema)


def _roots(picks: DataFrame) -> DataFrame:
    """(comp, root): follow each component's pick; of two that pick each other the
    smaller one is the root."""
    back = picks.select(F.col("comp").alias("o_comp"), F.col("other").alias("o_other"))
    up = (picks.join(back, (F.col("other") == F.col("o_comp")) & (F.col("comp") == F.col("o_other")), "left")
          .select("comp", F.when(F.col("o_comp").isNotNull() & (F.col("comp") < F.col("other")), F.col("comp"))
                  .otherwise(F.col("other")).alias("root")))
    up = cut_lineage(up)
    while True:
        above = up.select(F.col("comp").alias("n"), F.col("root").alias("r"))
        step = cut_lineage(up.join(above, F.col("root") == F.col("n"), "left").select(
            "comp", F.coalesce("r", "root").alias("root"), (F.coalesce("r", "root") != F.col("root")).alias("moved")))
        drop_lineage_table(up)
        if step.filter("moved").isEmpty():
            return step.select("comp", "root")
        up = step


def spanning_tree(points: DataFrame, id_col: str, vec: str, min_samples: int,
                  cell_rows: int = pivots.CELL_ROWS) -> DataFrame:
    """(lo, hi, w): the minimum spanning tree of mutual reachability over the points
    that have a vector, ids being unique."""
    points = points.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec}`").alias("vec")).filter(whole("id", "vec"))
    points = points.withColumn("vec", pivots.numbers(points))
    rows, listed = _listed(points, min_samples)
    placed, cells = pivots.place(rows.withColumn("g", F.lit("")), cell_rows, extra={"core": F.min("core")})
    id_type = placed.schema["id"].dataType
    schema = _edge_schema(id_type)
    names = [f.name for f in schema]
    left, tree = placed.count(), []
    if 0 < listed.count() <= LISTED_EDGES:
        comp, sure = _listed_rounds(rows, listed)
        tree.append(sure)
        left -= sure.count()
    else:
        comp = cut_lineage(placed.select("id", F.col("id").alias("comp")))
    while left > 1:
        now = cut_lineage(placed.join(comp, "id"))
        ends = [comp.select(F.col("id").alias(e), F.col("comp").alias(f"c_{e}")) for e in ("lo", "hi")]
        listed = cut_lineage(listed.select(*EDGE).join(ends[0], "lo").join(ends[1], "hi").filter("c_lo != c_hi"))
        cheap = F.min(F.struct(*EDGE, "other")).alias("e")
        by_list = (listed.select(*EDGE, F.explode(F.array(F.struct(F.col("c_lo").alias("comp"), F.col("c_hi").alias("other")),
                                                          F.struct(F.col("c_hi").alias("comp"), F.col("c_lo").alias("other")))).alias("x"))
                   .select("x.comp", *EDGE, "x.other"))
        sizes = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.agg(F.max_by("comp", F.struct("n", "comp"))).first()[0]
        for mine in (now.filter(F.col("comp") != F.lit(largest)), now):
            known = by_list.select(*names).unionByName(_to_pivots(mine, now, cells, schema).select(*names))
            known = cut_lineage(known.groupBy("comp").agg(cheap).select("comp", "e.*"))
            picking = known.filter(F.col("comp") != F.lit(largest))
            if not picking.isEmpty():
                break
            picking = known  # only the largest knows an edge
        # components of a cell's points: the component, or null if there are several
        pure = now.groupBy(*pivots.KEY).agg(F.when(F.min("comp") == F.max("comp"), F.min("comp")).alias("only")).orderBy(*pivots.KEY)
        cells.extra["only"] = np.array([r["only"] for r in pure.select("only").collect()], object)
        asking = (now.join(picking.select("comp", F.col("w").alias("r")), "comp").filter("bound < r")
                  .select("id", "g", "vec", "core", "comp", "r"))
        found = known.select(*names).unionByName(_search(asking, now, cells, schema).select(*names))
        # an edge counts for both its components, if they may pick
        both = found.unionByName(found.select(F.col("other").alias("comp"), *EDGE, F.col("comp").alias("other")))
        picks = cut_lineage(both.join(picking.select("comp"), "comp", "left_semi").groupBy("comp").agg(cheap).select("comp", "e.*"))
        added = cut_lineage(picks.select(*EDGE).distinct())
        tree.append(added)
        left -= added.count()
        roots = _roots(picks)
        new = cut_lineage(comp.join(roots, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")))
        for old in (comp, now, known, picks):
            drop_lineage_table(old)
        comp = new
    if not tree:
        return placed.sparkSession.createDataFrame([], T.StructType([schema["lo"], schema["hi"], schema["w"]]))
    return cut_lineage(functools.reduce(DataFrame.unionByName, tree).select("lo", "hi", F.round("w", DIGITS).alias("w")))


# condensed tree ----------------------------------------------------------------------
def _merges(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray):
    """Merge tree of a weighted tree's n points: (children, weight) of each inner node,
    numbered from n; edges of one weight merge at once."""
    up, top = list(range(n)), list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    inner, order, i = [], np.argsort(w, kind="stable").tolist(), 0
    u, v, w = u.tolist(), v.tolist(), w.tolist()
    while i < len(order):
        j, groups = i, {}
        while j < len(order) and w[order[j]] == w[order[i]]:
            a, b = find(u[order[j]]), find(v[order[j]])
            up[b] = a
            groups[a] = groups.pop(a, None) or [top[a]]
            groups[a] += groups.pop(b, None) or [top[b]]
            j += 1
        for root, children in groups.items():
            top[root] = n + len(inner)
            inner.append((children, w[order[i]]))
        i = j
    return inner


def _solve(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Condensed tree of one subtree: rows of clusters (``key`` and ``parent``, both null
    for what enters the subtree), of points that leave a cluster, and of large points,
    which go on in a subtree of their own."""
    ids = nodes["node"].to_numpy()
    place = pd.Series(np.arange(len(ids)), index=ids)
    inner = _merges(len(ids), place[edges["u"]].to_numpy(), place[edges["v"]].to_numpy(), edges["w"].to_numpy())
    m, size, least = int(nodes["m"].iloc[0]), nodes["size"].tolist(), nodes["least"].tolist()
    for children, _ in inner:
        size.append(sum(size[c] for c in children))
        least.append(min(least[c] for c in children))
    out = {c: [] for c in ("kind", "node", "key", "parent", "w", "size", "least")}

    def add(*values):
        for c, x in zip(out, values, strict=True):
            out[c].append(x)

    todo = [(len(size) - 1, None)]
    while todo:
        at, key = todo.pop()
        if at < len(ids):
            add("link", ids[at], key, None, None, size[at], least[at])
            continue
        children, w = inner[at - len(ids)]
        large = [c for c in children if size[c] >= m]
        for c in large:
            mine = key if len(large) == 1 else f"{least[c]}:{size[c]}"
            if len(large) > 1:
                add("cluster", None, mine, key, w, size[c], least[c])
            todo.append((c, mine))
        gone = [c for c in children if size[c] < m]
        while gone:
            c = gone.pop()
            if c < len(ids):
                add("exit", ids[c], key, None, w, size[c], least[c])
            else:
                gone += inner[c - len(ids)][0]
    return pd.DataFrame(out, dtype=object)  # ids stay whole numbers beside nulls


def _split(nodes: DataFrame, edges: DataFrame, reps: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cut the subtrees named in ``large`` (sub, cut, at_least) at a weight."""
    e = edges.join(F.broadcast(large), "sub")
    low = (F.col("w") < F.col("cut")) | F.col("at_least") & (F.col("w") <= F.col("cut"))
    below, above = cut_lineage(e.filter(low)), cut_lineage(e.filter(~low))
    comp = connected_components(below.select(F.col("sub").alias("cfg"), F.col("u").alias("node"), F.col("v").alias("root")))
    comp = comp.select(F.col("cfg").alias("sub"), "node", "comp")
    mine = nodes.join(F.broadcast(large.select("sub")), "sub").join(comp, ["sub", "node"], "left").withColumn(
        "comp", F.coalesce("comp", "node"))
    mine = cut_lineage(mine)
    per = mine.groupBy("sub", "comp").agg(F.sum("size").alias("c_size"), F.min("least").alias("c_least"), F.first("m").alias("c_m"),
                                          F.count(F.lit(1)).alias("c_nodes"), F.max("below").alias("c_below"))
    up, down = F.concat("sub", F.lit("h")), F.concat("sub", F.lit("l"), F.col("comp").cast("string"), F.lit("."))
    own = (F.col("c_size") >= F.col("c_m")) & (F.col("c_nodes") > 1)  # goes on below
    per = cut_lineage(per.withColumns({"up": up, "down": F.when(own, down)}))
    new_nodes = per.select(F.col("up").alias("sub"), F.col("comp").alias("node"), F.col("c_size").alias("size"),
                           F.col("c_least").alias("least"), F.col("c_m").alias("m"), F.coalesce("down", "c_below").alias("below"))
    homes = cut_lineage(mine.select("sub", "node", "size", "least", "m", "below", "comp")
                        .join(per.select("sub", "comp", "up", "down"), ["sub", "comp"]))
    inside = homes.filter("down IS NOT NULL").select(F.col("down").alias("sub"), "node", "size", "least", "m", "below")
    to = homes.select("sub", "node", "comp", "up", "down")
    end = lambda e: to.select("sub", F.col("node").alias(e), F.col("comp").alias(f"c_{e}"), "up", "down")
    high = (above.join(end("u").drop("down"), ["sub", "u"]).join(end("v").drop("up", "down"), ["sub", "v"])
            .select(F.col("up").alias("sub"), F.col("c_u").alias("u"), F.col("c_v").alias("v"), "w"))
    deep = (below.join(end("u").drop("up"), ["sub", "u"]).filter("down IS NOT NULL").select(F.col("down").alias("sub"), "u", "v", "w"))
    other = F.broadcast(large.select("sub"))
    moved = (reps.join(to, ["sub", "node"]).select("m", "id", F.coalesce("down", "up").alias("sub"),
                                                   F.when(F.col("down").isNull(), F.col("comp")).otherwise(F.col("node")).alias("node")))
    columns = nodes.columns
    return (cut_lineage(nodes.join(other, "sub", "left_anti").unionByName(new_nodes.select(*columns)).unionByName(inside.select(*columns))),
            cut_lineage(edges.join(other, "sub", "left_anti").unionByName(high).unionByName(deep)),
            cut_lineage(reps.join(other, "sub", "left_anti").unionByName(moved.select(*reps.columns))))


def _flat(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`_solve` of subtrees whose edges have one weight, without a task for each."""
    w = edges.groupBy("sub").agg(F.max("w").alias("w"))
    large = F.col("size") >= F.col("m")
    per = nodes.join(w, "sub").groupBy("sub").agg(F.max("w").alias("w"), F.count_if(large).alias("n_large"))
    x = nodes.join(per, "sub")
    key = F.concat(F.col("least").cast("string"), F.lit(":"), F.col("size").cast("string"))
    mine = F.when(F.col("n_large") > 1, key)
    null = F.lit(None).cast("string")
    row = lambda kind, k, w: ("sub", F.lit(kind).alias("kind"), "node", k.alias("key"), null.alias("parent"), w.alias("w"), "size", "least")
    return (x.filter(~large).select(*row("exit", null, F.col("w")))
            .unionByName(x.filter(large).select(*row("link", mine, F.lit(None).cast("double"))))
            .unionByName(x.filter(large & (F.col("n_large") > 1)).select(*row("cluster", key, F.col("w")))))


def condense(points: DataFrame, tree: DataFrame, sizes: Sequence[int], id_col: str = "id",
             local_edges: int = LOCAL_EDGES) -> tuple[DataFrame, DataFrame]:
    """The condensed trees of several least cluster sizes: clusters (m, key, parent,
    birth, size, least), the roots with a null parent and birth, and exits (m, id, key, w).
    A cluster's key is its smallest id and its size when it is born."""
    if min(sizes) < 2:
        raise ValueError("a cluster has two points at least")
    key_type = tree.schema["lo"].dataType
    every = F.explode(F.array(*[F.lit(int(m)) for m in sorted(set(sizes))])).alias("m")
    ids = points.select(F.col(f"`{id_col}`").cast(key_type).alias("id"))
    start = F.concat(F.col("m").cast("string"), F.lit("|")).alias("sub")
    reps = cut_lineage(ids.select("id", every).select("m", "id", start, F.col("id").alias("node")))
    nodes = reps.select("sub", "node", F.lit(1).cast("long").alias("size"), F.col("node").alias("least"), "m",
                        F.lit(None).cast("string").alias("below"))
    edges = cut_lineage(tree.select(F.col("lo").alias("u"), F.col("hi").alias("v"), "w", every).select(start, "u", "v", "w"))
    flats = []
    while True:
        per = edges.groupBy("sub").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("a"), F.max("w").alias("z"),
                                       F.percentile_approx("w", 0.5, 1000).alias("half")).filter(F.col("n") > local_edges)
        per = cut_lineage(per)
        if per.isEmpty():
            break
        flat = per.filter("a = z").select("sub")
        if not flat.isEmpty():
            names = F.broadcast(flat)
            flats.append(cut_lineage(_flat(nodes.join(names, "sub", "left_semi"), edges.join(names, "sub", "left_semi"))
                                     .join(nodes.select("sub", "node", "below", "m"), ["sub", "node"])))
            edges = cut_lineage(edges.join(names, "sub", "left_anti"))
        large = per.filter("a < z").select("sub", F.when(F.col("half") > F.col("a"), F.col("half")).otherwise(F.col("a")).alias("cut"),
                                           (F.col("half") <= F.col("a")).alias("at_least"))
        if not large.isEmpty():
            nodes, edges, reps = _split(nodes, edges, reps, cut_lineage(large))
    id_sql = key_type.simpleString()
    schema = (f"sub string, kind string, node {id_sql}, key string, parent string, w double, size long, least {id_sql}")

    def solve(key, n, e):
        out = _solve(n, e)
        out.insert(0, "sub", key[0])
        return out

    some = edges.select("sub").distinct()
    solved = (nodes.join(some, "sub", "left_semi").groupBy("sub").cogroup(edges.groupBy("sub")).applyInPandas(solve, schema))
    solved = solved.join(nodes.select("sub", "node", "below", "m"), ["sub", "node"], "left")
    columns = ["sub", "kind", "node", "key", "parent", "w", "size", "least", "below"]
    rows = functools.reduce(DataFrame.unionByName, [solved.select(*columns), *(f.select(*columns) for f in flats)])
    rows = cut_lineage(rows)
    # what enters a subtree is the cluster that its point had above; an h names the upper
    # part of a subtree that was split, where the same cluster enters
    rows = rows.withColumn("entry", F.regexp_replace("sub", "h+$", ""))
    alias = cut_lineage(rows.filter("kind = 'link'").select(F.col("below").alias("sub"), "key", F.col("entry").alias("above")))
    while not alias.filter("key IS NULL").isEmpty():
        up = alias.select(F.col("sub").alias("s"), F.col("key").alias("k"), F.col("above").alias("a"))
        step = cut_lineage(alias.join(up, F.col("key").isNull() & (F.col("above") == F.col("s")), "left").select(
            "sub", F.coalesce("key", "k", F.when(F.col("s").isNull(), "")).alias("key"), F.coalesce("a", "above").alias("above")))
        alias = step
    # a key of '' is the root: the subtree above has no subtree above it
    roots = ids.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).select(
        every, F.lit(None).cast("string").alias("parent"), F.lit(None).cast("double").alias("birth"), F.col("n").alias("size"), "least",
        F.concat(F.col("least").cast("string"), F.lit(":"), F.col("n").cast("string")).alias("key")).filter("size >= m")
    rows = rows.join(alias.select(F.col("sub").alias("entry"), F.col("key").alias("entering")), "entry", "left")
    m = F.substring_index("sub", "|", 1).cast("int").alias("m")
    rows = rows.select(m, "sub", "kind", "node", F.when(F.col("entering") != "", F.col("entering")).alias("entering"),
                       "key", "parent", "w", "size", "least")
    rows = rows.join(roots.select(F.col("m").alias("root_m"), F.col("key").alias("root")), F.col("m") == F.col("root_m"))
    own = lambda c: F.coalesce(c, "entering", "root")
    clusters = rows.filter("kind = 'cluster'").select("m", "key", own("parent").alias("parent"), F.col("w").alias("birth"), "size", "least")
    exits = (rows.filter("kind = 'exit'").select("sub", "node", own("key").alias("key"), "w").join(reps, ["sub", "node"])
             .select("m", "id", "key", "w"))
    return (cut_lineage(clusters.unionByName(roots.select(*clusters.columns))), cut_lineage(exits))


# selection ---------------------------------------------------------------------------
def stabilities(clusters: DataFrame, exits: DataFrame) -> DataFrame:
    """Clusters with their ``stability``: over their points, by how much 1 / weight grows
    from the cluster's birth to the point's exit or the next split."""
    rate = lambda c: 1.0 / F.greatest(F.col(c), F.lit(LEAST_WEIGHT))
    left = exits.select("m", "key", rate("w").alias("r"), F.lit(1).cast("long").alias("n"))
    split = clusters.filter("parent IS NOT NULL").select("m", F.col("parent").alias("key"), rate("birth").alias("r"), F.col("size").alias("n"))
    total = left.unionByName(split).groupBy("m", "key").agg(F.sum(F.col("r") * F.col("n")).alias("out"), F.sum("n").alias("n"))
    born = F.coalesce(rate("birth"), F.lit(0.0))
    return (clusters.join(total, ["m", "key"], "left")
            .select(*clusters.columns, F.round(F.coalesce(F.col("out") - F.col("n") * born, F.lit(0.0)), DIGITS).alias("stability")))


def _choose(t: pd.DataFrame, method: str, epsilon: float) -> pd.DataFrame:
    """Clusters of one tree with ``chosen``, the selected cluster that holds them."""
    t = t.sort_values("size", ascending=False)  # a parent is larger than its children
    key, parent = t["key"].tolist(), dict(zip(t["key"], t["parent"], strict=True))
    birth, stable = dict(zip(t["key"], t["birth"], strict=True)), dict(zip(t["key"], t["stability"], strict=True))
    children = {}
    for k in key:
        children.setdefault(parent[k], []).append(k)
    root, picked = key[0], set()
    if method == "leaf":
        for k in (k for k in key if k not in children and k != root):
            if birth[k] < epsilon:
                while parent[k] != root:
                    k = parent[k]
                    if birth[k] > epsilon:
                        break
            picked.add(k)
    else:
        value = {}
        for k in reversed(key):
            below = sum(value[c] for c in children.get(k, ()))
            value[k] = max(stable[k], below)
            if k != root and (k not in children or below <= stable[k]):
                picked.add(k)
    chosen = {}
    for k in key:  # the outermost one that is picked
        chosen[k] = chosen.get(parent[k]) or (k if k in picked else None)
    return pd.DataFrame({"key": key, "chosen": [chosen[k] for k in key]})


def _choose_in_rounds(t: DataFrame, method: str, epsilon: float) -> DataFrame:
    """`_choose` for trees of any size: one round a level."""
    if method == "leaf":
        inner = t.select("m", F.col("parent").alias("key")).filter("key IS NOT NULL").distinct()
        at = t.filter("parent IS NOT NULL").join(inner, ["m", "key"], "left_anti").select(
            "m", "key", "parent", "birth", (F.col("birth") >= epsilon).alias("done"))
        up = t.select("m", F.col("key").alias("p"), F.col("parent").alias("pp"), F.col("birth").alias("pb"))
        at = cut_lineage(at)
        while not at.filter("NOT done").isEmpty():
            x = at.join(up, (at.m == up.m) & (F.col("parent") == F.col("p")), "left").drop(up.m)
            stay = F.col("done") | F.col("pp").isNull()  # below the root
            at = cut_lineage(x.select("m", F.when(stay, F.col("key")).otherwise(F.col("p")).alias("key"),
                                      F.when(stay, F.col("parent")).otherwise(F.col("pp")).alias("parent"),
                                      F.when(stay, F.col("birth")).otherwise(F.col("pb")).alias("birth"),
                                      (stay | (F.col("pb") > epsilon)).alias("done")).distinct())
        picked = at.select("m", "key")
    else:
        n = t.filter("parent IS NOT NULL").groupBy("m", "parent").agg(F.count(F.lit(1)).alias("n"))
        open_ = cut_lineage(t.join(n.withColumnRenamed("parent", "key"), ["m", "key"], "left").select(
            "m", "key", "parent", "stability", F.coalesce("n", F.lit(0)).alias("n")))
        done = None
        while not open_.isEmpty():
            below = None if done is None else done.groupBy("m", F.col("parent").alias("key")).agg(
                F.sum("value").alias("below"), F.count(F.lit(1)).alias("have"))
            x = (open_.withColumns({"below": F.lit(0.0), "have": F.lit(0)}) if below is None else
                 open_.join(below, ["m", "key"], "left").fillna(0, ["below", "have"]))
            ready = cut_lineage(x.filter("have = n").select("m", "key", "parent", F.greatest("stability", "below").alias("value"),
                                                            ((F.col("n") == 0) | (F.col("below") <= F.col("stability"))).alias("pick")))
            open_ = cut_lineage(open_.join(ready, ["m", "key"], "left_anti"))
            done = ready if done is None else cut_lineage(done.unionByName(ready))
        picked = done.filter("pick AND parent IS NOT NULL").select("m", "key")
    # the outermost picked ancestor of each cluster
    at = cut_lineage(t.join(picked.withColumn("p", F.lit(True)), ["m", "key"], "left").select(
        "m", "key", F.col("parent").alias("up"), F.when(F.col("p"), F.col("key")).alias("chosen")))
    while True:
        a = at.select(F.col("m").alias("am"), F.col("key").alias("ak"), F.col("up").alias("au"), F.col("chosen").alias("ac"))
        step = cut_lineage(at.join(a, (F.col("m") == F.col("am")) & (F.col("up") == F.col("ak")), "left").select(
            "m", "key", F.col("au").alias("up"), F.coalesce("ac", "chosen").alias("chosen")))
        if step.filter("up IS NOT NULL").isEmpty():
            return step.select("m", "key", "chosen")
        at = step


def select(clusters: DataFrame, exits: DataFrame, method: str = "eom", epsilon: float = 0.0,
           tree_rows: int = TREE_ROWS) -> DataFrame:
    """(m, id, cluster): each point's cluster, named by its smallest id, or -1 for
    noise.  ``method`` is ``leaf`` or ``eom`` (stability)."""
    if method not in ("leaf", "eom"):
        raise ValueError("method must be leaf or eom")
    t = cut_lineage(stabilities(clusters, exits))
    if t.count() <= tree_rows:
        schema = T.StructType([t.schema["m"], T.StructField("key", T.StringType()), T.StructField("chosen", T.StringType())])
        chosen = cut_lineage(t.groupBy("m").applyInPandas(
            lambda part: _choose(part, method, epsilon).assign(m=part["m"].iloc[0])[schema.names], schema))
    else:
        chosen = _choose_in_rounds(t, method, epsilon)
    named = chosen.join(t.select("m", F.col("key").alias("chosen"), "least"), ["m", "chosen"]).select("m", "key", "least")
    return exits.join(named, ["m", "key"], "left").select("m", "id", F.coalesce("least", F.lit(-1)).alias("cluster"))


def cluster_tree(points: DataFrame, id_col: str, vec: str, min_sizes: Sequence[int], min_samples: int, method: str = "eom",
                 epsilon: float = 0.0, cell_rows: int = pivots.CELL_ROWS) -> DataFrame:
    """(m, id, cluster) for every point and least cluster size ``m``, read from one
    spanning tree.  Points without a vector, and all points of a table that is smaller
    than a cluster, are noise."""
    held = points.filter(whole(id_col, vec))
    tree = spanning_tree(held, id_col, vec, min_samples, cell_rows)
    found = select(*condense(held, tree, min_sizes, id_col), method, epsilon)
    every = points.select(F.col(f"`{id_col}`").alias(id_col), F.explode(F.array(*[F.lit(int(m)) for m in sorted(set(min_sizes))])).alias("m"))
    return (every.join(found.withColumnRenamed("id", id_col), ["m", id_col], "left")
            .select("m", id_col, F.coalesce("cluster", F.lit(-1)).alias("cluster")))
