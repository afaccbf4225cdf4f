"""Table profiling (A3–A16, Q1–Q10) as single-pass aggregations.

Design notes for scale:
* every profile is one ``agg`` (partial aggregation map-side, one small
  shuffle), never a driver loop over columns;
* totals for shares come from scalar subqueries (``df.scalar()``), which
  run as a separate tiny job and are inlined as a literal — no cross join
  and no single-partition window over the data;
* exact quantiles count equal values, then rank only the parts of the value
  range that hold a wanted rank, part by part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import parse_list_literal, tolerant_timestamp, ustrip
from vellum.session import cut_lineage


def _hashable(df: DataFrame) -> list[str]:
    bad = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, bad)]


def _stack(pairs: Sequence[tuple[str, Sequence[Column]]], names: Sequence[str]) -> Column:
    """Unpivot rows given as (label, values) into columns ``names``."""
    args = []
    for label, vals in pairs:
        args.append(F.lit(label))
        args.extend(vals)
    return F.inline(F.array(*[F.struct(*[a.alias(n) for a, n in zip(args[i:i + len(names)], names)])
                              for i in range(0, len(args), len(names))]))


# A16 -----------------------------------------------------------------------------
def column_types(df: DataFrame) -> DataFrame:
    """Column list with Spark type names (schema metadata only, no scan)."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def type_tally(df: DataFrame) -> DataFrame:
    return column_types(df).groupBy("type").agg(F.count(F.lit(1)).alias("n_columns"))


# A3 / Q1 -------------------------------------------------------------------------
def null_profile(df: DataFrame, exact_distinct: bool = True, only_with_nulls: bool = False) -> DataFrame:
    """Per column: rows, nulls, % null, distinct non-null values.

    Distinct values are counted through (column, 128-bit hash) groups, so values
    are summed up before the shuffle and rows are not repeated per column set;
    ``exact_distinct=False`` uses sketches.
    """
    cols = df.columns
    hashable = set(_hashable(df))
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"__z{i}"))
        approx = not exact_distinct and c in hashable
        aggs.append((F.approx_count_distinct(F.col(c)) if approx else F.lit(None).cast("long")).alias(f"__d{i}"))
    wide = df.agg(*aggs)
    long = wide.select(F.col("__n").alias("n_rows"), _stack(
        [(c, [F.col(f"__z{i}"), F.col(f"__d{i}")]) for i, c in enumerate(cols)],
        ["column", "n_null", "n_distinct"]))
    if exact_distinct and hashable:
        values = df.select(_stack([(c, [F.md5(F.col(c).cast("string"))]) for c in cols if c in hashable],
                                  ["column", "value"])).filter(F.col("value").isNotNull()).distinct()
        counts = values.groupBy("column").agg(F.count(F.lit(1)).alias("__c"))
        known = F.when(F.col("column").isin(sorted(hashable)), F.coalesce("__c", F.lit(0)))
        long = long.join(counts, "column", "left").withColumn("n_distinct", known.cast("long"))
    out = long.withColumn("pct_null", F.round(F.col("n_null") * 100.0 / F.col("n_rows"), 2))
    if only_with_nulls:
        out = out.filter(F.col("n_null") > 0)
    return out.select("column", "n_rows", "n_null", "pct_null", "n_distinct")


# A4 ------------------------------------------------------------------------------
def value_counts(df: DataFrame, col: str, n: int | None = 20, ascending: bool = False,
                 dropna: bool = True, weight: str | None = None) -> DataFrame:
    """Counts per value (sums of ``weight`` if given); top-n (or bottom-n) with ties
    broken by value."""
    src = df.filter(F.col(col).isNotNull()) if dropna else df
    each = F.sum(weight) if weight else F.count(F.lit(1))
    vc = src.groupBy(F.col(col).alias("value")).agg(each.alias("count"))
    order = [F.col("count").asc() if ascending else F.col("count").desc(), F.col("value").asc_nulls_first()]
    vc = vc.orderBy(*order)
    return vc.limit(n) if n else vc


def value_shares(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """Counts and % of all rows per value (Q9); the total is a scalar subquery."""
    total = df.select(F.count(F.lit(1))).scalar()
    src = df.filter(F.col(col).isNotNull()) if dropna else df
    return (src.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
               .withColumn("pct_of_rows", F.round(F.col("count") * 100.0 / total, 2)))


# A5 ------------------------------------------------------------------------------
def null_share_by_group(df: DataFrame, col: str, by: str) -> DataFrame:
    """Nulls of ``col`` per ``by``: share of all nulls and share of the group."""
    all_nulls = df.select(F.count_if(F.col(col).isNull())).scalar()
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"),
                           F.count_if(F.col(col).isNull()).alias("n_null"))
    return (g.withColumn("pct_of_nulls", F.round(F.col("n_null") * 100.0 / all_nulls, 2))
             .withColumn("pct_of_group", F.round(F.col("n_null") * 100.0 / F.col("n_rows"), 2)))


# A6 ------------------------------------------------------------------------------
def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row over all hashable columns."""
    # a 256-bit hash of the row stands for it in the shuffle, whatever the row's size
    key = F.sha2(F.to_json(F.struct(*_hashable(df)), {"ignoreNullFields": "false"}), 256)
    g = df.groupBy(key.alias("row")).agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("n_duplicates"),
                 F.count(F.lit(1)).alias("n_distinct_rows"))


# A7 ------------------------------------------------------------------------------
def exact_quantiles(df: DataFrame, key: str, value: str, probs: Sequence[float]) -> DataFrame:
    """(key, q): interpolated quantiles of the non-null values of each key.

    Equal values are counted first.  Counts are added up in parts of the value
    range (64 to each power of two), which tells the parts that hold a wanted
    rank; only the values of those parts are ranked, part by part.  No task sees
    all values of a key.
    """
    v = F.col(value).cast("double")
    c = (df.filter(v.isNotNull()).groupBy(F.col(key).alias("k"), v.alias("v"))
         .agg(F.count(F.lit(1)).alias("n")))
    c = c.withColumn("part", F.signum("v") * F.floor(F.log2(1 + F.abs("v")) * 64))
    order = Window.partitionBy("k").orderBy("part")
    parts = c.groupBy("k", "part").agg(F.sum("n").alias("n")).withColumns({
        "base": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "all": F.sum("n").over(Window.partitionBy("k"))})
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("all") - 1)).alias("pos"))
                      for i, p in enumerate(probs)])
    wanted = parts.withColumn("w", F.explode(ranks)).select(
        F.col("k").alias("wk"), F.col("part").alias("wpart"), "base", F.col("n").alias("held"), "w.i", "w.pos")
    wanted = wanted.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))))
    wanted = wanted.filter((F.col("rank") >= F.col("base")) & (F.col("rank") < F.col("base") + F.col("held")))
    held = c.join(wanted.select("wk", "wpart", "base").distinct(),
                  F.col("k").eqNullSafe(F.col("wk")) & (F.col("part") == F.col("wpart")))
    inside = Window.partitionBy("k", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = held.select("k", "part", "v", "n", "base").withColumn("upto", F.col("base") + F.sum("n").over(inside))
    found = upto.select("k", "part", "v", "n", "upto").join(
        wanted.drop("base", "held"), F.col("k").eqNullSafe(F.col("wk")) & (F.col("part") == F.col("wpart"))
        & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    low = F.max(F.when(F.col("rank") == F.floor("pos"), F.col("v")))
    high = F.max(F.when(F.col("rank") == F.ceil("pos"), F.col("v")))
    share = F.first(F.col("pos") - F.floor("pos"))
    each = found.groupBy("k", "i").agg((low + (high - low) * share).alias("x"))
    return each.groupBy(F.col("k").alias(key)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("q"))


def describe_by(df: DataFrame, value: str, by: str, digits: int = 6) -> DataFrame:
    """count, mean, std (n−1) and five-number summary of a value for each key."""
    v = F.col(value).cast("double")
    g = df.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                           F.min(v).alias("min"), F.max(v).alias("max"))
    q = exact_quantiles(df, by, value, (0.25, 0.5, 0.75)).withColumnRenamed(by, "__by")
    j = g.join(q, F.col(by).eqNullSafe(F.col("__by")), "left")
    r = lambda c, n: F.round(c, digits).alias(n)
    return j.select(by, "n", r("mean", "mean"), r("std", "std"), r("min", "min"), r(F.col("q")[0], "p25"),
                    r(F.col("q")[1], "median"), r(F.col("q")[2], "p75"), r("max", "max"))


def describe(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """count, mean, std (n−1), min, quartiles, max per column, long form."""
    long = df.select(_stack([(c, [F.col(c).cast("double")]) for c in cols], ["column", "value"]))
    d = describe_by(long, "value", "column", digits)
    return d.select("column", F.round(F.col("n").cast("double"), digits).alias("count"), "mean", "std", "min",
                    "p25", F.col("median").alias("p50"), "p75", "max")


# A8 ------------------------------------------------------------------------------
def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins between min and max; the maximum falls in the last bin."""
    v = F.col(col).cast("double")
    bounds = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    lo = bounds.select("lo").scalar()
    hi = bounds.select("hi").scalar()
    width = (hi - lo) / bins
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((v - lo) / (hi - lo) * bins).cast("int")))
    return (df.filter(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
              .withColumn("bin_lo", lo + F.col("bin") * width)
              .withColumn("bin_hi", lo + (F.col("bin") + 1) * width))


# A9 ------------------------------------------------------------------------------
def top_categories(df: DataFrame, by: str, n: int) -> DataFrame:
    return value_counts(df, by, n).select(F.col("value").alias(by))


def box_stats(df: DataFrame, value: str, by: str, top_n: int = 15, digits: int = 12) -> DataFrame:
    """Five-number summary per category for the ``top_n`` most frequent ones.

    The top-n key list is tiny (n rows) and joined with a broadcast semi join.
    """
    keys = F.broadcast(top_categories(df, by, top_n))
    d = describe_by(df.join(keys, by, "left_semi"), value, by, digits)
    return d.select(by, "n", "min", "p25", "median", "p75", "max")


# A10 -----------------------------------------------------------------------------
def pearson_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All pairs (a < b) of Pearson correlation in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}")
                    for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)])))


# A11 / T12 / Q8 -----------------------------------------------------------------
def year_histogram(df: DataFrame, col: str) -> DataFrame:
    ts = tolerant_timestamp(col) if not isinstance(df.schema[col].dataType,
                                                   (T.TimestampType, T.DateType)) else F.col(col)
    return (df.select(F.year(ts).alias("year")).groupBy("year")
              .agg(F.count(F.lit(1)).alias("count")))


def timestamp_range(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: min, max and NULL count after tolerant parsing."""
    aggs = []
    for i, c in enumerate(cols):
        ts = (F.col(c) if isinstance(df.schema[c].dataType, (T.TimestampType, T.DateType))
              else tolerant_timestamp(c))
        aggs += [F.min(ts).alias(f"lo{i}"), F.max(ts).alias(f"hi{i}"),
                 F.count_if(ts.isNull()).alias(f"z{i}")]
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"lo{i}").alias("min_ts"),
                 F.col(f"hi{i}").alias("max_ts"), F.col(f"z{i}").alias("n_null"))
        for i, c in enumerate(cols)])))


# A12 -----------------------------------------------------------------------------
def coverage(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(F.col(col).isNotNull()).alias("n_present"),
                  F.round(F.count_if(F.col(col).isNotNull()) * 100.0 / F.count(F.lit(1)), 2)
                  .alias("pct_present"))


# A13 -----------------------------------------------------------------------------
def list_item_counts(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    """Explode a list column and count its items (top-n), stripped, blanks dropped.
    Items are counted as they stand; only different ones are stripped and added up.
    (The outer form leaves out the planner's filter, which would make each list twice
    more; the null items of empty lists go with the blanks.)"""
    raw = (df.select(F.explode_outer(F.col(col)).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("c"))
           .select(ustrip(F.col("item").cast("string")).alias("item"), "c").filter(F.col("item") != ""))
    return value_counts(raw, "item", n, weight="c")


def list_profile(df: DataFrame, cols: Sequence[str], n: int = 20) -> DataFrame:
    """(column, is_list, value, count): for each column whether it holds lists
    (arrays or list literals) and its most frequent items."""
    out = None
    for c in cols:
        is_list = looks_like_list(df, c)
        kind = df.schema[c].dataType
        items = (df.select(F.col(c).alias("l")) if isinstance(kind, T.ArrayType)
                 else df.select((parse_list_literal(c) if is_list else F.array(F.col(c).cast("string"))).alias("l")))
        part = list_item_counts(items, "l", n).select(F.lit(c).alias("column"), F.lit(is_list).alias("is_list"),
                                                      "value", "count")
        out = part if out is None else out.unionByName(part)
    return out


# Q1, Q2, Q5, Q10: whole reports in long form --------------------------------------
def _facts(df: DataFrame, section: str, name, value) -> DataFrame:
    return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("long").alias("value"))


def overview(df: DataFrame) -> DataFrame:
    """(section, name, value): rows, duplicate rows, columns by type, nulls and
    distinct values by column."""
    dup = duplicate_rows(df)
    types = type_tally(df)
    nulls = null_profile(df)
    return (_facts(dup, "rows", F.lit("duplicates"), F.col("n_duplicates"))
            .unionByName(_facts(dup, "rows", F.lit("distinct"), F.col("n_distinct_rows")))
            .unionByName(_facts(types, "type", F.col("type"), F.col("n_columns")))
            .unionByName(_facts(nulls, "nulls", F.col("column"), F.col("n_null")))
            .unionByName(_facts(nulls, "distinct", F.col("column"), F.col("n_distinct"))))


def metadata_profile(df: DataFrame, categories: Sequence[str], error: str = "error", top: int = 10) -> DataFrame:
    """(section, name, value): coverage of every column, error counts with the most
    frequent errors, and each category's number of values and top values.  Every section
    reads a table of the shared folder with these columns alone, so rows are made once."""
    kept = dict.fromkeys([*categories, error])
    spot = [f"__p{i}" for i in range(len(df.columns))]
    facts = cut_lineage(df.select(*[F.col(c).isNotNull().alias(p) for c, p in zip(df.columns, spot, strict=True)], *kept))
    present = facts.agg(F.count(F.lit(1)).alias("__all"), *[F.count_if(p).alias(c) for c, p in zip(df.columns, spot, strict=True)])
    cover = present.select(_stack([("rows", [F.col("__all")])] + [(c, [F.col(c)]) for c in df.columns],
                                  ["name", "value"]))
    out = _facts(cover, "present", F.col("name"), F.col("value"))
    errors = facts.filter(F.col(error).isNotNull()).select(F.substring_index(error, ":", 1).alias("kind"))
    out = out.unionByName(_facts(value_counts(errors, "kind", top), "error", F.col("value"), F.col("count")))
    for c in categories:
        n = facts.agg(F.count_distinct(c).alias("n"))
        out = out.unionByName(_facts(n, "distinct", F.lit(c), F.col("n")))
        out = out.unionByName(_facts(value_counts(facts, c, top), f"top {c}", F.col("value"), F.col("count")))
    return out



def looks_like_list(df: DataFrame, col: str, share: float = 0.5) -> bool:
    """Auto-detect list-literal strings: > ``share`` of all non-null values."""
    if isinstance(df.schema[col].dataType, T.ArrayType):
        return True
    s = (df.filter(F.col(col).isNotNull())
           .agg(F.avg(F.ltrim(F.col(col)).startswith("[").cast("double"))).scalar())
    return bool(df.sparkSession.range(1).select(s > share).first()[0])


# A14 / A15 -----------------------------------------------------------------------
def group_positions(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    return (df.filter(F.col(group) != -1).groupBy(group)
              .agg(F.avg(x).alias("x"), F.avg(y).alias("y")))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
