"""URL filters by path-template trees (operator 12), DataFrame functions only.

Rules.  A rule (verdict, ``host/path``) fits the urls of its host and all subdomains
whose path starts with the rule's; the longest fitting rule decides.  Urls that it
decides are the labelled ones of what follows.

Tree.  A host's paths are cut at slashes.  A segment that is common at its depth of
the host (`LEAST` urls and one in `BRANCHES` at least) is a branch, all others
become the wildcard ``*``; what lies deeper than `DEPTH` is one wildcard ``**``.  A
url's path so becomes a template, a leaf of its host's tree, and the templates' counts
add up to those of their nodes.

Merging.  The labelled branches of a node, in order of their share of blocked urls,
are compared with the one before: where a chi-square test of the two shares stays
under `CHI2`, both are one branch, named after the first.  Branches without a label
show no likeness and stay apart.  Templates of merged branches are one template.

Verdict.  A merged template's purity is its share of blocked urls among the labelled
ones, smoothed towards the whole table's share, or `PRIOR` if that is less, with the
weight of `SMOOTH` urls and of a quarter of the template's urls without a label.  Urls without a rule are blocked where
it is at least `REJECT`, else allowed.

Scale.  Urls are joined to two tables, of a host's branches and of rejected templates.
Of both the few keys that hold over 1 / `HOT` of all rows are broadcast, and their rows
stay in place; no other key is large enough to fill a task.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits
no rule, and is allowed; empty segments are skipped; a literal ``*`` counts as a
wildcard; ties of equally long rules go to the first in code-point order; repeated rows
count each and stay; null ids are carried; an empty table gives an empty table; of the
input's columns only those in ``keep`` stay, and one with a result's name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import A_TO_Z
from vellum.session import cut_lineage

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
LEAST = 4          # urls of a branch
BRANCHES = 50      # a branch has a url in so many of its depth
DEPTH = 16         # levels of a tree
SEGMENT = 64       # longest segment that can be a branch
CHI2 = 6.635       # 1 % level, one degree of freedom
SMOOTH = 4
PRIOR = 0.5        # a template without labels is never rejected
REJECT = 0.8
HOT = 256          # keys above this part of all rows are broadcast: fewer than HOT rows
OUT = ("host", "path", "rule", "verdict", "template")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    part = lambda i: F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)([^?#]*)", i)
    return F.translate(part(1), *A_TO_Z), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, tail = rule.partition("/")
        mine = (host == name) | F.endswith(host, F.lit("." + name))
        fits.append(F.when(mine & F.startswith(path, F.lit("/" + tail)),
                           F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    found = F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))
    return found["rule"], found["verdict"]


def join_table(rows: DataFrame, table: DataFrame, keys: list[str], n: str, add: list[str], total: int) -> DataFrame:
    """``rows`` with the columns ``add`` of a table with one row a key, null where a
    key has none.  ``n`` counts a key's rows: keys that hold a large part of all are
    broadcast and their rows stay in place."""
    hot = F.broadcast(table.filter(F.col(n) * HOT > total).select(*keys, *add))
    cold = table.filter(F.col(n) * HOT <= total).select(*keys, *add)
    rest = rows.join(hot, keys, "left_anti").join(cold, keys, "left")
    return rows.join(hot, keys).select(*rows.columns, *add).unionByName(rest.select(*rows.columns, *add))


def branches(rows: DataFrame, total: int) -> DataFrame:
    """(host, n, branches): the common segments, each with its depth, of every host
    that has any; at most `BRANCHES` a depth."""
    at = rows.select("host", F.posexplode(F.slice("segments", 1, DEPTH)).alias("depth", "segment"))
    per = cut_lineage(at.groupBy("host", "depth", "segment").agg(F.count(F.lit(1)).alias("n")))
    whole = per.groupBy("host", "depth").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
    often = per.filter((F.col("n") >= LEAST) & (F.length("segment") <= SEGMENT))
    known = join_table(often, whole, ["host", "depth"], "kinds", ["all"], per.count())
    kept = (known.filter(F.col("n") * BRANCHES >= F.col("all")).groupBy("host")
            .agg(F.collect_list(F.struct("depth", "segment")).alias("branches")))
    return kept.join(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "host")


def template(segments: Column, known: Column) -> Column:
    """A path's template: branches by name, wildcards for other segments."""
    near = F.transform(F.slice(segments, 1, DEPTH), lambda s, i: F.when(
        F.array_contains(known, F.struct(i.alias("depth"), s.alias("segment"))), s).otherwise(F.lit("*")))
    return F.array_join(F.concat(near, F.when(F.size(segments) > DEPTH, F.array(F.lit("**"))).otherwise(
        F.array().cast("array<string>"))), "/")


def merged_templates(leaves: DataFrame) -> DataFrame:
    """(host, template, merged) of the templates whose branches' names change."""
    at = leaves.withColumn("way", F.split("template", "/")).select(
        "host", "template", "blocked", "allowed", "way", F.posexplode("way").alias("k", "segment"))
    at = at.withColumns({"node": F.array_join(F.slice("way", F.lit(1), F.col("k") + 1), "/"),
                         "parent": F.array_join(F.slice("way", F.lit(1), F.col("k")), "/")})
    nodes = (at.groupBy("host", "k", "parent", "node", "segment")
             .agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a")).filter("a + b > 0"))
    # a node has at most BRANCHES branches and a wildcard
    row = Window.partitionBy("host", "k", "parent").orderBy(F.col("b") / (F.col("a") + F.col("b")), "segment")
    b, a, pb, pa = (c.cast("double") for c in (F.col("b"), F.col("a"), F.lag("b").over(row), F.lag("a").over(row)))
    nodes = nodes.withColumns({"x": b * pa - a * pb, "rows": (a + b) * (pa + pb), "sides": (a + pa) * (b + pb),
                               "all": a + b + pa + pb})
    apart = (F.col("rows").isNull() | (F.col("all") * F.col("x") * F.col("x") > CHI2 * F.col("rows") * F.col("sides")))
    nodes = nodes.withColumn("one", F.sum(F.when(apart, 1).otherwise(0)).over(row))
    same = Window.partitionBy("host", "k", "parent", "one")
    names = (nodes.withColumn("name", F.min("segment").over(same)).filter("name != segment")
             .select("host", "k", "node", "name"))
    named = at.join(names, ["host", "k", "node"], "left")
    way = F.array_sort(F.collect_list(F.struct("k", F.coalesce("name", "segment").alias("s"))))
    return (named.groupBy("host", "template").agg(
        F.array_join(F.transform(way, lambda x: x["s"]), "/").alias("merged")).filter("merged != template"))


def judge_templates(rows: DataFrame) -> DataFrame:
    """(host, template, n, merged, purity) of every template."""
    side = lambda v: F.count(F.when(F.col("given") == v, 1))
    leaves = cut_lineage(rows.groupBy("host", "template").agg(
        F.count(F.lit(1)).alias("n"), side("block").alias("blocked"), side("allow").alias("allowed")))
    share = leaves.agg((F.sum("blocked") / F.sum(F.col("blocked") + F.col("allowed"))).alias("p")).first()["p"]
    leaves = (leaves.join(merged_templates(leaves), ["host", "template"], "left")
              .withColumn("merged", F.coalesce("merged", "template")))
    pool = leaves.groupBy("host", "merged").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "blocked", "allowed")])
    known = F.col("all_blocked") + F.col("all_allowed")
    weight = SMOOTH + (F.col("all_n") - known) / 4
    pool = pool.withColumn("purity", (F.col("all_blocked") + weight * F.lit(min(share or 0.0, PRIOR))) / (known + weight))
    return leaves.join(pool, ["host", "merged"]).select("host", "template", "n", "merged", "purity")


def filter_urls(df: DataFrame, url: str = "url", rules=RULES, keep: list[str] | None = None) -> DataFrame:
    """Add host, path, rule, verdict and the merged path template of each url."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in OUT]
    host, path = split_url(F.col(f"`{url}`"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), host.alias("host"), path.alias("path"))
    rule, given = rule_of(F.col("host"), F.col("path"), rules)
    rows = cut_lineage(rows.withColumns({"rule": rule, "given": given,
                                         "segments": F.filter(F.split("path", "/"), lambda s: s != "")}))
    total = rows.count()
    rows = join_table(rows, branches(rows, total), ["host"], "n", ["branches"], total)
    known = F.coalesce("branches", F.array().cast("array<struct<depth:int,segment:string>>"))
    rows = cut_lineage(rows.withColumn("template", template(F.col("segments"), known)).drop("segments", "branches"))
    judged = join_table(rows, cut_lineage(judge_templates(rows)), ["host", "template"], "n", ["merged", "purity"], total)
    verdict = F.coalesce("given", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "host", "path", "rule",
                         verdict.alias("verdict"), F.col("merged").alias("template"))
