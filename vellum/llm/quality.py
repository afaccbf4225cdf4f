"""Quality rules with adaptive thresholds (operator 2), DataFrame functions only.

Each document gets word, symbol, line and repetition counts in its own row.
Every rule's measure is a whole number.  Its distribution is kept per language and
source as a mergeable quantile sketch: counts of log-linear buckets of six significant
bits, so a quantile is at most 1/32 below its exact value, counts add up whatever the
partitioning, and reruns agree.  A language and source with fewer than ``min_docs``
documents uses its language's merged sketch, and that of all documents if the language
is small too.  Documents join their cutoffs and fail outside any of them.

`SHARES` are counts for each thousand of their unit: symbols and repeated words of the
words, duplicate lines of the lines.  A share's cutoff R is the upper quartile moved out
by ``spread`` times the quartiles' distance, or the sketch's upper quantile that the rule
names if that is higher, as where most documents measure zero.  A document of N units
fails if its count exceeds what R allows by more than ``spread`` standard deviations
of a count, R N + spread * sqrt(R N + 1), so that one duplicate line of three is
no reason, and a thousand of three thousand are.

`RANGES` are letters for each word, with both ends, and the words on a log scale, whose
low end alone counts: a text is short for its source, none is too long.  Their cutoffs
are the quartiles moved out by ``spread`` times their distance, at least the sketch's
resolution, and in short texts, whose means vary more, by 1 + 10 / sqrt(words) of that.

The sketches hold the documents that pass the base rules.

Edge cases: a null or empty text has zero words and fails the base rules; texts of any
length are measured whole, in their row; null languages and sources are groups of their
own; repeated rows count each; extra columns stay; a column with a result's name is
replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import SPACES, words
from vellum.session import cut_lineage

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
SPREAD = 3
MIN_DOCS = 50
BROADCAST_GROUPS = 100_000  # rows of cutoffs, some 100 bytes each, that may go to every task
#: Rule: its count, its unit's count, the size of one event, its upper quantile in percent.
SHARES = {"symbols": ("n_symbols", "n_words", 1, 90),
          "dup_lines": ("n_dup_lines", "n_lines", 1, 99),
          "repeats": ("n_repeat_words", "n_words", WINDOW, 99)}
#: Rule: least distance of its quartiles, whether high values fail too.  Letters a
#: thousand words lie in buckets of 128; the log scale has 16 steps for a doubling.
RANGES = {"word_length": (128, True), "length_log": (1, False)}
PERCENTS = (25, 75, 90, 99)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(w: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the array ``w``."""

    def positions(hashes: Column) -> Column:
        tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            marked = F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
            return F.array_sort(F.array_compact(marked))

        return let(tagged, twins)

    def covered(pos: Column) -> Column:
        steps = F.transform(pos, lambda p, j: F.least(
            F.lit(window), F.coalesce(F.get(pos, j + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        return (F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long"))
                .otherwise(let(positions(hashes), covered)))

    def hashed(ws: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ws) - window),
                           lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(window)]))

    return let(w, lambda ws: F.when(F.size(ws) > window, let(hashed(ws), count))
               .otherwise(F.lit(0).cast("long")))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts, ``n_lines`` and ``base_failed``."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    d = df.withColumns({
        "__words": words(t),
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "__lines": let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("kinds"))),
    })
    d = d.withColumns({"n_words": F.size("__words").cast("long"),
                       "n_lines": F.col("__lines.all").cast("long"),
                       "n_dup_lines": (F.col("__lines.all") - F.col("__lines.kinds")).cast("long"),
                       "n_repeat_words": repeat_words(F.col("__words"))}).drop("__words", "__lines")
    n = F.col("n_words")
    return d.withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * n))


def rule_values() -> dict[str, Column]:
    """Each rule's measure, a whole number."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    digits = F.length(F.bin(n)) - 1
    out = {rule: F.floor(1000 * F.col(count) / F.greatest(F.col(unit), F.lit(1))).cast("long")
           for rule, (count, unit, _, _) in SHARES.items()}
    out["word_length"] = F.floor(1000 * F.col("word_chars") / n).cast("long")
    out["length_log"] = 16 * digits + F.call_function("shiftright", 16 * n, digits) - 16
    return out


def bucket(value: Column) -> Column:
    """Lower end of the log-linear bucket of a whole number."""
    spare = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    v = F.call_function("shiftright", value, spare)
    return F.call_function("shiftleft", v, spare)


def sketches(df: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Mergeable sketches: (lang, source, rule, bucket, docs) of the documents
    that pass the base rules."""
    entries = F.array(*[F.struct(F.lit(k).alias("rule"), bucket(v).alias("bucket"))
                        for k, v in rule_values().items()])
    return (df.filter(~F.col("base_failed"))
            .select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"),
                    F.explode(entries).alias("e"))
            .groupBy("lang", "source", "e.rule", "e.bucket").agg(F.count(F.lit(1)).alias("docs")))


def quantiles(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, rule, docs, q25, q75, ...): level 2 is language and
    source, 1 language, 0 all; upper levels merge the sketches below."""
    levels = F.array(F.struct(F.lit(2).alias("level"), F.col("lang"), F.col("source")),
                     F.struct(F.lit(1).alias("level"), F.col("lang"),
                              F.lit(None).cast("string").alias("source")),
                     F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"),
                              F.lit(None).cast("string").alias("source")))
    merged = (sketch.select(F.explode(levels).alias("g"), "rule", "bucket", "docs")
              .groupBy("g.level", "g.lang", "g.source", "rule", "bucket")
              .agg(F.sum("docs").alias("docs")))
    group = ["level", "lang", "source", "rule"]
    upto = Window.partitionBy(*group).orderBy("bucket")
    ranked = merged.withColumns({
        "upto": F.sum("docs").over(upto.rowsBetween(Window.unboundedPreceding, 0)),
        "all": F.sum("docs").over(Window.partitionBy(*group))})
    return ranked.groupBy(*group).agg(F.max("all").alias("docs"), *[
        F.min(F.when(100 * F.col("upto") >= p * F.col("all"), F.col("bucket"))).alias(f"q{p}") for p in PERCENTS])


def cutoffs(sketch: DataFrame, min_docs: int = MIN_DOCS, spread: int = SPREAD) -> DataFrame:
    """One row of cutoffs for each language and source in the sketches: the shares'
    R, and the ranges' quartiles."""
    q, aggs = quantiles(sketch), []
    for rule, (_, _, _, upper) in SHARES.items():
        cut = F.greatest(F.col("q75") + spread * (F.col("q75") - F.col("q25")), F.col(f"q{upper}"))
        aggs.append(F.max(F.when(F.col("rule") == rule, cut)).alias(rule))
    for rule in RANGES:
        aggs += [F.max(F.when(F.col("rule") == rule, F.col(f"q{p}"))).alias(f"{rule}_q{p}") for p in (25, 75)]
    wide = q.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *aggs)
    cuts = [*SHARES, *(f"{r}_q{p}" for r in RANGES for p in (25, 75))]
    pack = lambda p: F.struct("docs", *cuts).alias(p)
    own = wide.filter("level = 2").select("lang", "source", pack("own"))
    by_lang = wide.filter("level = 1").select(F.col("lang").alias("l1"), pack("by_lang"))
    whole = wide.filter("level = 0").select(F.lit(1).alias("one"), pack("whole"))
    pick = (F.when(F.col("own.docs") >= min_docs, F.col("own"))
            .when(F.col("by_lang.docs") >= min_docs, F.col("by_lang")).otherwise(F.col("whole")))
    return (own.join(by_lang, F.col("lang").eqNullSafe(F.col("l1")), "left")
            .withColumn("one", F.lit(1)).join(whole, "one", "left")
            .select("lang", "source", pick.alias("cut"))
            .select("lang", "source", *[F.col(f"cut.{c}").alias(f"cut_{c}") for c in cuts]))


def apply_rules(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                min_docs: int = MIN_DOCS, spread: int = SPREAD,
                keep: list[str] | None = None) -> DataFrame:
    """Add the base counts, ``base_failed``, ``kept`` and ``failed``, the names of the
    rules that a document fails, to the ``keep`` columns (all by default) of every
    row.  Texts are measured once; the measured rows are a table in the shared folder
    that the sketches and the join both read."""
    out = [*COUNTS, "base_failed", "kept", "failed"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in out]
    given = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row") if keep else F.lit(None).alias("__row"),
                      F.col(f"`{lang}`").alias("__lang"), F.col(f"`{source}`").alias("__source"),
                      F.col(f"`{text}`").alias("__text"))
    rows = cut_lineage(measure(given, "__text").drop("__text"))
    cuts = cut_lineage(cutoffs(sketches(rows, "__lang", "__source"), min_docs, spread))
    if cuts.count() <= BROADCAST_GROUPS:  # else the rows move to their cutoffs
        cuts = F.broadcast(cuts)
    return (judge(rows, cuts, "__lang", "__source", spread)
            .select(*[F.col(f"__row.`{c}`").alias(c) for c in keep], *out))


def judge(rows: DataFrame, cuts: DataFrame, lang: str = "lang", source: str = "source",
          spread: int = SPREAD) -> DataFrame:
    """Join measured rows to their cutoffs and add ``kept`` and ``failed``."""
    c = cuts.withColumnsRenamed({"lang": "__cut_lang", "source": "__cut_source"})
    joined = rows.join(c, F.col(f"`{lang}`").eqNullSafe(F.col("__cut_lang"))
                       & F.col(f"`{source}`").eqNullSafe(F.col("__cut_source")), "left")
    values, bad = rule_values(), []
    for rule, (count, unit, event, _) in SHARES.items():
        allowed = F.col(f"cut_{rule}") * F.col(unit)  # thousandths
        over = (1000 * F.col(count) - allowed).cast("double")
        bad.append((rule, over > spread * F.sqrt(1000.0 * event * (allowed + 1000 * event))))
    for rule, (least, both) in RANGES.items():
        low, high = F.col(f"cut_{rule}_q25"), F.col(f"cut_{rule}_q75")
        step = spread * F.greatest(high - low, F.lit(least)) * (1 + 10 / F.sqrt(F.greatest("n_words", F.lit(1)).cast("double")))
        bad.append((f"{rule}_low", low - values[rule] > step))
        if both:
            bad.append((f"{rule}_high", values[rule] - high > step))
    failed = F.concat_ws(",", *[F.when(x, F.lit(rule)) for rule, x in bad])
    joined = joined.withColumn("failed", F.when(F.col("base_failed"), "base").otherwise(failed))
    return joined.withColumn("kept", F.col("failed") == "")
