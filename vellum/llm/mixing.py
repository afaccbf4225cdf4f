"""Mixing sources to target weights (operator 5), DataFrame functions only.

Targets.  A document's size is its number of words.  Sources in code-point order
(null last) weigh 5, 2, 1, repeating, and share 150 % of all words; no target is
above twice its source, and what that leaves goes to the others by weight.  In
order of twice the size over weight the capped sources come first, so one
running sum finds them all.

Schedule.  Each source's documents, in hash order, form a stream of words that is
cut into blocks of equal length; a target asks for the first blocks of the
stream, and of its second pass where the target exceeds the source.  Slot i of
the mix takes the point i * golden ratio modulo 1, mapped through the sources'
cumulative shares; a source's slots, ranked, take its blocks in order.  Points of
this sequence fall evenly, so every stretch of the mix holds the sources near
their shares.  The slots beyond a source's blocks stay empty; the few blocks that
the finite sequence leaves without a slot come last.  A target's last block is
cut, so each source gives its rounded target exactly.

Documents are ordered by a hash of their id and text, so rows that share an id, or
have none, are spread like others.

Edge cases: null and empty texts have size 0 and are not taken; very long texts lie
in several blocks; a null source is a source, the last one; documents of equal hash go
by id and size; rows with equal ids are separate documents, and of repeated rows it does
not matter which is taken; extra columns, of any name, are not read by `mix` and carried
by `mixed_documents`; an empty table, or one without a word, takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import SPACES, running_start, words
from vellum.session import cut_lineage

WEIGHTS = (5, 2, 1)
SLOTS = 1 << 16     # slots of a mix, about; blocks are as long as that asks for
GOLDEN = 2654435769  # 2^32 over the golden ratio
PART_BITS = 10


def hash32(key: Column) -> Column:
    """First 32 bits of the md5 of a value's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8),
                  16, 10).cast("long")


def sized(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          keep: list[str] | None = None) -> DataFrame:
    """(doc_id, source, size, u, and the ``keep`` columns) of every row; ``u`` is the
    hash that orders a source's documents."""
    t, i = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{doc_id}`")
    size = F.greatest(F.size(words(t)), F.lit(0))
    mark = F.concat(F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), F.md5(t))
    return df.select(i.alias("doc_id"), F.col(f"`{source}`").alias("source"), size.cast("long").alias("size"),
                     hash32(mark).alias("u"), *(keep or []))


def targets(rows: DataFrame) -> DataFrame:
    """(source, sid, source_size, target): one row per source."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # a row per source: ordering them in one task is small next to the documents
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(by_name).cast("long"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                          (F.pmod(F.col("sid") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    per = per.withColumns({"w": weight.cast("double"), "cap": 2.0 * F.col("source_size")})
    before = (Window.orderBy(F.col("cap") / F.col("w"), "sid")
              .rowsBetween(Window.unboundedPreceding, -1))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        "total": 1.5 * F.sum("source_size").over(everything),
        "w_all": F.sum("w").over(everything)})
    full = ((F.col("total") - F.col("cap_before")) * F.col("w")
            >= F.col("cap") * (F.col("w_all") - F.col("w_before")))
    per = per.withColumn("full", full)
    per = per.withColumns({
        "cap_full": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything),
        "w_open": F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything)})
    share = (F.col("total") - F.col("cap_full")) * F.col("w") / F.col("w_open")
    return per.select("source", "sid", "source_size",
                      F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", share))
                      .alias("target"))


def schedule(plan: DataFrame, block: int) -> DataFrame:
    """(sid, pass, block_no, words, slot) of every block that the mix takes.

    ``plan`` is the table of `targets`.  Numbers of slots and blocks are about
    `SLOTS` plus two per source.
    """
    size, take = F.col("source_size"), F.floor(F.col("target") + 0.5).cast("long")
    div = lambda a, b: F.floor(a / b).cast("long")
    up = lambda a: div(a + (block - 1), F.lit(block))
    p = plan.filter(size > 0).withColumn("take", F.least(take, 2 * size))
    p = p.withColumns({"blocks": up(size), "passes": div(F.col("take"), size)})
    p = p.withColumn("need", F.col("passes") * F.col("blocks")
                     + up(F.col("take") - F.col("passes") * size)).filter("need > 0")
    order = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    p = cut_lineage(p.withColumn("base", F.coalesce(F.sum("need").over(order), F.lit(0)))
                    .select("sid", "source_size", "take", "blocks", "need", "base"))
    n = p.agg(F.sum("need")).first()[0] or 0
    if n >= 1 << 31:
        raise ValueError("too many blocks for 32-bit points")
    spark = plan.sparkSession
    asked = p.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("need") - 1)))
    asked = asked.withColumn("place", F.col("base") + F.col("rank"))
    n_slots = n + n // 16 + 64
    points = spark.range(n_slots).withColumn(
        "x", F.shiftright(F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1 << 32)) * F.lit(n), 32))
    visits = points.join(asked.select("place", "sid"), F.col("x") == F.col("place")).select("id", "sid")
    ranked = running_start(visits, ["sid"], [F.col("id")], F.lit(1).cast("long"), "visit",
                           F.floor(F.col("id") * 256 / n_slots).cast("int"))
    got = ranked.select(F.col("sid").alias("s"), "visit", "id")
    r = asked.join(got, (F.col("sid") == F.col("s")) & (F.col("rank") == F.col("visit")), "left")
    turn = div(F.col("rank"), F.col("blocks"))
    no = F.col("rank") - turn * F.col("blocks")
    left = F.col("take") - turn * F.col("source_size") - no * block
    return r.select("sid", turn.alias("pass"), no.alias("block_no"),
                    F.least(F.lit(block).cast("long"), F.col("source_size") - no * block, left)
                    .alias("words"), F.coalesce("id", F.lit(n_slots) + F.col("place")).alias("slot"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        slots: int = SLOTS, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot) of every row, and the
    ``keep`` columns, whose names differ from these.

    ``taken`` counts the words that the mix takes, repeats included;
    ``first_slot`` is the earliest slot that takes one (null: none does).
    """
    keep = keep or []
    rows = cut_lineage(sized(df, doc_id, text, source, keep))
    plan = cut_lineage(targets(rows))
    total = plan.agg(F.sum("target")).first()[0] or 0.0
    block = max(1, -(-int(total) // slots))
    named = rows.join(F.broadcast(plan) if _small(plan) else plan,
                      rows["source"].eqNullSafe(plan["source"])).drop(rows["source"], plan["source"])
    placed = running_start(
        named.filter("size > 0"), ["sid"], [F.col("u"), F.col("doc_id"), F.col("size")],
        F.col("size"), "start", F.shiftright("u", 32 - PART_BITS).cast("int"))
    first, last = (F.floor(x / block).cast("long") for x in
                   (F.col("start"), F.col("start") + F.col("size") - 1))
    pieces = placed.withColumn("no", F.explode(F.sequence(first, last)))
    b = schedule(plan, block).withColumnRenamed("sid", "b_sid")
    begin, end = F.col("no") * block, F.col("no") * block + F.col("words")
    overlap = F.greatest(F.lit(0).cast("long"), F.least(end, F.col("start") + F.col("size"))
                         - F.greatest(begin, F.col("start")))
    taken = (pieces.join(b, (F.col("sid") == F.col("b_sid")) & (F.col("no") == F.col("block_no")), "left")
             .withColumn("part", F.when(F.col("slot").isNull(), F.lit(0).cast("long")).otherwise(overlap))
             .groupBy("sid", "start", "doc_id", "size", "source_size", "target", *keep)
             .agg(F.sum("part").alias("taken"),
                  F.min(F.when(F.col("part") > 0, F.col("slot"))).alias("first_slot")))
    out = ["doc_id", "size", "source_size", "target", "taken", "first_slot", *keep]
    none = named.filter("size = 0").withColumns({"taken": F.lit(0).cast("long"),
                                                 "first_slot": F.lit(None).cast("long")})
    return taken.select(*out).unionByName(none.select(*out))


def _small(plan: DataFrame, rows: int = 100_000) -> bool:
    """True if the table of sources (some 100 bytes a row) may be broadcast."""
    return plan.count() <= rows


def mixed_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    source: str = "source") -> DataFrame:
    """The rows of ``df`` as the mix takes them: a row stands once for every pass
    that takes words of it (the one document a target cuts stays whole)."""
    t = F.col(f"`{text}`")
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit(""))
    # rows of one id, source and text can stand in for each other
    key = F.md5(F.concat_ws("\n", part(doc_id), part(source), F.md5(t)))
    rows = (df.filter(F.translate(t, SPACES, "") != "")
            .select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("key")))
    given = df.select(F.col(f"`{doc_id}`").alias("id"), t.alias("text"), F.col(f"`{source}`").alias("source"), key.alias("row_key"))
    wanted = (mix(given, "id", keep=["row_key"]).filter("taken > 0").groupBy(F.col("row_key").alias("key"))
              .agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).alias("copies")))
    # one exchange of the texts, by the key, serves the join and the windows
    group = Window.partitionBy("key")
    numbered = rows.join(wanted, "key").withColumns({"no": F.row_number().over(group.orderBy(F.lit(1))),
                                                     "all": F.count(F.lit(1)).over(group)})
    mine = F.floor((F.col("copies") + F.col("all") - F.col("no")) / F.col("all"))
    return (numbered.withColumn("copy", F.explode(F.array_repeat(F.lit(1), mine.cast("int"))))
            .select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns]))
