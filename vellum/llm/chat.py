"""Chat formatting by quotation linking (operator 7), DataFrame functions only.

A line that begins with ``>`` marks is quoted; the number of marks is its level.
Quoted lines of one level that follow each other are a passage.  Messages are
indexed by the hashes of their own text, its paragraphs, sentences and lines, all
normalised (folded, white space collapsed, so re-wrapped quotes match); a unit that
several messages of a conversation hold belongs to the first of them.  A passage
looks up its own hash, which counts for all its lines, and those of its sentences
and lines.  A message replies to the earlier message that has most of its outermost
quotes, the later of equals; a message without such a quote starts a thread.
Conversations come out without quotes, threads in order of their first turn and,
within a thread, messages in order of turn, so that a reply stands after what it
answers.  Nothing is gathered by conversation: a unit's first holder is a minimum,
replies are joins on (conversation, hash), threads are components of replies, and
the order is a range sort.

Edge cases: a null text has no lines and stays null; a text without quotes stays as
it is, one of quotes alone becomes empty; quotes that match no earlier message are
removed all the same; rows with a null conversation or turn are never linked; rows
of one conversation and turn are one message in links, and each stays; a very long text
is parsed in its row; a null role is formatted as ``unknown``; extra columns, of any
name, are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import words
from vellum.llm.components import components
from vellum.session import cut_lineage

MARKS = r"^((?:[ \t]*>)+)"
WROTE = r"wrote:[ \t]*$"
STOP = r"(?<=[.!?]) "


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def line_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def parsed_lines(text: Column) -> Column:
    """Array of (level, text without marks, normalised text)."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(
        line_level(x).alias("level"), F.regexp_replace(x, MARKS + "[ \t]?", "").alias("text"),
        normal(F.regexp_replace(x, MARKS, "")).alias("norm")))


def own_text(lines: Column) -> Column:
    """Unquoted lines, without the line that names a quote's author."""
    def own(x: Column, i: Column) -> Column:
        before_quote = F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False))
        return (x["level"] == 0) & ~(before_quote & x["text"].rlike(WROTE))

    kept = F.transform(F.filter(lines, own), lambda x: x["text"])
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def units(own: Column) -> Column:
    """Hashes of a message's own text, its paragraphs, sentences and lines."""
    texts = F.concat(F.array(own), F.split(own, r"\n[ \t]*\n"), F.split(own, "\n"),
                     F.split(normal(own), STOP))
    return F.array_distinct(F.transform(
        F.filter(F.transform(texts, normal), lambda x: x != ""), lambda x: F.xxhash64(x)))


def evidence(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, weight) of quoted passages, their sentences and lines."""
    rows = (messages.filter(F.exists("lines", lambda x: x["level"] > 0))
            .select("conv", "turn", "mid", F.posexplode("lines").alias("pos", "line"))
            .select("conv", "turn", "mid", "pos", F.col("line.level").alias("level"),
                    F.col("line.norm").alias("norm"))
            .filter("level > 0 AND norm != ''"))
    # the lines of one message, which one row has held
    order = Window.partitionBy("conv", "turn", "mid").orderBy("pos")
    new = ((F.col("level") != F.lag("level").over(order)) | (F.col("pos") != F.lag("pos").over(order) + 1))
    numbered = (rows.withColumn("new", F.coalesce(new, F.lit(True)).cast("int"))
                .withColumn("passage", F.sum("new").over(order)))
    passages = (numbered.groupBy("conv", "turn", "mid", "level", "passage")
                .agg(F.array_sort(F.collect_list(F.struct("pos", "norm"))).alias("all")))
    passages = passages.withColumn("norm", normal(F.array_join("all.norm", " ")))
    one = F.lit(1).cast("long").alias("weight")
    whole = passages.select("conv", "turn", "level", F.xxhash64("norm").alias("hash"),
                            F.size("all").cast("long").alias("weight"))
    sentences = (passages.withColumn("part", F.explode(F.split("norm", STOP)))
                 .select("conv", "turn", "level", F.xxhash64("part").alias("hash"), one))
    lines = rows.select("conv", "turn", "level", F.xxhash64("norm").alias("hash"), one)
    return whole.unionByName(sentences).unionByName(lines)


def replies(messages: DataFrame) -> DataFrame:
    """(conv, turn, reply_to) of the messages whose quotes are found."""
    first = (messages.select("conv", "turn", F.explode(units(F.col("own"))).alias("hash"))
             .groupBy("conv", "hash").agg(F.min("turn").alias("origin")))
    found = evidence(messages).join(first, ["conv", "hash"]).filter("origin < turn")
    votes = found.groupBy("conv", "turn", "level", "origin").agg(F.sum("weight").alias("weight"))
    best = F.max_by(F.col("origin"), F.struct(-F.col("level"), "weight", "origin"))
    return votes.groupBy("conv", "turn").agg(best.alias("reply_to"))


def link(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
         text: str = "text") -> DataFrame:
    """(conv, turn, role, text, reply_to, thread, formatted) of every row, in order
    of conversation, thread and turn, under the given names of the first four."""
    lines = parsed_lines(F.col("text"))
    rows = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
                     F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    quoted = F.exists("lines", lambda x: x["level"] > 0)
    rows = (rows.withColumn("lines", lines)
            .withColumn("own", F.when(quoted, own_text(F.col("lines"))).otherwise(F.col("text"))))
    known = rows.filter("conv IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    messages = (known.withColumn("mid", F.xxhash64("text")).dropDuplicates(["conv", "turn", "mid"]))
    links = cut_lineage(replies(messages))
    node = lambda t: F.struct(F.col("conv"), F.col(t).alias("turn"))
    threads = components(links.select(node("turn").alias("a"), node("reply_to").alias("b")))
    threads = threads.select(F.col("node.conv").alias("t_conv"), F.col("node.turn").alias("t_turn"),
                             F.col("root.turn").alias("root"))
    at = lambda p: ((F.col("conv") == F.col(f"{p}_conv"))
                    & (F.col("turn") == F.col(f"{p}_turn")))
    l = links.select(F.col("conv").alias("l_conv"), F.col("turn").alias("l_turn"), "reply_to")
    out = rows.join(l, at("l"), "left").join(threads, at("t"), "left")
    header = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"))
    return (out.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role),
                       F.col("own").alias(text), "reply_to", F.coalesce("root", "turn").alias("thread"),
                       F.concat(header, F.coalesce("own", F.lit(""))).alias("formatted"))
            .orderBy(conv, "thread", turn))


WRAP = 7  # words of a re-wrapped line


def quote_previous(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """(conv, turn, role, text): messages as mail programs send them, by conversation and
    turn modulo 4: as they are; after the previous turn, quoted line by line; after the
    two turns before, nested; after the previous turn, re-wrapped."""
    rows = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
                     F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    one = rows.groupBy("conv", "turn").agg(F.min("text").alias("said"))
    for name, back in (("last", 1), ("first", 2)):
        before = one.select("conv", (F.col("turn") + back).alias("turn"), F.col("said").alias(name))
        rows = rows.join(before, ["conv", "turn"], "left")

    def quoted(value: Column, mark: str) -> Column:
        return F.array_join(F.transform(F.split(value, "\n"), lambda x: F.concat(F.lit(mark), x)), "\n")

    w = words("last")
    wrapped = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / WRAP).cast("int")), lambda i: F.concat(
        F.lit("> "), F.array_join(F.slice(w, i * WRAP + 1, WRAP), " "))), "\n")
    kind = F.pmod(F.col("conv") + F.col("turn"), F.lit(4))
    own = F.coalesce("text", F.lit(""))
    nested = F.concat(F.coalesce("role", F.lit("someone")), F.lit(" wrote:\n"),
                      F.when(F.col("first").isNotNull(), F.concat(quoted(F.col("first"), ">> "), F.lit("\n"))).otherwise(""),
                      quoted(F.col("last"), "> "), F.lit("\n"), own)
    message = (F.when(F.col("last").isNull() | (F.size(w) < 1), F.col("text"))
               .when(kind == 1, F.concat(quoted(F.col("last"), "> "), F.lit("\n"), own))
               .when(kind == 2, nested)
               .when(kind == 3, F.concat(wrapped, F.lit("\n"), own)).otherwise(F.col("text")))
    return rows.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), message.alias(text))
