"""SimHash near-duplicates by pivot distance tables (operator 10).

A document's fingerprint has a bit set where over half of the hashes of its
word shingles (repeats included) have it set.  Documents whose fingerprints
differ in ``max_bits`` bits or fewer are linked; components of links are the
groups.

Search.  Copies share a fingerprint, so the search runs over distinct
fingerprints.  The pivot table holds each fingerprint's Hamming distances to
many reference fingerprints.  By the triangle inequality two fingerprints
within ``max_bits`` differ by at most ``max_bits`` in every coordinate.  A
reference over all 64 bits parts unrelated fingerprints only by a factor of
three or so and yields no join key, so the references lie in ``max_bits + 1``
disjoint bit blocks: a linked pair is equal in at least one block, and there
its coordinates do not differ at all.  The coordinates of a block are thus the
key of a cell; pairs of a cell are discarded if any coordinate of another block
differs by more than ``max_bits``, and the survivors are verified bit by bit.

A crowded cell (over ``cell_rows`` members) gets a second level of pivots: the bits
outside its block fall into ``max_bits + 1`` blocks of their own, with references of
their own, and a linked pair of the cell is equal in at least one of these as well, so
the coordinates of both blocks together are the key of a smaller cell.

Cells that are still crowded, as in large groups of near copies, are not paired.
Their members go, exactly, through single bit flips: two fingerprints within two bits
meet in a value one flip away from both, and at most 65 fingerprints meet in a value;
wider limits add flips in turn.  `search_shares` counts who takes which way.

Edge cases: a null or empty text, or one without words, has fingerprint zero
and is linked like any other; a text of fewer words than a shingle is one
shingle; very long texts are hashed a megabyte at a time; repeated rows are linked by
their equal fingerprints; rows with a null id get a component but never name one; extra
columns, of any name, are not read by `near_duplicates` and carried by `one_of_each`; an
empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import map_batches, utf8
from vellum.llm.components import components
from vellum.session import cut_lineage, drop_lineage_table

SEED = 42
REFERENCES = 12     # references in a block; 5 bits a coordinate, 60 bits a block
CELL_ROWS = 64
CHUNK = 1 << 20     # bytes of a text that are split into words at once


def word_chunks(raw: bytes, size: int = CHUNK):
    """Lists of a text's words; a text of any length is cut at white space."""
    space = re.compile(rb"[\x20\x09-\x0D]").search
    pos, n = 0, len(raw)
    while pos < n:
        found = space(raw, pos + size) if pos + size < n else None
        end = found.start() if found else n
        yield raw[pos:end].split()
        pos = end


def fingerprint(raw: bytes, shingle: int, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of a lower-cased text's word shingles."""
    from xxhash import xxh64_intdigest

    total, ones, tail = 0, np.zeros(64, np.int64), []

    def add(hashes: list[int]) -> None:
        nonlocal total, ones
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)

    for chunk in word_chunks(raw):
        got = tail + chunk
        if len(got) >= shingle:
            text = b" ".join(got)
            ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) + 1) - 1
            begins = np.concatenate(([0], ends[:-1] + 1))
            stop = len(got) - shingle + 1
            add([xxh64_intdigest(text[i:j], seed)
                 for i, j in zip(begins[:stop].tolist(), ends[shingle - 1:].tolist(), strict=True)])
        tail = got[-(shingle - 1):] if shingle > 1 else []
    if not total and tail:
        add([xxh64_intdigest(b" ".join(tail), seed)])
    value = np.packbits(2 * ones > total, bitorder="little").view("<i8")[0]
    return int(value)


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 3, out: str = "fingerprint",
                 keep: list[str] | None = None) -> DataFrame:
    """Add ``out``, the SimHash as a signed 64-bit integer."""
    keep = df.columns if keep is None else keep
    d = df.withColumn("__raw", utf8(F.col(f"`{text}`")))

    def make():
        return lambda col: [pa.array(
            [fingerprint(x.lower(), shingle) for x in col.to_pylist()], pa.int64())]

    return map_batches(d, ["__raw"], T.StructType([T.StructField(out, T.LongType())]), keep, make)


def blocks(n: int) -> list[int]:
    """Masks of n disjoint bit blocks of 64 bits."""
    edges = [64 * i // n for i in range(n + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _coordinates(mask: int, rng) -> Column:
    """Distances of ``fp`` to the references within the bits of a mask, 5 bits each."""
    packed = F.lit(0).cast("long")
    for j in range(REFERENCES):
        ref = int.from_bytes(rng.bytes(8), "little") & mask
        inside = F.col("fp").bitwiseAND(F.lit(signed(mask)))
        distance = F.bit_count(inside.bitwiseXOR(F.lit(signed(ref)))).cast("long")
        packed = packed.bitwiseOR(F.shiftleft(distance, 5 * j))
    return packed


def pivot_table(fps: DataFrame, max_bits: int, seed: int = SEED) -> DataFrame:
    """(fp, c0, c1, ...): the distances to each block's references."""
    rng = np.random.default_rng(seed)
    return fps.select("fp", *[_coordinates(mask, rng).alias(f"c{i}") for i, mask in enumerate(blocks(max_bits + 1))])


def inner_blocks(mask: int, n: int) -> list[int]:
    """Masks of n blocks of the bits outside ``mask``, in order."""
    rest = [b for b in range(64) if not mask >> b & 1]
    edges = [len(rest) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in rest[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False)]


def _near(a: Column, b: Column, max_bits: int) -> Column:
    """True unless a coordinate of two packed rows differs by over max_bits."""
    ok = F.lit(True)
    for j in range(REFERENCES):
        x, y = (F.shiftright(c, 5 * j).bitwiseAND(F.lit(31)) for c in (a, b))
        ok = ok & (F.abs(x - y) <= max_bits)
    return ok


def _in_cells(cells: DataFrame, key: list[str]) -> DataFrame:
    """Members of cells that hold more than one, with the cell's ``members``."""
    sizes = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return cut_lineage(cells.join(sizes, key))


def _pairs(members: DataFrame, key: list[str], max_bits: int) -> DataFrame:
    """(a, b) of the linked pairs of each cell: those that the coordinates leave,
    verified bit by bit."""
    x, y = members.alias("x"), members.alias("y")
    on = F.col("x.fp") < F.col("y.fp")
    for k in key:
        on = on & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    for i in range(max_bits + 1):
        on = on & _near(F.col(f"x.c{i}"), F.col(f"y.c{i}"), max_bits)
    return (x.join(y, on).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
            .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))


def _levels(fps: DataFrame, max_bits: int, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """Members of the cells of both levels, each with its ``members``."""
    n = max_bits + 1
    coords = [f"c{i}" for i in range(n)]
    table = pivot_table(fps, max_bits)
    cells = table.select("fp", *coords, F.explode(F.array(
        *[F.struct(F.lit(i).alias("block"), F.col(f"c{i}").alias("key")) for i in range(n)]))
        .alias("cell")).select("fp", *coords, "cell.*")
    first = _in_cells(cells, ["block", "key"])
    rng, inner = np.random.default_rng(SEED + 1), []
    for i, mask in enumerate(blocks(n)):
        inner += [F.struct(F.lit(i).alias("of"), F.lit(j).alias("inner"), _coordinates(m, rng).alias("inner_key"))
                  for j, m in enumerate(inner_blocks(mask, n))]
    mine = F.filter(F.array(*inner), lambda c: c["of"] == F.col("block"))
    deep = (first.filter(F.col("members") > cell_rows).drop("members")
            .select("fp", *coords, "block", "key", F.explode(mine).alias("c")).select("fp", *coords, "block", "key", "c.inner", "c.inner_key"))
    return first, _in_cells(deep, ["block", "key", "inner", "inner_key"])


def links(fps: DataFrame, max_bits: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b) with the same components as all pairs of distinct ``fp`` values
    that differ in ``max_bits`` bits or fewer."""
    n = max_bits + 1
    if not 0 <= max_bits <= 20 or 64 / n > 31 and n < 3:
        raise ValueError("max_bits must be 2 to 20")
    first, second = _levels(fps, max_bits, cell_rows)
    small = F.col("members") <= cell_rows
    crowded = second.filter(~small).select("fp").distinct()
    return (_pairs(first.filter(small), ["block", "key"], max_bits)
            .unionByName(_pairs(second.filter(small), ["block", "key", "inner", "inner_key"], max_bits))
            .unionByName(_flip_links(crowded, max_bits)))


def search_shares(fps: DataFrame, max_bits: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(way, fingerprints): how many distinct fingerprints stand in paired cells of
    either level, and how many in cells that single bit flips had to take."""
    first, second = _levels(fps, max_bits, cell_rows)
    small = F.col("members") <= cell_rows
    ways = (("first level", first.filter(small)), ("second level", second.filter(small)), ("bit flips", second.filter(~small)))
    out = None
    for way, members in ways:
        one = members.agg(F.count_distinct("fp").alias("fingerprints")).select(F.lit(way).alias("way"), "fingerprints")
        out = one if out is None else out.unionByName(one)
    return out


def _flip_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links of the fingerprints within max_bits, by meeting half way.

    Values within r flips of two fingerprints show a distance of 2r or less, so
    an even limit needs no check.  For an odd limit one side flips a bit more.
    """
    bits = F.array(*[F.lit(signed(1 << i)) for i in range(64)])

    def ball(col: Column, r: int) -> Column:
        out = F.array(col)
        for _ in range(r):
            out = F.array_union(out, F.flatten(F.transform(
                out, lambda v: F.transform(bits, lambda bit: v.bitwiseXOR(bit)))))
        return out

    half = max_bits // 2
    met = fps.select("fp", F.explode(ball(F.col("fp"), half)).alias("meet"))
    if max_bits % 2 == 0:
        together = met.groupBy("meet").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
        return (together.select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
                .filter("a != b"))
    wide = fps.select(F.col("fp").alias("b"), F.explode(ball(F.col("fp"), half + 1)).alias("meet"))
    return met.join(wide, "meet").filter(F.col("fp") < F.col("b")).select(F.col("fp").alias("a"), "b")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                    max_bits: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, text_hash, fingerprint, component_id, group_fp) for every row of ``df``.

    ``fingerprint`` is a signed 64-bit integer, ``component_id`` the smallest id of
    the group, ``group_fp`` its smallest fingerprint, ``text_hash`` xxhash64 of the
    text.
    """
    given = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"),
                      F.xxhash64(F.col(f"`{text}`")).alias("hash"))
    docs = cut_lineage(fingerprints(given, "text", shingle, "fp", ["id", "hash"]))
    distinct = cut_lineage(docs.groupBy("fp").agg(F.min("id").alias("first")))
    found = components(links(distinct.select("fp"), max_bits, cell_rows))
    smallest = (found.join(distinct, found.node == distinct.fp).groupBy("root")
                .agg(F.min("first").alias("least")))
    linked = found.join(smallest, "root").select(F.col("node").alias("fp"), "root", "least")
    named = cut_lineage(distinct.join(linked, "fp", "left").select(
        "fp", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component"),
        F.coalesce("root", "fp").alias("group_fp")))
    drop_lineage_table(distinct)
    return docs.join(named, "fp").select(
        F.col("id").alias(doc_id), F.col("hash").alias("text_hash"), F.col("fp").alias("fingerprint"),
        F.col("component").alias("component_id"), "group_fp")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                max_bits: int = 2) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each group the row with the
    smallest id stays (null ids last, then by the text's hash); of equal rows, one."""
    groups = near_duplicates(df, doc_id, text, shingle, max_bits)
    row = F.struct(F.col(f"`{doc_id}`").isNull().alias("no_id"), F.col(f"`{doc_id}`").alias("id"), "text_hash")
    stay = (groups.groupBy("group_fp").agg(F.min(row).alias("r"))
            .select(F.col("r.id").alias("__id"), F.col("r.text_hash").alias("__stay")))
    # one exchange of the texts serves the join and the removal of equal rows
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{doc_id}`").alias("id"),
                     F.xxhash64(F.col(f"`{text}`")).alias("hash")).withColumn("key", F.xxhash64("id", "hash"))
    stay = stay.withColumn("stay_key", F.xxhash64("__id", "__stay"))
    same = F.coalesce(F.col("id") == F.col("__id"), F.col("id").isNull() & F.col("__id").isNull())
    kept = rows.join(stay, (F.col("key") == F.col("stay_key")) & same, "left_semi")
    kept = kept.dropDuplicates(["key", "id", "hash"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])
