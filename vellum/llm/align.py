"""Alignment of two tokenizers' tokens (operator 11).

A text with a space before it is encoded twice: by a byte-level BPE tokenizer (A)
and by a sentencepiece model (B), which adds the space itself.  Tokens are byte
ranges.  Every token points to the token farthest to the right that overlaps it: the
other tokenizer's token that holds its last byte, or itself where nothing reaches
farther (of two tokens that end together B's is the end).  Pointers only lead to the
right, so doubling them, for all tokens of many texts at once, ends at each
component's terminal token after as many rounds as the longest chain has binary
digits.  Terminal tokens stand where both tokenizers have an end; they label the
groups.  The first pointers are the links too: an overlap of two tokens ends where
one of them does, so each link is a token with the other's token at its last byte.

An id pair's count is the number of links, corpus-wide, that hold it.  A block of
texts (`BLOCK` bytes, or one longer text) has its distinct pairs once; these rows,
not the links, are shuffled to the counts and back to their block, so a pair that
stands in every text costs a row for each block.

Both tokenizers leave a single blank or line feed between two other characters to
the part after it, so texts are cut there (`Tokenizers.by_word` checks the
vocabularies' files), each distinct part is encoded once and kept for later texts;
other vocabularies get whole texts.

Edge cases: null and empty texts, and texts whose joined tokens differ from space
and text (signs that a tokenizer replaces), have no tokens: zeros and ''.  Special
tokens' strings are plain text.  Very long texts go through in parts of `PARTS`
parts.  Pairs of equal count for a B id are all its best.  Repeated rows are
separate documents and count each; null ids are carried like others; an empty table
gives an empty table; of the input's columns only those in ``keep`` stay, and one
with a result's name is replaced.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import bounded_batches, slices, worker_cache
from vellum.session import cut_lineage

BLOCK = 2 << 20       # bytes of texts whose tokens are held at once
PARTS = 200_000       # parts of a long text that are held at once
KEPT_PARTS = 200_000  # memoised parts in a worker; beyond them or `KEPT_IDS` it starts anew
KEPT_IDS = 4_000_000
TOGETHER = 500        # parts that are encoded in one call
#: Runs that end before a single blank or line feed between two other characters.
PART = re.compile(r"\s?(?:\S++|(?![ \n]\S)\s++)++")
SCHEMA = ("n_a long, n_b long, n_groups long, n_links long, groups string, block string, places array<int>, "
          "times array<long>, block_pairs array<long>, block_counts array<long>")


def byte_characters() -> dict[str, int]:
    """Byte-level BPE's sign for each byte: printable bytes stand for themselves, the
    others for the signs from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizers:
    """Both tokenizers and the parts that they have encoded."""

    def __init__(self, a_spec: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_spec)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        vocabulary, sign = self.a.get_vocab(), byte_characters()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(sign[c] for c in token) if all(c in sign for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # decimal ids side by side, a comma after each
        digits = [b"%d," % i for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digits_size = np.array([len(x) for x in digits], np.int64)
        self.digits_start = np.cumsum(self.digits_size) - self.digits_size
        self.blank = self.b.piece_to_id("▁")
        self.by_word = self._cuts(json.loads(a_spec), pieces)
        self.clear()

    def _cuts(self, spec: dict, pieces: list[str]) -> bool:
        """True if no token of either reaches over the places where `PART` cuts."""
        pre = spec.get("pre_tokenizer") or {}
        probe = "aﬁ é\n\tB  c "
        return (not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                and pre.get("use_regex", True) and self.b.normalize(probe) in (probe, ("▁" + probe).replace(" ", "▁"))
                and not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces))

    def clear(self) -> None:
        """Forget all parts."""
        self.index: dict[str, int] = {}
        self.good: list[bool] = []
        self.held: list[tuple[list, list]] = [([], []), ([], [])]  # ids and parts' sizes, of A and of B
        self.n_ids = 0

    def parts(self, text: str):
        """Iterator of a text's parts, the space before it included."""
        whole = " " + text
        if not self.by_word:
            return iter((whole,))
        return iter(PART.findall(whole)) if len(text) < BLOCK else (m.group() for m in PART.finditer(whole))

    def learn(self, parts: list[str]) -> None:
        """Encode parts that are not kept.  Parts that would be cut again there are
        encoded side by side, `TOGETHER` at a time, and parted by their bytes."""
        plain = [p for p in parts if p[0] in " \n" and not p[1:2].isspace() and not p[-1].isspace()]
        other = set(parts).difference(plain) if len(plain) < len(parts) else ()
        for some in [plain[i:i + TOGETHER] for i in range(0, len(plain), TOGETHER)]:
            if self.by_word and self.keep(some):
                continue
            other = [*other, *some]
        for part in other:
            if not self.keep([part]):  # a text with this part has no tokens
                self.index[part] = len(self.good)
                self.good.append(False)
                for _, size in self.held:
                    size.append(np.zeros(1, np.int64))

    def keep(self, parts: list[str]) -> bool:
        """Keep the tokens of parts that can stand side by side, if they spell them."""
        text = "".join(parts)
        raw = text.encode()
        sizes = np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts))
        ends = np.cumsum(sizes)
        a = self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode(text[1:] if text[0] == " " else text, num_threads=1)
        if text[0] != " ":
            b = b[1:] if b and b[0] == self.blank else []  # the space that B adds
        if (b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw):
            return False
        cuts = []
        for ids, size in ((a, self.a_size), (b, self.b_size)):
            ids = np.array(ids, np.int64)
            at = np.cumsum(size[ids])
            last = np.searchsorted(at, ends)
            if not np.array_equal(at[last], ends):
                return False  # a token over a cut: never, by `_cuts`
            cuts.append((ids, np.diff(last + 1, prepend=0)))
        self.index.update(zip(parts, range(len(self.good), len(self.good) + len(parts)), strict=True))
        self.good += [True] * len(parts)
        for (ids, size), (more, n) in zip(self.held, cuts, strict=True):
            ids.append(more)
            size.append(n)
        self.n_ids += len(a) + len(b)
        return True

    def tokens(self, numbers: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the parts side by side, how many each part has)."""
        for arrays in self.held[which]:
            arrays[:] = [np.concatenate([np.zeros(0, np.int64), *arrays])]
        (ids,), (sizes,) = self.held[which]
        starts, size = np.cumsum(sizes) - sizes, sizes[numbers]
        return ids[spread(starts[numbers], size)], size

    def numbers(self, parts: list[str]) -> np.ndarray:
        """Numbers of the parts in this worker's memory."""
        if len(self.index) > KEPT_PARTS or self.n_ids > KEPT_IDS:
            self.clear()
        new = [p for p in dict.fromkeys(parts) if p not in self.index]
        if new:
            self.learn(new)
        return np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[i] to starts[i] + sizes[i], one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(B token at each A token's last byte, A token at each B token's last byte,
    terminal of every token).  Tokens are numbered A first; ends ascend and the last
    ones are equal."""
    n = len(a_end)
    to_b, to_a = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
    own = np.arange(n, n + len(b_end))
    after = np.concatenate((to_b + n, np.where(a_end[to_a] > b_end, to_a, own) if n else own))
    while True:
        farther = after[after]
        if np.array_equal(farther, after):
            return to_b, to_a, after
        after = farther


def align_parts(t: Tokenizers, parts: list[str], sizes: np.ndarray):
    """Alignment of texts, given as their parts side by side and how many each has:
    (good, n_a, n_b, n_groups, decimal groups, their sizes, text and id pair of each
    link)."""
    texts, numbers = len(sizes), t.numbers(parts)
    owner = np.repeat(np.arange(texts), sizes)
    good = np.bincount(owner, ~np.array(t.good, bool)[numbers], texts) == 0
    mine = good[owner]
    numbers, owner = numbers[mine], owner[mine]
    (a, a_parts), (b, b_parts) = t.tokens(numbers, 0), t.tokens(numbers, 1)
    n_a = np.bincount(owner, a_parts, texts).astype(np.int64)
    n_b = np.bincount(owner, b_parts, texts).astype(np.int64)
    a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    to_b, to_a, label = terminals(a_end, b_end)
    last = label[len(a):] == np.arange(len(a), len(a) + len(b))  # B tokens that end a group
    text_of_b = np.repeat(np.arange(texts), n_b)
    n_groups = np.bincount(text_of_b[last], minlength=texts)
    nth = np.cumsum(last) - 1
    group = nth[label - len(a)]
    a_upto = np.cumsum(np.bincount(group[:len(a)], minlength=int(last.sum())))
    b_upto = np.cumsum(np.bincount(group[len(a):], minlength=int(last.sum())))
    # a group's A ids, then its B ids
    a_place = np.arange(len(a)) + np.concatenate(([0], b_upto))[group[:len(a)]]
    b_place = np.arange(len(b)) + a_upto[group[len(a):]]
    ids = np.empty(len(a) + len(b), np.int64)
    ids[a_place], ids[b_place] = a, b
    size = t.digits_size[ids]
    ends = np.cumsum(size)
    out = t.digits[spread(t.digits_start[ids], size)]
    out[ends[a_place[a_upto - 1]] - 1] = ord("|")
    out[ends[b_place[last]] - 1] = ord(";")
    stop = np.cumsum(n_a + n_b)
    text_end = np.concatenate(([0], ends))[stop]
    filled = n_a > 0
    keep = np.ones(len(out), bool)
    keep[text_end[filled] - 1] = False  # no sign after a text's last id
    length = np.diff(text_end, prepend=0) - filled
    more = ~last  # the B tokens whose last byte is no A token's last one
    links = np.concatenate(((a << 32) | b[to_b], (a[to_a[more]] << 32) | b[more]))
    text = np.concatenate((np.repeat(np.arange(texts), n_a), text_of_b[more]))
    return good, n_a, n_b, n_groups, out[keep], length, text, links


def _long_text(t: Tokenizers, text: str):
    """`align_parts` of one text, some of its parts at a time."""
    parts, found = t.parts(text), []
    while some := list(itertools.islice(parts, PARTS)):
        found.append(align_parts(t, some, np.array([len(some)])))
        pairs, n = np.unique(found[-1][7], return_counts=True)
        found[-1] = (*found[-1][:6], pairs, n)
    good = np.array([all(f[0][0] for f in found)])
    n_a, n_b, n_groups = (np.array([sum(int(f[i][0]) for f in found)]) * good for i in (1, 2, 3))
    groups = b";".join(f[4].tobytes() for f in found) if good[0] else b""
    pairs, at = np.unique(np.concatenate([f[6] for f in found]), return_inverse=True)
    n = np.bincount(at, np.concatenate([f[7] for f in found]), len(pairs)).astype(np.int64)
    if not good[0]:
        pairs, n = pairs[:0], n[:0]
    return good, n_a, n_b, n_groups, np.frombuffer(groups, np.uint8), np.array([len(groups)]), pairs, n


def align_block(t: Tokenizers, texts: pa.Array) -> list[pa.Array]:
    """Columns of `SCHEMA` for the texts of a block."""
    values = [x or "" for x in texts.to_pylist()]
    rows = len(values)
    if rows == 1 and len(values[0]) > BLOCK // 4:
        _, n_a, n_b, n_groups, out, length, pairs, times = _long_text(t, values[0])
        places, each, counts = np.arange(len(pairs)), np.array([len(pairs)]), times
    else:
        split = [list(t.parts(x)) if x else [] for x in values]
        sizes = np.array([len(x) for x in split], np.int64)
        _, n_a, n_b, n_groups, out, length, text, links = align_parts(t, list(itertools.chain.from_iterable(split)), sizes)
        pairs, at, counts = np.unique(links, return_inverse=True, return_counts=True)
        codes, times = np.unique(text * max(1, len(pairs)) + at, return_counts=True)
        places, each = codes % max(1, len(pairs)), np.bincount(codes // max(1, len(pairs)), minlength=rows)

    def strings() -> pa.Array:
        ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
        return pa.StringArray.from_buffers(rows, pa.py_buffer(ends), pa.py_buffer(out.tobytes()))

    def lists(flat: np.ndarray, kind: pa.DataType, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))

    ends = np.concatenate(([0], np.cumsum(each)))
    first = np.arange(rows + 1).clip(max=1) * len(pairs)  # the block's pairs stand in its first row
    return [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()),
            pa.array(n_a + n_b - n_groups, pa.int64()), strings(), pa.array([uuid.uuid4().hex] * rows),
            lists(places, pa.int32(), ends), lists(times, pa.int64(), ends),
            lists(pairs, pa.int64(), first), lists(counts, pa.int64(), first)]


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the token, group and link counts of each text, its ``groups`` as decimal
    ids (``a1,a2|b1;a3|b2,b3``), and its linked id pairs: ``places`` in the pairs of its
    ``block``, and how many ``times`` each is linked.  A block's distinct pairs
    (A's id * 2^32 + B's id) and their counts stand in its first row."""
    fields = T._parse_datatype_string(SCHEMA).fields
    keep = [c for c in (df.columns if keep is None else keep) if c not in [f.name for f in fields]]
    with open(a_path, encoding="utf-8") as f:
        a_spec = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    # vocabularies are fixed tables of some megabytes, whatever the input's size
    shared = df.sparkSession.sparkContext.broadcast((a_spec, b_model))
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    names, n_keep, key = schema.names, len(keep), f"align {a_path} {b_path}"

    def run(batches):
        t = worker_cache(key, lambda: Tokenizers(*shared.value))
        for whole in batches:
            for b in slices(whole, BLOCK):
                yield pa.RecordBatch.from_arrays(
                    [b.column(i) for i in range(n_keep)] + align_block(t, b.column(n_keep)), names=names)
        pa.default_memory_pool().release_unused()

    return bounded_batches(rows).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): links that hold an id pair, and whether no other pair of
    the same B id has more."""
    total = cut_lineage(_block_pairs(aligned).groupBy("pair").agg(F.sum("n").alias("count"))
                        .withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    most = total.groupBy("b").agg(F.max("count").alias("most"))
    return total.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _block_pairs(aligned: DataFrame) -> DataFrame:
    both = F.arrays_zip(F.col("block_pairs").alias("pair"), F.col("block_counts").alias("n"))
    return (aligned.filter(F.size("block_pairs") > 0).select("block", F.posexplode(both).alias("place", "e"))
            .select("block", "place", F.col("e.pair").alias("pair"), F.col("e.n").alias("n")))


def count_links(aligned: DataFrame) -> DataFrame:
    """Rows of `align` with ``n_best``, the links whose pair is its B id's commonest,
    and ``count_sum``, the sum of all links' counts, in place of the pairs."""
    drop = ["block", "places", "times", "block_pairs", "block_counts"]
    keep = [c for c in aligned.columns if c not in [*drop, "n_best", "count_sum"]]
    aligned = cut_lineage(aligned.select(*keep, *drop))
    found = (_block_pairs(aligned).join(pair_counts(aligned), "pair")
             .select(F.col("block").alias("of"), "place", "count", "best"))
    rows = aligned.select(*keep, "block", "places", "times")
    schema = T.StructType([aligned.schema[c] for c in keep]
                          + T._parse_datatype_string("n_best long, count_sum long").fields)
    names = schema.names

    def back(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        at = pairs["place"].to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = pairs["count"].to_numpy(), pairs["best"].to_numpy()
        out = texts.select(keep).combine_chunks()
        places, times = texts["places"].combine_chunks(), texts["times"].combine_chunks()
        owner = np.repeat(np.arange(len(out)), np.diff(places.offsets.to_numpy()))
        p, n = places.flatten().to_numpy(), times.flatten().to_numpy()
        sums = []
        for value in (best, count):
            total = np.zeros(len(out), np.int64)
            np.add.at(total, owner, value[p] * n)
            sums.append(pa.array(total, pa.int64()))
        return pa.table([*out.columns, *sums], names=names)

    return rows.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(back, schema)
