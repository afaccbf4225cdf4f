"""Interpolated modified Kneser-Ney n-gram scores (operator 8).

Counting.  Tasks hash their texts' n-grams, add up equal ones and send them,
packed, to shards by the hash of the context.  Contexts of very frequent words
are dealt by the whole n-gram instead, so no word fills a shard; their few totals
are added up on the driver.  A shard adds up its n-grams and writes one file:
sorted 64-bit hashes of the n-grams with their counts, and sorted hashes of the
contexts with their totals and numbers of words seen once, twice and more often.
A shard's distinct n-grams give the next lower order its continuation counts, so
each order is one exchange of what the order above has left.  The number of shards
follows from the training texts' bytes, then tokens, and each exchange has a task for
each shard.  A shard's file is named after its number and describes itself, so that a
model of any size is a folder and a few numbers.

Scoring.  Workers map the files and look up hashes in sorted batches.  With
modified Kneser-Ney discounts D1, D2, D3+ from the counts of counts,

    p_k(w | context) = max(c - D(c), 0) / c(context) + weight(context) * p_(k-1)(w)

and p_0 = 1 / (types + 1), the share of each type and of all unknown words.  A
context that was never seen passes p_(k-1) on.  A text starts with order - 1
begin marks and ends with the end token.

Edge cases: a null or empty text is the end token alone; a very long text is one
chunk, scored whole; without training rows every token has probability 1; a discount
that its counts of counts do not give is 0.5; repeated rows and rows with equal ids are
learned and scored one by one; a kept column with a result's name is replaced; an empty
table gives an empty table; 64-bit hashes stand for words and n-grams.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import bounded_batches, map_batches, slices, utf8, worker_cache
from vellum.llm.shared_files import mapped_arrays, write_arrays
from vellum.session import checkpoint_dir, cut_lineage, drop_lineage_table

ORDER = 2
FLUSH = 3_000_000        # tokens whose n-grams a task adds up before it sends them
SHARD_TOKENS = 4_000_000  # training tokens for each shard, about
WORD_BYTES = 6           # bytes of a token with its space, about, before tokens are counted
TOP_WORDS = 64           # of a shard's words, those that may be hot
CHUNK = 1 << 21          # bytes of text that are hashed or scored together
U8 = np.uint64
ROOT = U8(0)             # the empty context
RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                       T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
SHARD_ROWS = "kind string, shard int, counts array<long>, blob binary"


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two 64-bit hashes, in order."""
    with np.errstate(over="ignore"):
        x = (np.asarray(a, U8) ^ U8(0x9E3779B97F4A7C15)) * U8(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U8(32))) + np.asarray(b, U8)
        x = (x ^ (x >> U8(30))) * U8(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U8(27))) * U8(0x94D049BB133111EB)
        return x ^ (x >> U8(31))


class Tokens:
    """Hashed tokens of some texts, with order - 1 begin marks before each."""

    def __init__(self, raws: list[bytes], order: int):
        from xxhash import xxh64_intdigest as h

        begin, end = h(b" begin"), h(b" end")  # no word holds a space
        texts = [r.lower().split() for r in raws]
        self.sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        flat = []
        for t in texts:
            flat += [begin] * (order - 1)
            flat += map(h, t)
            flat.append(end)
        self.begin = begin
        self.all = np.array(flat, U8)
        starts = np.cumsum(self.sizes + order - 1) - self.sizes
        self.at = np.repeat(starts - (np.cumsum(self.sizes) - self.sizes), self.sizes) + np.arange(self.sizes.sum())
        self.words = self.all[self.at]

    def context(self, k: int) -> np.ndarray:
        """Hash of the k - 1 tokens before each token."""
        c = np.zeros(len(self.at), U8)
        for j in range(k - 1, 0, -1):
            c = mix(c, self.all[self.at - j])
        return c

    def hot_run(self, hot: np.ndarray, order: int) -> np.ndarray:
        """How many of the order - 1 tokens before each token are hot in a row."""
        is_hot = found(hot, self.all)[0] | (self.all == U8(self.begin))
        run, live = np.zeros(len(self.at), np.uint8), np.ones(len(self.at), bool)
        for j in range(1, order):
            live &= is_hot[self.at - j]
            run += live
        return run


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is there, place) of values in a sorted array."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[place] == wanted, place


def text_chunks(raws: list[bytes], size: int = CHUNK):
    at = 0
    while at < len(raws):
        stop, total = at, 0
        while stop < len(raws) and (stop == at or total + len(raws[stop]) <= size):
            total += len(raws[stop])
            stop += 1
        yield raws[at:stop]
        at = stop


def raw_chunks(batches):
    for whole in batches:
        for b in slices(whole):
            yield from text_chunks(b.column(0).to_pylist())


# packed n-grams ----------------------------------------------------------------------
def narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)


def pack(*arrays: np.ndarray) -> bytes:
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays)


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    out, at = [], 4 + n
    for kind, size in json.loads(blob[4:4 + n]):
        out.append(np.frombuffer(blob, kind, size, at))
        at += out[-1].nbytes
    return out


def shard_of(context: np.ndarray, word: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    salt = np.where(hot, word, U8(0))
    return (mix(mix(context, salt), U8(1)) % U8(shards)).astype(np.int32)


def deal(k: int, context, lowers: list, run, word, count, shards: int):
    """(shard, blob) of distinct n-grams of order k, contexts written once.

    ``lowers`` holds each context's hashes of orders k - 1 to 2, ``run`` how many
    of its last words are hot.
    """
    shard = shard_of(context, word, run >= k - 1, shards)
    order = np.lexsort((context, shard))
    shard, context = shard[order], context[order]
    edges = np.flatnonzero(np.diff(shard)) + 1
    for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)], strict=True):
        if a == z:
            continue
        o, c = order[a:z], context[a:z]
        first = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1))
        yield int(shard[a]), pack(c[first], run[o][first], narrow(np.diff(np.append(first, z - a))),
                                  word[o], narrow(count[o]), *(x[o][first] for x in lowers))


def add_up(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each distinct key, in order of keys; sum of its counts)."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(key) else order
    return order[first], np.add.reduceat(count[order], first) if len(key) else count


def batch_rows(rows: list[tuple]) -> pa.Table:
    """A table of (kind, shard, counts, blob)."""
    cols = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.binary())
    return pa.table({n: pa.array(c, t) for n, c, t in
                     zip(("kind", "shard", "counts", "blob"), cols, kinds, strict=True)})


def signed(x) -> int:
    return int(np.asarray(x, U8).view(np.int64))


def merge_words(table: pa.Table, folder: str) -> pa.Table:
    """Training counts of a shard's words: a file, totals, its most frequent words."""
    parts = [unpack(b) for b in table["blob"].to_pylist()]
    word, count = (np.concatenate([p[i] for p in parts]).astype(U8) for i in (0, 1))
    at, total = add_up(word, count)
    keys, shard = word[at], table["shard"][0].as_py()
    write_arrays(folder, f"words-{shard}", (keys, narrow(total)))
    top = np.argsort(total)[-TOP_WORDS:]
    return batch_rows([("shard", shard, [len(keys), int(total.sum())], None),
                       *(("top", shard, [signed(keys[i]), int(total[i])], None) for i in top)])


def merge_grams(table: pa.Table, k: int, folder: str, shards: int) -> pa.Table:
    """A shard's n-grams of order k: a file, totals, and what order k - 1 gets."""
    parts = [unpack(b) for b in table["blob"].to_pylist()]
    word, count = (np.concatenate([p[i] for p in parts]).astype(U8) for i in (3, 4))
    context, run, *lowers = (np.concatenate([np.repeat(p[i], p[2]) for p in parts])
                             for i in (0, 1, *range(5, len(parts[0]))))
    del parts
    key = mix(context, word)
    at, total = add_up(key, count)
    key, context, run, word, *lowers = (x[at] for x in (key, context, run, word, *lowers))
    names, of = np.unique(context, return_inverse=True)
    sums = [np.bincount(of[m], total[m] if i == 0 else None, len(names)).astype(U8)
            for i, m in enumerate((total > 0, total == 1, total == 2, total > 2))]
    hot = np.zeros(len(names), bool)
    hot[of] = run >= k - 1
    shard = table["shard"][0].as_py()
    write_arrays(folder, f"grams{k}-{shard}", (key, narrow(total), names[~hot], *(narrow(s[~hot]) for s in sums)))
    rows = [("shard", shard, [int((total == i).sum()) for i in (1, 2, 3, 4)], None)]
    if hot.any():
        rows.append(("hot", shard, None, pack(names[hot], *(s[hot] for s in sums))))
    if k > 1:
        context = lowers[0] if lowers else np.zeros(len(word), U8)
        at, n = add_up(mix(context, word), np.ones(len(word), U8))
        rows += [("next", to, None, b) for to, b in
                 deal(k - 1, context[at], [x[at] for x in lowers[1:]], run[at], word[at], n, shards)]
    return batch_rows(rows)


# counting ------------------------------------------------------------------------------
def _count_words(df: DataFrame, shards: int) -> DataFrame:
    def run(batches):
        keys, counts, held = [], [], 0

        def send():
            at, total = add_up(np.concatenate(keys), np.concatenate(counts))
            word = np.concatenate(keys)[at]
            shard = (mix(word, U8(2)) % U8(shards)).astype(np.int32)
            for s in np.unique(shard).tolist():
                mine = shard == s
                yield "words", s, None, pack(word[mine], narrow(total[mine]))

        for raws in raw_chunks(batches):
            k, c = np.unique(Tokens(raws, 1).words, return_counts=True)
            keys.append(k)
            counts.append(c.astype(U8))
            held += len(k)
            if held >= FLUSH:
                yield from batch_rows(list(send())).to_batches()
                keys, counts, held = [], [], 0
        if keys:
            yield from batch_rows(list(send())).to_batches()

    return bounded_batches(df).mapInArrow(run, SHARD_ROWS)


def _count_grams(df: DataFrame, order: int, hot: np.ndarray, shards: int) -> DataFrame:
    def run(batches):
        held: list[tuple] = []
        size = 0

        def send():
            word, run_, *contexts = (np.concatenate(x) for x in zip(*held, strict=True))
            key = mix(contexts[0], word)
            at, count = add_up(key, np.ones(len(key), U8))
            context, *lowers = (c[at] for c in contexts)
            return [("next", s, None, b) for s, b in
                    deal(order, context, lowers, run_[at], word[at], count, shards)]

        for raws in raw_chunks(batches):
            t = Tokens(raws, order)
            held.append((t.words, t.hot_run(hot, order),
                         *(t.context(k) for k in ([order, *range(order - 1, 1, -1)]))))
            size += len(t.words)
            if size >= FLUSH:
                yield from batch_rows(send()).to_batches()
                held, size = [], 0
        if held:
            yield from batch_rows(send()).to_batches()

    return bounded_batches(df).mapInArrow(run, SHARD_ROWS)


def fit(df: DataFrame, text: str = "text", order: int = ORDER, shard_tokens: int = SHARD_TOKENS,
        folder: str | None = None) -> dict:
    """Count the texts of ``df``, write the model's files in the shared folder and
    return their description: a few numbers, and the totals of hot words' contexts."""
    spark = df.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/lm-{uuid.uuid4().hex}"
    rows = df.select(utf8(F.col(f"`{text}`")).alias("raw"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    word_shards = max(width, -(-size // (WORD_BYTES * shard_tokens)))

    def merged(parts: DataFrame, merge, n: int) -> DataFrame:
        """One task for each shard, however many there are."""
        return cut_lineage(parts.repartition(n, "shard").groupBy("shard").applyInArrow(merge, SHARD_ROWS))

    def merge(k: int):
        return lambda table: merge_grams(table, k, folder, shards)

    done = merged(_count_words(rows, word_shards), lambda table: merge_words(table, folder), word_shards)
    types, n_tokens = _sums(done, 2)
    shards = max(width, -(-n_tokens // shard_tokens))
    # words with a quarter of a shard's share: fewer than 4 * shards
    often = done.filter("kind = 'top'").filter(F.col("counts")[1] * 4 * shards > n_tokens).select(F.col("counts")[0].alias("word"))
    hot = np.sort(np.array([r.word for r in often.collect()], np.int64).view(U8))
    drop_lineage_table(done)
    model = {"order": order, "tokens": n_tokens, "types": types, "folder": folder,
             "word_shards": word_shards, "shards": shards, "hot": hot, "levels": {}}
    parts = _count_grams(rows, order, hot, shards)
    before = None
    for k in range(order, 0, -1):
        done = merged(parts, merge(k), shards)
        if before is not None:
            drop_lineage_table(before)
        model["levels"][k] = {"hot": _hot(done), "discounts": discounts(_sums(done, 4))}
        parts, before = done.filter("kind = 'next'"), done
    drop_lineage_table(before)
    return model


def _sums(done: DataFrame, n: int) -> list[int]:
    """Sums of the shards' counts."""
    got = done.filter("kind = 'shard'").agg(*[F.sum(F.col("counts")[i]) for i in range(n)]).first()
    return [x or 0 for x in got]


def _hot(done: DataFrame) -> list[np.ndarray]:
    """Totals of the contexts of hot words, of which there are at most four a shard."""
    parts = [unpack(r.blob) for r in done.filter("kind = 'hot'").select("blob").collect()]
    if not parts:
        return [np.zeros(0, U8)] * 5
    names, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return [names, *(np.bincount(of, np.concatenate([p[i] for p in parts]), len(names)).astype(U8)
                     for i in range(1, 5))]


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of n-grams counted 1, 2, 3 and 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out = []
    for i in (1, 2, 3):
        d = i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.0
        out.append(d if 0 < d <= i else 0.5)
    return out


# scoring -------------------------------------------------------------------------------
class Model:
    """Look-ups in the mapped files of a fitted model."""

    def __init__(self, model: dict):
        self.m, self.maps = model, {}

    def arrays(self, name: str) -> list[np.ndarray]:
        """The columns of a shard's file; none if the shard has no file."""
        if name not in self.maps:
            self.maps[name] = mapped_arrays(f"{self.m['folder']}/{name}")
        return self.maps[name]

    def look_up(self, kind: str, shard: np.ndarray, wanted: np.ndarray, first: int, n: int) -> np.ndarray:
        """The n numbers of each wanted hash (0 where there is none)."""
        distinct, place, back = np.unique(wanted, return_index=True, return_inverse=True)
        home = shard[place]
        out = np.zeros((n, len(distinct)))
        order = np.argsort(home, kind="stable")
        edges = np.flatnonzero(np.diff(home[order])) + 1
        for part in np.split(order, edges):
            columns = self.arrays(f"{kind}-{int(home[part[0]])}") if len(part) else []
            if columns:
                keys, *values = columns[first:first + n + 1]
                there, at = found(keys, distinct[part])
                for i, v in enumerate(values):
                    out[i, part[there]] = v[at[there]]
        return out[:, back]

    def base_counts(self, words: np.ndarray) -> np.ndarray:
        home = (mix(words, U8(2)) % U8(self.m["word_shards"])).astype(np.int32)
        return self.look_up("words", home, words, 0, 1)[0]

    def probabilities(self, t: Tokens) -> np.ndarray:
        order, shards = self.m["order"], self.m["shards"]
        run = t.hot_run(self.m["hot"], order)
        p = np.full(len(t.words), 1.0 / (self.m["types"] + 1))
        for k in range(1, order + 1):
            level = self.m["levels"][k]
            context, hot = t.context(k), run >= k - 1
            count = self.look_up(f"grams{k}", shard_of(context, t.words, hot, shards), mix(context, t.words), 0, 1)[0]
            sums = self.look_up(f"grams{k}", shard_of(context, t.words, np.zeros(len(hot), bool), shards), context, 2, 4)
            there, at = found(level["hot"][0], context)
            for i in range(4):
                sums[i][there] = level["hot"][i + 1][at[there]] if there.any() else 0
            d = np.array([0.0, *level["discounts"]])
            left = np.maximum(count - d[np.minimum(count, 3).astype(int)], 0)
            seen = sums[0] > 0
            total = np.where(seen, sums[0], 1)
            weight = (d[1] * sums[1] + d[2] * sums[2] + d[3] * sums[3]) / total
            p = np.where(seen, left / total + weight * p, p)
        return p

    def score(self, raws: list[bytes]) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        t = Tokens(raws, self.m["order"])
        first = np.cumsum(t.sizes) - t.sizes
        c = self.base_counts(t.words)
        base = np.log10((c + 0.1) / (self.m["tokens"] + 0.1 * (self.m["types"] + 1)))
        # extended precision: a long text's sum does not depend on its order
        sums = [np.add.reduceat(x.astype(np.longdouble), first).astype(np.float64)
                for x in (base, np.log10(self.probabilities(t)))]
        return t.sizes, np.add.reduceat((c > 0).astype(np.int64), first), *sums


def score(df: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_tokens, n_known, base_score and score (log10) to the ``keep`` columns."""
    # a few numbers and the hot contexts, at most four a shard: not the counts
    shared = df.sparkSession.sparkContext.broadcast(model)
    d = df.withColumn("__raw", utf8(F.col(f"`{text}`")))
    name = uuid.uuid4().hex

    def make():
        scorer = worker_cache(f"lm {name}", lambda: Model(shared.value))

        def run(raws: pa.Array) -> list[pa.Array]:
            got = [scorer.score(part) for part in text_chunks(raws.to_pylist())]
            cols = [np.concatenate(x) for x in zip(*got, strict=True)] or [np.zeros(0)] * 4
            return [pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()),
                                                   strict=True)]

        return run

    return map_batches(d, ["__raw"], RESULT, df.columns if keep is None else keep, make)


def perplexity(score_: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score_ / n_tokens)
