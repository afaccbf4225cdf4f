"""Text identity and embedding stage.

* One vector per *distinct* text id (E2): ids repeat when texts repeat, and
  equal texts give equal vectors, so encoding distinct ids is lossless.
* Resumable (E1): ids already present in the sink are skipped with a left
  anti join, new vectors are appended as a committed batch (`vellum.sources.ledger`) —
  running twice, or stopping at any point and running again, equals running once.  A
  dimension check guards every batch, and a sink that belongs to another dataset, or
  to another order of it, is refused (I2).
* The default encoder is a deterministic hashed character-trigram signed
  projection; a learned model plugs in as an Arrow ``mapInPandas`` function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.session import cut_lineage
from vellum.sources.ledger import Ledger


def trigram_vector(text: str, dim: int) -> np.ndarray:
    """L2-normalised signed counts of hashed code-point trigrams."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le"), "<u4").astype(np.int64)
    h = c[:-2] * 1000003 + c[1:-1] * 10007 + c[2:] * 101 if len(c) > 2 else c[:0]
    v = np.bincount(h % dim, np.where(h // dim % 2 == 0, 1.0, -1.0), dim)
    n = np.sqrt((v * v).sum())
    return (v / n if n else v).astype(np.float32)


def hashed_trigram_encoder(dim: int = 64):
    """Encoder (id, text) → (id, embedding array<float>): a text's trigrams are
    counted within its row, Arrow batch by batch, without a shuffle."""
    return pandas_encoder(lambda texts: [trigram_vector(t, dim) for t in texts], dim)


def pandas_encoder(fn: Callable[[list[str]], list[list[float]]], dim: int):
    """Wrap a batch model ``fn(texts) -> vectors`` as an Arrow mapInPandas encoder."""
    def encode(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        schema = T.StructType([df.schema[id_col], T.StructField("embedding", T.ArrayType(T.FloatType()))])

        def run(batches: Iterator[pd.DataFrame]):
            for b in batches:
                vecs = fn(b[text_col].fillna("").tolist())
                yield pd.DataFrame({id_col: b[id_col], "embedding": [np.asarray(v, np.float32) for v in vecs]})
        return df.select(id_col, text_col).mapInPandas(run, schema)
    encode.dim = dim
    return encode


def distinct_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(id_col, text_col).dropDuplicates([id_col])


def embed(df: DataFrame, id_col: str, text_col: str, encoder=None) -> DataFrame:
    enc = encoder or hashed_trigram_encoder()
    out = enc(distinct_texts(df, id_col, text_col), id_col, text_col)
    return out.withColumn("_dim_ok", F.size("embedding") == F.lit(enc.dim))


def embed_incremental(spark: SparkSession, df: DataFrame, out: str, id_col: str = "emb_id",
                      text_col: str = "full_text", encoder=None, dataset: str | None = None) -> int:
    """Append vectors for ids not yet in ``out``, as a committed batch; returns the
    number added.  With ``dataset``, the text of `dataset_key`, the sink belongs to
    that dataset: another one, or another order of it, is refused."""
    ledger = Ledger(spark, out).recover()
    known = {b["notes"].get("dataset") for b in ledger.batches()} - {None}
    if dataset is not None and known and known != {dataset}:
        raise ValueError(f"{out} belongs to dataset {sorted(known)[0]}, not {dataset}: data or order have changed")
    todo = distinct_texts(df, id_col, text_col)
    if (held := ledger.rows()) is not None:
        todo = todo.join(held.select(id_col), id_col, "left_anti")
    new = cut_lineage(embed(todo, id_col, text_col, encoder))
    bad = new.filter(~F.col("_dim_ok")).count()
    if bad:
        raise ValueError(f"{bad} vectors with the wrong dimension")
    return ledger.append(new.drop("_dim_ok"), notes={"dataset": dataset} if dataset is not None else None)


def fingerprint(df: DataFrame, id_col: str) -> DataFrame:
    """Order-free dataset fingerprint: row count and the sum of the ids' first 48
    md5 bits (a xor would cancel duplicates)."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 12), 16, 10)
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(h.cast("decimal(20,0)")).cast("decimal(38,0)").alias("hash_sum"))


#: Modulus (a prime under 2^31, so products fit 63 bits) and bases of the two hashes.
PRIME, BASES = 2147483647, (1000003, 998244353)


def ordered_fingerprint(df: DataFrame, text_col: str, order: list[str]) -> DataFrame:
    """One row (n_rows, hash_a, hash_b) that changes with any text, its place or their
    number.

    A sequence's hash is the polynomial sum of h_i * B^(n - 1 - i), which is associative
    with its length: (m, x) and (n, y) side by side give (m + n, x * B^n + y).  Rows are
    sorted by range, each task folds its rows, and the tasks' few numbers, in order of
    their ranges, give the whole.  Rows of equal ``order`` go by their texts.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    h = [F.conv(F.substring(F.md5(text), at, 8), 16, 10).cast("long") % PRIME for at in (1, 9)]
    keys = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)]
    rows = df.select(*keys, F.md5(text).alias("md5"), h[0].alias("h0"), h[1].alias("h1"))
    by = [*(f"o{i}" for i in range(len(order))), "md5"]

    def fold(batches):
        n, values, powers, first = 0, [0, 0], [1, 1], None
        for b in batches:
            if not b.num_rows:
                continue
            size = b.num_rows
            for i, base in enumerate(BASES):
                hashes = b.column(i).to_numpy()
                while len(hashes) > 1:  # halves side by side, each pair one step further
                    odd = len(hashes) % 2
                    if odd:
                        hashes = np.concatenate(([0], hashes))
                    hashes = (hashes[::2] * base + hashes[1::2]) % PRIME
                    base = base * base % PRIME
                step = pow(BASES[i], size, PRIME)
                values[i] = (values[i] * step + int(hashes[0])) % PRIME
                powers[i] = powers[i] * step % PRIME
            n += size
        from pyspark import TaskContext
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], pa.int64()) for x in (TaskContext.get().partitionId(), n, *values, *powers)],
                names=["part", "n", "v0", "v1", "p0", "p1"])

    parts = rows.orderBy(*by).select("h0", "h1").mapInArrow(fold, "part long, n long, v0 long, v1 long, p0 long, p1 long")
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "a", "b")])
    # a row for each task
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("part", "n", "v0", "v1", "p0", "p1"))), zero, lambda s, x: F.struct(
        (s["n"] + x["n"]).alias("n"), ((s["a"] * x["p0"] + x["v0"]) % PRIME).alias("a"), ((s["b"] * x["p1"] + x["v1"]) % PRIME).alias("b")))
    return parts.agg(whole.alias("w")).select(F.col("w.n").alias("n_rows"), F.col("w.a").alias("hash_a"), F.col("w.b").alias("hash_b"))


def dataset_key(df: DataFrame, text_col: str, order: list[str]) -> str:
    """The ordered fingerprint as one text, for `embed_incremental`."""
    r = ordered_fingerprint(df, text_col, order).first()
    return f"{r.n_rows}-{r.hash_a:08x}{r.hash_b:08x}"
