"""Language identification and language-routed enrichment.

G1 (re-aimed from a statistical detector library): a character-trigram
profile learned with one ``groupBy(lang, gram)`` over labelled texts, and a
naive-Bayes score per (document, language) with add-one smoothing:

    score(d, L) = Σ_g c(d,g) · ln(c(L,g) + 1)  −  N(d) · ln(T(L) + V)

The profile, as long as it is small (its rows are counted first), goes to every task
as a sorted array of grams and a matrix of log counts, and whole texts are scored in
their rows, Arrow batch by batch: nothing is shuffled.  A larger profile is joined to
the (document, gram) counts.  Several folds are held out from one table of counts by
fold.  Texts without any letter get NULL.  Ties go to the smaller code.

G3: rows whose normalised language is supported and not English are passed
through a user batch function per language; everything else passes through
unchanged.  The work runs in ``mapInArrow``, a few rows at a time, on the rows' own partitions (no
shuffle by language), grouping by language inside each Arrow batch, so a
language holding a third of the rows is still spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import lang_code_norm
from vellum.session import cut_lineage

GRAM = 3
ROUTED_ROWS = 256         # rows whose texts are Python strings at once
PROFILE_ROWS = 2_000_000  # (language, gram) rows of a profile that every task gets: some 32 MB


def trigrams(text: str) -> F.Column:
    """Every overlapping character trigram of the lower-cased text, in one
    linear regex pass (a capturing look-ahead at each position); indexing
    by position instead would rescan long texts quadratically."""
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit("(?s)(?=(.{%d}))" % GRAM), 1)


def doc_grams(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, gram, c) — texts shorter than a trigram contribute nothing."""
    g = df.filter(F.length(text) >= GRAM).select(doc, F.explode(trigrams(text)).alias("gram"))
    return g.groupBy(doc, "gram").agg(F.count(F.lit(1)).alias("c"))


def train_profile(labelled: DataFrame, doc: str, text: str, lang: str) -> DataFrame:
    """(lang, gram, c) counts over all labelled texts."""
    g = labelled.filter(F.col(lang).isNotNull() & (F.length(text) >= GRAM)).select(
        lang, F.explode(trigrams(text)).alias("gram"))
    return g.groupBy(F.col(lang).alias("lang"), "gram").agg(F.count(F.lit(1)).alias("c"))


def detect(df: DataFrame, profile: DataFrame, doc: str, text: str, out: str = "pred_lang",
           profile_rows: int = PROFILE_ROWS) -> DataFrame:
    """(doc, out) for every row of ``df``."""
    if profile.count() <= profile_rows:
        return _detect_in_rows(df, profile, doc, text, out)
    v = profile.select(F.count_distinct("gram")).scalar()
    totals = profile.groupBy("lang").agg(F.sum("c").alias("t"))
    langs = totals.select(F.array_sort(F.collect_list(F.struct("lang", "t")))).scalar()
    dg = doc_grams(df, doc, text)
    hit = (dg.join(profile.select("lang", "gram", F.log(F.col("c") + 1).alias("lp")), "gram")
             .groupBy(doc, "lang").agg(F.sum(F.col("c") * F.col("lp")).alias("s")))
    n = dg.groupBy(doc).agg(F.sum("c").alias("n"))
    base = (df.select(doc, F.col(text).rlike(r"\p{L}").alias("_letters"))
              .join(n, doc, "left").withColumn("_langs", langs)
              .select(doc, "_letters", F.coalesce("n", F.lit(0)).alias("n"),
                      F.explode("_langs").alias("_l")))
    sc = (base.select(doc, "_letters", F.col("_l.lang").alias("lang"),
                      (-F.col("n") * F.log(F.col("_l.t") + v)).alias("const"))
              .join(hit, [doc, "lang"], "left")
              .withColumn("score", F.col("const") + F.coalesce("s", F.lit(0.0))))
    best = sc.groupBy(doc).agg(F.min_by("lang", F.struct(-F.col("score"), F.col("lang"))).alias("_p"),
                               F.first("_letters").alias("_letters"))
    return best.select(doc, F.when(F.col("_letters"), F.col("_p")).alias(out))


def gram_codes(text: str) -> np.ndarray:
    """Each trigram of a text as one whole number: three code points of 21 bits."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:] if len(c) >= GRAM else c[:0]


def _detect_in_rows(df: DataFrame, profile: DataFrame, doc: str, text: str, out: str) -> DataFrame:
    """`detect` with the profile at hand in every task."""
    p = profile.select("lang", "gram", "c").toPandas()  # counted by the caller
    langs = sorted(p["lang"].unique())
    codes = np.array([gram_codes(g)[0] for g in p["gram"]], np.int64)
    grams, row = np.unique(codes, return_inverse=True)
    column = p["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    count = np.zeros((len(grams), len(langs)))
    np.add.at(count, (row, column), p["c"].to_numpy(np.float64))
    shared = df.sparkSession.sparkContext.broadcast((langs, grams, np.log(count + 1), np.log(count.sum(axis=0) + len(grams))))
    schema = T.StructType([df.schema[doc], T.StructField(out, T.StringType())])

    def run(batches):
        names, keys, weight, total = shared.value
        for b in batches:
            found = []
            for t in b.column(1).to_pylist():
                if t is None or not names:
                    found.append(None)
                    continue
                g = gram_codes(t)
                at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                score = weight[at[keys[at] == g]].sum(axis=0) - len(g) * total
                found.append(names[int(score.argmax())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=schema.names)

    letters = F.col(f"`{text}`").rlike(r"\p{L}")
    return df.select(doc, F.when(letters, F.lower(F.col(f"`{text}`"))).alias("_t")).mapInArrow(run, schema)


def detect_held_out(df: DataFrame, doc: str, text: str, lang: str, fold: str, n_folds: int) -> DataFrame:
    """(doc, pred_lang): each fold scored by the profile of the other folds, whose gram
    counts are made once, by fold."""
    labelled = df.filter(F.col(lang).isNotNull() & (F.length(text) >= GRAM))
    counts = cut_lineage(labelled.select(F.col(fold).alias("fold"), F.col(lang).alias("lang"), F.explode(trigrams(text)).alias("gram"))
                         .groupBy("fold", "lang", "gram").agg(F.count(F.lit(1)).alias("c")))
    out = None
    for f in range(n_folds):
        profile = counts.filter(F.col("fold") != f).groupBy("lang", "gram").agg(F.sum("c").alias("c"))
        part = detect(df.filter(F.col(fold) == f), profile, doc, text)
        out = part if out is None else out.unionByName(part)
    return out


def language_routed(df: DataFrame, lang: str, columns: Sequence[str],
                    fn: Callable[[str, pd.Series], pd.Series]) -> DataFrame:
    """Add ``<col>_en`` for each of ``columns``: ``fn(norm_lang, texts)`` for
    rows in a supported non-English language, the original text otherwise."""
    norm = lang_code_norm(lang)
    routed = F.coalesce(norm.isNotNull() & (norm != "en"), F.lit(False))
    x = df.withColumn("_norm", norm)
    keep = x.filter(~routed)
    for c in columns:
        keep = keep.withColumn(f"{c}_en", F.col(c))
    todo = x.filter(routed)
    schema = T.StructType(list(todo.schema.fields) + [T.StructField(f"{c}_en", T.StringType())
                                                       for c in columns])

    names = todo.columns
    new = [f"{c}_en" for c in columns]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROUTED_ROWS):
                part = b.slice(at, ROUTED_ROWS)
                # only what the function takes becomes Python strings, a slice at a time
                codes = part.column(names.index("_norm")).to_pandas()
                out = []
                for c in columns:
                    texts = part.column(names.index(c)).to_pandas()
                    done = pd.Series([None] * len(texts), dtype=object)
                    for code, idx in codes.groupby(codes).groups.items():
                        done.loc[idx] = fn(code, texts.loc[idx]).to_numpy()
                    out.append(pa.array(done, pa.string(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*names, *new])

    done = todo.mapInArrow(run, schema)
    return keep.unionByName(done).drop("_norm")
