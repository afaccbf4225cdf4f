"""Language ID by a byte convolutional network (operator 1).

Bytes are embedded, filters of several widths slide over a window of fixed
length, each filter keeps its maximum, and a softmax layer names the language.
The network is trained in numpy on the driver, on a bounded sample: at most
``per_lang`` different labelled texts of each language, chosen by hash, one window of
each at a hashed place.  The weights, some ten thousand numbers, go to
the workers, which cut every whole text into windows side by side, score them in
batches and average the windows' probabilities by their bytes.

`known_languages` drops what is in none of the learned languages.  Its network has a
class more, ``REJECT``, that learns from the same windows with their bytes shuffled, and
a document's score must reach its language's cutoff: a low quantile of the scores of all
held-out documents whose label the network finds.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is
every text where no labelled row exists; with one learned language each text with
a letter is that language; of equally likely languages the first in code-point order
wins; texts shorter than a window are padded with zero bytes, very long ones are more
windows; repeated rows get equal answers, and are learned once; rows with a null id
count as labelled rows of fold 1; a kept column with a result's name is replaced; an
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import fold, map_batches
from vellum.session import cut_lineage

WINDOW = 256        # bytes in a window
EMBED = 8
WIDTHS = (2, 3, 4, 5)
FILTERS = 12        # of each width
PER_LANG = 1500     # labelled rows of a language that training reads at most
EPOCHS = 12
BATCH = 256         # windows scored at once
REJECT = ""         # class of shuffled windows: text in no learned language
HELD_OUT = 5        # folds, one of which is held out for the cutoffs
LOW = 0.002         # quantile of held-out scores below which a document is dropped
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()),
                       T.StructField("score", T.DoubleType())])


class ByteNet:
    """Weights as float32 arrays; ``conv`` holds all widths in one matrix whose
    rows past a filter's width are zero."""

    def __init__(self, langs: list[str], weights: dict[str, np.ndarray]):
        self.langs, self.w = langs, weights

    def windows(self, x: np.ndarray) -> np.ndarray:
        """(windows, places, bytes of a place x EMBED) of a byte matrix."""
        span = max(WIDTHS)
        e = self.w["embed"][np.pad(x, ((0, 0), (0, span - 1)))]
        view = np.lib.stride_tricks.sliding_window_view(e, span, axis=1)  # (n, places, EMBED, span)
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(*x.shape, span * EMBED)

    def forward(self, x: np.ndarray, for_training: bool = False):
        view = self.windows(x)
        n, places, k = view.shape
        out = (view.reshape(-1, k) @ self.w["conv"]).reshape(n, places, -1)
        best = out.argmax(axis=1) if for_training else None
        top = np.take_along_axis(out, best[:, None], 1)[:, 0] if for_training else out.max(axis=1)
        hidden = np.maximum(top + self.w["conv_bias"], 0)
        z = hidden @ self.w["out"] + self.w["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        p = z / z.sum(axis=1, keepdims=True)
        return (p, hidden, best, view) if for_training else p

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i:i + BATCH]) for i in range(0, len(x), BATCH)])

    def predict(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(language number, probability) of whole texts of at least one byte."""
        counts = np.array([-(-len(r) // WINDOW) for r in raws])
        owner = np.repeat(np.arange(len(raws)), counts)
        x = np.frombuffer(b"".join(r.ljust(c * WINDOW, b"\0") for r, c in
                                   zip(raws, counts.tolist(), strict=True)), np.uint8)
        p = self.probabilities(x.reshape(-1, WINDOW)).astype(np.float64)
        last = np.cumsum(counts) - 1
        weight = np.full(len(owner), float(WINDOW))
        weight[last] = [len(r) - (c - 1) * WINDOW for r, c in zip(raws, counts.tolist(), strict=True)]
        total = np.add.reduceat(p * weight[:, None], last - counts + 1, axis=0)
        total /= total.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        return best, total[np.arange(len(best)), best]


def gradients(net: ByteNet, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Derivatives of the windows' weighted cross entropy by the network's weights."""
    w, (n, span) = net.w, (len(x), max(WIDTHS))
    p, hidden, best, view = net.forward(x, True)
    d = p.copy()
    d[np.arange(n), target] -= 1
    d *= weight[:, None].astype(p.dtype)
    back = (d @ w["out"].T) * (hidden > 0)
    # only the place of a filter's maximum passes gradient on
    at_best = np.take_along_axis(view, best[:, :, None], 1)  # (n, filters, span x EMBED)
    per_place = (back[:, :, None] * w["conv"].T[None]).reshape(n, back.shape[1], span, EMBED)
    padded = np.pad(x, ((0, 0), (0, span - 1)))
    seen = padded[np.arange(n)[:, None, None], best[:, :, None] + np.arange(span)]
    embed = np.zeros_like(w["embed"])
    np.add.at(embed, seen.ravel(), per_place.reshape(-1, EMBED))
    return {"out": hidden.T @ d, "out_bias": d.sum(0), "conv_bias": back.sum(0),
            "conv": np.einsum("nfk,nf->kf", at_best, back) * filter_mask(), "embed": embed}


def filter_mask() -> np.ndarray:
    """Ones at the places of each filter's width."""
    span, n_filters = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((span, EMBED, n_filters), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[:width, :, i * FILTERS:(i + 1) * FILTERS] = 1
    return mask.reshape(span * EMBED, n_filters)


def untrained(langs: list[str], rng) -> ByteNet:
    n_filters, span = FILTERS * len(WIDTHS), max(WIDTHS)
    normal = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
    return ByteNet(langs, {
        "embed": normal(256, EMBED, scale=0.5), "conv": normal(span * EMBED, n_filters, scale=0.2) * filter_mask(),
        "conv_bias": np.zeros(n_filters, np.float32),
        "out": normal(n_filters, len(langs), scale=0.2), "out_bias": np.zeros(len(langs), np.float32)})


def train(texts: list[bytes], labels: list[str], seed: int = 7, epochs: int = EPOCHS) -> ByteNet:
    """Adam on cross entropy; each epoch shows random crops, so that short texts
    are learned too.  Languages weigh alike."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    net = untrained(langs, rng)
    if len(langs) < 2:
        return net
    w = net.w
    y = np.array([langs.index(v) for v in labels])
    share = len(y) / (len(langs) * np.bincount(y, minlength=len(langs)))
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            rows = order[at:at + 64]
            x = np.zeros((len(rows), WINDOW), np.uint8)
            for j, r in enumerate(rows):
                raw = texts[r]
                size = min(len(raw), int(rng.integers(16, WINDOW + 1)))
                start = int(rng.integers(0, len(raw) - size + 1))
                x[j, :size] = np.frombuffer(raw[start:start + size], np.uint8)
            step += 1
            for k, g in gradients(net, x, y[rows], share[y[rows]] / len(rows)).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                rate = 0.004 * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                w[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    return net


def sample(df: DataFrame, text: str, lang: str, per_lang: int = PER_LANG) -> tuple[list, list]:
    """Windows of at most ``per_lang`` different labelled texts per language, on the
    driver.

    Texts are chosen by their hashes, with a chance that a count per language sets, so
    that no language's texts meet in one task; copies of a text are one.
    """
    t, label = F.col(f"`{text}`"), F.col(f"`{lang}`")
    rows = df.filter(label.isNotNull() & t.rlike(r"\p{L}")).select(
        label.alias("lang"), t.alias("text"), F.pmod(F.xxhash64(t), F.lit(1 << 30)).alias("u"),
        F.pmod(F.xxhash64(t, F.lit("place")), F.lit(1 << 30)).alias("v"))
    counts = dict(rows.select("lang", "u", "v").distinct().groupBy("lang").count().collect())  # one row per language
    if not counts:
        return [], []
    chance = F.create_map(*[F.lit(x) for k, n in counts.items()
                            for x in (k, int((1 << 30) * min(1.0, 1.2 * per_lang / n)) + 1)])
    start = 1 + F.pmod(F.col("v"), F.greatest(F.length("text") - WINDOW + 1, F.lit(1)))
    few = (rows.filter(F.col("u") < chance[F.col("lang")])
           .select("lang", "u", "v", F.substring(F.col("text"), start, F.lit(WINDOW)).alias("text"))
           .dropDuplicates(["lang", "u", "v"]))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("u", "v", "text"))  # some per_lang rows
    got = few.withColumn("nth", nth).filter(F.col("nth") <= per_lang).orderBy("u", "v", "lang").collect()
    return [r.text.encode()[:WINDOW] for r in got], [r.lang for r in got]


def shuffled(texts: list[bytes], n: int, seed: int = 5) -> list[bytes]:
    """n windows with their bytes in random order."""
    rng = np.random.default_rng(seed)
    return [rng.permutation(np.frombuffer(texts[int(i)], np.uint8)).tobytes() for i in rng.integers(0, len(texts), n)]


def learn(df: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, reject: bool = False) -> ByteNet:
    """Network trained on a bounded sample of the labelled rows of ``df``; with
    ``reject``, and a class `REJECT` of shuffled windows."""
    texts, labels = sample(df, text, lang, per_lang)
    if reject and texts:
        junk = shuffled(texts, min(per_lang, len(texts)))
        texts, labels = texts + junk, labels + [REJECT] * len(junk)
    return train(texts, labels)


def known_languages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                    low: float = LOW) -> DataFrame:
    """The rows of ``df`` in a learned language, by the network and the cutoffs; all of
    them where no row has a label.  The network learns from the labelled rows outside
    one of `HELD_OUT` folds."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text}`").alias("text"),
                     F.col(f"`{lang}`").alias("lang"), (fold(F.col(f"`{doc_id}`"), HELD_OUT) == 0).alias("held_out"))
    net = learn(rows.filter("NOT held_out"), reject=True)
    if not net.langs:
        return df
    scored = cut_lineage(identify(rows, net, keep=["row", "lang", "held_out"]))
    found = scored.filter((F.col("lang_pred") != "und") & (F.col("lang_pred") != REJECT))
    cuts = (found.filter("held_out AND lang = lang_pred").groupBy("lang_pred")
            .agg(F.percentile_approx("score", low, 10_000).alias("cut")).collect())  # a row per language
    cut = F.lit(0.0)
    for r in cuts:  # a language without held-out rows has no cutoff
        cut = F.when(F.col("lang_pred") == r.lang_pred, F.lit(r.cut)).otherwise(cut)
    return found.filter(F.col("score") >= cut).select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])


def identify(df: DataFrame, net: ByteNet, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to the ``keep`` columns."""
    langs, weights = net.langs, net.w

    def make():
        model = ByteNet(langs, weights)

        def run(texts: pa.Array) -> list[pa.Array]:
            found = [t for t in texts.to_pylist()]
            use = [i for i, t in enumerate(found) if t and any(map(str.isalpha, t))] if langs else []
            names, scores = ["und"] * len(found), [0.0] * len(found)
            room = BATCH * WINDOW * 8  # bytes of texts that are held as windows at once
            while use:
                taken, size = 0, 0
                while taken < len(use) and (not taken or size + len(found[use[taken]]) <= room):
                    size += len(found[use[taken]]) + WINDOW
                    taken += 1
                part, use = use[:taken], use[taken:]
                best, score = model.predict([found[i].encode() for i in part])
                for i, b, x in zip(part, best.tolist(), score.tolist(), strict=True):
                    names[i], scores[i] = langs[b], round(min(max(x, 0.0), 1.0), 6)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return run

    return map_batches(df, [text], RESULT, df.columns if keep is None else keep, make)
