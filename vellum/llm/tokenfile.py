"""Token ids as binary files with Elias-Fano document boundaries (operator 9).

A table becomes a set of files in ascending id order.  A file holds its
documents' ids side by side (16 bits each if the vocabulary allows, else 32),
the documents' ends and their ascending doc_ids as Elias-Fano sequences, and a
footer; there is no table of 64-bit offsets.  There are as many files as the texts'
bytes ask for (`FILE_BYTES`), and one for each shuffle partition at least.  File i
holds the documents between two quantiles of doc_id; an id that fills more than two
files by itself, the null id too, has files of its own, in order of its rows' hashes.
The quantiles come from the id column alone, and each text is encoded once, before its
ids move.  A file is written as a stream by the
task that sorts its documents.  The manifest (a row per file) is a table in the
shared folder and gives each file the ids of all files before it.

Texts are encoded by the tokenizers library.  Its normalizer and its split never
join characters across ASCII white space, so texts are cut there and each distinct
word is encoded once for a batch and kept for later ones; `exact_split` checks
these conditions on the tokenizer and other tokenizers get whole texts.

Edge cases: a null or empty text has the end id alone; very long texts are encoded
whole; rows with a null id come first; rows of equal id stand side by side, in order of
their ids within a file; repeated rows are separate documents; extra columns, of any
name, are not read; an empty table writes no file and reads as an empty table.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import eliasfano
from vellum.llm.common import map_batches, worker_cache
from vellum.llm.shared_files import Writer, local_map
from vellum.session import checkpoint_dir, cut_lineage

MAGIC = b"TOKFILE1"
NULL_ID = -(1 << 63)   # the null id's place among the others
FOOTER = "<QQQQQqQ8s"  # docs, null ids, ids, bytes an id, place of ends, least id, place of ids
FILE_BYTES = 1 << 30   # bytes of text that a file holds, about
CHUNK = 1 << 22       # bytes of text whose new words are encoded together
TOGETHER = 500        # words in one call's text
WORDS_KEPT = 400_000  # memoised words in a worker; more are encoded again each time
CLOSING = b".,;:!?"
# Fixed value: a split that parts letters, digits and other signs.
LETTER_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def exact_split(spec: dict) -> bool:
    """True if encoding word by word equals encoding the whole text: white space
    is collapsed and then dropped, letters are folded, and no step reads over it."""
    steps = spec.get("normalizer") or {}
    steps = [s["type"] for s in steps.get("normalizers", [steps]) if s]
    pre = spec.get("pre_tokenizer") or {}
    pre = [(p["type"], p.get("behavior"), p.get("add_prefix_space")) for p in pre.get("pretokenizers", [pre]) if p]
    return (set(steps) == {"NFC", "Replace", "Lowercase"}
            and bool(pre) and pre[0][:2] == ("Split", "Removed")
            and all(p[0] in ("Split", "ByteLevel") and not p[2] for p in pre))


class WordEncoder:
    """Ids of texts, word by word, as bytes of ``dtype`` numbers.

    Where the split is `LETTER_SPLIT`, a folded word of ASCII letters is one unit
    that goes straight to the library's merges, and closing punctuation is a unit of
    its own and is cut off first.  Other words of letters go to the library many at a
    time, with blanks between them: each is one unit and so has one token with the
    end-of-word suffix, which tells them apart again.  The rest go one by one.
    """

    def __init__(self, spec: str):
        # one task has one core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.dtype = id_type(self.tok.get_vocab_size())
        parsed = json.loads(spec)
        self.by_word = exact_split(parsed)
        suffix = parsed["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        pre = parsed.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [pre])[0]
        letters = suffix and (first.get("pattern") or {}).get("Regex") == LETTER_SPLIT
        self.closing = CLOSING if letters else b""
        self.letters = bool(letters)
        self.raw_ids = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tok.get_vocab_size())]
        self.special = [t["content"].lower() for t in parsed.get("added_tokens", [])]
        self.kept: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def fresh(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Encode words that are not kept."""
        out, texts = {}, []
        merge, raw_id = self.tok.model.tokenize, self.raw_ids
        for w in words:
            if self.letters and w.isalpha():  # ASCII letters: one unit, which no step alters
                out[w] = b"".join([raw_id[t.id] for t in merge(w.decode())])
            else:
                texts.append(w.decode())
        plain = [t for t in texts if self.letters and t.isalpha()]
        other = [t for t in texts if not (self.letters and t.isalpha())]
        groups = [plain[i:i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        found = self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for g, e in zip(groups, found, strict=True):
            ids = np.array(e.ids, self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(g):  # folding a letter made another unit
                other += g
                continue
            raw, size = ids.tobytes(), ids.itemsize
            edges = [0, *(stops * size).tolist()]
            out.update((t.encode(), raw[i:j]) for t, i, j in zip(g, edges, edges[1:], strict=False))
        out.update(zip([t.encode() for t in other], self.whole(other), strict=True))
        return out

    def core(self, word: bytes) -> bytes:
        """The word without closing punctuation that follows a letter or digit."""
        cut = word.rstrip(self.closing) if self.closing else word
        if cut and cut is not word:
            last = cut.decode()[-1].lower()
            return cut if len(last) == 1 and last.isalnum() else word
        return word

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not kept; kept from now on while there is room."""
        core = [self.core(w) for w in words]
        tail = [w[len(c):] for w, c in zip(words, core, strict=True)]
        need = ({*core, *tail} - {b""}).difference(self.kept)
        now = self.fresh(list(need))
        now[b""] = b""
        get = lambda w: now[w] if w in now else self.kept[w]
        now.update({w: get(c) + get(t) for w, c, t in zip(words, core, tail, strict=True) if t})
        if len(self.kept) + len(now) <= WORDS_KEPT:
            self.kept.update(now)
        return now

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; nulls count as empty."""
        if not self.by_word:
            return self.whole([t or "" for t in texts.to_pylist()])
        out, at = [], 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
        while at < len(texts):
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
            out += self.encode_chunk(texts.slice(at, stop - at).fill_null(""))
            at = stop
        return out

    def encode_chunk(self, texts: pa.Array) -> list[bytes]:
        folded = pc.ascii_lower(texts)  # the normalizer folds letters too
        words = pc.ascii_split_whitespace(folded)
        sizes = pc.list_value_length(words).to_numpy()
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        get = self.kept.get
        ids = [get(w) for w in distinct]
        new = [i for i, x in enumerate(ids) if x is None]
        if new:
            now = self.learn([distinct[i] for i in new])
            for i in new:
                ids[i] = now[distinct[i]]
        # the ids of all words, side by side, from those of the distinct ones
        width = self.dtype.itemsize
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        starts = np.cumsum(lengths) - lengths
        which = coded.indices.to_numpy()
        n = lengths[which]
        stops = np.cumsum(n)
        places = np.repeat(starts[which] - (stops - n), n) + np.arange(stops[-1] if len(stops) else 0)
        raw = np.frombuffer(b"".join(ids), self.dtype)[places].tobytes()
        edges = np.concatenate(([0], stops))[np.concatenate(([0], np.cumsum(sizes)))] * width
        out = [raw[i:j] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        for x in self.special:
            for i in np.flatnonzero(pc.match_substring(folded, x).to_numpy(zero_copy_only=False)):
                out[i] = self.whole([texts[int(i)].as_py()])[0]
        return out


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


class TokenFileWriter:
    def __init__(self, folder: str, no: int, width: int):
        self.out, self.width = Writer(folder, f"tokens-{no:06d}"), width
        self.ends: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.total = self.docs = self.nulls = 0

    def add(self, doc_ids: pa.Array, ids: list[bytes]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        self.out.write(b"".join(ids))
        self.ends.append(self.total + np.cumsum(sizes))
        self.total += int(sizes.sum())
        self.docs += len(ids)
        self.nulls += doc_ids.null_count
        self.ids.append(doc_ids.drop_null().to_numpy())

    def close(self) -> str:
        ids = np.concatenate(self.ids).astype(np.int64)
        least = int(ids[0]) if len(ids) else 0
        ends = self.out.write(eliasfano.encode(np.concatenate(self.ends)))
        # differences of 64-bit ids fit unsigned 64 bits
        places = self.out.write(eliasfano.encode(ids.view(np.uint64) - np.uint64(least % (1 << 64))))
        self.out.write(struct.pack(FOOTER, self.docs, self.nulls, self.total, self.width, ends, least, places, MAGIC))
        return self.out.close()


class TokenFile:
    """Reader of one file: documents by number."""

    def __init__(self, data: np.ndarray):
        (self.docs, self.nulls, self.total, self.width, ends, self.least, ids, magic) = struct.unpack_from(
            FOOTER, data, len(data) - struct.calcsize(FOOTER))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.tokens = data[:self.total * self.width].view(f"<u{self.width}")
        self.ends = eliasfano.Sequence(data[ends:])
        self.ids = eliasfano.Sequence(data[ids:])

    def starts(self, i: int, j: int) -> np.ndarray:
        """First places of documents i to j, and the end of the last."""
        before = np.zeros(1, np.int64) if i == 0 else self.ends.slice(i - 1, i).astype(np.int64)
        return np.concatenate((before, self.ends.slice(i, j).astype(np.int64)))

    def doc_ids(self, i: int, j: int) -> pa.Array:
        got = self.ids.slice(max(0, i - self.nulls), max(0, j - self.nulls))
        got = (got + np.uint64(self.least % (1 << 64))).view(np.int64)
        return pa.concat_arrays([pa.nulls(max(0, min(j, self.nulls) - i), pa.int64()), pa.array(got)])


def write_tokens(df: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
                 folder: str | None = None, files: int | None = None) -> DataFrame:
    """Write the files and return the manifest: (no, uri, docs, tokens, start).

    ``path`` names a tokenizer file that the driver reads; workers get its text,
    a fixed size whatever the input's.  ``files`` follows from the bytes by default.
    """
    spark = df.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    shared = spark.sparkContext.broadcast(spec)
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    key, body = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")
    if files is None:
        size = df.agg(F.sum(F.octet_length(body))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    cuts, first, width_of = _places(df.select(key.alias("id")), files)
    rows = df.select(key.alias("doc_id"), body.alias("text"))
    out = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("no", T.IntegerType())])

    def make():
        enc = worker_cache(f"tokenizer {path}", lambda: WordEncoder(shared.value))
        end = np.array([end_id], enc.dtype).tobytes()

        def run(texts: pa.Array, ids: pa.Array) -> list:
            slot = np.searchsorted(cuts, ids.fill_null(NULL_ID).to_numpy(), "right")
            coded = [x + end for x in enc.encode(texts)]
            no = first[slot]
            for i in np.flatnonzero(width_of[slot] > 1).tolist():  # one of an id's own files, by hash
                no[i] += zlib.crc32(coded[i]) * int(width_of[slot[i]]) >> 32
            return [pa.array(coded, pa.binary()), pa.array(no.astype(np.int32))]

        return run

    coded = map_batches(rows, ["text", "doc_id"], out, ["doc_id"], make)
    n = int(width_of.sum())
    placed = (coded.repartitionById(n, "no")
              .sortWithinPartitions("no", F.col("doc_id").asc_nulls_first(), "ids"))
    width = id_type(json_vocabulary(spec)).itemsize

    def write(batches):
        writer, no = None, -1

        def done():
            uri = writer.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([no], pa.int32()), pa.array([uri]), pa.array([writer.docs], pa.int64()),
                 pa.array([writer.total], pa.int64())], names=["no", "uri", "docs", "tokens"])

        for b in batches:
            nos = b.column("no").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(nos)) + 1).tolist(), len(nos)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if nos[i] != no:
                    if writer:
                        yield done()
                    no = int(nos[i])
                    writer = TokenFileWriter(folder, no, width)
                part = b.slice(i, j - i)
                writer.add(part.column("doc_id"), part.column("ids").to_pylist())
        if writer:
            yield done()

    manifest = cut_lineage(placed.mapInArrow(write, "no int, uri string, docs long, tokens long"))
    before = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _places(ids: DataFrame, files: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids that begin a slot, each slot's first file, its number of files): slots lie
    between quantiles of the ids; an id with more than two files' share of the rows is a
    slot with files of its own."""
    points = [i / files for i in range(1, files)]
    total, cuts = ids.agg(F.count(F.lit(1)), F.percentile_approx("id", points, 10 * files) if points else F.lit(None)).first()
    share = max(1.0, total / files)
    heavy = {NULL_ID if r["id"] is None else r["id"]: r["count"] for r in
             ids.groupBy("id").count().filter(F.col("count") > 2 * share).collect()}  # fewer than files / 2 rows
    edges = {*(cuts or []), *heavy, *(h + 1 for h in heavy if h < np.iinfo(np.int64).max)}
    cuts = np.array(sorted(edges), np.int64)
    width = np.ones(len(cuts) + 1, np.int64)
    for h, n in heavy.items():
        width[np.searchsorted(cuts, h, "right")] = int(-(-n // share))
    return cuts, np.cumsum(width) - width, width


def json_vocabulary(spec: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec).get_vocab_size()


def read_tokens(manifest: DataFrame, at_once: int = 4096) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files; ``ids``
    are little-endian unsigned 32-bit integers."""

    def read(batches):
        for b in batches:
            for uri, base in zip(b.column("uri").to_pylist(), b.column("start").to_pylist(), strict=True):
                f = TokenFile(local_map(uri))
                for i in range(0, f.docs, at_once):
                    j = min(i + at_once, f.docs)
                    places = f.starts(i, j)
                    ids = [f.tokens[a:z].astype("<u4").tobytes() for a, z in
                           zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [f.doc_ids(i, j), pa.array(base + places[:-1], pa.int64()),
                         pa.array(np.diff(places), pa.int64()), pa.array(ids, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])

    spread = manifest.select("uri", "start", "no")
    n = max(1, manifest.count())
    return (spread.repartitionById(n, F.pmod("no", F.lit(n))).select("uri", "start")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary"))

