"""Token files, top-k search, mixing, chats, near-duplicates, pipeline."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from helpers import (DOCS, Union, brute_components, brute_fingerprint, document_rows, duck, frame, same_rows)
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vellum.llm import catalog, chat, eliasfano, langid, mixing, simhash, tokenfile, topk
from vellum.llm.common import documents
from vellum.llm.components import components

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1), max_size=300), st.integers(0, 60), st.data())
def test_elias_fano_round_trip(values, shift, data):
    v = np.sort(np.array(values, np.uint64) >> np.uint64(shift))
    raw = np.frombuffer(eliasfano.encode(v), np.uint8)
    s = eliasfano.Sequence(raw)
    assert s.size == len(raw) and s.slice(0, len(v)).tolist() == v.tolist()
    if len(v):
        i = data.draw(st.integers(0, len(v) - 1))
        j = data.draw(st.integers(i, len(v)))
        assert s.select(i) == v[i] and s.slice(i, j).tolist() == v[i:j].tolist()


def test_elias_fano_is_small():
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 30, 100_000))
    assert len(eliasfano.encode(v)) * 8 / len(v) < 2 + np.log2((1 << 30) / len(v)) + 2
    with pytest.raises(ValueError):
        eliasfano.encode(np.array([2, 1]))


def test_word_encoding_equals_whole_texts():
    with open(WORD_BPE, encoding="utf-8") as f:
        enc = tokenfile.WordEncoder(f.read())
    tok, rng = Tokenizer.from_file(WORD_BPE), random.Random(2)
    assert enc.by_word and enc.letters
    kinds = ["ab \n", "the ing tion's'll é", "Áé \t́", "ΑΣ Σς ", "01 $%'\x1c\x85  x", "İIıſK ﬁ가각",
             "ab.,;:!? 's", "".join(map(chr, range(1, 1500)))]
    texts = ["".join(rng.choice(k) for _ in range(rng.randint(0, 40))) for k in kinds for _ in range(200)]
    texts += ["a <|endoftext|> b", "<|STARTOFTEXT|>", "x<|startoftext|>y z"]
    got = enc.encode(pa.array(texts))
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files_hold_every_document(spark, tmp_path):
    df = frame(spark)
    manifest = tokenfile.write_tokens(df, WORD_BPE, 2, folder=str(tmp_path), files=3)
    rows = tokenfile.read_tokens(manifest, at_once=7).collect()
    tok, at = Tokenizer.from_file(WORD_BPE), 0
    want = collections.Counter()
    for r in df.collect():
        want[r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [2])] += 1
    got = collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows)
    assert got == want
    rows.sort(key=lambda r: r.start)
    order = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert order == sorted(order)
    for r in rows:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    none = tokenfile.write_tokens(df.limit(0), WORD_BPE, 2, folder=str(tmp_path / "none"), files=3)
    assert tokenfile.read_tokens(none).count() == 0


def test_token_files_of_one_id_are_split(spark, tmp_path):
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i % 50} of {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = tokenfile.write_tokens(df, WORD_BPE, 2, folder=str(tmp_path), files=12)
    docs = [r.docs for r in manifest.collect()]
    assert len(docs) > 12 and max(docs) < 120 and sum(docs) == 600
    got, tok, at = sorted(tokenfile.read_tokens(manifest).collect(), key=lambda r: r.start), Tokenizer.from_file(WORD_BPE), 0
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = collections.Counter((i, tuple(tok.encode(t, add_special_tokens=False).ids + [2])) for i, t in rows)
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want


def test_top_k_with_ties_and_bad_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.25, 0.5]) for _ in range(4)], "x") for i in range(300)]
    rows[3] = (3, None, "x")
    rows[4] = (4, [1.0, None, 0.0, 0.0], "x")
    rows[6] = (6, [float("nan"), 0.0, 0.0, 0.0], "x")
    rows[7] = (7, [float("inf"), 0.0, 0.0, 0.0], "x")
    rows[8] = (8, [], "x")
    rows[9] = (9, [0.5], "x")
    rows[11] = rows[10]
    rows[12] = (None, [0.5, 0.5, 0.5, 0.5], "x")
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5], "x") for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    rows = [*rows, rows[20], rows[20], rows[21]]  # a query's row three times, a candidate's twice
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    got = topk.top_k(df, F.col("id") % 10 == 0, block=37, queries=7)
    held = [(i, tuple(int(256 * x // 1) for x in v)) for i, v, _ in rows if i is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in held:
        if q % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in held if i != q)
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:5], 1)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    same_rows(topk.top_k(df, F.col("id") % 50 == 0), catalog.ORACLE["op6_top_k"], embeddings=df.filter("size(embedding) = 4"))
    assert topk.top_k(df.limit(0), F.col("id") % 10 == 0).count() == 0
    two = topk.top_k(df.filter("vec_id IN (0, 1, 2)"), F.col("id") == 0)
    assert two.count() == 2


def test_mix_matches_sql_and_targets(spark):
    df = frame(spark, document_rows(6, 300))
    got = mixing.mix(df)
    assert got.count() == df.count()
    same_rows(got, catalog.ORACLE["op5_mix_sources"], documents=df)
    assert got.filter("taken > 2 * size").isEmpty()
    by = got.join(mixing.sized(df).select("doc_id", "source").distinct(), "doc_id").collect()
    assert by
    per = collections.defaultdict(int)
    for r in got.collect():
        per[r.source_size, r.target] += r.taken
    assert all(abs(v - k[1]) <= 1 for k, v in per.items())
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, mixing.mix(df).collect()), key=str)


@pytest.mark.parametrize("where", ["false", "text IS NULL OR text = ''", "doc_id = 1", "source = 'src1'"])
def test_mix_edges(spark, where):
    df = frame(spark).filter(where)
    got = mixing.mix(df)
    assert got.count() == df.count()
    assert got.filter("taken < 0 OR taken > 2 * size").isEmpty()
    assert mixing.mixed_documents(df).columns == df.columns


def test_mixed_documents_of_sources_that_share_ids(spark):
    """Copies go to the rows that the mix took, whatever ids they share."""
    rows = [(i, f"{' '.join(f'w{k}' for k in range(10))} {src} {j}", "en", src, 1)
            for src, n in (("a", 80), ("b", 80), ("c", 80), (None, 80)) for j in range(n) for i in [7 if j % 2 else None]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    size = collections.Counter(r[3] for r in rows for _ in r[1].split())
    want = {r.source: r.target for r in mixing.targets(mixing.sized(df)).collect()}
    got = collections.Counter()
    for r in mixing.mixed_documents(df).collect():
        got[r.source] += len(r.text.split())
    assert set(got) == {"a", "b", "c", None}
    for source, target in want.items():
        assert target <= got[source] <= target + 13 and got[source] <= 2 * size[source]


CLASHES = ["row", "ids", "kept", "score", "n_words", "failed", "__key", "__row", "m_copies", "key", "copies", "id", "hash", "size",
           "taken", "u", "held_out", "lang_pred", "fp", "fingerprint", "all", "no", "copy", "base_failed", "__text", "__in0"]


def test_stages_carry_columns_of_any_name(spark):
    df = frame(spark, [r[:5] for r in document_rows(4, 80)], ", ".join(DOCS.split(", ")[:5]))
    wide = df.select("*", *[F.concat(F.lit(c), F.lit(" of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c)
                            for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, "")
        assert out.columns == wide.columns and out.dtypes == wide.dtypes
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert all(r[c] == f"{c} of {'?' if r.doc_id is None else r.doc_id}" for c in CLASHES), name
        assert sorted(r.doc_id or -1 for r in rows) == sorted(r.doc_id or -1 for r in stage(spark, df, "").collect()), name


def test_mixed_documents_repeat_whole_rows(spark):
    df = frame(spark, document_rows(6, 200))
    copies = collections.Counter((r.doc_id, r.text) for r in mixing.mixed_documents(df).collect())
    want = collections.Counter()
    for r in mixing.mix(df).filter("taken > 0").collect():
        want[r.doc_id] += -(-r.taken // r.size)
    got = collections.Counter()
    for (i, _), n in copies.items():
        got[i] += n
    assert got == want


CHAT = [
    (1, 0, "user", "Hello there all.\nHow do I join tables\nin Spark?\n\nThanks a lot"),
    (1, 1, "assistant", "> How do I join\n> tables in Spark?\nUse join."),
    (1, 2, "user", "An unrelated question"),
    (1, 3, "user", "bob wrote:\n>> how do i JOIN tables\n> Use join.\n\nWhich kind?"),
    (1, 4, "assistant", "> Which kind?\nInner.\n> no such line"),
    (1, 5, "user", "> nothing like this\nhm"),
    (2, 0, "user", "> Use join.\nother conversation"), (2, 1, None, None), (None, 0, "user", "> x"),
    (2, None, "user", "plain > not quote"), (3, 0, "u", "same"), (3, 1, "u", "same"),
    (3, 2, "u", "> same\nyes"), (3, 2, "u", "> same\nyes"), (3, 3, "u", ""), (3, 4, "u", "> yes"),
]


def test_chat_links_and_sql(spark):
    df = spark.createDataFrame([(*r, "x") for r in CHAT], "conv_id long, turn long, role string, text string, own string")
    got = chat.link(df)
    same_rows(got, catalog.ORACLE["op7_chat_format"], conversations=df)
    reply = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.text) for r in got.collect()}
    assert reply[1, 1] == (0, 0, "Use join.") and reply[1, 3] == (1, 0, "Which kind?")
    assert reply[1, 4][:2] == (3, 0) and reply[1, 5] == (None, 5, "hm") and reply[3, 4] == (2, 0, "")
    assert chat.link(df.limit(0)).count() == 0


def test_quoted_turns_are_linked(spark):
    rows = [(c, t, "user" if t % 2 else None, f"Talk {c} begins with turn {t}.\nIt has a second line of {t * 7 + c} words, or more.")
            for c in range(6) for t in range(8)] + [(2, 9, "u", None), (None, 1, "u", "x"), (3, None, "u", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sent = chat.quote_previous(df)
    assert sent.count() == len(rows) and sent.filter("text LIKE '%>> %'").count() > 5
    got = {(r.conv_id, r.turn): r for r in chat.link(sent).collect()}
    for c, t, _, text in rows:
        r = got[c, t]
        if c is None or t is None or text is None:
            continue
        assert r.text == text  # no quote is left
        assert r.reply_to == (t - 1 if t and (c + t) % 4 else None)


def test_very_long_messages(spark):
    first = "\n".join(f"line number {i} of a long text" for i in range(20_000))
    rows = [(1, 0, "u", first), (1, 1, "u", "> line number 777 of a long text\nyes"), (1, 2, "u", "> " + "z" * 200_000 + "\nno")]
    got = {r.turn: r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].reply_to == 0 and got[2].reply_to is None and got[0].text == first


def test_fingerprints_and_components(spark):
    df = frame(spark, document_rows(7, 150))
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == df.count()
    text = collections.defaultdict(set)
    for r in df.collect():
        text[r.doc_id].add(brute_fingerprint(r.text))
    groups, first = brute_components([r.fingerprint for r in rows], 2), {}
    for r in rows:
        assert r.fingerprint in text[r.doc_id]
        assert r.group_fp == groups[r.fingerprint]
        first.setdefault(r.group_fp, set()).add(r.doc_id)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in first.items()}
    assert all(r.component_id == least[r.group_fp] for r in rows)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(least.values())
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_text_fingerprint(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    want = brute_fingerprint(text)
    assert simhash.fingerprint(text.encode(), 3) == want
    monkeypatch.setattr(simhash.word_chunks, "__defaults__", (50,))
    assert simhash.fingerprint(text.encode(), 3) == want


@pytest.mark.parametrize("bits,cell", [(2, 64), (2, 10 ** 6), (2, 1), (3, 20), (4, 5)])
def test_links_of_crowded_cells(spark, bits, cell):
    rng, fps = random.Random(2), set()
    for _ in range(3):
        base = rng.getrandbits(64)
        for _ in range(150):
            x = base
            for k in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << k
            fps.add(simhash.signed(x))
    df = spark.createDataFrame([(x,) for x in sorted(fps)], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df, bits, cell)).collect()}
    assert {x: got.get(x, x) for x in fps} == brute_components(fps, bits)


def test_second_pivots_part_crowded_cells(spark):
    """Fingerprints that share a block, and little else, need no bit flips."""
    rng = random.Random(6)
    fps = {simhash.signed(rng.getrandbits(43) << 21 | 5) for _ in range(400)}
    fps |= {x ^ (1 << 30) for x in list(fps)[:20]}
    fps |= {simhash.signed(simhash.blocks(3)[1] ^ (1 << a) ^ (1 << b)) for a in range(12) for b in range(a)}
    df = spark.createDataFrame([(x,) for x in sorted(fps)], "fp long")
    shares = {r.way: r.fingerprints for r in simhash.search_shares(df, 2, 20).collect()}
    assert shares["second level"] >= 40 and 0 < shares["bit flips"] <= 66
    got = {r.node: r.root for r in components(simhash.links(df, 2, 20)).collect()}
    assert {x: got.get(x, x) for x in fps} == brute_components(fps, 2)


def test_components_of_chains_and_stars(spark):
    rng, u = random.Random(3), Union()
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(40)]
    edges += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(7, 7), (500, 500)]
    for a, b in edges:
        u.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(u.find(x) == got.get(x, x) for e in edges for x in e)


def test_pipeline_equals_plain_version(spark, tmp_path):
    rows = [r[:5] for r in document_rows(8, 240)]
    schema = ", ".join(DOCS.split(", ")[:5])
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs = documents(spark, str(tmp_path))
    names, verdicts = duck(catalog.ORACLE["op2_quality_rules"], documents=docs)
    good = collections.Counter(v[0] for v in verdicts if v[names.index("kept")])
    stage = dict(corpus_pipeline.STAGES)
    state = stage["quality_rules"](spark, docs, "")
    assert collections.Counter(r.doc_id for r in state.collect()) == good
    state.write.parquet(str(tmp_path / "1"))
    state = spark.read.parquet(str(tmp_path / "1"))
    held = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % langid.HELD_OUT == 0
    net = langid.learn(state.filter(F.crc32(F.col("doc_id").cast("string")) % langid.HELD_OUT != 0).unionByName(
        state.filter("doc_id IS NULL")), reject=True)
    scored = []
    for r in state.collect():
        if any(map(str.isalpha, r.text)):
            best, score = net.predict([r.text.encode()])
            scored.append((r, net.langs[best[0]], round(float(score[0]), 6)))
    cut = {}
    for name in net.langs:
        mine = sorted(x for r, n, x in scored if n == name == r.lang and held(r))
        cut[name] = mine[max(0, -int(-len(mine) * langid.LOW // 1) - 1)] if mine else 0.0
    want = [r for r, name, x in scored if name != langid.REJECT and x >= cut[name]]
    state = stage["language_id"](spark, state, "")
    assert sorted(map(str, state.collect())) == sorted(map(str, want))
    state.write.parquet(str(tmp_path / "2"))
    state = spark.read.parquet(str(tmp_path / "2"))
    groups, first = brute_components([brute_fingerprint(r.text) for r in want], 2), {}
    for r in want:
        first.setdefault(groups[brute_fingerprint(r.text)], set()).add(r.doc_id)
    least = [min((i for i in ids if i is not None), default=None) for ids in first.values()]
    state = stage["near_duplicates"](spark, state, "")
    assert collections.Counter(r.doc_id for r in state.collect()) == collections.Counter(least)
    state.write.parquet(str(tmp_path / "3"))
    state = spark.read.parquet(str(tmp_path / "3"))
    names, mixed = duck(catalog.ORACLE["op5_mix_sources"], documents=state)
    at = {c: names.index(c) for c in names}
    want = collections.Counter({m[at["doc_id"]]: -(-m[at["taken"]] // m[at["size"]]) for m in mixed if m[at["taken"]]})
    state = stage["mix_sources"](spark, state, "")
    assert state.columns == docs.columns
    assert collections.Counter(r.doc_id for r in state.collect()) == want
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert collections.Counter(r.doc_id for r in last.collect()) == want


def test_pipeline_of_an_empty_table_and_extra_columns(spark, tmp_path):
    df = frame(spark)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, df, "")
        assert name == "encode" or out.columns == df.columns
        assert f(spark, df.limit(0), "").count() == 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_match_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    got = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLE:
        tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "embeddings", "conversations", "pages")}
        same_rows(got, catalog.ORACLE[name], **tables)
    elif name == "op9_token_files":
        tok, at = Tokenizer.from_file(WORD_BPE), 0
        rows = sorted(got.collect())
        for r, d in zip(rows, documents(spark, sf).orderBy("doc_id").collect(), strict=True):
            ids = tok.encode(d.text or "", add_special_tokens=False).ids + [2]
            assert tuple(r) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
    elif name == "op13_whitening":
        assert got.count() == 16 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
    else:
        assert got.count() == documents(spark, sf).count()
