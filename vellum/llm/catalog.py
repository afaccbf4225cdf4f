"""One query for each operator: its production parameters on its whole table."""

from __future__ import annotations

import zlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import align, bpe, chat, langid, license, lm, mixing, quality, simhash, tokenfile, topk, urlfilter, whiten
from vellum.llm.common import documents, fold, map_batches

QUERIES, ORACLE = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Learn from the labelled documents outside fold 0 of 5, predict all."""
    docs = documents(spark, sf).select("doc_id", "text", "lang",
                                       (fold(F.col("doc_id"), 5) == 0).alias("held_out"))
    net = langid.learn(docs.filter("not held_out"))
    return langid.identify(docs, net, keep=["doc_id", "held_out"])


@query
def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select("doc_id", "text", "lang", "source")
    return quality.apply_rules(d, keep=["doc_id"])


@query
def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Licenses found in the documents, with their place and containment."""
    return license.scan(documents(spark, sf).select("doc_id", "text"))


@query
def op4_byte_bpe(spark: SparkSession, sf: str, path: str | None = None) -> DataFrame:
    """Encode every text, decode the ids, digest both."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    d = documents(spark, sf).select("doc_id", "text")
    ids = bpe.bpe_encode(d, path, public_tokenizers.PATTERN, keep=["doc_id"])
    return digests(bpe.bpe_decode(ids, path), ["doc_id"])


def digests(coded: DataFrame, keep: list[str]) -> DataFrame:
    return coded.select(*keep, (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(documents(spark, sf).select("doc_id", "text", "source"))


@query
def op6_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 best inner products of every 50th vector with all others."""
    vectors = spark.read.parquet(f"{sf.rstrip('/')}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("id") % 50 == 0)


@query
def op7_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    return chat.link(spark.read.parquet(f"{sf.rstrip('/')}/conversations.parquet"))


@query
def op7_quoted_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies found in messages that quote earlier turns: as they stand, nested, re-wrapped."""
    return chat.link(chat.quote_previous(spark.read.parquet(f"{sf.rstrip('/')}/conversations.parquet")))


@query
def op8_lm_score(spark: SparkSession, sf: str, order: int = lm.ORDER) -> DataFrame:
    """Learn from the documents outside fold 0 of 10, score all."""
    docs = documents(spark, sf).select("doc_id", "text", (fold(F.col("doc_id"), 10) == 0).alias("held_out"))
    model = lm.fit(docs.filter("not held_out"), order=order)
    scored = lm.score(docs, model, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known",
                         F.lit(model["tokens"]).cast("long").alias("train_tokens"),
                         F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


@query
def op8_lm_score_order3(spark: SparkSession, sf: str) -> DataFrame:
    """`op8_lm_score` with trigrams; the SQL of that query holds bigrams."""
    return op8_lm_score(spark, sf, order=3)


@query
def op9_token_files(spark: SparkSession, sf: str, path: str | None = None) -> DataFrame:
    """Write every document's ids, read the files, digest each document's ids."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    written = tokenfile.write_tokens(documents(spark, sf).select("doc_id", "text"), path, end_id=2)
    crc = T.StructType([T.StructField("ids_crc32", T.LongType())])
    return map_batches(tokenfile.read_tokens(written), ["ids"], crc, ["doc_id", "start", "n_tokens"],
                       lambda: lambda ids: [pa.array([zlib.crc32(x) for x in ids.to_pylist()], pa.int64())])


@query
def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf).select("doc_id", "text"))
    return found.select("doc_id", simhash.hex16(F.col("fingerprint")).alias("fingerprint"),
                        "component_id")


@query
def op11_token_alignment(spark: SparkSession, sf: str, a_path: str | None = None,
                         b_path: str | None = None) -> DataFrame:
    """Groups and links of the two public tokenizers' tokens, and the links' counts."""
    a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
    b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")
    found = align.align(documents(spark, sf).select("doc_id", "text"), a_path, b_path, keep=["doc_id"])
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    found = align.count_links(found.withColumn("groups_sha256", digest).drop("groups"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op12_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on every page's url."""
    pages = spark.read.parquet(f"{sf.rstrip('/')}/pages.parquet").select("page_id", "url")
    return urlfilter.filter_urls(pages, keep=["page_id"])


@query
def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """The first 16 whitened components of every vector (a deviation beyond a long: null)."""
    vectors = spark.read.parquet(f"{sf.rstrip('/')}/embeddings.parquet").select("vec_id", "embedding")
    return whiten.whiten(vectors).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


# SQL --------------------------------------------------------------------------------
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_SPACE = r"'[\x20\x09-\x0D]'"
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _rule_sql() -> str:
    """Cutoffs and verdict of the quality rules, from the bucket counts."""
    q, cuts, bad = quality, [], []
    for rule, (count, unit, event, upper) in q.SHARES.items():
        cuts.append((rule, f"greatest(q75 + {q.SPREAD} * (q75 - q25), q{upper})"))
        bad.append((rule, f"(1000 * {count} - cut_{rule} * {unit})::DOUBLE > {q.SPREAD} * sqrt(1000.0::DOUBLE * {event} "
                          f"* (cut_{rule} * {unit} + {1000 * event}))"))
    for rule, (least, both) in q.RANGES.items():
        cuts += [(f"{rule}_q{p}", f"q{p}") for p in (25, 75)]
        step = (f"{q.SPREAD} * greatest(cut_{rule}_q75 - cut_{rule}_q25, {least}) "
                f"* (1 + 10 / sqrt(greatest(n_words, 1)::DOUBLE))")
        bad.append((f"{rule}_low", f"cut_{rule}_q25 - {rule} > {step}"))
        if both:
            bad.append((f"{rule}_high", f"{rule} - cut_{rule}_q75 > {step}"))
    sums = ", ".join(f"max(CASE WHEN rule = '{r if r in q.SHARES else r[:-4]}' THEN {x} END) AS cut_{r}" for r, x in cuts)
    picks = ", ".join(f"CASE WHEN o.docs >= {q.MIN_DOCS} THEN o.cut_{r} WHEN l.docs >= {q.MIN_DOCS} THEN l.cut_{r} "
                      f"ELSE a.cut_{r} END AS cut_{r}" for r, _ in cuts)
    failed = ", ".join(f"CASE WHEN {x} THEN '{r}' END" for r, x in bad)
    stacked = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rule, {r}::BIGINT AS v FROM M WHERE NOT base_failed"
                                 for r in (*q.SHARES, *q.RANGES))
    points = ", ".join(f"min(CASE WHEN 100 * nth >= {p} * n THEN bucket END) AS q{p}" for p in q.PERCENTS)
    return f"""
V AS ({stacked}),
H AS (SELECT lang, source, rule,
        (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket
      FROM V),
G AS (SELECT 2 AS level, lang, source, rule, bucket FROM H
      UNION ALL SELECT 1, lang, NULL, rule, bucket FROM H
      UNION ALL SELECT 0, NULL, NULL, rule, bucket FROM H),
R AS (SELECT *, row_number() OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS nth,
        count(*) OVER (PARTITION BY level, lang, source, rule) AS n FROM G),
Q AS (SELECT level, lang, source, rule, max(n) AS docs, {points} FROM R GROUP BY ALL),
C AS (SELECT level, lang, source, max(docs) AS docs, {sums} FROM Q GROUP BY ALL),
K AS (SELECT o.lang, o.source, {picks} FROM (SELECT * FROM C WHERE level = 2) o
      LEFT JOIN (SELECT * FROM C WHERE level = 1) l ON l.lang IS NOT DISTINCT FROM o.lang
      LEFT JOIN (SELECT * FROM C WHERE level = 0) a ON true),
J AS (SELECT M.*, CASE WHEN base_failed THEN 'base' ELSE concat_ws(',', {failed}) END AS failed
      FROM M LEFT JOIN K ON K.lang IS NOT DISTINCT FROM M.lang AND K.source IS NOT DISTINCT FROM M.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed = '' AS kept, failed FROM J"""


ORACLE["op2_quality_rules"] = rf"""
WITH D AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text,
             {_WORDS} AS w FROM documents),
P AS (SELECT k, unnest(range(1, len(w) - 3)) AS p, w FROM D WHERE len(w) >= 5),
S AS (SELECT k, p, array_to_string(w[p:p + 4], ' ') AS s FROM P),
T AS (SELECT k, p, count(*) OVER (PARTITION BY k, s) AS c FROM S),
RW AS (SELECT k, count(DISTINCT p + o) AS n FROM T, range(0, 5) r(o) WHERE c > 1 GROUP BY k),
LN AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM D),
DL AS (SELECT k, count(*) AS lines, count(*) - count(DISTINCT line) AS n FROM LN
       WHERE regexp_replace(line, {_SPACE}, '', 'g') <> '' GROUP BY k),
B AS (SELECT D.*, len(w)::BIGINT AS n_words,
        length(regexp_replace(text, {_SPACE}, '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(lines, 0)::BIGINT AS n_lines,
        coalesce(DL.n, 0)::BIGINT AS n_dup_lines, coalesce(RW.n, 0)::BIGINT AS n_repeat_words
      FROM D LEFT JOIN DL USING (k) LEFT JOIN RW USING (k)),
M AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        {", ".join(f"1000 * {c} // greatest({u}, 1) AS {r}" for r, (c, u, _, _) in quality.SHARES.items())},
        1000 * word_chars // greatest(n_words, 1) AS word_length,
        16 * (length(bin(greatest(n_words, 1))) - 1) + ((16 * greatest(n_words, 1)) >> (length(bin(greatest(n_words, 1))) - 1)) - 16
          AS length_log FROM B),
{_rule_sql()}"""

ORACLE["op5_mix_sources"] = rf"""
WITH RECURSIVE D AS (SELECT row_number() OVER () AS k, doc_id, source, len({_WORDS})::BIGINT AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT AS u FROM documents),
S AS (SELECT source, sum(size)::BIGINT AS source_size,
        row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM D GROUP BY source),
W AS (SELECT *, 2.0::DOUBLE * source_size AS cap, [5, 2, 1][((sid - 1) % 3) + 1]::DOUBLE AS w FROM S),
-- shares, then whatever is above its cap is reshared, round by round
I AS (SELECT sid, false AS capped, 0 AS round FROM W
      UNION ALL
      SELECT W.sid, I.capped OR
        ((SELECT 1.5::DOUBLE * sum(source_size) FROM W)
         - coalesce(sum(CASE WHEN I.capped THEN cap END) OVER (), 0)) * w
        / sum(CASE WHEN I.capped THEN 0 ELSE w END) OVER () >= cap, I.round + 1
      FROM I JOIN W USING (sid) WHERE I.round < (SELECT count(*) FROM S)),
E AS (SELECT sid, capped FROM I WHERE round = (SELECT max(round) FROM I)),
T AS (SELECT W.*, CASE WHEN capped THEN cap ELSE least(cap,
        ((SELECT 1.5::DOUBLE * sum(source_size) FROM W)
         - (SELECT coalesce(sum(cap), 0.0) FROM W JOIN E USING (sid) WHERE capped)) * w
        / (SELECT sum(w) FROM W JOIN E USING (sid) WHERE NOT capped)) END AS target
      FROM W JOIN E USING (sid)),
BL AS (SELECT greatest(1, (floor(sum(target))::BIGINT + {mixing.SLOTS - 1}) // {mixing.SLOTS}) AS block FROM T),
N AS (SELECT *, least(floor(target + 0.5)::BIGINT, 2 * source_size) AS take FROM T, BL WHERE source_size > 0),
A AS (SELECT *, (source_size + block - 1) // block AS blocks, take // source_size AS passes FROM N),
NE AS (SELECT *, passes * blocks + (take - passes * source_size + block - 1) // block AS need FROM A),
NB AS (SELECT *, coalesce(sum(need) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         ::BIGINT AS base FROM NE WHERE need > 0),
ASK AS (SELECT *, unnest(range(need)) AS rank FROM NB),
TOT AS (SELECT count(*) AS n, count(*) + count(*) // 16 + 64 AS slots FROM ASK),
PT AS (SELECT i, (((i * {mixing.GOLDEN}) % 4294967296) * n) >> 32 AS x FROM TOT, range(slots) r(i)),
VI AS (SELECT sid, i, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS visit
       FROM PT JOIN ASK ON x = base + rank),
SL AS (SELECT ASK.sid, rank % blocks AS no, coalesce(i, slots + base + rank) AS slot, block,
         least(block, source_size - (rank % blocks) * block,
               take - (rank // blocks) * source_size - (rank % blocks) * block) AS words
       FROM ASK LEFT JOIN VI ON VI.sid = ASK.sid AND VI.visit = ASK.rank, TOT),
PL AS (SELECT D.*, T.sid, coalesce(sum(size) OVER (PARTITION BY T.sid ORDER BY u, doc_id, size, k
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st
       FROM D JOIN T ON T.source IS NOT DISTINCT FROM D.source),
PI AS (SELECT k, slot, greatest(0, least(no * block + words, st + size) - greatest(no * block, st)) AS part
       FROM PL JOIN SL ON SL.sid = PL.sid AND no * block < st + size AND no * block + block > st)
SELECT D.doc_id, D.size, T.source_size, T.target, coalesce(sum(part), 0)::BIGINT AS taken,
       min(CASE WHEN part > 0 THEN slot END)::BIGINT AS first_slot
FROM D JOIN T ON T.source IS NOT DISTINCT FROM D.source LEFT JOIN PI USING (k)
GROUP BY D.k, D.doc_id, D.size, T.source_size, T.target"""

ORACLE["op6_top_k"] = """
WITH E AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
P AS (SELECT q.k, q.vec_id AS query_id, c.vec_id,
        list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM E q JOIN E c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
R AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS nth FROM P)
SELECT query_id, nth::INTEGER AS rank, vec_id, score FROM R WHERE nth <= 5"""

_NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_STOPS = r"string_split(regexp_replace({}, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))"

ORACLE["op7_chat_format"] = rf"""
WITH RECURSIVE M AS (SELECT row_number() OVER () AS k, conv_id, turn, role, text FROM conversations),
LS AS (SELECT k, conv_id, turn, text, unnest(range(len(string_split(text, chr(10))))) AS pos,
         unnest(string_split(text, chr(10))) AS line FROM M WHERE text IS NOT NULL),
L AS (SELECT *, length(regexp_replace(regexp_extract(line, '^(([ \t]*>)+)', 1), '[^>]', '', 'g')) AS level,
        regexp_replace(line, '^(([ \t]*>)+)[ \t]?', '') AS bare FROM LS),
N AS (SELECT *, {_NORM.format("bare")} AS norm,
        coalesce(lead(level) OVER (PARTITION BY k ORDER BY pos), 0) > 0 AS before_quote FROM L),
B AS (SELECT k, max(level) AS quotes, coalesce(regexp_replace(string_agg(bare, chr(10) ORDER BY pos)
        FILTER (WHERE level = 0 AND NOT (before_quote AND regexp_matches(line, 'wrote:[ \t]*$'))),
        '^\s+|\s+$', '', 'g'), '') AS cut FROM N GROUP BY k),
O AS (SELECT M.*, CASE WHEN quotes > 0 THEN cut ELSE text END AS own FROM M LEFT JOIN B USING (k)),
U AS (SELECT conv_id, turn, unnest(list_distinct([own] || regexp_split_to_array(own, '\n[ \t]*\n')
        || string_split(own, chr(10)) || {_STOPS.format(_NORM.format("own"))})) AS unit
      FROM O WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND own IS NOT NULL),
F AS (SELECT conv_id, {_NORM.format("unit")} AS unit, min(turn) AS origin FROM U
      WHERE {_NORM.format("unit")} <> '' GROUP BY ALL),
D AS (SELECT min(k) AS k FROM M GROUP BY conv_id, turn, text),
Q AS (SELECT *, level IS DISTINCT FROM lag(level) OVER w OR pos IS DISTINCT FROM lag(pos) OVER w + 1 AS new
      FROM N WHERE level > 0 AND norm <> '' AND k IN (SELECT k FROM D) WINDOW w AS (PARTITION BY k ORDER BY pos)),
P AS (SELECT *, sum(new::INT) OVER (PARTITION BY k ORDER BY pos) AS passage FROM Q),
W AS (SELECT k, conv_id, turn, level, {_NORM.format("string_agg(norm, ' ' ORDER BY pos)")} AS unit,
        count(*) AS weight FROM P GROUP BY k, conv_id, turn, level, passage),
E AS (SELECT conv_id, turn, level, unit, weight FROM W
      UNION ALL SELECT conv_id, turn, level, unnest({_STOPS.format("unit")}), 1 FROM W
      UNION ALL SELECT conv_id, turn, level, norm, 1 FROM P),
V AS (SELECT E.conv_id, E.turn, level, origin, sum(weight) AS weight FROM E JOIN F USING (conv_id, unit)
      WHERE origin < E.turn GROUP BY ALL),
R AS (SELECT conv_id, turn, origin AS reply_to FROM V
      QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, weight DESC, origin DESC) = 1),
T AS (SELECT conv_id, turn, reply_to AS root FROM R
      UNION ALL SELECT T.conv_id, T.turn, R.reply_to FROM T JOIN R ON R.conv_id = T.conv_id AND R.turn = T.root),
H AS (SELECT conv_id, turn, min(root) AS root FROM T GROUP BY ALL)
SELECT O.conv_id, O.turn, O.role, own AS text, reply_to, coalesce(root, O.turn) AS thread,
       '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(own, '') AS formatted
FROM O LEFT JOIN R ON R.conv_id = O.conv_id AND R.turn = O.turn
LEFT JOIN H ON H.conv_id = O.conv_id AND H.turn = O.turn"""


_QUOTED = rf"""(
  SELECT C.conv_id, C.turn, role, CASE WHEN last IS NULL OR len(w) < 1 THEN text
      WHEN (C.conv_id + C.turn) % 4 = 1 THEN {{last}} || chr(10) || coalesce(text, '')
      WHEN (C.conv_id + C.turn) % 4 = 2 THEN coalesce(role, 'someone') || ' wrote:' || chr(10)
        || CASE WHEN first IS NOT NULL THEN {{first}} || chr(10) ELSE '' END || {{last}} || chr(10) || coalesce(text, '')
      WHEN (C.conv_id + C.turn) % 4 = 3 THEN array_to_string(list_transform(range(0, len(w), {chat.WRAP}),
        lambda i: '> ' || array_to_string(w[i + 1:i + {chat.WRAP}], ' ')), chr(10)) || chr(10) || coalesce(text, '')
      ELSE text END AS text
  FROM conversations C
  LEFT JOIN (SELECT conv_id, turn + 1 AS turn, min(text) AS last, regexp_extract_all(min(text), '[^\x20\x09-\x0D]+') AS w
             FROM conversations GROUP BY ALL) A ON A.conv_id = C.conv_id AND A.turn = C.turn
  LEFT JOIN (SELECT conv_id, turn + 2 AS turn, min(text) AS first FROM conversations GROUP BY ALL) B
    ON B.conv_id = C.conv_id AND B.turn = C.turn)"""
_MARKED = "array_to_string(list_transform(string_split({}, chr(10)), lambda x: '{} ' || x), chr(10))"
ORACLE["op7_quoted_replies"] = ORACLE["op7_chat_format"].replace(
    "FROM conversations)", "FROM " + _QUOTED.format(last=_MARKED.format("last", ">"), first=_MARKED.format("first", ">>")) + ")", 1)


def _license_sql() -> str:
    """Exact containment in every window, without the search for candidates."""
    rows, sizes = [], set()
    for name, text in license.TEMPLATES.items():
        w = [x.decode() for x in license.words_of(text.encode())]
        words = license.shingle_size(w)
        grams = sorted({" ".join(w[i:i + words]) for i in range(len(w) - words + 1)})
        step = 2 << license.level_of(len(grams))
        sizes.add(words)
        rows += [f"('{name}', {words}, {len(grams)}, {step}, '{g}')" for g in grams]
    places = " UNION ALL ".join(
        f"SELECT k, doc_id, {x} AS words, len(w) - {x - 1} AS n, p, array_to_string(w[p + 1:p + {x}], ' ') AS gram "
        f"FROM (SELECT *, unnest(range(len(w) - {x - 1})) AS p FROM D WHERE len(w) >= {x})" for x in sorted(sizes))
    return rf"""
WITH G(license, words, size, step, gram) AS (VALUES {", ".join(rows)}),
D AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
P AS ({places}),
H AS (SELECT k, doc_id, n, p, words, license, size, step, gram FROM P JOIN G USING (words, gram)),
W AS (SELECT *, p // step - o AS win FROM H, range(2) r(o)
      WHERE p // step - o >= 0 AND (p // step - o = 0 OR (p // step - o) * step + step < n)),
S AS (SELECT k, doc_id, license, win, count(DISTINCT gram) / size::DOUBLE AS containment,
        min(p) AS first_word, max(p) - min(p) + words AS n_words FROM W GROUP BY k, doc_id, license, win, size, words)
SELECT doc_id, license, containment, first_word, n_words,
       count(*) OVER (PARTITION BY k, license) AS windows
FROM S WHERE containment >= {license.THRESHOLD}
QUALIFY row_number() OVER (PARTITION BY k, license ORDER BY containment DESC, win) = 1"""


ORACLE["op3_license_scan"] = _license_sql()


def _discount_sql(name: str, table: str, count: str) -> str:
    """D1, D2, D3+ of an order, 0.5 where the counts of counts give none."""
    n = "list_value(" + ", ".join(f"count(*) FILTER (WHERE {count} = {i})" for i in (1, 2, 3, 4)) + ")"
    d = [f"CASE WHEN n[{i}] > 0 THEN {i} - {i + 1} * y * n[{i + 1}] / n[{i}] ELSE 0 END AS d{i}" for i in (1, 2, 3)]
    fit = ", ".join(f"CASE WHEN d{i} > 0 AND d{i} <= {i} THEN d{i} ELSE 0.5 END AS d{i}" for i in (1, 2, 3))
    return f"""{name} AS (SELECT {fit} FROM (SELECT {", ".join(d)} FROM (
  SELECT n, CASE WHEN n[1] > 0 THEN n[1]::DOUBLE / (n[1] + 2 * n[2]) ELSE 0 END AS y FROM (SELECT {n} AS n FROM {table}))))"""


def _crc32_sql(text: str) -> str:
    """crc32 of a text of ASCII characters, byte by byte."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        table.append(c)
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), "
            f"lambda a, b: xor(a >> 8, list_extract({table}::BIGINT[], (xor(a, b) & 255) + 1))), 4294967295::BIGINT)")


#: Bigrams; the end token and the begin mark are blanks, which no word holds.
ORACLE["op8_lm_score"] = rf"""
WITH D AS (SELECT row_number() OVER () AS k, doc_id,
        coalesce({_crc32_sql("doc_id::VARCHAR")} % 10 = 0, false) AS held_out,
        list_append(regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[^\x20\x09-\x0D]+'), chr(10)) AS w
      FROM documents),
T AS (SELECT k, doc_id, held_out, unnest(w) AS w, unnest(range(len(w))) AS pos FROM D),
B AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY k ORDER BY pos), chr(9)) AS prev FROM T),
UN AS (SELECT w, count(*) AS c FROM T WHERE NOT held_out GROUP BY w),
TOT AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM UN),
C2 AS (SELECT prev, w, count(*) AS c FROM B WHERE NOT held_out GROUP BY ALL),
C1 AS (SELECT w, count(*) AS c FROM C2 GROUP BY w),
{_discount_sql("D2", "C2", "c")},
{_discount_sql("D1", "C1", "c")},
X1 AS (SELECT sum(c) AS tot, D1.d1 * count(*) FILTER (WHERE c = 1) + D1.d2 * count(*) FILTER (WHERE c = 2)
         + D1.d3 * count(*) FILTER (WHERE c > 2) AS spare FROM C1, D1 GROUP BY D1.d1, D1.d2, D1.d3),
X2 AS (SELECT prev, sum(c) AS tot, D2.d1 * count(*) FILTER (WHERE c = 1) + D2.d2 * count(*) FILTER (WHERE c = 2)
         + D2.d3 * count(*) FILTER (WHERE c > 2) AS spare FROM C2, D2 GROUP BY prev, D2.d1, D2.d2, D2.d3),
P1 AS (SELECT UN.w, UN.c AS raw, (greatest(C1.c - CASE C1.c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0)
         + X1.spare / (TOT.v + 1)) / X1.tot AS p FROM UN JOIN C1 USING (w), D1, X1, TOT),
S AS (SELECT B.*, coalesce(raw, 0) AS raw, coalesce(p, X1.spare / X1.tot / (TOT.v + 1)) AS p1, TOT.n, TOT.v
      FROM B LEFT JOIN P1 USING (w), X1, TOT),
Q AS (SELECT S.k, doc_id, held_out, raw, log10((raw + 0.1) / (n + 0.1 * (v + 1))) AS base,
        log10(CASE WHEN X2.tot IS NULL THEN p1 ELSE (greatest(coalesce(C2.c, 0)
          - CASE coalesce(C2.c, 0) WHEN 0 THEN 0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0) + X2.spare * p1) / X2.tot END) AS lp
      FROM S LEFT JOIN X2 ON X2.prev = S.prev LEFT JOIN C2 ON C2.prev = S.prev AND C2.w = S.w, D2)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE raw > 0) AS n_known,
       (SELECT n FROM TOT) AS train_tokens, round(fsum(base), 6) AS base_score, round(fsum(lp), 6) AS score
FROM Q GROUP BY k, doc_id, held_out"""


def _url_sql() -> str:
    """Rules, template trees, merged branches and purities."""
    u = urlfilter
    fits = []
    for verdict, rule in sorted(u.RULES, key=lambda r: (-len(r[1]), r[1])):
        name, _, tail = rule.partition("/")
        fits.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{tail}') "
                    f"THEN {{'rule': '{rule}', 'verdict': '{verdict}'}}")
    return rf"""
WITH U AS (SELECT row_number() OVER () AS r, page_id,
        CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
H AS (SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{_AZ}', '{_AZ.lower()}') AS host,
        regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM U),
P AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS w, CASE {" ".join(fits)} END AS fit FROM H),
S AS (SELECT r, host, unnest(w[:{u.DEPTH}]) AS segment, unnest(range(1, least(len(w), {u.DEPTH}) + 1)) AS k FROM P),
SN AS (SELECT *, sum(n) OVER (PARTITION BY host, k) AS whole
       FROM (SELECT host, k, segment, count(*) AS n FROM S GROUP BY host, k, segment)),
BR AS (SELECT host, k, segment FROM SN
       WHERE n >= {u.LEAST} AND length(segment) <= {u.SEGMENT} AND n * {u.BRANCHES} >= whole),
TP AS (SELECT r, string_agg(CASE WHEN BR.k IS NULL THEN '*' ELSE segment END, '/' ORDER BY k) AS template
       FROM S LEFT JOIN BR USING (host, k, segment) GROUP BY r),
R AS (SELECT P.r, page_id, host, path, fit.rule AS rule, fit.verdict AS given,
        coalesce(template, '') || CASE WHEN len(w) > {u.DEPTH} THEN '/**' ELSE '' END AS template FROM P LEFT JOIN TP USING (r)),
L AS (SELECT host, template, count(*) AS n, count(*) FILTER (WHERE given = 'block') AS b,
        count(*) FILTER (WHERE given = 'allow') AS a FROM R GROUP BY ALL),
A AS (SELECT host, template, b, a, string_split(template, '/') AS way, unnest(range(1, len(way) + 1)) AS k FROM L),
NA AS (SELECT *, way[k] AS segment, array_to_string(way[:k], '/') AS node, array_to_string(way[:k - 1], '/') AS parent FROM A),
ND AS (SELECT host, k, parent, node, segment, sum(b)::DOUBLE AS b, sum(a)::DOUBLE AS a FROM NA GROUP BY ALL HAVING sum(a + b) > 0),
PV AS (SELECT *, lag(b) OVER s AS pb, lag(a) OVER s AS pa FROM ND
       WINDOW s AS (PARTITION BY host, k, parent ORDER BY b / (a + b), segment)),
CL AS (SELECT *, sum(CASE WHEN pb IS NULL OR (a + b + pa + pb) * (b * pa - a * pb) * (b * pa - a * pb)
              > {u.CHI2}::DOUBLE * ((a + b) * (pa + pb)) * ((a + pa) * (b + pb)) THEN 1 ELSE 0 END)
         OVER (PARTITION BY host, k, parent ORDER BY b / (a + b), segment) AS one FROM PV),
NM AS (SELECT host, k, node, min(segment) OVER (PARTITION BY host, k, parent, one) AS name FROM CL),
MG AS (SELECT host, template, string_agg(coalesce(name, segment), '/' ORDER BY k) AS merged
       FROM NA LEFT JOIN NM USING (host, k, node) GROUP BY ALL),
PO AS (SELECT host, merged, sum(n)::DOUBLE AS n, sum(b)::DOUBLE AS b, sum(a)::DOUBLE AS a FROM L JOIN MG USING (host, template) GROUP BY ALL),
TOT AS (SELECT least(coalesce(sum(b)::DOUBLE / nullif(sum(a + b), 0), 0), {u.PRIOR}::DOUBLE) AS p FROM L),
PU AS (SELECT host, merged, (b + ({u.SMOOTH} + (n - (b + a)) / 4) * p) / ((b + a) + ({u.SMOOTH} + (n - (b + a)) / 4)) AS purity
       FROM PO, TOT)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN purity >= {u.REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
       merged AS template
FROM R JOIN MG USING (host, template) JOIN PU USING (host, merged)"""


ORACLE["op12_url_filter"] = _url_sql()
