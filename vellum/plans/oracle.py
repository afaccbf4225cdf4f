"""DuckDB SQL equivalents of the catalogue queries (independent oracle)."""

from __future__ import annotations

from vellum.plans import sqlfrag as s

ORACLE: dict[str, str] = {}

ORACLE["clean_funnel"] = f"""
WITH d AS (
  SELECT doc_id, {s.first_line('text')} AS title, text AS abstract, lang
  FROM documents),
a AS (
  SELECT *, {s.dropped_by('title', 'abstract')} AS dropped_by FROM d),
c AS (
  SELECT *, CASE WHEN dropped_by IS NULL THEN {s.clean_abstract('abstract')} END AS clean_abstract,
         CASE WHEN coalesce(lang = 'en' AND lang = 'en', false) THEN 'english' ELSE 'other' END AS split,
         {s.document_type('title')} AS type
  FROM a)
SELECT lang, split, type, dropped_by, count(*) AS n_docs,
       CAST(sum(length(clean_abstract)) AS BIGINT) AS clean_chars
FROM c GROUP BY ALL
"""

DOCS = f"""SELECT doc_id, {s.first_line('text')} AS title, text AS abstract, lang,
  lang AS title_lang, lang AS abstract_lang, source FROM documents"""
WORD = r"[\p{L}\p{N}_]+"

ORACLE["informative_reason"] = f"""
SELECT doc_id, {s.informative_reason('abstract')} AS reason FROM ({DOCS})"""

ORACLE["english_split_counts"] = """
SELECT CASE WHEN coalesce(lang = 'en', false) THEN 'english' ELSE 'other' END AS side,
       count(*) AS n_docs FROM documents GROUP BY 1"""

ORACLE["doc_type_counts"] = f"""
SELECT {s.document_type('t')} AS type, count(*) AS n_docs FROM (
  SELECT CASE doc_id % 9 WHEN 1 THEN ' LHD #' || doc_id WHEN 2 THEN 'the lhd  Probe ' || title WHEN 3 THEN NULL
         WHEN 4 THEN 'lhdx' || title ELSE title END AS t FROM ({DOCS})) GROUP BY 1"""

ORACLE["boilerplate_filter"] = f"""
SELECT {s.boilerplate(s.clean_abstract('a'))} AS boilerplate, count(*) AS n_docs
FROM (SELECT ['Type ', 'typed ', '', '目次 ', ''][doc_id % 5 + 1] || abstract AS a FROM ({DOCS})) GROUP BY 1"""

ORACLE["lang_code_map"] = """
WITH m(k, v) AS (VALUES ('ja','ja'),('zh','zh'),('zh-cn','zh'),('zh-tw','zh'),('zh-hk','zh'),
  ('ko','ko'),('fr','fr'),('de','de'),('es','es'),('ru','ru'),('it','it'),('pt','pt'),
  ('nl','nl'),('ar','ar'),('hi','hi'),('en','en'))
SELECT lang, count(*) AS n_docs, any_value(m.v) AS m2m_code
FROM documents LEFT JOIN m ON lower(documents.lang) = m.k GROUP BY lang"""

_NC = s.strip("upper(" + s.strip("coalesce(concat_ws(' & ', p_type, p_name), '')") + ")")
ORACLE["class_name_norm"] = f"""
SELECT {s.strip(f"regexp_replace(replace({_NC}, '&', 'AND'), {s.q(s.WS + '+')}, ' ', 'g')")} AS norm,
       count(*) AS n FROM part GROUP BY 1"""

ORACLE["full_text_id"] = f"""
SELECT doc_id, sha256(concat(coalesce(title,''), '. ', coalesce(abstract,''))) AS emb_id,
       length(concat(coalesce(title,''), '. ', coalesce(abstract,'')))::INTEGER AS n_chars
FROM ({DOCS})"""

_RAW = "concat('<think>' || chr(10) || 'plan' || chr(10) || '</think>', '**', text, '** *(note)*')"
_THINK = s.strip(f"regexp_replace({_RAW}, '(?s)<think>.*?</think>', '', 'g')")
ORACLE["topic_name_clean"] = f"""
SELECT conv_id, turn,
  {s.strip(f"regexp_replace(split_part(regexp_replace({_THINK}, '\\*\\*', '', 'g'), chr(10), 1), '\\*\\(.*?\\)\\*', '', 'g')")}
  AS topic_name
FROM conversations"""

ORACLE["ordered_distinct_terms"] = f"""
WITH t AS (
  SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term,
         unnest(range(len(regexp_extract_all(lower(text), '{WORD}')))) AS pos
  FROM conversations),
f AS (SELECT conv_id, term, min((turn, pos)) AS first_at FROM t GROUP BY ALL)
SELECT conv_id, string_agg(term, ' ' ORDER BY first_at) AS terms FROM f GROUP BY conv_id"""

ORACLE["schema_conform_union"] = f"""
SELECT doc_id AS id, 'documents' AS origin, {s.first_line('text')} AS title, CAST(NULL AS VARCHAR) AS url,
       lang, n_chars FROM documents
UNION ALL
SELECT page_id, 'pages', regexp_extract(html, '(?s)<title>(.*?)</title>', 1), url,
       regexp_extract(html, '<html lang="([^"]*)"', 1), CAST(NULL AS BIGINT) FROM pages"""

LABELED = """SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l USING (doc_id)"""

ORACLE["duplicate_rows"] = """
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicates, count(*) AS n_distinct_rows
FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang, source, n_chars)"""

ORACLE["null_profile"] = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_null,
       round((count(*) - count({c})) * 100.0 / count(*), 2) AS pct_null,
       count(DISTINCT {c}) AS n_distinct FROM ({LABELED})"""
    for c in ["doc_id", "lang", "source", "n_chars", "quality", "toxic"])

ORACLE["value_counts_top"] = """
SELECT p_type AS value, count(*) AS count FROM part WHERE p_type IS NOT NULL
GROUP BY 1 ORDER BY count DESC, value LIMIT 20"""

ORACLE["value_counts_bottom"] = """
SELECT event_type AS value, count(*) AS count FROM events WHERE event_type IS NOT NULL
GROUP BY 1 ORDER BY count ASC, value LIMIT 3"""

ORACLE["null_share_by_group"] = f"""
SELECT lang, count(*) AS n_rows, count(*) - count(quality) AS n_null,
  round((count(*) - count(quality)) * 100.0 /
        (SELECT count(*) - count(quality) FROM ({LABELED})), 2) AS pct_of_nulls,
  round((count(*) - count(quality)) * 100.0 / count(*), 2) AS pct_of_group
FROM ({LABELED}) GROUP BY lang"""

ORACLE["describe_numeric"] = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", round(count({c})::DOUBLE, 6) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
       round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lineitem"""
    for c in ["l_quantity", "l_discount", "l_tax"])

ORACLE["histogram_fixed"] = """
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
h AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(39, floor((value - lo) / (hi - lo) * 40)::INT) END AS bin,
             count(*) AS count FROM events, b WHERE value IS NOT NULL GROUP BY 1)
SELECT bin, count, lo + bin * ((hi - lo) / 40) AS bin_lo, lo + (bin + 1) * ((hi - lo) / 40) AS bin_hi
FROM h, b"""

ORACLE["box_stats_top_groups"] = """
WITH top AS (SELECT p_brand FROM part WHERE p_brand IS NOT NULL GROUP BY 1
             ORDER BY count(*) DESC, p_brand LIMIT 15)
SELECT p_brand, count(p_retailprice) AS n, min(p_retailprice) AS min,
  quantile_cont(p_retailprice, 0.25) AS p25, quantile_cont(p_retailprice, 0.5) AS median,
  quantile_cont(p_retailprice, 0.75) AS p75, max(p_retailprice) AS max
FROM part SEMI JOIN top USING (p_brand) GROUP BY p_brand"""

_PC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORACLE["pearson_matrix"] = "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for i, a in enumerate(_PC) for b in _PC[i + 1:])

ORACLE["year_histogram"] = """
SELECT year(o_orderdate)::INT AS year, count(*) AS count FROM orders GROUP BY 1"""

ORACLE["timestamp_ranges"] = """
SELECT 'ts' AS "column", min(ts) AS min_ts, max(ts) AS max_ts, count(*) - count(ts) AS n_null FROM events
UNION ALL
SELECT 'created_at', min(c), max(c), count(*) - count(c) FROM (
  SELECT try_strptime('2024-' || (props::JSON->>'k'), '%Y-%m') AS c FROM events)"""

ORACLE["coverage_ratio"] = f"""
SELECT count(*) AS n_rows, count(quality) AS n_present,
       round(count(quality) * 100.0 / count(*), 2) AS pct_present FROM ({LABELED})"""

ORACLE["list_item_counts"] = f"""
SELECT item AS value, count(*) AS count FROM (
  SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) AS item FROM documents)
GROUP BY 1 ORDER BY count DESC, value LIMIT 20"""

ORACLE["list_literal_items"] = """
SELECT item AS value, count(*) AS count FROM (
  SELECT unnest(CASE WHEN p_type = 'SMALL' THEN [p_type] ELSE string_split(p_name, ' ') END) AS item
  FROM part)
GROUP BY 1 ORDER BY count DESC, value LIMIT 20"""

ORACLE["text_length_profile"] = """
WITH d AS (SELECT least(length(text)::DOUBLE,
                        (SELECT quantile_cont(length(text), 0.99) FROM documents)) AS len FROM documents),
b AS (SELECT min(len) AS lo, max(len) AS hi FROM d),
h AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(49, floor((len - lo) / (hi - lo) * 50)::INT) END AS bin,
             count(*) AS count FROM d, b GROUP BY 1)
SELECT bin, count, lo + bin * ((hi - lo) / 50) AS bin_lo, lo + (bin + 1) * ((hi - lo) / 50) AS bin_hi
FROM h, b"""

ORACLE["value_inspector"] = """
SELECT p_type AS value, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM part), 2)
       AS pct_of_rows, 'p_type' AS "column" FROM part WHERE p_type IS NOT NULL GROUP BY 1
UNION ALL
SELECT event_type, count(*), round(count(*) * 100.0 / (SELECT count(*) FROM events), 2), 'event_type'
FROM events WHERE event_type IS NOT NULL GROUP BY 1"""

ORACLE["lang_mix"] = """
SELECT lang AS value, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 2)
       AS pct_of_rows FROM documents WHERE lang IS NOT NULL GROUP BY 1"""

ORACLE["cluster_sizes"] = "SELECT label, count(*) AS size FROM embeddings GROUP BY label"

ORACLE["names_per_group"] = """
SELECT n_regionkey, array_to_string(list_sort(list_distinct(list(n_name))), ', ') AS names
FROM nation GROUP BY n_regionkey"""

ORACLE["group_label_position"] = """
SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS x, round(avg(embedding[2]::DOUBLE), 6) AS y
FROM embeddings WHERE label <> -1 GROUP BY label"""


# 3. vectors, kNN, evaluation ------------------------------------------------------
def _pynorm(x: str) -> str:
    return " ".join(x.strip().upper().replace("&", "AND").split())


def _values(rows) -> str:
    def lit(v):
        return "NULL" if v is None else (str(v) if isinstance(v, int) else s.q(v))
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def _norm_sql(x: str) -> str:
    t = f"upper({s.strip(f'coalesce({x}, {chr(39)}{chr(39)})')})"
    return s.strip(f"regexp_replace(replace({t}, '&', 'AND'), {s.q(s.WS + '+')}, ' ', 'g')")


def _classes_ctes() -> str:
    from vellum.plans import classes as c
    routes = ([(_pynorm(x), "sub", None) for x in c.SUBMODEL_CLASSES]
              + [(_pynorm(x), "single", y) for x, y in c.SINGLE_SUBCLASS])
    return f"""
LM(label, main_class) AS (VALUES {_values(c.LABEL_MAIN)}),
R(main_norm, kind, single_subclass) AS (VALUES {_values(routes)}),
M(main_norm, id, name) AS (VALUES {_values(c.ID_TO_NAME)}),
JT(key, gt_main, gt_sub) AS (VALUES {_values(c.JOURNAL_TRUTH)}),
PT(key, gt_main, gt_sub) AS (VALUES {_values(c.PUBLISHER_TRUTH)}),
E AS (SELECT e.vec_id, e.embedding::DOUBLE[] AS v, e.label, LM.main_class
      FROM embeddings e LEFT JOIN LM USING (label))"""


def _knn_ctes(p: str, k: int, lab: str, extra_join: str = "", src: str = "E q") -> str:
    """CTEs {p}N (neighbours) and {p}P (qid, pred, conf) for leave-one-out kNN."""
    return f"""
{p}N AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.{lab} AS lab, list_distance(qe.v, t.v) AS dist,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(qe.v, t.v), t.vec_id) AS rn
         FROM {src} JOIN E qe ON qe.vec_id = q.vec_id JOIN E t ON t.vec_id <> q.vec_id {extra_join}
         QUALIFY rn <= {k}),
{p}V AS (SELECT qid, lab, count(*) AS c FROM {p}N GROUP BY ALL),
{p}P AS (SELECT v.qid, arg_min(v.lab, (-v.c, v.lab)) AS pred,
           any_value(CAST(1.0 / (1.0 + n.dist) AS FLOAT)) AS conf
         FROM {p}V v JOIN {p}N n ON n.qid = v.qid AND n.rn = 1 GROUP BY v.qid)"""


ORACLE["knn_main"] = f"""
WITH {_classes_ctes()},
{_knn_ctes('K', 3, 'label')}
SELECT KP.qid AS vec_id, KP.pred AS pred_label, KP.conf AS confidence, E.label
FROM KP JOIN E ON E.vec_id = KP.qid"""

TWO_STAGE = f"""{_classes_ctes()},
{_knn_ctes('A', 3, 'main_class')},
S1 AS (SELECT qid AS vec_id, pred AS lcc_main_name_pred, conf AS main_knn_confidence,
              {_norm_sql('pred')} AS main_norm FROM AP),
Q2 AS (SELECT S1.vec_id, S1.main_norm FROM S1 JOIN R USING (main_norm) WHERE R.kind = 'sub'),
{_knn_ctes('B', 3, 'label', f"AND {_norm_sql('t.main_class')} = q.main_norm", 'Q2 q')},
TS AS (
SELECT S1.vec_id, S1.lcc_main_name_pred, S1.main_knn_confidence,
  CASE WHEN R.kind = 'single' THEN R.single_subclass
       WHEN R.kind = 'sub' THEN coalesce(M.name, CAST(BP.pred AS VARCHAR)) END AS lcc_name_pred,
  CASE WHEN R.kind = 'single' THEN CAST(1.0 AS FLOAT) WHEN R.kind = 'sub' THEN BP.conf END AS sub_knn_confidence,
  CASE WHEN R.kind = 'single' THEN 'direct_map' WHEN R.kind = 'sub' THEN S1.main_norm
       ELSE 'no_submodel:' || S1.main_norm END AS sub_model_used
FROM S1 LEFT JOIN R USING (main_norm) LEFT JOIN BP ON BP.qid = S1.vec_id
LEFT JOIN M ON M.main_norm = S1.main_norm AND M.id = BP.pred),
PM AS (SELECT TS.*, d.source AS journal, d.lang AS publisher FROM TS JOIN documents d ON d.doc_id = TS.vec_id),
PT2 AS (SELECT PM.*,
  CASE WHEN JT.gt_main IS NOT NULL THEN 'journal' WHEN PT.gt_main IS NOT NULL THEN 'publisher' END AS truth_source,
  coalesce(JT.gt_main, PT.gt_main) AS gt_main,
  CASE WHEN JT.gt_main IS NOT NULL THEN JT.gt_sub ELSE PT.gt_sub END AS gt_sub,
  PT.gt_main IS NOT NULL AS publisher_hit
  FROM PM LEFT JOIN JT ON JT.key = PM.journal LEFT JOIN PT ON PT.key = PM.publisher),
JR AS (SELECT * FROM PT2 WHERE truth_source = 'journal'),
GA AS (SELECT journal, count(*) AS n_papers, any_value(gt_main) AS gt_main, any_value(gt_sub) AS gt_sub,
         round(avg(CASE WHEN coalesce(lcc_main_name_pred = gt_main, false) THEN 1.0 ELSE 0.0 END), 3) AS acc_main,
         round(avg(CASE WHEN coalesce(lcc_name_pred = gt_sub, false) THEN 1.0 ELSE 0.0 END), 3) AS acc_sub
       FROM JR GROUP BY journal),
LOW AS (SELECT * FROM GA WHERE acc_main < 0.7)"""

ORACLE["knn_two_stage"] = f"WITH {TWO_STAGE}\nSELECT * FROM TS"

ORACLE["prediction_metadata_join"] = f"""WITH {TWO_STAGE}
SELECT vec_id, journal, publisher, lcc_main_name_pred, lcc_name_pred FROM PM"""

ORACLE["truth_coverage"] = f"""WITH {TWO_STAGE}
SELECT count(*) AS n_rows, count(*) FILTER (WHERE truth_source = 'journal') AS n_journal,
  count(*) FILTER (WHERE publisher_hit) AS n_publisher,
  count(*) FILTER (WHERE truth_source IS NOT NULL) AS n_combined,
  round(count(*) FILTER (WHERE truth_source IS NOT NULL) * 100.0 / count(*), 1) AS pct_combined FROM PT2"""


def _report_sql(src: str, t: str, p: str) -> str:
    return f"""
PC AS (SELECT CAST({t} AS VARCHAR) AS t, CAST({p} AS VARCHAR) AS p, count(*) AS n FROM {src}
       WHERE {t} IS NOT NULL AND {p} IS NOT NULL GROUP BY ALL),
CL AS (SELECT t AS cls FROM PC UNION SELECT p FROM PC),
PER AS (SELECT cls,
   coalesce((SELECT sum(n) FROM PC WHERE PC.t = cls), 0) AS support,
   coalesce((SELECT sum(n) FROM PC WHERE PC.p = cls), 0) AS predicted,
   coalesce((SELECT sum(n) FROM PC WHERE PC.t = cls AND PC.p = cls), 0) AS tp FROM CL),
PR AS (SELECT cls, support, tp,
   CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
   CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM PER),
F AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM PR),
REP AS (
SELECT cls AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM F
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), sum(support)::BIGINT FROM F
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM F
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM F)"""


ORACLE["classification_report"] = f"""WITH {_classes_ctes()},
{_knn_ctes('K', 3, 'label')},
KM AS (SELECT KP.qid AS vec_id, KP.pred AS pred_label, E.label FROM KP JOIN E ON E.vec_id = KP.qid),
{_report_sql('KM', 'label', 'pred_label')}
SELECT * FROM REP"""

ORACLE["classification_report_main"] = f"""WITH {TWO_STAGE},
{_report_sql('PT2', 'gt_main', 'lcc_main_name_pred')}
SELECT * FROM REP"""

ORACLE["confusion_long"] = f"""WITH {TWO_STAGE},
PC AS (SELECT gt_main AS t, lcc_main_name_pred AS p, count(*) AS n FROM PT2
       WHERE gt_main IS NOT NULL AND lcc_main_name_pred IS NOT NULL GROUP BY ALL),
FO AS (SELECT t, CASE WHEN p IN (SELECT t FROM PC) THEN p ELSE 'Other' END AS p, sum(n) AS n FROM PC GROUP BY ALL)
SELECT t AS true_class, p AS pred_class, CAST(n AS BIGINT) AS n,
       round(n / sum(n) OVER (PARTITION BY t), 6) AS share FROM FO"""

ORACLE["group_accuracy"] = f"WITH {TWO_STAGE}\nSELECT * FROM GA"
ORACLE["low_performers"] = f"WITH {TWO_STAGE}\nSELECT * FROM LOW"


def _shares_sql(truth: str, pred: str) -> str:
    return f"""WITH {TWO_STAGE},
G AS (SELECT journal, {pred} AS predicted, count(*) AS n, any_value({truth}) AS truth FROM JR
      WHERE {pred} IS NOT NULL AND journal IN (SELECT journal FROM LOW) GROUP BY ALL)
SELECT journal, predicted, round(n * 100.0 / sum(n) OVER (PARTITION BY journal), 1) AS pct,
       coalesce(predicted = truth, false) AS hit FROM G"""


ORACLE["wrong_destinations"] = _shares_sql("gt_main", "lcc_main_name_pred")
ORACLE["wrong_destinations_sub"] = _shares_sql("gt_sub", "lcc_name_pred")

ORACLE["low_performer_summary"] = f"""WITH {TWO_STAGE},
W AS (SELECT journal, lcc_main_name_pred AS w, count(*) AS n FROM JR
      WHERE journal IN (SELECT journal FROM LOW) AND lcc_main_name_pred IS NOT NULL
        AND NOT coalesce(lcc_main_name_pred = gt_main, false) GROUP BY ALL),
TW AS (SELECT journal, arg_min(w, (-n, w)) AS top_wrong_pred, max(n) * 100.0 / sum(n) AS top_wrong_pct
       FROM W GROUP BY journal)
SELECT LOW.journal, n_papers, gt_main, acc_main, acc_sub, coalesce(top_wrong_pred, '—') AS top_wrong_pred,
       round(coalesce(top_wrong_pct, 0.0), 1) AS top_wrong_pct
FROM LOW LEFT JOIN TW USING (journal)"""


def _score_sql(k: int) -> str:
    return f"""(WITH {_classes_ctes()},
{_knn_ctes('K', k, 'label')},
KM AS (SELECT KP.qid AS vec_id, KP.pred AS pred_label, E.label FROM KP JOIN E ON E.vec_id = KP.qid),
{_report_sql('KM', 'label', 'pred_label')}
SELECT 'knn_k{k}' AS model, max(f1) FILTER (WHERE class = 'accuracy') AS accuracy,
       max(f1) FILTER (WHERE class = 'macro avg') AS f1_macro,
       max(f1) FILTER (WHERE class = 'weighted avg') AS f1_weighted FROM REP)"""


ORACLE["score_table"] = "\nUNION ALL\n".join(_score_sql(k) for k in (1, 3, 5))

ORACLE["centroids"] = """
SELECT label, (pos - 1)::INTEGER AS pos, round(avg(x::DOUBLE), 6) AS x FROM (
  SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)
GROUP BY label, pos"""

_CENT = """C AS (SELECT label, list(x ORDER BY pos) AS c FROM (
  SELECT label, pos, avg(x::DOUBLE) AS x FROM (
    SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
  GROUP BY label, pos) GROUP BY label)"""

ORACLE["centroid_distances"] = f"""WITH {_CENT}
SELECT a.label AS a, b.label AS b,
       round(least(greatest(1.0 - list_cosine_similarity(a.c, b.c), 0.0), 2.0), 6) AS dist
FROM C a JOIN C b ON a.label <> b.label"""

ORACLE["soft_subtopics"] = f"""WITH {_CENT}
SELECT e.vec_id, coalesce(string_agg(CAST(C.label AS VARCHAR), ',' ORDER BY C.label)
                          FILTER (WHERE list_cosine_similarity(e.embedding::DOUBLE[], C.c) >= 0.25), '') AS subtopics
FROM embeddings e, C GROUP BY e.vec_id"""

ORACLE["id_vector_lookup"] = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS emb_id FROM documents),
v AS (SELECT d.emb_id, arg_max(e.embedding, e.vec_id) AS v FROM embeddings e JOIN d ON d.doc_id = e.vec_id GROUP BY d.emb_id)
SELECT d.doc_id, d.emb_id, round(v.v[1]::DOUBLE, 6) AS x0, len(v.v)::INTEGER AS dim FROM d LEFT JOIN v USING (emb_id)"""

ORACLE["missing_vectors"] = """
SELECT lang, count(*) AS n_missing FROM documents
WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY lang"""


# neighbour-graph map --------------------------------------------------------------
def _graph_ctes() -> str:
    from vellum.plans.catalog import MAP_NEIGHBOURS
    return f"""MV AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
MN AS (SELECT q.vec_id AS a, t.vec_id AS b, list_distance(q.v, t.v) AS dist,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) AS rn
  FROM MV q JOIN MV t ON q.vec_id <> t.vec_id QUALIFY rn <= {MAP_NEIGHBOURS}),
MP AS (SELECT a, b, CASE WHEN dist > 0 THEN exp(-pow(dist / max(dist) OVER (PARTITION BY a), 2)) ELSE 1.0 END AS p FROM MN),
MW AS MATERIALIZED (SELECT a, b, max(p) + (CASE WHEN count(*) > 1 THEN min(p) ELSE 0 END) * (1 - max(p)) AS w
  FROM (SELECT a, b, p FROM MP UNION ALL SELECT b, a, p FROM MP) GROUP BY a, b)"""


def _graph_map_sql(dims: int) -> str:
    """Long-form steps of the matrix, then Gram-Schmidt with the root of the degrees first."""
    from vellum.plans.catalog import MAP_STEPS
    cols = ["r", *[f"c{j}" for j in range(dims)]]
    ctes = []
    for i, c in enumerate(cols):
        unit = ", ".join([*cols[:i], f"{c} / sqrt(sum({c} * {c}) OVER ()) AS {c}", *cols[i + 1:]])
        rest = ", ".join([*cols[:i + 1], *[f"{o} - {c} * (sum({c} * {o}) OVER ()) AS {o}" for o in cols[i + 1:]]])
        ctes.append(f"U{i} AS MATERIALIZED (SELECT id, {unit} FROM {f'O{i - 1}' if i else 'S'}),\n"
                    f"O{i} AS MATERIALIZED (SELECT id, {rest} FROM U{i})")
    wide = ", ".join(f"max(x) FILTER (WHERE j = {j}) AS c{j}" for j in range(dims))
    length = " + ".join(f"c{j} * c{j}" for j in range(dims))
    steps = ",\n".join(ctes)
    return f"""WITH RECURSIVE {_graph_ctes()},
MD AS MATERIALIZED (SELECT a AS id, sqrt(sum(w)) AS r FROM MW GROUP BY a),
MM AS MATERIALIZED (SELECT a, b, w / (p.r * q.r) / 2 AS w FROM MW JOIN MD p ON p.id = a JOIN MD q ON q.id = b
  UNION ALL SELECT id, id, 0.5 FROM MD),
R AS (SELECT 0 AS step, id, j, ('0x' || substr(md5(id::VARCHAR || ':' || j), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5::DOUBLE AS x
    FROM MD, range({dims}) t(j)
  UNION ALL
  SELECT step + 1, a, j, sum(w * x) FROM R JOIN MM ON b = id WHERE step < {MAP_STEPS} GROUP BY step, a, j),
S AS MATERIALIZED (SELECT id, any_value(r) AS r, {wide} FROM R JOIN MD USING (id) WHERE step = {MAP_STEPS} GROUP BY id),
{steps}
SELECT id AS vec_id, {dims}::INTEGER AS dim, round(sqrt({length}), 6) AS length FROM O{len(cols) - 1}"""


ORACLE["neighbour_graph"] = f"""WITH {_graph_ctes()}
SELECT a, b, round(w, 6) AS w FROM MW"""
ORACLE["graph_map_2d"] = _graph_map_sql(2)
ORACLE["graph_map_10d"] = _graph_map_sql(10)


def _pca_sql(dims: int, squarings: int = 11) -> str:
    """Leading eigenvectors of the covariance one by one: the matrix squared again and again
    is the eigenvector's projector, which is then taken out of the matrix."""
    ctes = []
    for k in range(dims):
        for n in range(squarings):
            of, t = (f"C{k}", f"A{k}_0") if not n else (f"A{k}_{n - 1}", f"A{k}_{n}")
            ctes.append(f"""{t} AS MATERIALIZED (SELECT i, j, x / sum(x) FILTER (WHERE i = j) OVER () AS x
  FROM (SELECT p.i, q.j, sum(p.x * q.x) AS x FROM {of} p JOIN {of} q ON p.j = q.i GROUP BY p.i, q.j))""")
        last = f"A{k}_{squarings - 1}"
        ctes.append(f"""V{k} AS MATERIALIZED (SELECT i, x / sqrt(sum(x * x) OVER ()) AS v FROM {last}
  WHERE j = (SELECT arg_max(i, x) FROM {last} WHERE i = j)),
W{k} AS MATERIALIZED (SELECT c.i, sum(c.x * v.v) AS u FROM C{k} c JOIN V{k} v ON v.i = c.j GROUP BY c.i),
C{k + 1} AS MATERIALIZED (SELECT c.i, c.j, c.x - a.v * p.u - o.u * b.v + a.v * b.v * (SELECT sum(u * v) FROM W{k} JOIN V{k} USING (i)) AS x
  FROM C{k} c JOIN V{k} a ON a.i = c.i JOIN V{k} b ON b.i = c.j JOIN W{k} o ON o.i = c.i JOIN W{k} p ON p.i = c.j)""")
    parts = " UNION ALL ".join(f"SELECT {k} AS k, i, v FROM V{k}" for k in range(dims))
    chain = ",\n".join(ctes)
    return f"""WITH X AS MATERIALIZED (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings)),
Z AS MATERIALIZED (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM X),
C0 AS MATERIALIZED (SELECT p.i, q.i AS j, sum(p.x * q.x) AS x FROM Z p JOIN Z q USING (vec_id) GROUP BY p.i, q.i),
{chain},
P AS (SELECT vec_id, k, sum(x * v) AS y FROM X JOIN ({parts}) USING (i) GROUP BY vec_id, k)
SELECT vec_id, {dims}::INTEGER AS dim, round(sqrt(sum(y * y)), 6) AS length FROM P GROUP BY vec_id"""


ORACLE["pca_reduce"] = _pca_sql(10)


# 4. labelling ---------------------------------------------------------------------
def _stop_sql() -> str:
    from vellum.operators.labels import english_stop_words
    return ", ".join(s.q(w) for w in english_stop_words())


def _tfidf_ctes(g: str, src: str = "documents", text: str = "text") -> str:
    return f"""
D AS (SELECT {g} AS g, doc_id, {text} AS text FROM {src} WHERE NOT {s.blank(text)}),
T AS (SELECT g, doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM D),
TF AS (SELECT g, doc_id, term, count(*) AS tf FROM T WHERE term NOT IN ({_stop_sql()}) GROUP BY ALL),
VOC AS (SELECT g, term, sum(tf) AS cf, count(*) AS df FROM TF GROUP BY g, term),
N AS (SELECT g, count(*) AS n FROM D GROUP BY g),
W AS (SELECT TF.g, doc_id, term, tf * (ln((n + 1) / (df + 1)) + 1) AS w
      FROM TF JOIN VOC USING (g, term) JOIN N USING (g)),
NM AS (SELECT g, doc_id, sqrt(sum(w * w)) AS norm FROM W GROUP BY ALL),
SC AS (SELECT g, term, sum(w / norm) AS score FROM W JOIN NM USING (g, doc_id) GROUP BY ALL),
TOP AS (SELECT g, term, score,
          row_number() OVER (PARTITION BY g ORDER BY round(score, 9) DESC, term DESC) AS r
        FROM SC WHERE NOT regexp_matches(term, '^\\p{{Nd}}+$') AND length(term) > 1 QUALIFY r <= 10)"""


ORACLE["tfidf_terms"] = f"""WITH {_tfidf_ctes('lang')}
SELECT g AS lang, r::INTEGER AS rank, term, round(score, 6) AS score FROM TOP"""

ORACLE["cluster_cards"] = f"""WITH {_tfidf_ctes('source')},
SZ AS (SELECT source AS g, count(*) AS size FROM documents WHERE text IS NOT NULL AND source <> '-1' GROUP BY 1),
KW AS (SELECT g, list(term ORDER BY r) AS kw FROM TOP GROUP BY g)
SELECT SZ.g AS source, array_to_string(coalesce(kw, ['unknown']), ',') AS keywords,
       array_to_string(list_slice(coalesce(kw, ['unknown']), 1, 3), ' / ') AS name, size
FROM SZ LEFT JOIN KW USING (g)"""

ORACLE["topic_terms_class_tfidf"] = """
WITH T AS (SELECT source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents),
TF AS (SELECT source, term, count(*) AS tf FROM T GROUP BY ALL),
TOT AS (SELECT source, sum(tf) AS tot FROM TF GROUP BY source),
FT AS (SELECT term, sum(tf) AS ft FROM TF GROUP BY term),
W AS (SELECT source, term, tf / tot * ln(1 + (SELECT avg(tot) FROM TOT) / ft) AS score
      FROM TF JOIN TOT USING (source) JOIN FT USING (term)),
TOP AS (SELECT source, term, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, term) AS r
        FROM W QUALIFY r <= 3)
SELECT source, source || '_' || string_agg(term, '_' ORDER BY r) AS label FROM TOP GROUP BY source"""

_RDF = {
    "title": f"nullif({s.first_line('text')}, '')",
    "abstract_chars": f"length(nullif({s.strip('text')}, ''))::INTEGER",
    "doi": "'10.1000/' || doc_id", "authors": "'Author ' || doc_id", "affiliations": "source",
    "journal": "'Journal ' || source", "publisher": "lang",
    "publication_date": "'2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')",
    "volume": "(doc_id % 40)::VARCHAR", "issue": "'7'", "start_page": "doc_id::VARCHAR",
    "end_page": "(doc_id + 9)::VARCHAR", "topics": "source", "related_titles": "'About ' || source",
    "created_at": "'2024-02-01'", "modified_at": "'2024-03-0' || (doc_id % 9)",
}
_RDF_COLS = ", ".join(f"CASE WHEN doc_id % 97 <> 13 THEN {v} END AS {k}" for k, v in _RDF.items())
ORACLE["ingest_rdf"] = f"""
SELECT 'doc-' || doc_id || '.rdf' AS file, {_RDF_COLS},
       CASE WHEN doc_id % 97 = 13 THEN 'ParseError' END AS error
FROM documents"""


# 7. language ----------------------------------------------------------------------
LANG_CTES = r"""
D AS (SELECT doc_id, lang, text, lower(text) AS t,
        ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 2 AS fold FROM documents),
G AS (SELECT doc_id, lang, fold, substr(t, i, 3) AS gram
      FROM (SELECT doc_id, lang, fold, t, unnest(range(1, length(t) - 1)) AS i FROM D WHERE length(t) >= 3)),
P AS (SELECT 1 - fold AS fold, lang, gram, count(*) AS c FROM G WHERE lang IS NOT NULL GROUP BY ALL),
V AS (SELECT fold, count(DISTINCT gram) AS v FROM P GROUP BY fold),
TT AS (SELECT fold, lang, sum(c) AS t FROM P GROUP BY ALL),
DG AS (SELECT doc_id, fold, gram, count(*) AS c FROM G GROUP BY ALL),
N AS (SELECT doc_id, sum(c) AS n FROM DG GROUP BY doc_id),
HIT AS (SELECT DG.doc_id, P.lang, sum(DG.c * ln(P.c + 1)) AS s FROM DG JOIN P USING (fold, gram) GROUP BY ALL),
SC AS (SELECT D.doc_id, D.lang AS true_lang, TT.lang,
         -coalesce(N.n, 0) * ln(TT.t + V.v) + coalesce(HIT.s, 0) AS score,
         regexp_matches(D.text, '\p{L}') AS letters
       FROM D JOIN TT USING (fold) JOIN V USING (fold) LEFT JOIN N ON N.doc_id = D.doc_id
       LEFT JOIN HIT ON HIT.doc_id = D.doc_id AND HIT.lang = TT.lang),
PRED AS (SELECT doc_id, any_value(true_lang) AS lang,
           CASE WHEN bool_or(letters) THEN arg_min(lang, (-score, lang)) END AS pred_lang
         FROM SC GROUP BY doc_id)"""

ORACLE["language_id"] = f"WITH {LANG_CTES}\nSELECT doc_id, lang, pred_lang FROM PRED"

ORACLE["language_id_report"] = f"""WITH {LANG_CTES},
{_report_sql('PRED', 'lang', 'pred_lang')}
SELECT * FROM REP"""

_ROUTE = """CASE WHEN m.v IS NOT NULL AND m.v <> 'en' THEN '[' || m.v || '] ' || {c} ELSE {c} END"""
ORACLE["language_routed"] = f"""
WITH m(k, v) AS (VALUES ('ja','ja'),('zh','zh'),('zh-cn','zh'),('zh-tw','zh'),('zh-hk','zh'),
  ('ko','ko'),('fr','fr'),('de','de'),('es','es'),('ru','ru'),('it','it'),('pt','pt'),
  ('nl','nl'),('ar','ar'),('hi','hi'),('en','en'))
SELECT doc_id, md5({_ROUTE.format(c=s.first_line('text'))}) AS title_en_md5,
       md5({_ROUTE.format(c='text')}) AS abstract_en_md5
FROM documents LEFT JOIN m ON lower(documents.lang) = m.k"""

ORACLE["run_summary"] = """
SELECT count(DISTINCT CASE WHEN cid <> -1 THEN cid END) AS n_clusters,
       count(*) FILTER (WHERE cid = -1) AS n_outliers, count(*) AS n_rows, 'label x source' AS config
FROM (SELECT e.label * 100 + CAST(regexp_extract(d.source, '(\\d+)$', 1) AS INTEGER) AS cid
      FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id)"""


# 10. remaining profile and report queries ----------------------------------------
def _column_profile_sql() -> str:
    from vellum.sources.tables import TABLES
    return "\nUNION ALL\n".join(
        f"""SELECT '{t}' AS "table", (SELECT count(*) FROM information_schema.columns
            WHERE table_name = '{t}') AS n_columns, (SELECT count(*) FROM {t}) AS n_rows""" for t in TABLES)


ORACLE["column_profile"] = _column_profile_sql()

ORACLE["head_tail"] = """
(SELECT o_orderkey, o_totalprice, 'head' AS "end" FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)
UNION ALL
(SELECT o_orderkey, o_totalprice, 'tail' FROM orders ORDER BY o_totalprice ASC, o_orderkey LIMIT 10)"""

ORACLE["vector_health"] = """
SELECT CASE WHEN vec_id % 11 = 0 THEN 'wrong_dim' WHEN vec_id % 13 = 0 THEN 'zero' WHEN vec_id % 17 = 0 THEN 'missing'
            WHEN vec_id % 19 = 0 THEN 'nan' END AS vector_problem, count(*) AS n
FROM embeddings GROUP BY 1"""

ORACLE["confidence_profile"] = f"""WITH {_classes_ctes()},
{_knn_ctes('K', 3, 'label')},
C AS (SELECT CAST(conf AS DOUBLE) AS v FROM KP),
B AS (SELECT min(v) AS lo, max(v) AS hi FROM C),
H AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(39, floor((v - lo) / (hi - lo) * 40)::INT) END AS bin,
             count(*) AS count FROM C, B GROUP BY 1)
SELECT bin, count, round(lo + bin * ((hi - lo) / 40), 6) AS bin_lo, round(lo + (bin + 1) * ((hi - lo) / 40), 6) AS bin_hi
FROM H, B"""


# 11. whole reports ------------------------------------------------------------------
def _decoded(x: str) -> str:
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"replace({x}, '&{name};', {s.q(char)})"
    return x


_PAGE = s.clean_abstract("html", decode=_decoded)
ORACLE["clean_text_pages"] = f"""
SELECT page_id, length(t)::INTEGER AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, {_PAGE} AS t FROM pages)"""

_LABELLED = "SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)"
_LABELLED_COLS = ("doc_id", "lang", "source", "n_chars", "quality", "toxic")
ORACLE["table_overview"] = f"""
WITH L AS ({_LABELLED}), G AS (SELECT count(*) AS c FROM L GROUP BY {", ".join(_LABELLED_COLS)}),
T AS (SELECT CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' END AS t
      FROM (DESCRIBE {_LABELLED}))
SELECT 'rows' AS section, 'duplicates' AS name, sum(c - 1)::BIGINT AS value FROM G
UNION ALL SELECT 'rows', 'distinct', count(*) FROM G
UNION ALL SELECT 'type', t, count(*) FROM T GROUP BY t
""" + "".join(f"""UNION ALL SELECT 'nulls', '{c}', count(*) FILTER (WHERE {c} IS NULL) FROM L
UNION ALL SELECT 'distinct', '{c}', count(DISTINCT {c}) FROM L
""" for c in _LABELLED_COLS)


def _metadata_sql(src: str, columns, categories, top: int = 10) -> str:
    parts = [f"SELECT 'present' AS section, 'rows' AS name, count(*) AS value FROM {src}"]
    parts += [f"SELECT 'present', '{c}', count({c}) FROM {src}" for c in columns]
    parts.append(f"SELECT * FROM (SELECT 'error', split_part(error, ':', 1) AS v, count(*) AS n FROM {src} "
                 f"WHERE error IS NOT NULL GROUP BY 2 ORDER BY n DESC, v LIMIT {top})")
    for c in categories:
        parts.append(f"SELECT 'distinct', '{c}', count(DISTINCT {c}) FROM {src}")
        parts.append(f"SELECT * FROM (SELECT 'top {c}', {c} AS v, count(*) AS n FROM {src} "
                     f"WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY n DESC, v LIMIT {top})")
    return "\nUNION ALL ".join(parts)


_PUB_COLS = ["file"] + ["abstract" if k == "abstract_chars" else k for k in _RDF] + ["error"]
ORACLE["publication_profile"] = f"""
WITH R AS ({ORACLE["ingest_rdf"].replace("AS abstract_chars", "AS abstract")})
{_metadata_sql("R", _PUB_COLS, ["journal", "publisher", "volume", "publication_date"])}"""

ORACLE["confidence_by_class"] = f"""WITH {_classes_ctes()},
{_knn_ctes('K', 3, 'label')},
C AS (SELECT pred AS pred_label, CAST(conf AS DOUBLE) AS v FROM KP)
SELECT pred_label, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min,
  round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS max FROM C GROUP BY 1"""

ORACLE["prediction_profile"] = f"""WITH {TWO_STAGE},
PP AS (SELECT lcc_main_name_pred, lcc_name_pred, sub_model_used, truth_source,
         CASE WHEN gt_main IS NULL THEN 'no truth: none found' END AS error FROM PT2)
{_metadata_sql("PP", ["lcc_main_name_pred", "lcc_name_pred", "sub_model_used", "truth_source", "error"],
               ["lcc_main_name_pred", "lcc_name_pred", "truth_source"])}"""

_ITEMS = "SELECT * FROM (SELECT '{c}' AS \"column\", {l} AS is_list, v AS value, count(*) AS count FROM ({src}) WHERE v <> '' GROUP BY v ORDER BY count DESC, v LIMIT 20)"
ORACLE["list_profile"] = "\nUNION ALL ".join(
    _ITEMS.format(c=c, l=l, src=src) for c, l, src in (
        ("words", "true", "SELECT trim(unnest(string_split(p_name, ' '))) AS v FROM part"),
        ("literal", "true", "SELECT trim(unnest(string_split(p_name, ' '))) AS v FROM part"),
        ("p_type", "false", "SELECT trim(p_type) AS v FROM part")))


ORACLE["known_languages"] = """
SELECT lang AS title_lang, count(*) AS n_docs FROM documents WHERE lang IN ('en', 'fr', 'de') GROUP BY 1"""

ORACLE["named_documents"] = """
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN -1 ELSE doc_id % 7 END AS cluster_id, n_name AS name
FROM documents LEFT JOIN nation ON n_nationkey = CASE WHEN doc_id % 10 = 0 THEN -1 ELSE doc_id % 7 END AND n_nationkey < 6"""

ORACLE["excluded_ids"] = "SELECT doc_id, lang FROM documents WHERE doc_id % 7 <> 0"


# 12. iterative and sampled operators ------------------------------------------------
def _register_late() -> None:
    from vellum.plans import oracle_topics
    ORACLE.update(oracle_topics.build(_classes_ctes, _knn_ctes, _tfidf_ctes, DOCS, s))


_register_late()
