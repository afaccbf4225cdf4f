"""DuckDB SQL of the iterative operators: linkage, topics, density, sampling."""

from __future__ import annotations

CLUSTERED = r"""
CD AS (SELECT d.doc_id, e.embedding, e.label * 100 + CAST(regexp_extract(d.source, '(\d+)$', 1) AS INTEGER) AS cluster_id,
         concat(coalesce({first}, ''), '. ', coalesce(d.text, '')) AS full_text
       FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id)"""

CENTROIDS = """
{out} AS (SELECT k, list(x ORDER BY pos) AS c FROM (
  SELECT k, pos, avg(x::DOUBLE) AS x FROM (
    SELECT {key} AS k, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM {src})
  GROUP BY k, pos) GROUP BY k),
{out}U AS (SELECT k, list_transform(c, lambda x: CASE WHEN list_inner_product(c, c) > 0
             THEN x / sqrt(list_inner_product(c, c)) ELSE 0.0 END) AS u FROM {out})"""

# One round merges every pair of clusters that are each other's nearest below the
# threshold; a threshold without a merge ends with its round.
LINKAGE = """
TH(th) AS (VALUES {ths}),
LK AS (
  SELECT 0 AS round, th, k AS cluster, [k] AS members, u AS s, 1.0::DOUBLE AS n FROM TH, {cent}U
  UNION ALL
  SELECT round + 1, th, cluster, list_sort(flatten(list(members))),
         CASE WHEN len(list(s)) = 1 THEN list(s)[1]
              ELSE list_transform(list_zip(list(s)[1], list(s)[2]), lambda p: p[1] + p[2]) END, sum(n)
  FROM (
    WITH PR AS (SELECT a.th, a.cluster AS x, b.cluster AS y,
                  round(1.0 - list_inner_product(a.s, b.s) / (a.n * b.n), 12) AS l
                FROM LK a JOIN LK b ON a.th = b.th AND a.cluster <> b.cluster),
    NN AS (SELECT th, x, arg_min(y, (l, y)) AS y, min(l) AS l FROM PR GROUP BY th, x),
    MG AS (SELECT a.th, a.x AS new, a.y AS old FROM NN a JOIN NN b ON a.th = b.th AND b.x = a.y AND b.y = a.x
           WHERE a.x < a.y AND a.l < a.th)
    SELECT LK.round, LK.th, coalesce(MG.new, LK.cluster) AS cluster, LK.members, LK.s, LK.n
    FROM LK LEFT JOIN MG ON MG.th = LK.th AND MG.old = LK.cluster
    WHERE LK.th IN (SELECT th FROM MG))
  GROUP BY round, th, cluster),
FIN AS (SELECT * FROM LK WHERE (th, round) IN (SELECT (th, max(round)) FROM LK GROUP BY th)),
ASG AS (SELECT th, unnest(members) AS item, cluster FROM FIN)"""

SCORES = """
TOT AS (SELECT list(x ORDER BY pos) AS t, any_value(n) AS n_all FROM (
  SELECT pos, sum(x) AS x, count(*)::DOUBLE AS n FROM (
    SELECT unnest(u) AS x, unnest(range(len(u))) AS pos FROM {cent}U) GROUP BY pos)),
ZR AS (SELECT th, cluster, sum(CASE WHEN list_inner_product(u, u) = 0 THEN 1.0 ELSE 0.0 END) AS z
       FROM ASG JOIN {cent}U ON k = item GROUP BY ALL),
CL AS (SELECT th, n, 1.0 - (list_inner_product(s, s) + z) / (n * n) AS inside,
         CASE WHEN n_all > n THEN 1.0 - (list_inner_product(s, t) - list_inner_product(s, s)) / (n * (n_all - n)) END
           AS outside FROM FIN JOIN ZR USING (th, cluster), TOT),
SC0 AS (SELECT th, count(*) AS n_clusters, avg(outside) AS inter, avg(CASE WHEN n > 1 THEN inside END) AS intra
        FROM CL GROUP BY th),
SCO AS (SELECT th, round(CASE WHEN n_clusters < 2 OR inter IS NULL OR intra IS NULL THEN -1.0
                         ELSE inter - intra END, 6) AS score, n_clusters FROM SC0)"""


def build(classes_ctes, knn_ctes, tfidf_ctes, docs: str, s) -> dict[str, str]:
    from vellum.operators import hierarchy as H
    from vellum.plans.catalog import CARD_SIZE, DENSITY_GRID, LINK_THRESHOLDS

    out: dict[str, str] = {}
    out["stable_sample"] = """
SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 100"""

    ids = f"SELECT concat(coalesce(title,''), '. ', coalesce(abstract,'')) AS full_text FROM ({docs})"
    out["dataset_fingerprint"] = f"""
SELECT count(*) AS n_rows,
       sum(('0x' || substr(md5(sha256(full_text)), 1, 12))::BIGINT)::DECIMAL(38, 0) AS hash_sum FROM ({ids})"""

    from vellum.operators.embed import BASES, PRIME
    hashes = ", ".join(f"('0x' || substr(md5(coalesce(text, '')), {at}, 8))::BIGINT % {PRIME} AS h{i}" for i, at in enumerate((1, 9)))
    sums = ", ".join(f"(sum(h{i} * p{i} % {PRIME}) % {PRIME})::BIGINT AS hash_{c}" for i, c in enumerate("ab"))
    step = ", ".join(f"p{i} * {b} % {PRIME} AS p{i}" for i, b in enumerate(BASES))
    out["ordered_fingerprint"] = f"""WITH RECURSIVE
PW AS (SELECT 0::BIGINT AS i, 1::BIGINT AS p0, 1::BIGINT AS p1 UNION ALL
       SELECT i + 1, {step} FROM PW WHERE i + 1 < (SELECT count(*) FROM documents)),
H AS (SELECT s, count(*) OVER (PARTITION BY s) - row_number() OVER (PARTITION BY s ORDER BY s * doc_id, md5(coalesce(text, ''))) AS i, {hashes}
      FROM documents, (VALUES (1), (-1)) t(s))
SELECT count(*) AS n_rows, {sums} FROM H JOIN PW USING (i) GROUP BY s"""

    out["text_embeddings"] = f"""
WITH T AS (SELECT DISTINCT sha256(full_text) AS emb_id, lower(full_text) AS t FROM ({ids})),
C AS (SELECT emb_id, list_transform(string_split(t, ''), lambda x: unicode(x)::BIGINT) AS c FROM T),
G AS (SELECT emb_id, unnest(list_transform(range(1, len(c) - 1),
        lambda i: c[i] * 1000003 + c[i + 1] * 10007 + c[i + 2] * 101)) AS h FROM C),
V AS (SELECT emb_id, (h % 64)::INTEGER AS i, sum(CASE WHEN h // 64 % 2 = 0 THEN 1 ELSE -1 END) AS v FROM G GROUP BY ALL)
SELECT T.emb_id, 64::INTEGER AS dim, true AS _dim_ok,
       count(*) FILTER (WHERE v <> 0)::INTEGER AS n_active,
       coalesce(arg_min(i, (-greatest(v, 0), i)) FILTER (WHERE v > 0), -1)::INTEGER AS strongest
FROM T LEFT JOIN V USING (emb_id) GROUP BY T.emb_id"""

    scaled = classes_ctes().replace("E AS (", "E0 AS (", 1)
    out["knn_scaled"] = f"""
WITH {scaled},
ST AS (SELECT pos, avg(x::DOUBLE) AS mu, stddev_pop(x::DOUBLE) AS sd FROM (
  SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY pos),
E AS (SELECT vec_id, any_value(label) AS label,
        list((x::DOUBLE - mu) / CASE WHEN sd = 0 THEN 1.0 ELSE sd END ORDER BY pos) AS v
      FROM (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
      JOIN ST USING (pos) GROUP BY vec_id),
{knn_ctes('K', 3, 'label')}
SELECT qid AS vec_id, pred AS pred_label, conf AS confidence FROM KP"""

    ths = ", ".join(f"({t}::DOUBLE)" for t in LINK_THRESHOLDS)
    clustered = CLUSTERED.format(first=s.first_line("d.text"))
    base = clustered + "," + CENTROIDS.format(out="C", key="cluster_id", src="CD")
    swept = base + "," + LINKAGE.format(ths=ths, cent="C")
    out["merge_average_linkage"] = f"""WITH RECURSIVE {swept}
SELECT th, item AS cluster_id, cluster AS label FROM ASG"""
    scores = swept + "," + SCORES.format(cent="C")
    out["threshold_scores"] = f"WITH RECURSIVE {scores}\nSELECT th, score, n_clusters FROM SCO"
    lo, hi = H.TARGET_MIN_CLUSTERS, H.TARGET_MAX_CLUSTERS
    choice = f"""
RK AS (SELECT th, CASE WHEN n_clusters BETWEEN {lo} AND {hi} THEN 1 ELSE 2 END AS tier,
         CASE WHEN n_clusters BETWEEN {lo} AND {hi} THEN -score ELSE abs(n_clusters - {(lo + hi) / 2}) END AS key
       FROM SCO WHERE score > 0),
B AS (SELECT min((tier, key, th)) AS b, arg_min(th, (tier, key, th)) AS th, arg_min(tier, (tier, key, th)) AS tier FROM RK)"""
    out["threshold_choice"] = f"""WITH RECURSIVE {scores},{choice}
SELECT coalesce(th, {H.FALLBACK_THRESHOLD})::DOUBLE AS th,
       CASE tier WHEN 1 THEN 'in_range' WHEN 2 THEN 'closest_to_mid' ELSE 'fallback' END AS rule FROM B"""

    out["reassign_topics"] = f"""WITH RECURSIVE {CENTROIDS.format(out="C", key="label", src="embeddings")},
{LINKAGE.format(ths="(1.0::DOUBLE)", cent="C")},
SZ AS (SELECT label AS item, count(*) AS size FROM embeddings GROUP BY 1),
MN AS (SELECT cluster, arg_min(item, (-size, item)) AS main_topic FROM ASG JOIN SZ USING (item) GROUP BY cluster)
SELECT vec_id, label AS topic, CASE WHEN label = -1 THEN -1 ELSE main_topic END AS main_topic
FROM embeddings JOIN ASG ON item = label JOIN MN USING (cluster)"""

    out["topic_documents"] = f"""WITH RECURSIVE R AS ({out["reassign_topics"]}),
O AS (SELECT vec_id, CASE WHEN vec_id % 25 = 0 THEN -1 ELSE topic END AS topic,
        CASE WHEN vec_id % 25 = 0 THEN -1 ELSE main_topic END AS main_topic FROM R)
SELECT *, CASE WHEN main_topic = -1 THEN 'Outlier' ELSE 'topic ' || main_topic END AS main_topic_label,
       CASE WHEN topic = -1 THEN 'Outlier' ELSE 'topic ' || topic END AS subtopic_label FROM O"""

    topics = f"""{base},{LINKAGE.format(ths="(0.9::DOUBLE)", cent="C")},
{tfidf_ctes('cluster_id', 'CD', 'full_text')},
SZ AS (SELECT cluster_id AS g, count(*) AS size FROM CD WHERE cluster_id <> -1 GROUP BY 1),
KW AS (SELECT g, list(term ORDER BY r) AS kw FROM TOP GROUP BY g),
CARDS AS (SELECT SZ.g AS cluster_id, coalesce(kw, ['unknown']) AS keywords,
            array_to_string(list_slice(coalesce(kw, ['unknown']), 1, 3), ' / ') AS name FROM SZ LEFT JOIN KW USING (g)),
MEM AS (SELECT ASG.cluster AS merged_cluster_id, CARDS.name, row_number() OVER (
          PARTITION BY ASG.cluster ORDER BY CARDS.name) - 1 AS spos
        FROM ASG JOIN CARDS ON CARDS.cluster_id = ASG.item),
NK AS (SELECT name, min(keywords) AS keywords FROM CARDS GROUP BY name),
WD AS (SELECT merged_cluster_id, spos, unnest(keywords) AS kw, unnest(range(len(keywords))) AS kpos
       FROM MEM JOIN NK USING (name)),
FW AS (SELECT merged_cluster_id, kw, min((spos, kpos)) AS first_at FROM WD GROUP BY ALL),
MK AS (SELECT merged_cluster_id, list(kw ORDER BY first_at) AS keywords FROM FW GROUP BY 1),
MS AS (SELECT merged_cluster_id, string_agg(name, ' | ' ORDER BY spos) AS subclusters FROM MEM GROUP BY 1),
MT AS (SELECT merged_cluster_id, subclusters, array_to_string(keywords, ',') AS keywords,
         array_to_string(list_slice(keywords, 1, 3), ' / ') AS main_topic FROM MS JOIN MK USING (merged_cluster_id))"""
    out["merged_topic_table"] = f"WITH RECURSIVE {topics}\nSELECT * FROM MT"
    out["keyword_join_report"] = f"""WITH RECURSIVE {topics}
SELECT merged_cluster_id, name FROM MEM
WHERE name NOT IN (SELECT name FROM CARDS JOIN SZ ON SZ.g = CARDS.cluster_id WHERE size >= {CARD_SIZE})"""
    out["topic_tags"] = f"""WITH RECURSIVE {topics},
TG AS (SELECT doc_id, string_agg(C.k::VARCHAR, ',' ORDER BY C.k)
         FILTER (WHERE list_cosine_similarity(CD.embedding::DOUBLE[], C.c) >= {H.SOFT_SIMILARITY}) AS subtopics
       FROM CD, C GROUP BY doc_id)
SELECT CD.doc_id, CD.cluster_id, ASG.cluster AS main_topic, coalesce(subtopics, '') AS subtopics
FROM CD JOIN ASG ON ASG.item = CD.cluster_id JOIN TG USING (doc_id)"""
    out["topic_tags_auto"] = f"""WITH RECURSIVE {scores},{choice},
TG AS (SELECT doc_id, string_agg(C.k::VARCHAR, ',' ORDER BY C.k)
         FILTER (WHERE list_cosine_similarity(CD.embedding::DOUBLE[], C.c) >= {H.SOFT_SIMILARITY}) AS subtopics
       FROM CD, C GROUP BY doc_id)
SELECT CD.doc_id, CD.cluster_id, ASG.cluster AS main_topic, coalesce(subtopics, '') AS subtopics
FROM CD JOIN ASG ON ASG.item = CD.cluster_id AND ASG.th = (SELECT coalesce(th, {H.FALLBACK_THRESHOLD})::DOUBLE FROM B)
JOIN TG USING (doc_id)"""
    out["final_topic_table"] = f"""WITH RECURSIVE {topics},
OWNER AS (SELECT name, min(merged_cluster_id) AS merged_cluster_id FROM MEM GROUP BY name)
SELECT CD.doc_id, CD.cluster_id, CARDS.name AS subtopic, OWNER.merged_cluster_id, MT.main_topic AS main_topic_name
FROM CD JOIN CARDS USING (cluster_id) LEFT JOIN OWNER ON OWNER.name = CARDS.name
LEFT JOIN MT ON MT.merged_cluster_id = OWNER.merged_cluster_id"""

    grid = ", ".join(f"({i}, {e}::DOUBLE, {m}, {n})" for i, (e, m, n) in enumerate(DENSITY_GRID))
    density = f"""
CFG(cfg, eps, min_size, min_samples) AS (VALUES {grid}),
X AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
DS AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d FROM X a JOIN X b ON a.id <> b.id),
NR AS (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM DS),
CO AS (SELECT cfg, a AS id, d AS core FROM CFG JOIN NR ON r = min_samples - 1),
ED AS (SELECT c.cfg, a, b FROM CFG c JOIN DS ON d <= eps JOIN CO x ON x.cfg = c.cfg AND x.id = a AND x.core <= eps
       JOIN CO y ON y.cfg = c.cfg AND y.id = b AND y.core <= eps),
RC AS (SELECT DISTINCT cfg, a AS id, a AS comp FROM ED
       UNION SELECT ED.cfg, ED.b, RC.comp FROM RC JOIN ED ON ED.cfg = RC.cfg AND ED.a = RC.id AND RC.comp < ED.b),
CP AS (SELECT cfg, id, min(comp) AS comp FROM RC GROUP BY ALL),
SZ AS (SELECT cfg, comp, count(*) AS size FROM CP GROUP BY ALL),
DC AS (SELECT CFG.cfg, X.id AS vec_id, CASE WHEN size >= min_size THEN CP.comp ELSE -1 END AS cluster
       FROM CFG CROSS JOIN X LEFT JOIN CP ON CP.cfg = CFG.cfg AND CP.id = X.id
       LEFT JOIN SZ ON SZ.cfg = CP.cfg AND SZ.comp = CP.comp)"""
    out["density_clusters"] = f"WITH RECURSIVE {density}\nSELECT cfg, vec_id, cluster FROM DC"
    out["density_grid"] = f"""WITH RECURSIVE {density},
G AS (SELECT cfg, count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters,
        count(*) FILTER (WHERE cluster = -1) AS n_outliers, count(*) AS n FROM DC GROUP BY cfg)
SELECT *, round(n_clusters / (1 + n_outliers / n), 6) AS score FROM G"""
    out |= density_trees()
    columns = [("o_totalprice", "o_totalprice::DOUBLE"), ("o_custkey", "CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END::DOUBLE"),
               ("o_orderstatus", "NULL::DOUBLE")]
    out["profile_by_month"] = " UNION ALL ".join(f"""
SELECT strftime(o_orderdate, '%Y') AS year, '{c}' AS "column", count(*) AS n_rows,
       {"0::BIGINT" if c == "o_orderstatus" else "count(*) - count(x)"} AS n_null, round(min(x), 4) AS min, round(max(x), 4) AS max,
       round(avg(x), 4) AS mean, round(stddev_pop(x), 3) AS std FROM (SELECT o_orderdate, {x} AS x FROM orders) GROUP BY 1""" for c, x in columns)
    from vellum.plans.catalog import FREQUENT_OF_MONTH, FREQUENT_OF_YEAR
    out["frequent_by_month"] = f"""
WITH counted AS (
  SELECT month, "column", value, count(*) AS n,
         row_number() OVER (PARTITION BY month, "column" ORDER BY count(*) DESC, value) AS r
  FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, unnest(['o_custkey', 'o_orderpriority']) AS "column",
               unnest([o_custkey::VARCHAR, o_orderpriority]) AS value FROM orders)
  WHERE value IS NOT NULL GROUP BY month, "column", value),
bound AS (SELECT month, "column", coalesce(max(n) FILTER (WHERE r > {FREQUENT_OF_MONTH}), 0) AS missed FROM counted GROUP BY ALL),
yearly AS (SELECT substr(month, 1, 4) AS year, "column", sum(missed) AS missed FROM bound GROUP BY ALL),
listed AS (
  SELECT substr(c.month, 1, 4) AS year, c."column" AS "column", c.value AS value, sum(n)::BIGINT AS low, sum(n - missed) AS above
  FROM counted c JOIN bound USING (month, "column")
  WHERE r <= {FREQUENT_OF_MONTH} GROUP BY substr(c.month, 1, 4), c."column", c.value),
ranked AS (
  SELECT year, "column", value, low, (above + missed)::BIGINT AS high, missed,
         row_number() OVER (PARTITION BY year, "column" ORDER BY above + missed DESC, value) AS r
  FROM listed JOIN yearly USING (year, "column")),
closed AS (SELECT *, greatest(missed, coalesce(max(high) FILTER (WHERE r > {FREQUENT_OF_YEAR}) OVER (PARTITION BY year, "column"), 0))::BIGINT AS m
  FROM ranked)
SELECT year, "column", value, low, high, m AS missed FROM closed WHERE r <= {FREQUENT_OF_YEAR}"""
    out["knn_cells"] = """
SELECT a.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id)
         ::INTEGER AS rank, b.vec_id AS neighbor,
       round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dist
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY rank <= 5"""
    return out


# Prim's order of the mutual reachabilities: every part of the tree under a weight is a
# run of it.  CT holds the runs that are still a cluster's, heaviest edges cut first.
TREE = """
X AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
DS AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d FROM X a JOIN X b ON a.id <> b.id),
CO AS (SELECT a AS id, d AS core FROM DS QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = {samples} - 1),
MR AS (SELECT a, b, round(greatest(x.core, y.core, d), 9) AS w FROM DS JOIN CO x ON x.id = a JOIN CO y ON y.id = b),
PR AS (SELECT 0 AS step, id, CASE WHEN id = (SELECT min(id) FROM X) THEN 0.0 ELSE 'inf'::DOUBLE END AS w,
         id = (SELECT min(id) FROM X) AS now, false AS done FROM X
  UNION ALL
  SELECT step + 1, id, w, NOT done AND id = first(id) OVER (ORDER BY done, w, id), done FROM (
    SELECT step, R.id, least(R.w, coalesce(MR.w, 'inf'::DOUBLE)) AS w, R.done OR R.now AS done
    FROM (SELECT *, max(CASE WHEN now THEN id END) OVER () AS at FROM PR) R
    LEFT JOIN MR ON MR.a = R.at AND MR.b = R.id AND NOT R.done AND NOT R.now
    WHERE step + 1 < (SELECT count(*) FROM X))),
PO AS (SELECT step AS pos, id, w FROM PR WHERE now),
SM(m) AS (VALUES {sizes}),
CT AS (SELECT m, min(id)::VARCHAR || ':' || count(*) AS key, NULL::VARCHAR AS parent, NULL::DOUBLE AS birth, 0 AS lo, (max(pos))::INTEGER AS hi,
         (SELECT max(w) FROM PO WHERE pos > 0) AS top, count(*) AS size, min(id) AS least
       FROM SM, PO GROUP BY m HAVING count(*) >= m
  UNION ALL
  SELECT m, CASE WHEN parts > 1 THEN least::VARCHAR || ':' || (hi - lo + 1) ELSE key END, CASE WHEN parts > 1 THEN key ELSE parent END,
         CASE WHEN parts > 1 THEN top ELSE birth END, lo, hi, (SELECT max(w) FROM PO WHERE pos > lo AND pos <= hi),
         CASE WHEN parts > 1 THEN hi - lo + 1 ELSE size END, CASE WHEN parts > 1 THEN least ELSE old_least END
  FROM (SELECT m, key, parent, birth, top, size, old_least, parts, part.lo AS lo, part.hi AS hi,
          (SELECT min(id) FROM PO WHERE pos >= part.lo AND pos <= part.hi) AS least
    FROM (SELECT *, len(large) AS parts, unnest(large) AS part FROM (
      SELECT m, key, parent, birth, top, size, least AS old_least, list_filter(list_transform(range(1, len(cuts) + 1),
          lambda i: {{'lo': cuts[i], 'hi': coalesce(cuts[i + 1] - 1, hi)}}), lambda x: x.hi - x.lo + 1 >= m) AS large
      FROM (SELECT *, list_prepend(lo, (SELECT coalesce(list(pos::INTEGER ORDER BY pos), []) FROM PO
                                        WHERE pos > lo AND pos <= hi AND w = top)) AS cuts FROM CT))))),
EX AS (SELECT m, id, arg_min(key, hi - lo) AS key, arg_min(top, hi - lo) AS w FROM CT JOIN PO ON pos BETWEEN lo AND hi GROUP BY m, id),
CL AS (SELECT DISTINCT m, key, parent, birth, size, least FROM CT),
OU AS (SELECT m, key, 1 / greatest(w, 1e-6) AS r, 1 AS n FROM EX
       UNION ALL SELECT m, parent, 1 / greatest(birth, 1e-6), size FROM CL WHERE parent IS NOT NULL),
ST AS (SELECT CL.*, round(o - n * coalesce(1 / greatest(birth, 1e-6), 0.0), 9) AS stability
       FROM CL JOIN (SELECT m, key, sum(r * n) AS o, sum(n) AS n FROM OU GROUP BY ALL) USING (m, key)),
UP AS (SELECT m, key, key AS anc, 0 AS far FROM ST UNION ALL
       SELECT UP.m, UP.key, ST.parent, far + 1 FROM UP JOIN ST ON ST.m = UP.m AND ST.key = UP.anc WHERE ST.parent IS NOT NULL),
DP AS (SELECT m, key, max(far) AS depth FROM UP GROUP BY ALL)"""

# The leaf itself, the first ancestor that is born above the epsilon, or else the one below the root.
LEAF = """
LF AS (SELECT m, key, birth FROM ST WHERE parent IS NOT NULL AND (m, key) NOT IN (SELECT (m, parent) FROM ST WHERE parent IS NOT NULL)),
PK AS (SELECT DISTINCT LF.m, CASE WHEN LF.birth >= {eps} THEN LF.key
         ELSE coalesce(arg_min(anc, far) FILTER (WHERE far > 0 AND a.birth > {eps} AND a.parent IS NOT NULL),
                       arg_max(anc, far) FILTER (WHERE a.parent IS NOT NULL)) END AS key
       FROM LF JOIN UP USING (m, key) JOIN ST a ON a.m = UP.m AND a.key = UP.anc GROUP BY LF.m, LF.key, LF.birth)"""

EOM = """
VA AS (SELECT depth, ST.m, ST.key, parent, stability AS value, true AS pick FROM ST JOIN DP USING (m, key)
       WHERE depth = (SELECT max(depth) FROM DP)
  UNION ALL
  SELECT D.depth, D.m, D.key, D.parent, greatest(stability, coalesce(below, 0.0)), below IS NULL OR below <= stability
  FROM (SELECT depth, ST.m, key, parent, stability FROM ST JOIN DP USING (m, key)) D
  JOIN (SELECT DISTINCT depth - 1 AS depth FROM VA) L ON L.depth = D.depth
  LEFT JOIN (SELECT m, parent AS key, sum(value) AS below FROM VA GROUP BY ALL) B ON B.m = D.m AND B.key = D.key),
PK AS (SELECT m, key FROM VA WHERE pick AND parent IS NOT NULL)"""

CHOSEN = """
OK AS (SELECT UP.m, UP.key, arg_max(least, far) AS least FROM UP JOIN PK ON PK.m = UP.m AND PK.key = UP.anc
       JOIN ST ON ST.m = UP.m AND ST.key = UP.anc GROUP BY ALL),
LB AS (SELECT SM.m, X.id AS vec_id, coalesce(least, -1) AS cluster FROM SM CROSS JOIN X
       LEFT JOIN EX ON EX.m = SM.m AND EX.id = X.id LEFT JOIN OK ON OK.m = EX.m AND OK.key = EX.key)"""


def density_trees() -> dict[str, str]:
    from vellum.plans.catalog import LEAF_EPSILON, TREE_SAMPLES, TREE_SIZES

    tree = TREE.format(samples=TREE_SAMPLES, sizes=", ".join(f"({m})" for m in TREE_SIZES))
    leaf = lambda eps: f"WITH RECURSIVE {tree},{LEAF.format(eps=f'{eps}::DOUBLE')},{CHOSEN}"
    return {
        "density_leaf": leaf(LEAF_EPSILON) + "\nSELECT * FROM LB",
        "density_eom": f"WITH RECURSIVE {tree},{EOM},{CHOSEN}\nSELECT * FROM LB",
        "density_tree_grid": leaf(0.0) + """
SELECT m AS cfg, count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters,
       count(*) FILTER (WHERE cluster = -1) AS n_outliers, count(*) AS n,
       round(n_clusters / (1 + n_outliers / n), 6) AS score FROM LB GROUP BY m"""}
