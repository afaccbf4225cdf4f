"""Planted quirks of the text rules, evaluation metrics, embedding resume,
small file sources, and the driver contract."""

import json
import os

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import evaluate as ev
from vellum.operators import filters as flt


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(expr("x").alias("y")).first().y


def test_strip_and_blank(spark):
    assert one(spark, tx.ustrip, "　 a 　\n") == "a"
    assert one(spark, tx.is_blank, "　 ") is True
    assert one(spark, tx.is_blank, None) is True


def test_clean_abstract_rules(spark):
    cases = {
        "<p>Hello</p>  world": "Hello world",
        "&amp;lt;b&amp;gt;": "&lt;b&gt;",          # tags go before decoding: escaped tags survive
        "&lt;b&gt;x": "<b>x",
        'na\\"ive caf\\\'e': "naive cafe",
        "energy $E=mc^2$ here": "energy E=mc^2 here",
        "\\emph{a} and \\textbf{b}": "a and b",
        "\\begin{eq} x \\end{eq}": "eq x eq",
        "\\alpha beta": "beta",
        "``quoted''": '"quoted"',
        None: "",
        "no\ttabs\n\nor  runs": "no tabs or runs",
    }
    for src, want in cases.items():
        assert one(spark, tx.clean_abstract, src) == want, src


def test_informative_reason(spark):
    long_ok = "This is a fine abstract, " * 5
    assert one(spark, flt.informative_reason, "short.") == "too_short"
    assert one(spark, flt.informative_reason, "Article " + long_ok) == "metadata_prefix"
    assert one(spark, flt.informative_reason, "x" * 120) == "no_sentence_mark"
    cite = "Journal of things, vol 3, pp. 12-34, some words to make it long enough " * 2 + "; 1999"
    assert one(spark, flt.informative_reason, cite) == "citation"
    assert one(spark, flt.informative_reason, long_ok) is None


def test_document_type_and_split(spark):
    assert one(spark, flt.document_type, "LHD #123 shot") == "diagnostic_report"
    assert one(spark, flt.document_type, "lhd ece data") == "diagnostic_report"
    assert one(spark, flt.document_type, "A study of plasma") == "scientific_paper"
    assert one(spark, flt.document_type, None) == "unknown"
    df = spark.createDataFrame([("en", "en"), ("en", None), (None, None), ("ja", "en")], "title_lang string, abstract_lang string")
    a, b = flt.split_english(df)
    assert a.count() == 1 and b.count() == 3


def test_small_functions(spark):
    assert one(spark, tx.norm_class, " Bibliography  & Information Science ") == "BIBLIOGRAPHY AND INFORMATION SCIENCE"
    assert one(spark, tx.lang_code_norm, "ZH-CN") == "zh" and one(spark, tx.lang_code_norm, "xx") is None
    assert one(spark, tx.clean_topic_name, "**Main Topic** *(note)*\nsecond line") == "Main Topic"
    assert one(spark, tx.strip_think, "<think>\nplan\n</think>\n Title ") == "Title"
    assert one(spark, tx.parse_list_literal, "['a', 'b']") == ["a", "b"]
    assert one(spark, tx.parse_list_literal, "plain") == ["plain"]
    assert one(spark, lambda c: tx.text_id(c), None) == one(spark, lambda c: tx.text_id(c), "")
    assert one(spark, lambda c: tx.full_text(c, F.lit("abs")), "T") == "T. abs"


def test_classification_report_zero_division(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", None), ("b", "d")], "t string, p string")
    rep = {r["class"]: r for r in ev.classification_report(df, "t", "p").collect()}
    assert rep["d"].precision == 0.0 and rep["d"].recall == 0.0 and rep["d"].support == 0
    assert rep["a"].precision == 1.0 and rep["a"].recall == 0.5
    assert rep["accuracy"].f1 == round(2 / 4, 6) and rep["accuracy"].support == 4


def test_truth_priority_and_low_performers(spark):
    pred = spark.createDataFrame([("J1", "P1", "X"), ("J2", "P1", "Y"), ("J3", "P9", "X")],
                                 "journal string, publisher string, main string")
    jt = spark.createDataFrame([("J1", "X", "x1")], "key string, gt_main string, gt_sub string")
    pt = spark.createDataFrame([("P1", "Y", "y1")], "key string, gt_main string, gt_sub string")
    t = {r.journal: r for r in ev.attach_truth(pred, jt, pt).collect()}
    assert t["J1"].gt_main == "X" and t["J1"].truth_source == "journal"
    assert t["J2"].gt_main == "Y" and t["J2"].truth_source == "publisher"
    assert t["J3"].gt_main is None
    acc = spark.createDataFrame([("a", 0.6996), ("b", 0.7)], "journal string, acc_main double")
    acc = acc.withColumn("acc_main", F.round("acc_main", 3))
    assert [r.journal for r in ev.low_performers(acc).collect()] == []


def test_embed_incremental_resume(spark, tmpdir_path):
    from vellum.operators.embed import embed_incremental
    df = spark.createDataFrame([("a", "text one"), ("b", "text two"), ("a", "text one")], "emb_id string, full_text string")
    out = os.path.join(tmpdir_path, "vec")
    assert embed_incremental(spark, df, out) == 2
    assert embed_incremental(spark, df, out) == 0
    more = df.unionByName(spark.createDataFrame([("c", "third")], "emb_id string, full_text string"))
    assert embed_incremental(spark, more, out) == 1
    v = spark.read.parquet(out)
    assert v.count() == 3 and v.select(F.size("embedding")).distinct().first()[0] == 64


def test_embedding_refuses_another_dataset(spark, tmpdir_path):
    from vellum.operators.embed import dataset_key, embed_incremental
    rows = [(i, f"t{i}", f"text number {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "n long, emb_id string, full_text string")
    key = dataset_key(df, "full_text", ["n"])
    assert key == dataset_key(df.repartition(7), "full_text", ["n"])
    out = os.path.join(tmpdir_path, "vec")
    assert embed_incremental(spark, df.filter("n < 20"), out, dataset=key) == 20
    assert embed_incremental(spark, df, out, dataset=key) == 20
    swapped = df.withColumn("n", F.when(F.col("n") == 3, 4).when(F.col("n") == 4, 3).otherwise(F.col("n")))
    for other in (swapped, df.filter("n > 0"), df.replace("text number 7", "text", "full_text")):
        with pytest.raises(ValueError, match="order"):
            embed_incremental(spark, other, out, dataset=dataset_key(other, "full_text", ["n"]))
    assert spark.read.parquet(out).count() == 40
    assert dataset_key(df.limit(0), "full_text", ["n"]) == "0-0000000000000000"


def test_ordered_fingerprint_is_a_polynomial(spark):
    import hashlib

    from vellum.operators.embed import BASES, PRIME, ordered_fingerprint
    rows = [(i // 3, None if i == 5 else f"x{i * i}") for i in range(500)]
    got = ordered_fingerprint(spark.createDataFrame(rows, "k long, t string").repartition(6), "t", ["k"]).first()
    md5 = sorted((k, hashlib.md5((t or "").encode()).hexdigest()) for k, t in rows)
    for at, base, name in ((0, BASES[0], "hash_a"), (8, BASES[1], "hash_b")):
        value = 0
        for _, m in md5:
            value = (value * base + int(m[at:at + 8], 16)) % PRIME
        assert got[name] == value
    assert got.n_rows == 500


def test_file_sources(spark, tmpdir_path):
    from vellum.sources import files
    p = os.path.join(tmpdir_path, "ids.txt")
    with open(p, "w") as f:
        f.write("# bad ids\n\n  id2  \nid3\n#id4\n")
    ids = sorted(r.id for r in files.read_id_list(spark, p).collect())
    assert ids == ["id2", "id3"]
    csv = os.path.join(tmpdir_path, "t.csv")
    with open(csv, "w") as f:
        f.write("a,b\n1,2\n")
    assert files.read_any(spark, csv).count() == 1
    with pytest.raises(ValueError):
        files.read_any(spark, os.path.join(tmpdir_path, "x.xlsx"))
    m = spark.createDataFrame([(0, ["b", "a"]), (1, ["c"])], "main_topic int, names array<string>")
    jp = os.path.join(tmpdir_path, "map.json")
    files.write_topic_map(m, jp)
    assert files.read_topic_map(spark, jp).count() == 3
    cl = spark.createDataFrame([(1,), (1,), (2,), (-1,)], "cluster_id int")
    s = files.run_summary(cl, config="x").first()
    assert (s.n_clusters, s.n_outliers, s.n_rows) == (2, 1, 4)
    files.write_summary(files.run_summary(cl), os.path.join(tmpdir_path, "summary"))


def test_entry_contract(spark):
    import __spark_entry__ as se
    df = se.entry(spark)
    assert df.count() > 0
    q, o = se.queries(), se.oracle_sql()
    assert set(o) <= set(q)
    for name in ("clean_funnel", "knn_main", "tfidf_terms"):
        assert name in o


def test_embed_stream_resumes(spark, tmpdir_path):
    from vellum.streaming.jobs import embed_stream
    src = os.path.join(tmpdir_path, "src")
    out = os.path.join(tmpdir_path, "out")
    ck = os.path.join(tmpdir_path, "ck")
    schema = "emb_id string, full_text string"
    spark.createDataFrame([("a", "one"), ("b", "two")], schema).write.parquet(os.path.join(src, "p1"))
    embed_stream(spark, src + "/*", schema, out, ck)
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([("b", "two"), ("c", "three")], schema).write.parquet(os.path.join(src, "p2"))
    embed_stream(spark, src + "/*", schema, out, ck)
    assert spark.read.parquet(out).count() == 3


def test_classify_job_runs(spark):
    from vellum.plans import classes
    from vellum.plans.catalog import embeddings_with_classes
    from vellum.plans.jobs import classify_job
    from vellum.sources.tables import table
    sf = "/root/testdata/sf0.001"
    e = embeddings_with_classes(spark, sf)
    meta = table(spark, sf, "documents", "doc_id", "source", "lang").select(
        F.col("doc_id").alias("vec_id"), F.col("source").alias("journal"), F.col("lang").alias("publisher"))
    out = classify_job(e, e, meta, classes.routes(spark), classes.id_to_name(spark),
                       classes.journal_truth(spark), classes.publisher_truth(spark), id_col="vec_id",
                       vec="embedding", main_label="main_class", sub_label="label", exclude_self=True)
    n = out["predictions"].count()
    assert n > 0
    cov = out["coverage"].first()
    assert cov.n_rows == n and cov.n_combined <= n
    rep = {r["class"] for r in out["report_main"].collect()}
    assert {"accuracy", "macro avg", "weighted avg"} <= rep
    assert out["journal_accuracy"].count() > 0


def test_language_scores_in_rows_equal_the_join(spark, sf):
    from vellum.operators.lang import detect, train_profile
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(300)
    d = d.unionByName(spark.createDataFrame([(-1, None, None, None, 0), (-2, "", None, None, 0), (-3, "ab", None, None, 0),
                                             (-4, "12 34", None, None, 0)], d.schema))
    profile = train_profile(d, "doc_id", "text", "lang")
    rows, joined = ({r.doc_id: r.p for r in detect(d, profile, "doc_id", "text", "p", n).collect()} for n in (10 ** 9, -1))
    assert rows == joined and len(rows) == 304 and rows[-1] is None and rows[-4] is None and rows[-3] is not None


def test_large_samples_rank_one_range(spark, monkeypatch):
    from vellum.operators import sample
    df = spark.range(5000).withColumn("v", F.col("id") * 2)
    want = {r.id for r in sample.stable_sample(df, 777, "id").collect()}
    monkeypatch.setattr(sample, "TOP_ROWS", 10)
    assert {r.id for r in sample.stable_sample(df, 777, "id").collect()} == want
    assert sample.stable_sample(df, 9000, "id").count() == 5000


def test_term_counts_are_made_once(spark, sf):
    from vellum.plans.catalog import tfidf_terms
    plan = tfidf_terms(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # the texts are behind a written table
