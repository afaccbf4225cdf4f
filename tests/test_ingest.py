"""Planted RDF files: field rules, malformed input, discovery, resume."""

import os

import pytest
from pyspark.sql import functions as F

from vellum.sources import ledger, rdf

HEAD = ('<?xml version="1.0" encoding="UTF-8"?>\n'
        '<rdf:RDF xmlns="https://example.org/schema/1.0/" '
        'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" '
        'xmlns:dc="http://purl.org/dc/elements/1.1/" '
        'xmlns:prism="http://prismstandard.org/namespaces/basic/2.0/">')
TAIL = "</rdf:RDF>"

GOOD = HEAD + """<Article>
<dc:title xml:lang="en">English title</dc:title>
<dc:title xml:lang="ja">日本語タイトル</dc:title>
<description><type>other</type><notation>not this</notation></description>
<description><type> Abstract </type><notation>&amp;lt;p&amp;gt;Body &amp;amp; more </notation></description>
<creator><Researcher><name> Alice </name><affiliationName>Uni A</affiliationName></Researcher></creator>
<creator><Researcher><name>Bob</name></Researcher></creator>
<productIdentifier><identifier rdf:datatype="http://example.org/DOI">10.1/xyz</identifier></productIdentifier>
<publication><prism:publicationName>J. Test</prism:publicationName><dc:publisher>Pub</dc:publisher>
<prism:publicationDate>2020-05</prism:publicationDate><prism:volume>3</prism:volume><prism:number>2</prism:number>
<prism:startingPage>10</prism:startingPage><prism:endingPage>20</prism:endingPage></publication>
<publication><prism:publicationName>Second</prism:publicationName></publication>
<topic dc:title="Physics"/><topic dc:title="Math"/>
<relatedTitle> Rel 1 </relatedTitle>
<createdAt>2020-01-01</createdAt><modifiedAt>2020-02-01</modifiedAt><modifiedAt> 2021-03-04 </modifiedAt>
</Article>""" + TAIL

NO_LANG = HEAD + """<Article><dc:title xml:lang="en">First en</dc:title><dc:title>No lang</dc:title>
<notation>fallback notation</notation></Article>""" + TAIL
EMPTY_FIRST = HEAD + """<Article><dc:title xml:lang="ja"></dc:title><dc:title>Second</dc:title></Article>""" + TAIL

BAD = {
    "truncated.rdf": HEAD + "<Article><dc:title>x</dc:title>",
    "entity.rdf": HEAD + "<Article>&undefined;</Article>" + TAIL,
    "two_roots.rdf": "<a/><b/>",
    "junk.rdf": "<a/>junk",
    "unbound.rdf": "<x:a/>",
    "empty.rdf": "",
}


def _write(root, name, text, raw=None):
    p = os.path.join(root, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(raw if raw is not None else text.encode("utf-8"))
    return p


def _plant(root):
    _write(root, "a/good.rdf", GOOD)
    _write(root, "a/b/nolang.rdf", NO_LANG)
    _write(root, "c/emptyfirst.rdf", EMPTY_FIRST)
    _write(root, "c/bom.rdf", None, raw=b"\xef\xbb\xbf" + GOOD.encode("utf-8"))
    _write(root, "c/readme.txt", "not rdf")
    for n, t in BAD.items():
        _write(root, "bad/" + n, t)


def test_discovery_and_fields(spark, tmpdir_path):
    _plant(tmpdir_path)
    df = rdf.ingest(spark, tmpdir_path)
    rows = {os.path.basename(r.file): r for r in df.collect()}
    assert "readme.txt" not in rows
    # Spark's file source lists no zero-length files, so an empty file gives
    # no row at all (documented difference: the original emits an error row).
    assert "empty.rdf" not in rows
    assert len(rows) == 4 + len(BAD) - 1
    g = rows["good.rdf"]
    assert g.error is None
    assert g.title == "日本語タイトル"
    assert g.abstract == "<p>Body & more"
    assert g.authors == ["Alice", "Bob"] and g.affiliations == ["Uni A"]
    assert g.doi == "10.1/xyz"
    assert (g.journal, g.publisher, g.publication_date, g.volume, g.issue, g.start_page, g.end_page) == (
        "J. Test", "Pub", "2020-05", "3", "2", "10", "20")
    assert g.topics == ["Physics", "Math"] and g.related_titles == ["Rel 1"]
    assert g.created_at == "2020-01-01" and g.modified_at == "2021-03-04"
    n = rows["nolang.rdf"]
    assert n.title == "No lang" and n.abstract == "fallback notation" and n.authors is None
    assert rows["emptyfirst.rdf"].title is None
    assert rows["bom.rdf"].error is None and rows["bom.rdf"].title == "日本語タイトル"
    for name in BAD:
        if name == "empty.rdf":
            continue
        r = rows[name]
        assert r.error is not None and r.error.startswith("ParseError"), (name, r.error)
        assert r.title is None and r.abstract is None
    assert df.columns[0] == "file" and df.columns[-1] == "error" and len(df.columns) == 18


def test_resumable_ingest(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    out = os.path.join(tmpdir_path, "out")
    _write(src, "one.rdf", GOOD)
    assert rdf.ingest_new_files(spark, src, out) == 1
    assert rdf.ingest_new_files(spark, src, out) == 0
    _write(src, "sub/two.rdf", NO_LANG)
    assert rdf.ingest_new_files(spark, src, out) == 1
    assert spark.read.parquet(out).count() == 2


class Stop(Exception):
    pass


@pytest.mark.parametrize("step", ["record", "publish"])
def test_a_stop_between_the_steps_adds_nothing_twice(spark, tmpdir_path, monkeypatch, step):
    """Rows are written, then the job dies: before the record, or before the files show."""
    src, out = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "out")
    for i in range(5):
        _write(src, f"d{i}.rdf", GOOD)
    _write(src, "odd [1]{a}*.rdf", NO_LANG)
    with monkeypatch.context() as m:
        m.setattr(ledger.Ledger, step, lambda *a: (_ for _ in ()).throw(Stop))
        with pytest.raises(Stop):
            rdf.ingest_new_files(spark, src, out, batch_files=2)
    book = ledger.Ledger(spark, out)
    assert book.rows() is None and book.batches() == []
    total = rdf.ingest_new_files(spark, src, out, batch_files=2)
    assert total == (6 if step == "record" else 4)  # a recorded batch was finished first
    rows = spark.read.parquet(out)
    assert rows.count() == 6 and rows.select("file").distinct().count() == 6
    assert [b["rows"] for b in book.batches()] == [2, 2, 2] and not os.listdir(os.path.join(out, "_stage"))
    assert len([n for n in os.listdir(os.path.join(out, "_ledger")) if n.endswith(".inputs")]) == 3
    assert rdf.ingest_new_files(spark, src, out) == 0


def test_half_published_batches_are_finished(spark, tmpdir_path, monkeypatch):
    out = os.path.join(tmpdir_path, "out")
    book, moves = ledger.Ledger(spark, out), []
    entry = book.stage(spark.range(100).repartition(4), spark.createDataFrame([("x",)], "file string"))
    book.record(entry)
    move = ledger.Ledger._move

    def some(self, a, b):
        if len(moves) == 2:
            raise Stop
        moves.append(b)
        move(self, a, b)

    with monkeypatch.context() as m:
        m.setattr(ledger.Ledger, "_move", some)
        with pytest.raises(Stop):
            book.publish(entry)
    assert ledger.Ledger(spark, out).recover().rows().count() == 100
    assert book.inputs().count() == 1 and ledger.Ledger(spark, out).recover().rows().distinct().count() == 100
    assert book.append(spark.range(0)) == 0 and len(book.batches()) == 1


def test_finished_files_are_not_read(spark, tmpdir_path):
    src, out = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "out")
    _write(src, "a.rdf", GOOD)
    assert rdf.ingest_new_files(spark, src, out) == 1
    os.chmod(os.path.join(src, "a.rdf"), 0)
    plan = rdf.list_files(spark, src)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    _write(src, "b.rdf", NO_LANG)
    with open(os.path.join(src, "a.rdf"), "wb") as f:  # other bytes: never looked at
        f.write(b"broken")
    assert rdf.ingest_new_files(spark, src, out) == 1
    assert {os.path.basename(r.file): r.error for r in spark.read.parquet(out).collect()} == {"a.rdf": None, "b.rdf": None}


def test_streaming_ingest_resumes(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    out = os.path.join(tmpdir_path, "out")
    ck = os.path.join(tmpdir_path, "ck")
    _write(src, "one.rdf", GOOD)
    _write(src, "two.rdf", NO_LANG)
    rdf.ingest_stream(spark, src, out, ck, max_files_per_trigger=1)
    assert spark.read.parquet(out).count() == 2
    _write(src, "three.rdf", EMPTY_FIRST)
    rdf.ingest_stream(spark, src, out, ck, max_files_per_trigger=1)
    assert spark.read.parquet(out).count() == 3


def test_merge_and_repair(spark, tmpdir_path):
    a = os.path.join(tmpdir_path, "b1")
    b = os.path.join(tmpdir_path, "b2")
    spark.createDataFrame([("f1", "t1")], "file string, title string").write.parquet(a)
    spark.createDataFrame([("f2", "x", 1)], "file string, extra string, volume int").write.parquet(b)
    m = rdf.merge_batches(spark, [a, b])
    assert m.count() == 2 and len(m.columns) == 18
    assert m.filter(F.col("file") == "f2").first().volume == "1"
    dst = os.path.join(tmpdir_path, "fixed")
    assert rdf.repair_batches(spark, os.path.join(tmpdir_path, "b*"), dst) == 2


def test_sampling(spark, tmpdir_path):
    _plant(tmpdir_path)
    files = rdf.discover(spark, tmpdir_path)
    s1 = [r.file for r in rdf.sample_files(files, 3).collect()]
    s2 = [r.file for r in rdf.sample_files(files, 3).collect()]
    assert s1 == s2 and len(s1) == 3
    assert rdf.sample_files(files, 100).count() == files.count()
    folders = rdf.sample_folders(files, 1).select(F.regexp_extract("file", r"^(.*)/[^/]*$", 1)).distinct()
    assert folders.count() == 1


def test_clean_job_partitions(spark, tmpdir_path, sf):
    from vellum.operators.lang import train_profile
    from vellum.plans.jobs import clean_job
    from vellum.sources.tables import table
    src = os.path.join(tmpdir_path, "src")
    long_en = "This abstract describes a long experiment, with results. " * 3
    for i in range(4):
        _write(src, f"d{i}.rdf", HEAD + f"""<Article><dc:title>Title {i} of a paper</dc:title>
<description><type>abstract</type><notation>{long_en}</notation></description></Article>""" + TAIL)
    _write(src, "lhd.rdf", HEAD + f"""<Article><dc:title>LHD #12 log</dc:title>
<description><type>abstract</type><notation>{long_en}</notation></description></Article>""" + TAIL)
    _write(src, "short.rdf", HEAD + "<Article><dc:title>T</dc:title><notation>short</notation></Article>" + TAIL)
    prof = train_profile(table(spark, sf, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang")
    res = clean_job(spark, src, prof, os.path.join(tmpdir_path, "en"), os.path.join(tmpdir_path, "other"))
    assert res["kept"] == 5
    assert res["english_scientific"] + res["english_not_scientific"] + res["other"] == res["kept"]


def test_declared_charsets_and_last_type(spark, tmpdir_path):
    """Bytes are read by byte-order mark or declaration; the last type and the last
    notation count, by their own text; comments do not split a text."""
    latin = HEAD.replace("UTF-8", "ISO-8859-1") + (
        "<Article><dc:title>Caf\u00e9</dc:title><description><type>abstract</type><type>other</type>"
        "<notation>not typed</notation></description><relatedTitle>one <!-- x -->two</relatedTitle></Article>") + TAIL
    wide = HEAD.replace("UTF-8", "UTF-16") + (
        "<Article><dc:title>\u65e5\u672c</dc:title><description><type>other</type><type>Abstract<b/>x</type>"
        "<notation>first</notation><notation>last<i>inner</i></notation></description></Article>") + TAIL
    _write(tmpdir_path, "latin.rdf", None, raw=latin.encode("latin-1"))
    _write(tmpdir_path, "wide.rdf", None, raw=wide.encode("utf-16"))
    _write(tmpdir_path, "prefix.rdf", GOOD.replace("dc:", "d:").replace("xmlns:dc", "xmlns:d"))
    rows = {os.path.basename(r.file): r for r in rdf.ingest(spark, tmpdir_path).collect()}
    assert rows["latin.rdf"].title == "Caf\u00e9" and rows["latin.rdf"].abstract == "not typed"
    assert rows["latin.rdf"].related_titles == ["one two"]
    assert rows["wide.rdf"].title == "\u65e5\u672c" and rows["wide.rdf"].abstract == "last"
    assert rows["prefix.rdf"].publisher == "Pub" and rows["prefix.rdf"].topics == ["Physics", "Math"]
