"""Bibliographic RDF/XML ingest.

Files are read with the ``binaryFile`` source (recursive, glob-filtered);
each record becomes one row of the publications table.  A malformed file
never fails the job: an Arrow-batched pandas UDF parses the bytes once with the
standard-library XML parser, which honours byte-order marks and declared
encodings, and returns the fields as they stand in the record, or the error text
(``"ParseError: …"``); every other column is NULL for the broken rows.  Stripping,
entity decoding and empty values are Spark expressions.

Element names are matched by ``local-name()``, so any namespace prefix or
default namespace works.  (The original DOI lookup used an unprefixed path
against a default-namespaced document and therefore never matched; the
intended lookup is built here.)
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import html_unescape, ustrip
from vellum.session import cut_lineage
from vellum.sources.ledger import Ledger
from vellum.sources.schema import PUBLICATION_SCHEMA, conform


# S1 ------------------------------------------------------------------------------
def discover(spark: SparkSession, root: str, pattern: str = "*.rdf") -> DataFrame:
    """(file, content) for every matching file below ``root``, recursively."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", pattern).load(root)
                 .select(F.col("path").alias("file"), "content"))


# S3, X1–X9 --------------------------------------------------------------------------
# The namespace of titles, and the element names of the record's fields.
TITLE = "{http://purl.org/dc/elements/1.1/}title"
PUBLICATION_FIELDS = {"journal": "publicationName", "publisher": "publisher", "publication_date": "publicationDate",
                      "volume": "volume", "issue": "number", "start_page": "startingPage", "end_page": "endingPage"}
# End of fixed values.
TEXTS = ("title", "abstract", "doi", "created_at", "modified_at", *PUBLICATION_FIELDS)
LISTS = ("authors", "affiliations", "topics", "related_titles")
RECORD = T.StructType([*[T.StructField(c, T.StringType()) for c in (*TEXTS, "error")],
                       *[T.StructField(c, T.ArrayType(T.StringType())) for c in LISTS]])


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def _string(e: ET.Element) -> str:
    """All text below an element."""
    return "".join(e.itertext())


def _texts(e: ET.Element) -> list[str]:
    """An element's own pieces of text, between its children."""
    return [x for x in (e.text, *(c.tail for c in e)) if x]


def _attribute(e: ET.Element, name: str) -> list[str]:
    return [v for k, v in e.attrib.items() if _local(k) == name]


def _by_name(root: ET.Element) -> tuple[dict[str, list], dict]:
    """Elements by local name, in document order, and each element's parent."""
    found, parent = {}, {}
    for e in root.iter():
        found.setdefault(_local(e.tag), []).append(e)
        for c in e:
            parent[c] = e
    return found, parent


def _children(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e if _local(c.tag) == name]


def _abstract(found: dict[str, list]) -> str | None:
    """The last notation of the first description whose last type says so, else the first
    notation; an element's own text is what stands before its first child."""
    for d in found.get("description", ()):
        kinds = [c.text for c in _children(d, "type") if c.text]
        notations = [c.text for c in _children(d, "notation") if c.text]
        if kinds and notations and " ".join(kinds[-1].strip(" \t\r\n").split()).lower() == "abstract":
            return notations[-1]
    return next((e.text for e in found.get("notation", ()) if e.text), None)


def record_fields(root: ET.Element) -> dict:
    """The 16 content fields of a record, as they stand there."""
    found, parent = _by_name(root)
    out: dict = dict.fromkeys(TEXTS)
    titles = [e for e in found.get("title", ()) if e.tag == TITLE]
    other = [e for e in titles if "en" not in _attribute(e, "lang")]
    if titles:
        out["title"] = _string((other or titles)[0])
    out["abstract"] = _abstract(found)
    for e in found.get("identifier", ()):
        kind = _attribute(e, "datatype")
        if kind and "DOI" in kind[0] and e in parent and _local(parent[e].tag) == "productIdentifier":
            out["doi"] = _string(e)
            break
    for field, name in (("created_at", "createdAt"), ("modified_at", "modifiedAt")):
        out[field] = next((s for s in map(_string, reversed(found.get(name, ()))) if s), None)
    if publication := found.get("publication"):
        for field, name in PUBLICATION_FIELDS.items():
            out[field] = next((s for s in map(_string, _children(publication[0], name)) if s), None)
    people = [e for e in found.get("Researcher", ()) if e in parent and _local(parent[e].tag) == "creator"]
    for field, name in (("authors", "name"), ("affiliations", "affiliationName")):
        last = [[c for c in _children(e, name) if _string(c)][-1:] for e in people]
        out[field] = [x for found_ in last for c in found_ for x in _texts(c)]
    out["topics"] = [v for e in found.get("topic", ()) for v in _attribute(e, "title")]
    out["related_titles"] = [x for e in found.get("relatedTitle", ()) for x in _texts(e)]
    return out


def _read(b) -> dict:
    """A record's fields, or the error."""
    empty: dict = dict.fromkeys((*TEXTS, *LISTS))
    if b is None:
        return empty | {"error": "ValueError: no content"}
    try:
        return record_fields(ET.fromstring(bytes(b))) | {"error": None}
    except ET.ParseError as e:
        return empty | {"error": f"ParseError: {e}"}
    except Exception as e:  # noqa: BLE001 - the message is the data
        return empty | {"error": f"{type(e).__name__}: {e}"}


@F.pandas_udf(RECORD)
def read_record(content: pd.Series) -> pd.DataFrame:
    """The fields of each record, or the parser's message."""
    return pd.DataFrame([_read(b) for b in content], columns=RECORD.names, dtype=object)


def _nullif_empty(c: Column) -> Column:
    return F.when(c != "", c)


def _non_empty_list(a: Column) -> Column:
    a = F.filter(F.transform(a, lambda s: ustrip(s)), lambda s: s != "")
    return F.when(F.size(a) > 0, a)


def parse_records(df: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """(file, content bytes) → publications table (18 columns, fixed order); each
    record is parsed once."""
    r = df.select(F.col(file).alias("file"), read_record(F.col(content)).alias("_r")).select("file", "_r.*")
    plain = {c: _nullif_empty(ustrip(F.col(c))) for c in TEXTS}
    plain["title"] = _nullif_empty(F.col("title"))
    plain["abstract"] = ustrip(html_unescape(_nullif_empty(F.col("abstract"))))
    lists = {c: _non_empty_list(F.col(c)) for c in LISTS}
    return conform(r.select("file", "error", *[v.alias(k) for k, v in (plain | lists).items()]), PUBLICATION_SCHEMA)


def ingest(spark: SparkSession, root: str, pattern: str = "*.rdf") -> DataFrame:
    return parse_records(discover(spark, root, pattern))


# S4 -------------------------------------------------------------------------------
BATCH_FILES = 50_000      # files of a committed batch; their paths pass through the driver


def list_files(spark: SparkSession, root: str, pattern: str = "*.rdf") -> DataFrame:
    """(file, length) from the listing alone: the source reads no bytes of a file whose
    content is not asked for."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
            .load(root).select(F.col("path").alias("file"), "length"))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, content) of the named files; Spark deals them to tasks by their lengths."""
    literal = [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths]  # a path is no pattern
    return spark.read.format("binaryFile").load(literal).select(F.col("path").alias("file"), "content")


def ingest_new_files(spark: SparkSession, root: str, out: str, pattern: str = "*.rdf",
                     batch_files: int = BATCH_FILES) -> int:
    """Resumable batch ingest: parse only files whose path is not in the sink's ledger
    and append them, in committed batches of ``batch_files`` in order of their paths;
    returns the number of new rows.  Keyed on the path, so adding files never shifts
    earlier work; finished files are listed, not read."""
    ledger = Ledger(spark, out).recover()
    done = ledger.inputs()
    if done is None and (old := ledger.rows()) is not None:  # a sink from before the ledger
        done = old.select("file")
    todo = list_files(spark, root, pattern)
    if done is not None:
        todo = todo.join(done.select("file"), "file", "left_anti")
    todo, added, last = cut_lineage(todo), 0, ""
    while True:
        batch = todo.filter(F.col("file") > last).orderBy("file").limit(batch_files)
        paths = [r.file for r in batch.select("file").collect()]
        if not paths:
            return added
        last = paths[-1]
        added += ledger.append(parse_records(read_files(spark, paths)), batch.select("file"), {"root": root})


def ingest_stream(spark: SparkSession, root: str, out: str, checkpoint: str,
                  max_files_per_trigger: int = 50_000, pattern: str = "*.rdf"):
    """Structured-Streaming ingest: every file once, in bounded micro-batches,
    resumable from ``checkpoint``; runs until the folder is drained."""
    src = (spark.readStream.format("binaryFile").schema(
               "path string, modificationTime timestamp, length long, content binary")
           .option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
           .option("maxFilesPerTrigger", max_files_per_trigger).load(root)
           .select(F.col("path").alias("file"), "content"))
    q = (parse_records(src).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


# S5 / S6 ---------------------------------------------------------------------------
def merge_batches(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Concatenate batch outputs whose columns differ (missing → NULL, extra dropped)."""
    from vellum.sources.schema import union_conformed
    return union_conformed([spark.read.parquet(p) for p in paths], PUBLICATION_SCHEMA)


def repair_batches(spark: SparkSession, src: str, dst: str) -> int:
    """Read all batch files (schemas merged, unreadable files skipped), conform
    and write to a *new* path.  Returns the row count written."""
    read = spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", "true")
    conform(read.parquet(src), PUBLICATION_SCHEMA).write.mode("overwrite").parquet(dst)
    return spark.read.parquet(dst).count()


def skipped_inputs(spark: SparkSession, src: str) -> DataFrame:
    """(file) of the batch files that gave no row: unreadable or empty ones."""
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
              .load(src).select(F.col("path").alias("file")))
    read = (spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", "true").parquet(src)
            .select(F.input_file_name().alias("file")).distinct())
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return (listed.select(plain("file").alias("file"))
            .join(read.select(plain(F.url_decode("file")).alias("file")), "file", "left_anti"))


# S2 / S12 ---------------------------------------------------------------------------
def sample_files(files: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    from vellum.operators.sample import stable_sample
    return stable_sample(files, n, key="file", seed=seed)


def sample_folders(files: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Keep the files of ``n`` seeded-hash-chosen parent folders."""
    from vellum.operators.sample import sample_groups
    f = files.withColumn("folder", F.regexp_extract("file", r"^(.*)/[^/]*$", 1))
    return sample_groups(f, "folder", n, seed).drop("folder")


# Derived records: documents as RDF ------------------------------------------------
def _esc(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def documents_as_rdf(docs: DataFrame) -> DataFrame:
    """Render document rows as RDF/XML records (file, content bytes) so the
    ingest path can run over data derived from a table."""
    title = F.substring_index("text", "\n", 1)
    body = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns="https://example.org/schema/1.0/" '
              'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" '
              'xmlns:dc="http://purl.org/dc/elements/1.1/" '
              'xmlns:prism="http://prismstandard.org/namespaces/basic/2.0/"><Article>'),
        F.lit('<dc:title xml:lang="'), F.col("lang"), F.lit('">'), _esc(title), F.lit("</dc:title>"),
        F.lit('<dc:title xml:lang="en">'), _esc(F.upper(title)), F.lit("</dc:title>"),
        F.lit("<description><type>abstract</type><notation>"), _esc(_esc(F.col("text"))),
        F.lit("</notation></description>"),
        F.lit("<creator><Researcher><name>Author "), F.col("doc_id").cast("string"),
        F.lit("</name><affiliationName>"), F.col("source"), F.lit("</affiliationName></Researcher></creator>"),
        F.lit("<publication><prism:publicationName>Journal "), F.col("source"),
        F.lit("</prism:publicationName><dc:publisher>"), F.col("lang"),
        F.lit("</dc:publisher><prism:publicationDate>2024-01-"),
        F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"),
        F.lit("</prism:publicationDate><prism:volume>"), F.pmod("doc_id", F.lit(40)).cast("string"),
        F.lit("</prism:volume><prism:number> 7 </prism:number><prism:startingPage>"), F.col("doc_id").cast("string"),
        F.lit("</prism:startingPage><prism:endingPage>"), (F.col("doc_id") + 9).cast("string"),
        F.lit("</prism:endingPage></publication>"),
        F.lit('<productIdentifier><identifier rdf:datatype="https://example.org/NAID">x</identifier>'
              '<identifier rdf:datatype="https://example.org/DOI">10.1000/'), F.col("doc_id").cast("string"),
        F.lit("</identifier></productIdentifier>"),
        F.lit('<topic dc:title="'), F.col("source"), F.lit('"/>'),
        F.lit("<relatedTitle> About <!-- a comment -->"), F.col("source"), F.lit(" </relatedTitle>"),
        F.lit("<createdAt>2024-01-01</createdAt><createdAt> 2024-02-01 </createdAt>"),
        F.lit("<modifiedAt>2024-03-0"), F.pmod("doc_id", F.lit(9)).cast("string"), F.lit("</modifiedAt>"),
        # one record in 97 breaks off
        F.when(F.pmod("doc_id", F.lit(97)) == 13, F.lit("</Article>")).otherwise(F.lit("</Article></rdf:RDF>")))
    return docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".rdf")).alias("file"),
                       F.encode(body, "UTF-8").alias("content"))
