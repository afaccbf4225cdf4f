"""Corpus pipeline: quality rules, language ID, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, which
its predecessor kept; all but the last return the columns of ``documents``.
Null and empty texts fail the quality rules; extra columns, of any name, are carried
by every stage but the last, packed into one column while a stage works; repeated rows
and rows that share an id, or have none, are separate documents until the near-duplicates
go; an empty table passes through as an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, langid, mixing, quality, simhash
from vellum.llm.catalog import digests
from vellum.llm.common import documents
from vellum.session import checkpoint_dir

#: The network, the links and the encoding have no SQL form.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive cutoffs."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    judged = quality.apply_rules(docs.select(row, "text", "lang", "source"), keep=["row"])
    return judged.filter("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; all of them if nothing is labelled."""
    return langid.known_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, some twice, some not at all."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    keep = ["doc_id", "lang", "source"]
    ids = bpe.bpe_encode(docs, path, public_tokenizers.PATTERN, keep=keep)
    return digests(bpe.bpe_decode(ids, path), keep)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id),
          ("near_duplicates", near_duplicates), ("mix_sources", mix_sources),
          ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each result is written to the shared folder
    and read again by the next stage."""
    docs = documents(spark, sf_dir)
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
