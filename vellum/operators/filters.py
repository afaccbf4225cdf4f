"""Row filters and partitions of the cleaning stage.

All filters are Column predicates, so Catalyst pushes what it can into the
scan and keeps the rest inside one codegen stage.  Instead of dropping rows
silently, ``annotate_informative`` tags each row with the first rule that
would drop it; callers filter on ``dropped_by IS NULL``.  Partitions use
``coalesce(cond, false)`` so that NULL conditions land on exactly one side,
as with two-valued pandas masks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import DIGIT, WS, clean_abstract, col, is_blank, ustrip

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
META_KEYWORDS = ("article", "論文", "type:", "identifier:", "application/",
                 "text/", "pdf", "html", "doi", "report")
MIN_ABSTRACT_CHARS = 100
SENTENCE_MARKS = ".。、,"
# Whole patterns; WS and DIGIT spell out the white space and digits of Python's
# regular expressions, which Java's and RE2's classes do not equal.
CITATION_BODY = f"^.*(pp?\\.?{WS}*[0-9一二三四五六七八九十]+[-‐~〜][0-9一二三四五六七八九十]+).*;?{WS}*({DIGIT}{{4}})$"
DIAGNOSTIC_BODY = f"\\blhd{WS}*(bolometer|flxloop|fpellet|interferometer|cxrs|ece|diagnostic|probe)\\b|^lhd\\b|\\blhd{WS}*#?{DIGIT}+"  # noqa: E501
BOILERPLATE_BODY = "^(type|application|departmental|bulletin|text|論文|記事|表紙|裏表紙|奥付|目次)\\b"
# End of fixed values.
# ---------------------------------------------------------------------------

# Java: (?d) so that '.' stops only at '\n' (RE2 already behaves so).
CITATION_RE = "(?d)" + CITATION_BODY
DIAGNOSTIC_RE = "(?iU)" + DIAGNOSTIC_BODY
BOILERPLATE_RE = "(?iU)" + BOILERPLATE_BODY


# F1 -------------------------------------------------------------------------
def non_empty(title: str | Column = "title", abstract: str | Column = "abstract") -> Column:
    return ~is_blank(title) & ~is_blank(abstract)


def drop_empty(df: DataFrame, title: str = "title", abstract: str = "abstract") -> DataFrame:
    return df.filter(non_empty(title, abstract))


# F2 -------------------------------------------------------------------------
def informative_reason(abstract: str | Column = "abstract") -> Column:
    """First informativeness rule a raw abstract fails, or NULL if it passes.

    Rules, in order: too_short, metadata_prefix, citation, no_sentence_mark.
    (The "short metadata word" rule of the original can never fire after the
    100-character rule and is left out.)
    """
    t = F.lower(ustrip(F.coalesce(col(abstract), F.lit(""))))
    starts = F.lit(False)
    for kw in META_KEYWORDS:
        starts = starts | t.startswith(kw)
    marks = F.lit(False)
    for m in SENTENCE_MARKS:
        marks = marks | (F.instr(t, m) > 0)
    return (F.when(F.length(t) < MIN_ABSTRACT_CHARS, "too_short")
            .when(starts, "metadata_prefix")
            .when(t.rlike(CITATION_RE), "citation")
            .when(~marks, "no_sentence_mark"))


def drop_uninformative(df: DataFrame, abstract: str = "abstract") -> DataFrame:
    return df.filter(informative_reason(abstract).isNull())


def annotate_informative(df: DataFrame, title: str = "title",
                         abstract: str = "abstract") -> DataFrame:
    """Add ``dropped_by``: 'empty' (F1) or an F2 reason; NULL for kept rows."""
    return df.withColumn(
        "dropped_by",
        F.when(~non_empty(title, abstract), "empty").otherwise(informative_reason(abstract)))


# F3 / U3 --------------------------------------------------------------------
def english_cond(title_lang: str = "title_lang", abstract_lang: str = "abstract_lang") -> Column:
    return F.coalesce((F.col(title_lang) == "en") & (F.col(abstract_lang) == "en"), F.lit(False))


def split_english(df: DataFrame, title_lang: str = "title_lang",
                  abstract_lang: str = "abstract_lang") -> tuple[DataFrame, DataFrame]:
    """Disjoint, exhaustive partition; NULL languages go to the second frame."""
    cond = english_cond(title_lang, abstract_lang)
    return df.filter(cond), df.filter(~cond)


# F4 -------------------------------------------------------------------------
def drop_null_lang(df: DataFrame, cols=("title_lang", "abstract_lang")) -> DataFrame:
    return df.dropna(subset=list(cols))


# F5 -------------------------------------------------------------------------
def document_type(title: str | Column = "title") -> Column:
    t = F.lower(ustrip(col(title)))
    return (F.when(col(title).isNull(), "unknown")
            .when(t.rlike(DIAGNOSTIC_RE), "diagnostic_report")
            .otherwise("scientific_paper"))


def split_document_type(df: DataFrame, title: str = "title") -> tuple[DataFrame, DataFrame]:
    """(scientific papers, diagnostic reports); 'unknown' goes to neither, as in the source."""
    typed = df.withColumn("type", document_type(title))
    return (typed.filter(F.col("type") == "scientific_paper"),
            typed.filter(F.col("type") == "diagnostic_report"))


# F6 -------------------------------------------------------------------------
def is_boilerplate(clean: str | Column = "clean_abstract") -> Column:
    return F.coalesce(col(clean), F.lit("")).rlike(BOILERPLATE_RE)


def drop_boilerplate(df: DataFrame, clean: str = "clean_abstract") -> DataFrame:
    return df.filter(~is_boilerplate(clean))


# F7 / F9 / F10 --------------------------------------------------------------
def is_outlier(cluster_col: str = "cluster_id") -> Column:
    """Cluster id −1 marks noise; works for integer and string ids."""
    return F.coalesce(F.col(cluster_col).cast("string") == "-1", F.lit(False))


def drop_outliers(df: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    return df.filter(~is_outlier(cluster_col))


# Composite: one pass of the cleaning stage ------------------------------------
def clean_stage(df: DataFrame, title: str = "title", abstract: str = "abstract",
                title_lang: str = "title_lang", abstract_lang: str = "abstract_lang") -> DataFrame:
    """F1 → F2 (as reason) → T1 → F3 → F5 as added columns, no row dropped.

    ``clean_abstract`` is only computed for rows that survive F1/F2 (the
    expensive entity decoder never sees dropped rows).
    """
    a = annotate_informative(df, title, abstract)
    kept = F.col("dropped_by").isNull()
    return (a.withColumn("clean_abstract", F.when(kept, clean_abstract(abstract)))
             .withColumn("split", F.when(english_cond(title_lang, abstract_lang), "english")
                         .otherwise("other"))
             .withColumn("type", document_type(title)))
