"""SQL fragments (DuckDB / RE2 dialect) mirroring the Column functions.

Used only to write the independent oracle queries.  Patterns share the
character classes of ``vellum.functions.text`` (valid in Java and RE2);
Java-only flags such as ``(?d)``/``(?U)`` are not used here (in RE2 ``.``
already stops at ``\\n`` and ``(?U)`` would mean *ungreedy*).
"""

from __future__ import annotations

from vellum.functions.text import WORD, WS
from vellum.operators.filters import (BOILERPLATE_BODY, CITATION_BODY, DIAGNOSTIC_BODY,
                                      META_KEYWORDS, MIN_ABSTRACT_CHARS, SENTENCE_MARKS)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def blank(x: str) -> str:
    return f"coalesce({strip(x)} = '', true)"


def clean_abstract(x: str, decode=lambda x: x) -> str:
    """T1; ``decode`` writes the SQL that decodes a table's entities (most hold none)."""
    one = q(r"\1")
    t = f"coalesce({x}, '')"
    t = decode(f"regexp_replace({t}, '<[^>]+>', ' ', 'g')")
    t = f"regexp_replace({t}, {q(r'\\"([a-zA-Z])')}, {one}, 'g')"
    t = f"regexp_replace({t}, {q(r"\\'")}, '', 'g')"
    t = f"regexp_replace({t}, {q(r'\$(.*?)\$')}, {one}, 'g')"
    t = f"regexp_replace({t}, {q(r'\\[a-zA-Z]+\{(.*?)\}')}, {one}, 'g')"
    t = f"regexp_replace({t}, {q(r'\\(begin|end)\{.*?\}')}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(r'\\[a-zA-Z]+')}, '', 'g')"
    t = f"replace(replace({t}, '``', '\"'), {q("''")}, '\"')"
    t = f"regexp_replace({t}, {q(WS + '+')}, ' ', 'g')"
    return strip(t)


def informative_reason(x: str) -> str:
    empty = "''"
    t = f"lower({strip(f'coalesce({x}, {empty})')})"
    starts = " OR ".join(f"starts_with({t}, {q(k)})" for k in META_KEYWORDS)
    marks = " OR ".join(f"contains({t}, {q(m)})" for m in SENTENCE_MARKS)
    return (f"CASE WHEN length({t}) < {MIN_ABSTRACT_CHARS} THEN 'too_short' "
            f"WHEN {starts} THEN 'metadata_prefix' "
            f"WHEN regexp_matches({t}, {q(CITATION_BODY)}) THEN 'citation' "
            f"WHEN NOT ({marks}) THEN 'no_sentence_mark' END")


def dropped_by(title: str, abstract: str) -> str:
    return (f"CASE WHEN {blank(title)} OR {blank(abstract)} THEN 'empty' "
            f"ELSE {informative_reason(abstract)} END")


def document_type(x: str) -> str:
    pat = "(?i)" + DIAGNOSTIC_BODY
    return (f"CASE WHEN {x} IS NULL THEN 'unknown' "
            f"WHEN regexp_matches(lower({strip(x)}), {q(pat)}) THEN 'diagnostic_report' "
            f"ELSE 'scientific_paper' END")


def boilerplate(x: str) -> str:
    # RE2's word boundary knows ASCII words only
    pat = "(?i)" + BOILERPLATE_BODY.replace("\\b", f"([^{WORD[1:]}|$)")
    return f"regexp_matches(coalesce({x}, ''), {q(pat)})"


def first_line(x: str) -> str:
    return f"split_part({x}, chr(10), 1)"
