"""Column functions for text: normalisation, lines, snippets, escaping.

Everything here stays in the JVM. NFKC and full case folding are not Spark functions, but ICU is
part of every Spark 4 distribution (collations use it) and ``reflect`` calls a static method of it,
so no text has to cross into a Python worker.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, functions as F

# Line terminators and the characters that count as blank.
LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"
RARE_LINE_BREAKS = ("\r", "\x0b", "\f", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
NON_BLANK = r"(?U)[^\s\x1c-\x1f]"


def nfkc(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def casefold(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))


def normalize(text: Column, case_sensitive: bool = False, normalize_width: bool = True) -> Column:
    """NFKC (width folding) first, then case folding, each only if asked for.

    ``reflect`` is non-deterministic to the optimizer, so the result is computed once where it is
    projected and never duplicated into later expressions. ASCII text cannot change under NFKC.
    """
    out = text
    if normalize_width:
        out = F.when(text.rlike(r"[^\x00-\x7f]"), nfkc(text)).otherwise(text)
    if not case_sensitive:
        out = casefold(out)
    return F.when(text.isNotNull(), out)


def normalize_literal(text: str, case_sensitive: bool = False, normalize_width: bool = True) -> str:
    """The same normalisation for one driver-side string, such as a keyword."""
    if normalize_width:
        text = unicodedata.normalize("NFKC", text)
    return text if case_sensitive else text.casefold()


def once(value: Column) -> Column:
    """Generator that yields ``value`` itself, one row in, one row out.

    The optimizer copies a projected expression into every filter on it, its own filters below
    ``explode`` included. The output of a generator is computed once and only referenced.
    """
    return F.explode(F.array(value))


def is_blank(text: Column) -> Column:
    return ~text.rlike(NON_BLANK)


def has_rare_break(text: Column) -> Column:
    """Whether a text has a line terminator other than LF; byte search beats a regex here."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in RARE_LINE_BREAKS])


def split_lines(text: Column) -> Column:
    """All lines of a text, blank ones included; single-character split where that is enough."""
    return F.when(has_rare_break(text), F.split(text, LINE_BREAK, -1)).otherwise(F.split(text, "\n", -1))


def line_segments(raw: Column, normalized: Column | None = None) -> Column:
    """ARRAY<STRUCT<seg_idx, line_no, text>> of the non-blank lines of a whole file."""
    text = raw if normalized is None else normalized
    numbered = F.transform(
        split_lines(text), lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("text"))
    )
    kept = F.filter(numbered, lambda s: ~is_blank(s["text"]))
    return F.transform(
        kept,
        lambda s, i: F.struct(
            i.alias("seg_idx"), s["line_no"].alias("line_no"), s["text"].alias("text")
        ),
    )


def line_locator(line_no: Column) -> Column:
    return F.concat(F.lit("行 "), line_no.cast("string"))


def snippet(text: Column, start: Column, end: Column, chars: int, length: Column | None = None) -> Column:
    """``text[start:end]`` with ``chars`` characters either side; dots only where text was cut.

    ``length`` spares counting the characters of ``text`` again where that is known.
    """
    length = F.char_length(text) if length is None else length
    lo = F.greatest(start - F.lit(chars), F.lit(0))
    hi = F.least(end + F.lit(chars), length)
    body = text.substr(lo + F.lit(1), hi - lo)
    for space in "\r\n\t":
        body = F.replace(body, F.lit(space), F.lit(" "))
    return F.concat(
        F.when(lo > 0, F.lit("...")).otherwise(F.lit("")),
        body,
        F.when(hi < length, F.lit("...")).otherwise(F.lit("")),
    )


def sanitize_control(text: Column) -> Column:
    """Control characters that workbook cells reject become a space (tab, LF and CR stay)."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")


def sanitize_name(name: Column) -> Column:
    """File-name-safe version of a title; blank titles become ``_``."""
    cleaned = F.regexp_replace(name, r'[\\/:*?"<>|]', "_")
    cleaned = F.regexp_replace(cleaned, r"(?U)^\s+|\s+$", "")
    return F.when(name.isNull() | is_blank(name), F.lit("_")).otherwise(cleaned)


def html_escape(text: Column) -> Column:
    # Characters and their entities; the ampersand comes first.
    for char, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"),
    ):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def quote_literal(keyword: str) -> str:
    """A keyword as a Java regex literal."""
    return "\\Q" + keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E"
