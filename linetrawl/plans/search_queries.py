"""Registered queries: searching."""

from __future__ import annotations

from pyspark.sql import functions as F

from linetrawl import ScanSpec, SearchSpec
from linetrawl.functions.similarity import ratio
from linetrawl.functions.text import casefold, nfkc, normalize, snippet
from linetrawl.operators.matching import exact_test, java_pattern
from linetrawl.operators.report import keyword_counts
from linetrawl.operators.search import (
    all_positions, explode_hits, file_hits, first_hit_files, line_offsets, search_segments, search_texts,
)
from linetrawl.plans import fixtures as fx
from linetrawl.sinks.files import write_files
from linetrawl.sources.files import walk_files
from linetrawl.sources.splits import split_segments
from linetrawl.workspace import shared_dir

KEYWORDS = ("the", "license", "123", "@")
BOTH = ("the", "and", "license")
PATTERNS = ("licen[a-z]+", "[0-9]{3,}", "[a-z0-9.]+@[a-z0-9.]+")
NAMED = (r"(?P<host>[a-z0-9]+)\.(?:com|org|net)", r"(?P<n>[0-9]{2,})-(?:[0-9]+)")
GROUPS = ("(?:th|an)+e", "(?:er|in){2,}g?")
#: Printable ASCII and its full-width forms, which NFKC turns back.
ASCII, WIDE = "".join(map(chr, range(0x21, 0x7F))), "".join(map(chr, range(0xFF01, 0xFF5F)))
#: Thousands of keywords by rule, and some that long texts hold all of.
_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
MANY = tuple(a + b + c for a in _CONSONANTS for b in _VOWELS for c in _CONSONANTS)
COMMON = tuple("en nt es er re ea ne on st de ee na te et as he ni it ti ha nd ei ou ie ta le io ng ra nl no ns ht rt at".split())
FUZZY = ("license", "copyright notice", "identification")
OR_SPEC = SearchSpec(KEYWORDS, operator="or")
AND_SPEC = SearchSpec(BOTH)
RX_SPEC = SearchSpec(PATTERNS, mode="regex")
HITS = ["path", "seg_idx", "locator", "kw_idx", "position", "matched", "snippet"]
_HIT_COLS = ", ".join(HITS)


def _hits_or(spark, sf_dir):
    return search_texts(fx.documents(spark, sf_dir), OR_SPEC)


def _searched(spark, sf_dir, spec=OR_SPEC):
    return file_hits(fx.documents(spark, sf_dir).select("file_ord", "path", "mtime", "text"), spec)


def _or_sql(select, cap=20, **more):
    return fx.with_views("segments_v", **fx.keyword_hits_ctes("segments_v", KEYWORDS, cap), **more) + select


def _first_files(spark, sf_dir, n):
    files = fx.documents(spark, sf_dir).select("file_ord", "path", "mtime", "text")
    return explode_hits(first_hit_files(files, OR_SPEC, n))


def _first_files_sql(n):
    return _or_sql(
        f"SELECT {_HIT_COLS} FROM hits WHERE path IN (SELECT path FROM first_files)",
        first_files=f"SELECT d.path FROM docs d WHERE d.path IN (SELECT path FROM hits) ORDER BY d.file_ord LIMIT {n}")


def written(spark, sf_dir):
    """Every document as a file in the shared folder; returns its root."""
    root = shared_dir(spark, "files")
    docs = fx.documents(spark, sf_dir)
    write_files(docs.select("path", F.encode("text", "UTF-8").alias("content")), root).write.format("noop").mode("overwrite").save()
    return root


def _split_lines(spark, sf_dir):
    """Segments of files that are read in byte ranges of 1,000 bytes."""
    root = written(spark, sf_dir)
    segments, _ = split_segments(walk_files(spark, [root], ScanSpec(("*",), (), (), None)), 1000)
    return segments.select(F.expr(f"substr(path, {len(root) + 1})").alias("path"), F.col("idx").cast("int").alias("idx"), "line_no", "locator", "text")


def _norm(column):
    def run(spark, sf_dir):
        return fx.table(spark, sf_dir, "documents").select("doc_id", column(F.col("text")).alias("t")).select(
            "doc_id", F.char_length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))
    return run


def _norm_sql(expr):
    return f"SELECT doc_id, CAST(length({expr}) AS BIGINT) AS n, md5({expr}) AS digest FROM documents"


QUERIES = {
    "segment_lines": lambda s, d: fx.segments_v(s, d),
    "segment_lines_split": _split_lines,
    "line_offsets": lambda s, d: line_offsets(fx.documents(s, d).select("path", "text")),
    "kw_or": _hits_or,
    "kw_and": lambda s, d: search_texts(fx.documents(s, d), AND_SPEC),
    "kw_capped": lambda s, d: search_texts(fx.documents(s, d), SearchSpec(KEYWORDS, operator="or", max_hits_per_file=3)),
    "kw_segments_or": lambda s, d: search_segments(fx.turns_v(s, d), OR_SPEC),
    "kw_segments_and": lambda s, d: search_segments(fx.turns_v(s, d), SearchSpec(("the", "and", "with"))),
    "kw_segments_large_cap": lambda s, d: search_segments(
        fx.segments_v(s, d), SearchSpec(("the", "and"), operator="or", max_hits_per_file=150)),
    "kw_positions": lambda s, d: all_positions(fx.segments_v(s, d), SearchSpec(BOTH)),
    "kw_many": lambda s, d: search_texts(fx.documents(s, d), SearchSpec(MANY, operator="or")),
    "kw_many_and": lambda s, d: search_texts(fx.documents(s, d), SearchSpec(COMMON, max_hits_per_file=50)),
    "kw_many_segments": lambda s, d: search_segments(fx.turns_v(s, d), SearchSpec(MANY, operator="or")),
    "kw_many_segments_and": lambda s, d: search_segments(fx.turns_v(s, d), SearchSpec(COMMON)),
    "agg_kw_many": lambda s, d: all_positions(fx.segments_v(s, d), SearchSpec(MANY)).groupBy("kw_idx").agg(
        F.count("*").alias("n_hits"), F.sum("position").alias("positions")),
    "agg_kw": lambda s, d: keyword_counts(_hits_or(s, d), OR_SPEC),
    "agg_kw_rx": lambda s, d: keyword_counts(search_texts(fx.documents(s, d), RX_SPEC), RX_SPEC),
    "rx_groups": lambda s, d: search_texts(fx.documents(s, d), SearchSpec(GROUPS, mode="regex")),
    "kw_segments_and_large_cap": lambda s, d: search_segments(fx.segments_v(s, d), SearchSpec(("the", "and"), max_hits_per_file=5000)),
    "rx_filter": lambda s, d: fx.segments_v(s, d).filter(F.col("text").rlike(java_pattern(PATTERNS[0], False))).select("path", "idx", "text"),
    "rx_positions": lambda s, d: search_texts(fx.documents(s, d), SearchSpec(PATTERNS, mode="regex")),
    "rx_exact_lane": lambda s, d: search_texts(fx.documents(s, d), SearchSpec(NAMED, mode="regex")),
    "rx_candidates": lambda s, d: fx.segments_v(s, d).filter(F.col("text").rlike(exact_test(SearchSpec(NAMED, mode="regex")))).select("path", "idx"),
    "fz_hits": lambda s, d: search_texts(fx.documents(s, d), SearchSpec(FUZZY, mode="fuzzy")),
    "fz_segments": lambda s, d: search_segments(fx.turns_v(s, d), SearchSpec(("than the", "ention"), mode="fuzzy")),
    "fz_ratio": lambda s, d: fx.segments_v(s, d).select(
        "path", "idx", F.round(ratio(F.lit("license"), F.col("text")), 6).alias("ratio")),
    "hits_ordered": lambda s, d: explode_hits(_searched(s, d), "file_ord").orderBy("file_ord", "seg_idx", "kw_idx", "position"),
    "limit_files": lambda s, d: _first_files(s, d, 7),
    "limit_first": lambda s, d: _first_files(s, d, 1),
    "norm_nfkc": _norm(lambda text: nfkc(F.translate(text, ASCII, WIDE))),
    "norm_casefold": _norm(casefold),
    "norm_text": _norm(normalize),
    "snippet": lambda s, d: fx.segments_v(s, d).select(
        "path", "idx", snippet(F.col("text"), F.col("idx") * 3, F.col("idx") * 3 + 5, 10).alias("snippet")),
}

ORACLES = {
    "segment_lines": fx.with_views("segments_v") + "SELECT path, idx, line_no, locator, text FROM segments_v",
    "segment_lines_split": fx.with_views("segments_v") + "SELECT path, idx, line_no, locator, text FROM segments_v",
    "line_offsets": fx.with_views("lines") + (
        "SELECT path, line_no, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY path ORDER BY line_no "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM lines"),
    "kw_or": _or_sql(f"SELECT {_HIT_COLS} FROM hits"),
    "kw_and": fx.with_views("segments_v", **fx.keyword_hits_ctes("segments_v", BOTH, both=True)) + f"SELECT {_HIT_COLS} FROM hits",
    "kw_capped": _or_sql(f"SELECT {_HIT_COLS} FROM hits", cap=3),
    "kw_segments_or": fx.with_views("turns_v", **fx.keyword_hits_ctes("turns_v", KEYWORDS)) + f"SELECT {_HIT_COLS} FROM hits",
    "kw_segments_and": fx.with_views("turns_v", **fx.keyword_hits_ctes("turns_v", ("the", "and", "with"), both=True)) + f"SELECT {_HIT_COLS} FROM hits",
    "kw_segments_large_cap": fx.with_views("segments_v", **fx.keyword_hits_ctes("segments_v", ("the", "and"), 150)) + f"SELECT {_HIT_COLS} FROM hits",
    "kw_positions": fx.with_views("segments_v", **fx.keyword_hits_ctes("segments_v", BOTH, None)) + "SELECT path, seg_idx, kw_idx, position FROM every_hit",
    "kw_many": fx.with_views("segments_v", **fx.keyword_hits_ctes("segments_v", MANY)) + f"SELECT {_HIT_COLS} FROM hits",
    "kw_many_and": fx.with_views("segments_v", **fx.keyword_hits_ctes("segments_v", COMMON, 50, both=True)) + f"SELECT {_HIT_COLS} FROM hits",
    "kw_many_segments": fx.with_views("turns_v", **fx.keyword_hits_ctes("turns_v", MANY)) + f"SELECT {_HIT_COLS} FROM hits",
    "kw_many_segments_and": fx.with_views("turns_v", **fx.keyword_hits_ctes("turns_v", COMMON, both=True)) + f"SELECT {_HIT_COLS} FROM hits",
    "agg_kw_many": fx.with_views("segments_v", **fx.keyword_hits_ctes("segments_v", MANY, None)) + (
        "SELECT kw_idx, count(*) AS n_hits, CAST(sum(position) AS BIGINT) AS positions FROM every_hit GROUP BY kw_idx"),
    "rx_groups": fx.with_views("segments_v", **fx.regex_hits_ctes("segments_v", GROUPS)) + f"SELECT {_HIT_COLS} FROM hits",
    "kw_segments_and_large_cap": fx.with_views("segments_v", **fx.keyword_hits_ctes("segments_v", ("the", "and"), 5000, both=True)) + f"SELECT {_HIT_COLS} FROM hits",
    "agg_kw_rx": fx.with_views("segments_v", **fx.regex_hits_ctes("segments_v", PATTERNS)) + (
        f"SELECT ({list(PATTERNS)!r})[CAST(kw_idx + 1 AS INT)] AS keyword, count(DISTINCT path) AS n_files, count(*) AS n_hits FROM hits GROUP BY kw_idx"),
    "agg_kw": _or_sql("SELECT matched AS keyword, count(DISTINCT path) AS n_files, count(*) AS n_hits FROM hits GROUP BY matched"),
    "rx_filter": fx.with_views("segments_v") + f"SELECT path, idx, text FROM segments_v WHERE regexp_matches(text, '(?i){PATTERNS[0]}')",
    "rx_positions": fx.with_views("segments_v", **fx.regex_hits_ctes("segments_v", PATTERNS)) + f"SELECT {_HIT_COLS} FROM hits",
    "rx_exact_lane": fx.with_views("segments_v", **fx.regex_hits_ctes("segments_v", NAMED)) + f"SELECT {_HIT_COLS} FROM hits",
    "rx_candidates": fx.with_views("segments_v") + "SELECT path, idx FROM segments_v WHERE regexp_matches(text, '(?i)com|org|net') OR contains(text, '-')",
    "hits_ordered": _or_sql("SELECT hits.*, docs.file_ord FROM hits JOIN docs USING (path)"),
    "limit_files": _first_files_sql(7),
    "limit_first": _first_files_sql(1),
    "norm_nfkc": _norm_sql("text"),
    "norm_casefold": _norm_sql(fx.FOLD.format("text")),
    "norm_text": _norm_sql(fx.FOLD.format("text")),
    "snippet": fx.with_views("segments_v") + f"SELECT path, idx, {fx.snippet_sql('text', '(idx * 3)', '5', 10)} AS snippet FROM segments_v",
}
