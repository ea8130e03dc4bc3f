"""Result tables and run statistics over hits and outcomes."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from linetrawl.functions.paths import display_path, extension, format_timestamp, human_bytes
from linetrawl.functions.text import html_escape, quote_literal, sanitize_control
from linetrawl.operators.matching import is_portable, java_pattern
from linetrawl.sources.route import OFFICE_ONLY
from linetrawl.spec import SearchSpec

# Label of files without an extension, and summary keys.
NO_EXTENSION = "(なし)"
_SPAN = '<span class="hl">'
SUMMARY_KEYS = {
    "n_files": "走査ファイル数", "n_hit_files": "ヒットファイル数", "n_hits": "ヒット件数合計",
    "n_skipped": "スキップ数", "n_errors": "エラー数", "mode": "検索モード", "operator": "演算子",
    "keywords": "キーワード", "skip_breakdown": "スキップ内訳",
}


def results(hits: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per hit with extension and formatted mtime (blank where the file is unknown)."""
    times = manifest.select("path", "mtime")
    return hits.join(times, "path", "left").select(
        sanitize_control(F.col("path")).alias("path"), extension(F.col("path")).alias("ext"),
        sanitize_control(F.col("locator")).alias("locator"), sanitize_control(F.col("matched")).alias("matched"),
        sanitize_control(F.col("snippet")).alias("snippet"),
        F.coalesce(format_timestamp(F.col("mtime")), F.lit("")).alias("mtime"),
    )


def results_inline(hits: DataFrame) -> DataFrame:
    """The same rows where the hits already carry ``mtime``, which saves the join."""
    return hits.select(
        sanitize_control(F.col("path")).alias("path"), extension(F.col("path")).alias("ext"),
        sanitize_control(F.col("locator")).alias("locator"), sanitize_control(F.col("matched")).alias("matched"),
        sanitize_control(F.col("snippet")).alias("snippet"),
        F.coalesce(format_timestamp(F.col("mtime")), F.lit("")).alias("mtime"),
    )


def errors(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("outcome") == "error").select(
        sanitize_control(F.col("path")).alias("path"), sanitize_control(F.col("error")).alias("error"))


def skipped(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("outcome") == "skip").select("reason", sanitize_control(F.col("path")).alias("path"))


def skip_json(outcomes: DataFrame) -> DataFrame:
    """``reason`` and the JSON list of its paths, in bounded pieces.

    A reason may cover most of a huge run, so its list is cut into buckets of the path hash instead
    of being gathered in one place; ``bucket`` tells the pieces of a reason apart.
    """
    rows = skipped(outcomes).withColumn("path", display_path(F.col("path")))
    return (
        rows.withColumn("bucket", F.substring(F.md5("path"), 1, 3))
        .groupBy("reason", "bucket")
        .agg(F.to_json(F.array_sort(F.collect_list("path"))).alias("paths"))
    )


def console_lines(searched: DataFrame) -> DataFrame:
    """Printed block of each file with hits: a heading and one line per hit.

    ``searched`` has ``path`` and an ordered ``hits`` array (capped per file), so nothing is grouped.
    """
    lines = F.transform("hits", lambda h: F.concat(
        F.lit("  - "), F.when(h["locator"] != "", F.concat(F.lit("["), h["locator"], F.lit("] "))).otherwise(""),
        h["snippet"]))
    head = F.concat("path", F.lit("  ("), F.size("hits").cast("string"), F.lit(" hits)"))
    return searched.filter(F.size("hits") > 0).select(
        "path", F.array_join(F.concat(F.array(head), lines), "\n").alias("block"))


def highlight(snippet: Column, spec: SearchSpec) -> Column:
    """Escaped snippet with every keyword in a span.

    Keywords are found in the raw snippet in one pass, longer ones first, and the pieces are escaped
    afterwards, so a keyword never meets a tag or an entity. Patterns outside the portable
    subset are found by Python.
    """
    if spec.mode == "regex" and not all(map(is_portable, spec.keywords)):
        return _highlight_exact(spec)(snippet)
    if spec.mode == "regex":
        pattern = java_pattern("|".join(f"(?:{p})" for p in spec.keywords), spec.case_sensitive)
    else:
        pattern = ("" if spec.case_sensitive else "(?iu)") + "|".join(quote_literal(k) for k in sorted(spec.keywords, key=len, reverse=True))
    spans = F.transform(F.regexp_extract_all(snippet, F.lit(pattern), F.lit(0)), lambda m: F.concat(F.lit(_SPAN), html_escape(m), F.lit("</span>")))
    pieces = F.zip_with(F.split(snippet, pattern, -1), spans, lambda piece, span: F.concat(html_escape(piece), F.coalesce(span, F.lit(""))))
    return F.array_join(pieces, "")


def _highlight_exact(spec: SearchSpec):
    pattern = re.compile("|".join(f"(?:{p})" for p in spec.keywords), 0 if spec.case_sensitive else re.IGNORECASE)

    def one(text):
        out, at = [], 0
        for m in pattern.finditer(text):
            if m.end() > m.start():
                out += [html.escape(text[at:m.start()]), _SPAN, html.escape(m[0]), "</span>"]
                at = m.end()
        return "".join(out) + html.escape(text[at:])

    @F.arrow_udf("string")
    def mark(snippets: pa.Array) -> pa.Array:
        return pa.array([None if t is None else one(t) for t in snippets.to_pylist()], pa.string())

    return mark


def facet_match(path: Column, ext: Column, snippets: Column, want_ext: str = "", query: str = "") -> Column:
    """Extension facet and free text over path or any snippet, case-insensitively."""
    q = re.sub(r"^\s+|\s+$", "", query).lower()
    ext_ok = (ext == want_ext) if want_ext else F.lit(True)
    text_ok = (
        F.contains(F.lower(display_path(path)), F.lit(q)) | F.exists(snippets, lambda s: F.contains(F.lower(s), F.lit(q)))
        if q else F.lit(True)
    )
    return ext_ok & text_ok


def extension_counts(files: DataFrame) -> DataFrame:
    """Files per extension; order by count descending, then extension, to print."""
    label = F.coalesce(F.nullif(extension(F.col("path")), F.lit("")), F.lit(NO_EXTENSION))
    return files.groupBy(label.alias("ext")).agg(F.count("*").alias("n"))


def lane_counts(files: DataFrame) -> DataFrame:
    office = extension(F.col("path")).isin(*OFFICE_ONLY)
    return files.agg(F.count("*").alias("total"), F.count_if(~office).alias("plain"), F.count_if(office).alias("office"))


def hits_per_file(searched: DataFrame) -> DataFrame:
    return searched.filter(F.size("hits") > 0).select("path", F.size("hits").cast("bigint").alias("n_hits"))


def keyword_counts(hits: DataFrame, spec: SearchSpec) -> DataFrame:
    """Files and hits per keyword, as the spec writes it. Hits are first counted per (keyword, file), so that a keyword
    found everywhere is spread over the files before its single result row is formed."""
    per_file = hits.groupBy("kw_idx", "path").agg(F.count("*").alias("n"))
    counts = per_file.groupBy("kw_idx").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_hits"))
    keyword = F.element_at(F.array(*map(F.lit, spec.keywords)), F.col("kw_idx") + 1)
    return counts.select(keyword.alias("keyword"), "n_files", "n_hits")


def run_summary(outcomes: DataFrame, spec: SearchSpec) -> DataFrame:
    """One row of run totals; the skip breakdown is ``reason=n`` sorted by reason.

    Counted per (outcome, reason) first, so a handful of rows reach the final aggregate.
    """
    groups = outcomes.groupBy("outcome", "reason").agg(F.count("*").alias("n"), F.sum("n_hits").alias("h"))
    of = lambda name: F.coalesce(F.sum(F.when(F.col("outcome") == name, F.col("n"))), F.lit(0)).cast("bigint")
    pieces = F.array_sort(F.collect_list(F.when(
        F.col("outcome") == "skip", F.concat("reason", F.lit("="), F.col("n").cast("string")))))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_files"), of("hit").alias("n_hit_files"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "hit", F.col("h"))), F.lit(0)).cast("bigint").alias("n_hits"),
        of("skip").alias("n_skipped"), of("error").alias("n_errors"),
        F.lit(spec.mode).alias("mode"), F.lit(spec.operator).alias("operator"),
        F.lit(", ".join(spec.keywords)).alias("keywords"), F.array_join(pieces, ", ").alias("skip_breakdown"),
    )


def summary_rows(summary: DataFrame) -> DataFrame:
    """The one-row summary as key/value rows."""
    pairs = [F.struct(F.lit(i).alias("ord"), F.lit(label).alias("key"), F.col(c).cast("string").alias("value"))
             for i, (c, label) in enumerate(SUMMARY_KEYS.items())]
    return (
        summary.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
        .filter((F.col("key") != SUMMARY_KEYS["skip_breakdown"]) | (F.col("value") != ""))
        .select(F.col("ord").cast("bigint").alias("ord"), "key", sanitize_control(F.col("value")).alias("value"))
    )


def skip_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("outcome") == "skip").groupBy("reason").agg(F.count("*").alias("n"))


def report_index(runs: DataFrame, suffix: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Past reports of one type, with printable size and time; order by mtime descending to show."""
    return runs.filter((extension(F.col("name")) == suffix) & ~F.col("name").isin("_index.html", *exclude)).select(
        "name", human_bytes(F.col("size")).alias("size"), format_timestamp(F.col("mtime")).alias("ts"), "mtime")
