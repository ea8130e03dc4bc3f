"""Registered queries: listing, filtering, routing, decoding, outcomes, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from linetrawl import ScanSpec, SearchSpec
from linetrawl.functions.paths import format_timestamp
from linetrawl.operators import report
from linetrawl.operators.scan import scan
from linetrawl.plans import fixtures as fx
from linetrawl.plans import office_fixtures as of
from linetrawl.plans.search_queries import written
from linetrawl.sources.datasource import source_files
from linetrawl.sources.files import filter_manifest, union_roots, with_extra_root
from linetrawl.sources.plaintext import decode_text, guess_decode, looks_like_text
from linetrawl.sources.route import BINARY, route, skip_reason
from linetrawl.spec import DEFAULT_EXCLUDE_DIRS, DEFAULT_EXTENSIONS

SPEC = SearchSpec(("the", "license", "123", "@"), operator="or")
ANY = ScanSpec(extensions=("*",), exclude_dirs=(), exclude_patterns=(), max_size_mb=None)
ROOTS = ["/share/src1", "/share/src2/", "/share/src1/en", "/missing", ""]
_PATH = "SELECT path FROM files_v"


def _filtered(**changes):
    base = {k: getattr(ANY, k) for k in ("extensions", "exclude_dirs", "exclude_patterns", "max_size_mb")}
    spec = ScanSpec(**{**base, **changes})
    return lambda s, d: filter_manifest(fx.files_v(s, d), spec).select("path")


def _quoted(values):
    return ", ".join(f"'{v}'" for v in values)


def _roots_sql(roots):
    pick = "SELECT path FROM files_v WHERE starts_with(path, '{}/')"
    return fx.with_views("files_v") + " UNION ALL ".join(pick.format(r.rstrip("/")) for r in roots if r)


def _decoded(spark, sf_dir):
    texts = decode_text(fx.content_v(spark, sf_dir), ["path"], guess=False)
    return texts.select("path", F.char_length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


def _guessed(spark, sf_dir):
    """Whether the guess keeps the byte-order mark as a character differs by text; compare without it."""
    docs = fx.documents(spark, sf_dir).select("path", guess_decode(F.encode("text", "UTF-16")).alias("t"))
    docs = docs.withColumn("t", F.regexp_replace("t", r"^\ufeff", ""))
    return docs.select("path", F.char_length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


def _from_source(spark, sf_dir):
    """The default scan of documents that lie in a directory tree, with the content of what passes."""
    root = written(spark, sf_dir)
    files = source_files(spark, [root], ScanSpec(), ("path", "size", "content"))
    return files.select(F.expr(f"substr(path, {len(root) + 1})").alias("path"), "size", F.md5("content").alias("digest"))


def outcomes(spark, sf_dir, office=True):
    return scan(of.scan_v(spark, sf_dir), SPEC, office)[0]


def _scan_hits(spark, sf_dir):
    """Every hit of the scan, in plain text, workbooks and word documents."""
    return scan(of.scan_v(spark, sf_dir), SPEC, office=True)[1].select("path", "locator", "kw_idx", "position", "matched", "snippet")


# What the scan must say about scan_v: a NUL without a byte-order mark is binary, a damaged workbook is searched and
# empty, a damaged document is an error. A workbook has a line in each cell, a document its lines as paragraphs of one segment.
_KIND = f"""CASE WHEN ext IN ('.pdf', '.one') THEN 'scope_out' WHEN ext IN ('.doc', '.ppt', '.xls') THEN 'no_office'
  WHEN ext IN ({_quoted(BINARY)}) THEN 'binary' WHEN ext IN ('.docx', '.xlsx') AND file_ord % 5 = 0 THEN 'damaged ' || ext
  WHEN ext = '.docx' THEN 'docx' WHEN ext = '.xlsx' THEN 'xlsx'
  WHEN file_ord % 11 = 0 AND file_ord % 7 <> 0 THEN 'nul' WHEN trim(text, ' ' || chr(10) || chr(9) || chr(160)) = '' THEN 'blank' ELSE 'text' END"""


def _scan_ctes():
    segs = """SELECT path, idx, CASE WHEN kind = 'xlsx' THEN 'Lines!A' || line_no ELSE locator END AS locator,
        CASE WHEN kind = 'text' AND file_ord % 77 = 0 AND line_no = 1 THEN chr(0) || text ELSE text END AS text
        FROM segments_v JOIN kinds USING (path) WHERE kind IN ('text', 'xlsx')
      UNION ALL SELECT path, 0, '本文', string_agg(text, chr(13) ORDER BY line_no) FROM lines JOIN kinds USING (path) WHERE kind = 'docx' GROUP BY path"""
    return {
        "kinds": f"SELECT file_ord, path, {_KIND} AS kind FROM (SELECT *, {fx.EXT_SQL} AS ext FROM docs)",
        "text_segs": segs,
        **fx.keyword_hits_ctes("text_segs", SPEC.keywords),
        "counts": "SELECT path, count(*) AS n FROM hits GROUP BY path",
        "outcomes": (
            "SELECT path, CASE WHEN kind = 'damaged .docx' THEN 'error' WHEN kind IN ('scope_out', 'no_office', 'binary', 'nul', 'blank') THEN 'skip' "
            "WHEN coalesce(n, 0) > 0 THEN 'hit' ELSE 'no_hit' END AS outcome, "
            "CASE WHEN kind IN ('scope_out', 'no_office') THEN kind WHEN kind IN ('binary', 'nul', 'blank') THEN 'binary' END AS reason, "
            "CASE WHEN kind = 'damaged .docx' THEN 'extract_error: File is not a zip file' END AS error, "
            "CAST(coalesce(n, 0) AS BIGINT) AS n_hits FROM kinds LEFT JOIN counts USING (path)"),
    }


def _outcome_sql(select, **more):
    return fx.with_views("docs", "lines", "segments_v", **_scan_ctes(), **more) + select


_SUMMARY = """SELECT count(*) AS n_files, count_if(outcome = 'hit') AS n_hit_files,
  CAST(coalesce(sum(n_hits), 0) AS BIGINT) AS n_hits, count_if(outcome = 'skip') AS n_skipped, count_if(outcome = 'error') AS n_errors,
  'keyword' AS mode, 'or' AS operator, 'the, license, 123, @' AS keywords,
  (SELECT string_agg(reason || '=' || n, ', ' ORDER BY reason) FROM
    (SELECT reason, count(*) AS n FROM outcomes WHERE outcome = 'skip' GROUP BY reason)) AS skip_breakdown FROM outcomes"""

QUERIES = {
    "scan_manifest": lambda s, d: filter_manifest(fx.files_v(s, d), ScanSpec()).select(
        "path", "size", format_timestamp(F.col("mtime")).alias("mtime")),
    "scan_source": _from_source,
    "scan_multi_root": lambda s, d: union_roots(fx.files_v(s, d), ROOTS).select("path"),
    "scan_extra_root": lambda s, d: union_roots(
        fx.files_v(s, d), with_extra_root(["/share/src1"], "/share/src3", True)).select("path"),
    "filter_ext": _filtered(extensions=(".TXT", ".md", ".log")),
    "filter_ext_any": _filtered(extensions=(".txt", "*")),
    "filter_dirs": _filtered(exclude_dirs=(*DEFAULT_EXCLUDE_DIRS, "de")),
    "filter_glob": _filtered(exclude_patterns=("~$*", "*.tmp", "doc?[0-4].*", ".doc[!1]*")),
    "filter_size": lambda s, d: filter_manifest(
        fx.files_v(s, d).withColumn("size", F.col("size") * 1024), ScanSpec(("*",), (), (), 1)).select("path"),
    "route_files": lambda s, d: fx.files_v(s, d).select(
        "path", route(F.col("path")).alias("route"), skip_reason(F.col("path")).alias("reason")),
    "sniff_text": lambda s, d: fx.content_v(s, d).select("path", looks_like_text(F.col("content")).alias("is_text")),
    "decode_utf8": _decoded,
    "decode_fallback": _guessed,
    "scan_outcomes": lambda s, d: outcomes(s, d).select("path", "outcome", "reason", "error", "n_hits"),
    "scan_hits": _scan_hits,
    "scan_quarantine": lambda s, d: report.errors(outcomes(s, d)),
    "report_errors": lambda s, d: report.errors(outcomes(s, d)),
    "report_skipped": lambda s, d: report.skipped(outcomes(s, d)),
    "report_skip_json": lambda s, d: report.skip_json(outcomes(s, d)),
    "report_summary": lambda s, d: report.summary_rows(report.run_summary(outcomes(s, d), SPEC)),
    "agg_summary": lambda s, d: report.run_summary(outcomes(s, d), SPEC),
    "agg_skip": lambda s, d: report.skip_counts(outcomes(s, d)),
    "agg_ext": lambda s, d: report.extension_counts(fx.files_v(s, d)).orderBy(F.desc("n"), "ext"),
    "agg_lanes": lambda s, d: report.lane_counts(fx.files_v(s, d)),
}

ORACLES = {
    "scan_manifest": fx.with_views("files_v") + f"""SELECT path, size, strftime(mtime, '%Y-%m-%d %H:%M:%S') AS mtime FROM files_v
      WHERE {fx.EXT_SQL} IN ({_quoted(DEFAULT_EXTENSIONS)}) AND len(list_intersect(string_split(path, '/'), [{_quoted(DEFAULT_EXCLUDE_DIRS)}])) = 0
      AND NOT starts_with({fx.BASE_SQL}, '~$') AND NOT ends_with(path, '.tmp') AND size <= 100 * 1024 * 1024""",
    "scan_source": fx.with_views("docs") + f"""SELECT path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest
      FROM docs WHERE {fx.EXT_SQL} IN ({_quoted(DEFAULT_EXTENSIONS)}) AND len(list_intersect(string_split(path, '/'), [{_quoted(DEFAULT_EXCLUDE_DIRS)}])) = 0
      AND NOT starts_with({fx.BASE_SQL}, '~$') AND NOT ends_with(path, '.tmp')""",
    "scan_multi_root": _roots_sql(ROOTS),
    "scan_extra_root": _roots_sql(["/share/src1", "/share/src3"]),
    "filter_ext": fx.with_views("files_v") + f"{_PATH} WHERE {fx.EXT_SQL} IN ('.txt', '.md', '.log')",
    "filter_ext_any": fx.with_views("files_v") + _PATH,
    "filter_dirs": fx.with_views("files_v") + f"{_PATH} WHERE split_part(path, '/', 4) NOT IN ('.git', 'de')",
    "filter_glob": fx.with_views("files_v") + f"""{_PATH} WHERE NOT regexp_matches({fx.BASE_SQL}, '^~\\$') AND NOT ends_with(path, '.tmp')
      AND NOT regexp_full_match({fx.BASE_SQL}, 'doc.[0-4]\\..*') AND NOT regexp_full_match({fx.BASE_SQL}, '\\.doc[^1].*')""",
    "filter_size": fx.with_views("files_v") + f"{_PATH} WHERE size * 1024 <= 1024 * 1024",
    "route_files": fx.with_views("docs", k=f"SELECT path, {fx.EXT_SQL} AS ext FROM docs") + f"""SELECT path,
      CASE WHEN ext = '.xlsx' THEN 'xlsx' WHEN ext IN ('.docx', '.ppt', '.pdf', '.png') THEN 'skip' ELSE 'text' END AS route,
      CASE WHEN ext = '.pdf' THEN 'scope_out' WHEN ext IN ('.docx', '.ppt') THEN 'no_office' WHEN ext = '.png' THEN 'binary' END AS reason FROM k""",
    "sniff_text": fx.with_views("docs") + """SELECT path, file_ord % 7 = 0 OR (file_ord % 11 <> 0 AND length(text) > 0) AS is_text FROM docs""",
    "decode_utf8": fx.with_views("docs", t="""SELECT path, CASE WHEN file_ord % 7 = 0 AND file_ord % 11 = 0 THEN chr(0) || text
      WHEN file_ord % 11 = 0 OR (length(text) = 0 AND file_ord % 7 <> 0) THEN NULL ELSE text END AS t FROM docs""")
      + "SELECT path, CAST(length(t) AS BIGINT) AS n, md5(t) AS digest FROM t",
    "decode_fallback": fx.with_views("docs") + "SELECT path, CAST(length(text) AS BIGINT) AS n, md5(text) AS digest FROM docs",
    "scan_outcomes": _outcome_sql("SELECT path, outcome, reason, error, n_hits FROM outcomes"),
    "scan_hits": _outcome_sql("SELECT path, locator, kw_idx, position, matched, snippet FROM hits"),
    "scan_quarantine": _outcome_sql("SELECT path, error FROM outcomes WHERE outcome = 'error'"),
    "report_errors": _outcome_sql("SELECT path, error FROM outcomes WHERE outcome = 'error'"),
    "report_skipped": _outcome_sql("SELECT reason, path FROM outcomes WHERE outcome = 'skip'"),
    "report_skip_json": _outcome_sql("""SELECT reason, bucket, '[' || string_agg('"' || path || '"', ',' ORDER BY path) || ']' AS paths
      FROM (SELECT *, substring(md5(path), 1, 3) AS bucket FROM outcomes WHERE outcome = 'skip') GROUP BY reason, bucket"""),
    "report_summary": _outcome_sql(f"""SELECT CAST(ord AS BIGINT) AS ord, key, value FROM (
      SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS ord, unnest(['走査ファイル数', 'ヒットファイル数', 'ヒット件数合計', 'スキップ数', 'エラー数',
      '検索モード', '演算子', 'キーワード', 'スキップ内訳']) AS key, unnest([CAST(n_files AS VARCHAR), CAST(n_hit_files AS VARCHAR), CAST(n_hits AS VARCHAR),
      CAST(n_skipped AS VARCHAR), CAST(n_errors AS VARCHAR), mode, operator, keywords, skip_breakdown]) AS value FROM summary)""", summary=_SUMMARY),
    "agg_summary": _outcome_sql(_SUMMARY),
    "agg_skip": _outcome_sql("SELECT reason, count(*) AS n FROM outcomes WHERE outcome = 'skip' GROUP BY reason"),
    "agg_ext": fx.with_views("files_v") + f"SELECT coalesce(nullif({fx.EXT_SQL}, ''), '(なし)') AS ext, count(*) AS n FROM files_v GROUP BY 1",
    "agg_lanes": fx.with_views("files_v") + f"""SELECT count(*) AS total, count_if({fx.EXT_SQL} NOT IN ('.docx', '.ppt')) AS plain,
      count_if({fx.EXT_SQL} IN ('.docx', '.ppt')) AS office FROM files_v""",
}
