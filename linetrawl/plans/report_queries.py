"""Registered queries: result tables and facets over hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from linetrawl.functions.paths import extension
from linetrawl.functions.text import line_locator
from linetrawl.operators import report
from linetrawl.operators.search import explode_hits
from linetrawl.plans import fixtures as fx
from linetrawl.plans.search_queries import OR_SPEC, _hits_or, _or_sql, _searched

WANT_EXT, QUERY = ".md", " The of "


def _console(spark, sf_dir):
    named = _searched(spark, sf_dir).withColumn("hits", F.transform("hits", lambda h: F.struct(
        line_locator(h["line_no"]).alias("locator"), h["snippet"].alias("snippet"))))
    return report.console_lines(named)


def _facets(spark, sf_dir):
    found = _searched(spark, sf_dir).filter(F.size("hits") > 0)
    snippets = F.transform("hits", lambda h: h["snippet"])
    return found.select("path", report.facet_match(
        F.col("path"), extension(F.col("path")), snippets, WANT_EXT, QUERY).alias("shown"))


_ESCAPE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_FACET = f"""SELECT path, {fx.EXT_SQL} = '.md' AND (contains(lower(path), 'the of') OR any_snippet) AS shown
  FROM (SELECT path, bool_or(contains(lower(snippet), 'the of')) AS any_snippet FROM hits GROUP BY path)"""

QUERIES = {
    "report_results": lambda s, d: report.results(_hits_or(s, d), fx.files_v(s, d)),
    "report_results_inline": lambda s, d: report.results_inline(explode_hits(_searched(s, d), "mtime")),
    "report_console": _console,
    "report_highlight": lambda s, d: _hits_or(s, d).select(
        "path", "seg_idx", "kw_idx", "position", report.highlight(F.translate("snippet", "ou", "&<"), OR_SPEC).alias("fragment")),
    "report_facet_filter": lambda s, d: _facets(s, d).filter("shown").select("path"),
    "agg_shown": lambda s, d: _facets(s, d).agg(F.count_if("shown").alias("shown"), F.count("*").alias("total")),
    "agg_ext_facet": lambda s, d: _searched(s, d).filter(F.size("hits") > 0).select(
        extension(F.col("path")).alias("ext")).distinct().orderBy("ext"),
    "agg_hits_file": lambda s, d: report.hits_per_file(_searched(s, d)),
    "report_index": lambda s, d: report.report_index(fx.runs_v(s, d), ".html").orderBy(F.desc("mtime"), "name").drop("mtime"),
    "report_index_xlsx": lambda s, d: report.report_index(fx.runs_v(s, d), ".xlsx").orderBy(F.desc("mtime"), "name").drop("mtime"),
}

_RESULTS = (f"SELECT path, {fx.EXT_SQL} AS ext, locator, matched, regexp_replace(snippet, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g') AS snippet, "
            "strftime(mtime, '%Y-%m-%d %H:%M:%S') AS mtime FROM hits JOIN docs USING (path)")
_INDEX = """SELECT name, CASE WHEN size < 1024 THEN size || ' B'
  WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0::DOUBLE) WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576.0::DOUBLE)
  ELSE printf('%.1f GB', size / 1073741824.0::DOUBLE) END AS size, strftime(mtime, '%Y-%m-%d %H:%M:%S') AS ts FROM runs_v WHERE lower(name) LIKE '%{}'"""

ORACLES = {
    "report_results": _or_sql(_RESULTS),
    "report_results_inline": _or_sql(_RESULTS),
    "report_console": _or_sql("""SELECT path, path || '  (' || count(*) || ' hits)' || chr(10) ||
      string_agg('  - [' || locator || '] ' || snippet, chr(10) ORDER BY seg_idx, kw_idx, position) AS block FROM hits GROUP BY path"""),
    "report_highlight": _or_sql(f"""SELECT path, seg_idx, kw_idx, position,
      regexp_replace({_ESCAPE.format("translate(snippet, 'ou', '&<')")}, '(?i)(license|the|123|@)', '<span class="hl">\\1</span>', 'g') AS fragment FROM hits"""),
    "report_facet_filter": _or_sql(f"SELECT path FROM ({_FACET}) WHERE shown"),
    "agg_shown": _or_sql(f"SELECT count_if(shown) AS shown, count(*) AS total FROM ({_FACET})"),
    "agg_ext_facet": _or_sql(f"SELECT DISTINCT {fx.EXT_SQL} AS ext FROM hits"),
    "agg_hits_file": _or_sql("SELECT path, count(*) AS n_hits FROM hits GROUP BY path"),
    "report_index": fx.with_views("runs_v") + _INDEX.format(".html"),
    "report_index_xlsx": fx.with_views("runs_v") + _INDEX.format(".xlsx"),
}
