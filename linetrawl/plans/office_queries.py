"""Registered queries: Office packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from linetrawl import SearchSpec
from linetrawl.operators.search import search_segments
from linetrawl.plans import fixtures as fx
from linetrawl.plans import office_fixtures as of
from linetrawl.sinks.files import write_files
from linetrawl.sources import office
from linetrawl.sources.containers import workbook_parts
from linetrawl.sources.files import walk_files
from linetrawl.workspace import shared_dir

_OUT = ["path", "locator"]


def _workbook(*kinds, granularity="cell"):
    def run(spark, sf_dir):
        segs = office.xlsx_segments(office.xlsx_parts(of.books_v(spark, sf_dir)), granularity)
        return segs.filter(F.col("kind").isin(*kinds)).select(*_OUT, "text")
    return run


def _cells_by_part(spark, sf_dir):
    """The cells of workbooks that lie as files in the shared folder, read part by part."""
    root = shared_dir(spark, "books")
    write_files(of.books_v(spark, sf_dir), root).write.format("noop").mode("overwrite").save()
    segs = office.xlsx_segments(workbook_parts(walk_files(spark, [root])))
    return segs.filter("kind = 'row'").select(F.expr(f"substr(path, {len(root) + 1})").alias("path"), "locator", "text")


def _package(parts, files):
    return lambda s, d: office.package_segments(parts(files(s, d))).select(*_OUT, F.md5("text").alias("digest"))


def _books_hits(spark, sf_dir):
    segs = office.xlsx_segments(office.xlsx_parts(of.books_v(spark, sf_dir)))
    return search_segments(segs, SearchSpec(("the", "with"), max_hits_per_file=50)).select(
        *_OUT, "kw_idx", "position", "matched")


QUERIES = {
    "xlsx_cells": _workbook("row"),
    "xlsx_cells_by_part": _cells_by_part,
    "xlsx_rows": _workbook("row", granularity="row"),
    "xlsx_sheets": _workbook("sheet"),
    "xlsx_comments": _workbook("comment"),
    "xlsx_threads": _workbook("thread"),
    "xlsx_shapes": _workbook("shape", "graphic", "chart", "smartart"),
    "xlsx_hits": _books_hits,
    "docx_segments": _package(office.docx_parts, of.letters_v),
    "pptx_segments": _package(office.pptx_parts, of.slides_v),
}

_BOOK = "'/office/conv' || conv_id || '.xlsx'"
_BOOL = "CASE WHEN turn % 3 = 0 THEN 'True' ELSE 'False' END"
_NAMED = "CASE WHEN turn % 4 = 3 THEN ' (drawing' || sheet_no || '.xml)' ELSE '「box ' || turn || '」' END"
_SHEETS = "SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY role) AS sheet_no FROM conversations"
_TRIM = "trim(text, ' ' || chr(9) || chr(10))"
_CELLS = f"""SELECT {_BOOK} AS path, role || '!A' || (turn + 1) AS locator, CAST(turn AS VARCHAR) AS text FROM conversations
  UNION ALL SELECT {_BOOK}, role || '!B' || (turn + 1), text FROM conversations
  UNION ALL SELECT {_BOOK}, role || '!C' || (turn + 1), {_BOOL} FROM conversations"""
_DECK, _DOC = "'/office/conv' || conv_id || '.pptx'", "'/office/doc' || doc_id || '.docx'"
_SLIDE_NO = "row_number() OVER (PARTITION BY conv_id ORDER BY turn)"

# Segment order within a book: each sheet (name, then its rows), then the parts in archive order.
_ALL = {
    "sheets": _SHEETS,
    "segs": f"""SELECT {_BOOK} AS path, sheet_no AS o1, 0 AS o2, turn AS o3, c AS o4,
        CASE c WHEN 1 THEN role || '!A' || (turn + 1) WHEN 2 THEN role || '!B' || (turn + 1) ELSE role || '!C' || (turn + 1) END AS locator,
        CASE c WHEN 1 THEN CAST(turn AS VARCHAR) WHEN 2 THEN text ELSE {_BOOL} END AS text FROM sheets, (VALUES (1), (2), (3)) v(c)
      UNION ALL SELECT {_BOOK}, 1000 + sheet_no, 1, turn, 0, role || ': 図形' || {_NAMED}, text FROM sheets WHERE text <> ''
      UNION ALL SELECT {_BOOK}, 1000 + sheet_no, 2, turn, 0, role || '!B' || (turn + 1) || ' コメント (' || role || ')', {_TRIM} FROM sheets
      UNION ALL SELECT {_BOOK}, 1000 + sheet_no, 3, turn, 0, role || '!C' || (turn + 1) || CASE WHEN turn > 0 THEN ' スレッド返信' ELSE ' スレッドコメント' END
        || CASE WHEN role = 'user' THEN ' (User Name)' ELSE '' END, {_TRIM} FROM sheets""",
    "segments": "SELECT path, row_number() OVER (PARTITION BY path ORDER BY o1, o2, o3, o4) AS idx, locator, text FROM segs",
}

ORACLES = {
    "xlsx_cells": _CELLS,
    "xlsx_cells_by_part": _CELLS,
    "xlsx_rows": f"""SELECT {_BOOK} AS path, role || '!Row ' || (turn + 1) AS locator,
      turn || chr(9) || CASE WHEN text = '' THEN '' ELSE text || chr(9) END || {_BOOL} AS text FROM conversations""",
    "xlsx_sheets": f"SELECT DISTINCT {_BOOK} AS path, 'シート名: ' || role AS locator, role AS text FROM conversations",
    "xlsx_comments": f"""SELECT {_BOOK} AS path, role || '!B' || (turn + 1) || ' コメント (' || role || ')' AS locator, {_TRIM} AS text
      FROM conversations WHERE {_TRIM} <> ''""",
    "xlsx_threads": f"""SELECT {_BOOK} AS path, role || '!C' || (turn + 1) || CASE WHEN turn > 0 THEN ' スレッド返信' ELSE ' スレッドコメント' END
      || CASE WHEN role = 'user' THEN ' (User Name)' ELSE '' END AS locator, {_TRIM} AS text FROM conversations WHERE {_TRIM} <> ''""",
    "xlsx_shapes": f"""SELECT {_BOOK} AS path, role || ': 図形' || {_NAMED} AS locator, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)) AS text
        FROM ({_SHEETS}) WHERE text <> ''
      UNION ALL SELECT DISTINCT {_BOOK}, role || ': グラフ/図解「frame」', 'figure of ' || role FROM conversations
      UNION ALL SELECT DISTINCT {_BOOK}, 'グラフ (chart1.xml)', 'chart ' || conv_id || chr(10) || 'axis' FROM conversations
      UNION ALL SELECT DISTINCT {_BOOK}, 'SmartArt (data1.xml)', 'node ' || conv_id FROM conversations""",
    "xlsx_hits": fx.with_views(**_ALL, **fx.keyword_hits_ctes("segments", ("the", "with"), 50, both=True))
      + "SELECT path, locator, kw_idx, position, matched FROM hits",
    "docx_segments": f"""SELECT {_DOC} AS path, '本文' AS locator, md5(replace(text, chr(10), chr(13)) || chr(13)) AS digest FROM documents WHERE trim(text, ' ' || chr(10) || chr(9) || chr(160)) <> ''
      UNION ALL SELECT {_DOC}, 'セクション 1 / ヘッダー', md5('head ' || source) FROM documents
      UNION ALL SELECT {_DOC}, 'セクション 1 / フッター', md5('foot ' || lang) FROM documents
      UNION ALL SELECT {_DOC}, '図形「box」', md5(lang) FROM documents
      UNION ALL SELECT {_DOC}, 'コメント #1 (' || source || ')', md5('note ' || lang) FROM documents""",
    "pptx_segments": f"""WITH s AS (SELECT *, {_SLIDE_NO} AS n FROM conversations)
      SELECT {_DECK} AS path, 'スライド ' || n AS locator, md5(replace(text, chr(10), chr(13))) AS digest FROM s WHERE {_TRIM} <> ''
      UNION ALL SELECT {_DECK}, 'スライド ' || n || ' / Role', md5(role) FROM s
      UNION ALL SELECT {_DECK}, 'スライド ' || n || ' / ノート', md5('said by ' || role) FROM s""",
}
