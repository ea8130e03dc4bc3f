"""Registered queries: scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from linetrawl.functions import locators, paths, text
from linetrawl.plans import fixtures as fx
from linetrawl.sources import office
from linetrawl.sources.plaintext import text_segments


def _parts(s, d):
    """One drawing part per conversation turn, in a package per conversation."""
    return fx.table(s, d, "conversations").select(
        F.concat(F.lit("/book/"), "conv_id").alias("path"), F.concat(F.lit("XL/Drawings/drawing"), "turn", F.lit(".xml")).alias("part"),
        F.lit(office.REL_DRAWING).alias("type"), F.md5("text").alias("digest"))


def _links(s, d):
    """Sheets point at every drawing but those of the first turns."""
    return fx.table(s, d, "conversations").filter("turn > 0").select(
        F.concat(F.lit("/book/"), "conv_id").alias("path"), F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("sheet"),
        F.lit("xl/worksheets/sheet1.xml").alias("base"), F.concat(F.lit("../drawings/./drawing"), "turn", F.lit(".xml")).alias("target"),
        F.lit(office.REL_DRAWING).alias("type"))


def _noisy(column):
    return F.concat(F.lit("a\x07b\x0bc\x1fd\x00e\tf\n"), column)


def _turns_whole(s, d):
    """Conversation turns in order as one text per conversation."""
    turns = fx.turns_v(s, d)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n")
    return turns.groupBy("path").agg(joined.alias("whole")).select(
        "path", F.char_length("whole").cast("bigint").alias("n"), F.md5("whole").alias("digest"))


def _union(s, d):
    """Segments of two sources in one table, ordered by source and position."""
    lines = text_segments(fx.documents(s, d).select("path", "text")).select("path", F.lit(0).alias("part_ord"), "idx", "locator", "text")
    turns = fx.turns_v(s, d).select("path", F.lit(1).alias("part_ord"), "idx", "locator", "text")
    return lines.unionByName(turns).select("path", "part_ord", "idx", "locator", F.md5("text").alias("digest"))


def _grid(s, d):
    return fx.table(s, d, "conversations").select(
        F.concat(F.lit("/old/"), "conv_id", F.lit(".xls")).alias("path"), F.col("role").alias("sheet"),
        (F.col("turn") + 1).alias("row"), (F.col("conv_id") + 1).alias("col"),
        F.when(F.col("turn") % 5 != 4, F.col("text")).alias("value"))


def _thread_people(s, d):
    c = fx.table(s, d, "conversations")
    threads = c.select(F.concat(F.lit("/book/"), "conv_id").alias("path"), "turn", F.concat(F.lit("{"), "role", F.lit("}")).alias("person_id"))
    people = c.filter("role = 'user'").select(
        F.concat(F.lit("/book/"), "conv_id").alias("path"), F.lit("{user}").alias("person_id"), F.lit("User Name").alias("name")).distinct()
    return office.attach_people(threads, people).select("path", "turn", "who")


def _role_id():
    return F.when(F.col("turn") % 4 == 3, F.lit("x")).when(F.col("turn") % 4 == 2, F.lit("-1")).otherwise(
        (F.col("turn") % 4).cast("string"))


QUERIES = {
    "path_ext": lambda s, d: fx.files_v(s, d).select("path", paths.extension(F.col("path")).alias("ext")),
    "path_base": lambda s, d: fx.files_v(s, d).select("path", paths.basename(F.col("path")).alias("base"), F.array_join(paths.dir_parts(F.col("path"), "/share"), "|").alias("dirs")),
    "path_display": lambda s, d: fx.files_v(s, d).select("path", paths.display_path(F.replace(F.col("path"), F.lit("/"), F.lit("\\"))).alias("shown")),
    "ts_slug": lambda s, d: fx.files_v(s, d).select("path", paths.timestamp_slug(F.col("mtime")).alias("slug")),
    "ts_path": lambda s, d: fx.files_v(s, d).select("path", paths.apply_timestamp(F.concat(F.lit("out/{ts}/"), "path", F.lit("_{ts}.html")), paths.timestamp_slug(F.col("mtime"))).alias("out")),
    "fmt_ts": lambda s, d: fx.files_v(s, d).select("path", paths.format_timestamp(F.col("mtime")).alias("ts"), paths.iso_seconds(F.col("mtime")).alias("iso")),
    "human_bytes": lambda s, d: fx.files_v(s, d).select("path", *[
        paths.human_bytes(F.col("size") * m).alias(f"b{i}") for i, m in enumerate((1, 13, 50_001, 7_000_003, 9_000_000_017))]),
    "rels_path": lambda s, d: fx.files_v(s, d).select("path", paths.rels_path(F.col("path")).alias("rels")),
    "resolve_path": lambda s, d: fx.files_v(s, d).select("path", paths.resolve_target(F.col("path"), F.concat(F.lit(".././../X/"), paths.basename(F.col("path")))).alias("rel"),
                           paths.resolve_target(F.col("path"), F.concat(F.lit("/"), F.upper(F.col("path")))).alias("abs")),
    "col_letter": lambda s, d: fx.files_v(s, d).select("path", *[paths.column_letters(F.col("file_ord") * m - 3).alias(f"c{m}") for m in (1, 31, 977, 8_353_082_583)]),
    "sanitize_ctrl": lambda s, d: fx.documents(s, d).select("path", F.md5(text.sanitize_control(_noisy(F.col("text")))).alias("digest")),
    "html_escape": lambda s, d: fx.documents(s, d).select("path", F.md5(text.html_escape(F.concat(F.lit("<a href=\"x\">&'"), F.col("text")))).alias("digest")),
    "locators": lambda s, d: fx.table(s, d, "conversations").select("conv_id", "turn", *[
        locators.package(F.lit(k), F.col("turn"), F.col("turn"), F.when(F.col("turn") % 2 == 0, F.col("role")), F.when(F.col("turn") % 2 == 1, F.col("role"))).alias(k)
        for k in ("body", "header", "footer", "textbox", "note", "slide", "notes")],
        text.line_locator(F.col("turn")).alias("line"), locators.cell(F.col("role"), F.col("conv_id") + 1, F.col("turn")).alias("cell")),
    "agg_concat": _turns_whole,
    "segments_union": _union,
    "grid_to_cells": lambda s, d: office.grid_cells(_grid(s, d)),
    "xlsx_part_join": lambda s, d: office.attach_sheets(_parts(s, d), _links(s, d)).select("path", "part", "sheet", "digest"),
    "comment_author": lambda s, d: fx.table(s, d, "conversations").select(
        "conv_id", "turn", office.author_at(F.array(F.lit("Ann"), "role"), _role_id()).alias("author")),
    "thread_people": _thread_people,
}

_F, _FD = fx.with_views("files_v"), fx.with_views("docs")
def _letters_sql(n):
    """Column name of a BIGINT: the digits of a bijective base 26, most significant first."""
    below = [(26 ** k - 26) // 25 for k in range(1, 15)]  # numbers of fewer than k letters
    name = lambda k: " || ".join(
        f"chr(CAST(65 + ((({n}) - {below[k - 1] + 1}) // {26 ** i}) % 26 AS INT))" for i in range(k - 1, -1, -1))
    cases = " ".join(f"WHEN ({n}) <= {below[k]} THEN {name(k)}" for k in range(1, 14))
    return f"CASE WHEN ({n}) < 1 THEN '' {cases} ELSE {name(14)} END"


# One decimal with halves to even, in exact integer arithmetic.
_TENTHS = "(({n} * 10) // {u} + CASE WHEN 2 * (({n} * 10) % {u}) > {u} OR (2 * (({n} * 10) % {u}) = {u} AND (({n} * 10) // {u}) % 2 = 1) THEN 1 ELSE 0 END)"


def _bytes_sql(n):
    n = f"CAST({n} AS HUGEINT)"
    def unit(power, name):
        t = _TENTHS.format(n=n, u=f"CAST({1024 ** power} AS HUGEINT)")
        return f"({t} // 10) || '.' || ({t} % 10) || ' {name}'"
    return (f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < {1024**2} THEN {unit(1, 'KB')} WHEN {n} < {1024**3} THEN {unit(2, 'MB')} "
            f"WHEN {n} < {1024**4} THEN {unit(3, 'GB')} ELSE {unit(4, 'TB')} END")


ORACLES = {
    "path_ext": _F + f"SELECT path, {fx.EXT_SQL} AS ext FROM files_v",
    "path_base": _F + f"SELECT path, {fx.BASE_SQL} AS base, split_part(path, '/', 3) || '|' || split_part(path, '/', 4) AS dirs FROM files_v",
    "path_display": _F + "SELECT path, path AS shown FROM files_v",
    "ts_slug": _F + "SELECT path, strftime(mtime, '%Y%m%d-%H%M%S') AS slug FROM files_v",
    "ts_path": _F + "SELECT path, 'out/' || strftime(mtime, '%Y%m%d-%H%M%S') || '/' || path || '_' || strftime(mtime, '%Y%m%d-%H%M%S') || '.html' AS out FROM files_v",
    "fmt_ts": _F + "SELECT path, strftime(mtime, '%Y-%m-%d %H:%M:%S') AS ts, strftime(mtime, '%Y-%m-%dT%H:%M:%S') AS iso FROM files_v",
    "human_bytes": _F + "SELECT path, " + ", ".join(
        f"{_bytes_sql(f'size * {m}')} AS b{i}" for i, m in enumerate((1, 13, 50_001, 7_000_003, 9_000_000_017))) + " FROM files_v",
    "rels_path": _F + f"SELECT path, regexp_replace(path, '([^/]+)$', '_rels/\\1.rels') AS rels FROM files_v",
    "resolve_path": _F + f"SELECT path, lower('/share/x/' || {fx.BASE_SQL}) AS rel, lower(ltrim(path, '/')) AS abs FROM files_v",
    "col_letter": _F + "SELECT path, " + ", ".join(
        f"{_letters_sql(f'CAST(file_ord AS HUGEINT) * {m} - 3')} AS c{m}" for m in (1, 31, 977, 8_353_082_583)) + " FROM files_v",
    "sanitize_ctrl": _FD + "SELECT path, md5(regexp_replace('a b c d e' || chr(9) || 'f' || chr(10) || text, '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g')) AS digest FROM docs",
    "html_escape": _FD + """SELECT path, md5('&lt;a href=&quot;x&quot;&gt;&amp;&#x27;' ||
      replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS digest FROM docs""",
    "locators": f"""SELECT conv_id, turn, '本文' AS body, 'セクション ' || turn || ' / ヘッダー' AS header, 'セクション ' || turn || ' / フッター' AS footer,
      CASE WHEN turn % 2 = 0 THEN '図形「' || role || '」' ELSE '図形' END AS textbox,
      'コメント #' || turn || CASE WHEN turn % 2 = 1 THEN ' (' || role || ')' ELSE '' END AS note,
      'スライド ' || turn || CASE WHEN turn % 2 = 0 THEN ' / ' || role ELSE '' END AS slide, 'スライド ' || turn || ' / ノート' AS notes,
      '行 ' || turn AS line, role || '!' || {_letters_sql('CAST(conv_id AS HUGEINT) + 1')} || turn AS cell FROM conversations""",
    "agg_concat": fx.with_views("turns_v", w="SELECT path, string_agg(text, chr(10) ORDER BY idx) AS w FROM turns_v GROUP BY path")
      + "SELECT path, CAST(length(w) AS BIGINT) AS n, md5(w) AS digest FROM w",
    "segments_union": fx.with_views("segments_v", "turns_v") + """SELECT path, 0 AS part_ord, idx, locator, md5(text) AS digest FROM segments_v
      UNION ALL SELECT path, 1, idx, locator, md5(text) FROM turns_v""",
    "grid_to_cells": f"""SELECT '/old/' || conv_id || '.xls' AS path, role || '!' || {_letters_sql('CAST(conv_id AS HUGEINT) + 1')} || (turn + 1) AS locator, text
      FROM conversations WHERE turn % 5 <> 4 AND text IS NOT NULL""",
    "xlsx_part_join": """SELECT '/book/' || conv_id AS path, 'XL/Drawings/drawing' || turn || '.xml' AS part,
      CASE WHEN turn > 0 THEN role || ' ' || turn ELSE '' END AS sheet, md5(text) AS digest FROM conversations""",
    "comment_author": "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Ann' WHEN 1 THEN role ELSE '' END AS author FROM conversations",
    "thread_people": """SELECT '/book/' || conv_id AS path, turn, CASE WHEN role = 'user' THEN 'User Name' ELSE '' END AS who FROM conversations""",
}
