"""One pass over files with content: route, read, search, and say what became of each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linetrawl.functions.text import is_blank
from linetrawl.operators.search import explode_hits, file_hits, search_segments
from linetrawl.sources import office as office_source
from linetrawl.sources.containers import workbook_parts
from linetrawl.sources.plaintext import decode_text
from linetrawl.sources.route import route, skip_reason
from linetrawl.sources.splits import split_segments
from linetrawl.spec import SearchSpec
from linetrawl.workspace import shared_dir


def outcome(error: Column, reason: Column, n_hits: Column) -> Column:
    """``error``, else ``skip``, else ``hit``, else ``no_hit``."""
    return (
        F.when(F.coalesce(error, F.lit("")) != "", "error")
        .when(reason.isNotNull(), "skip")
        .when(n_hits > 0, "hit")
        .otherwise("no_hit")
    )


def by_route(files: DataFrame, office: bool = False) -> dict[str, DataFrame]:
    """Files with content, split by route. Files skipped by name keep no content, so where the source
    reads content on demand it stays unread."""
    kinds = ["text", "xlsx"] + (["docx", "pptx"] if office else [])
    routes = {kind: files.filter(route(F.col("path"), office) == kind) for kind in kinds}
    skipped = files.filter(route(F.col("path"), office) == "skip")
    routes["skip"] = skipped.withColumn("content", F.lit(None).cast("binary"))
    return routes


def scan_texts(files: DataFrame, spec: SearchSpec, office: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Outcome and hits of files of the text and skip routes.

    ``files`` has ``path`` and ``content``, plus ``error`` where reading already failed; ``keep``
    carries manifest columns along. One row per file, no shuffle. Text without any line worth
    searching counts as binary.
    """
    base = ["path", *keep]
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    named = files.select(*base, error.alias("error"), skip_reason(F.col("path"), office).alias("_named"), "content")
    texts = decode_text(named, [*base, "error", "_named"])
    unread = F.col("text").isNull() | is_blank(F.col("text"))
    texts = texts.select(
        *base, "error", F.coalesce("_named", F.when(F.col("error").isNull() & unread, "binary")).alias("reason"), "text"
    )
    searched = file_hits(texts, spec)
    n_hits = F.size("hits").cast("bigint")
    return searched.select(
        *base, "error", F.when(F.col("error").isNull(), F.col("reason")).alias("reason"),
        n_hits.alias("n_hits"), outcome(F.col("error"), F.col("reason"), n_hits).alias("outcome"), "hits",
    )


def package_parts(routes: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Part rows per package route.

    Documents and slides have two readers, their segments and their errors, so what was unpacked is
    written to the shared folder once.
    """
    large = routes.get("large_xlsx")
    routes = {kind: rows.filter(F.col("content").isNotNull()) for kind, rows in routes.items() if kind in ("xlsx", "docx", "pptx")}
    parts = {"xlsx": office_source.xlsx_parts(routes["xlsx"])}
    if large is not None:
        parts["xlsx"] = parts["xlsx"].unionByName(workbook_parts(large))
    for kind, unpack in (("docx", office_source.docx_parts), ("pptx", office_source.pptx_parts)):
        if kind in routes:
            rows = unpack(routes[kind])
            out = shared_dir(rows.sparkSession, f"parts-{kind}")
            rows.write.parquet(out)
            parts[kind] = rows.sparkSession.read.schema(rows.schema).parquet(out)
    return parts


def package_segments(parts: dict[str, DataFrame], granularity: str = "cell") -> DataFrame:
    """Segments of all package routes, in file order within each file."""
    out = office_source.xlsx_segments(parts["xlsx"], granularity)
    for kind in ("docx", "pptx"):
        if kind in parts:
            out = out.unionByName(office_source.package_segments(parts[kind]))
    return out


def scan(files: DataFrame | dict[str, DataFrame], spec: SearchSpec, office: bool = False,
         granularity: str = "cell") -> tuple[DataFrame, DataFrame]:
    """``(outcomes, hits)`` over every route of ``files``, or of files split by :func:`by_route` or
    ``sources.files.read_routes``.

    Packages yield many segments per file, so only their trimmed hits and the package file names
    meet in a join; text files are finished inside their row. Files of the route ``large``, where there is one,
    are read in splits and searched by segment.
    """
    routes = files if isinstance(files, dict) else by_route(files, office)
    plain = routes["text"].unionByName(routes["skip"], allowMissingColumns=True)
    texts = scan_texts(plain, spec, office)
    parts = package_parts(routes)
    hits = search_segments(package_segments(parts, granularity), spec)
    found = hits.groupBy("path").agg(F.count("*").alias("n_hits")).select(
        "path", "n_hits", F.lit(None).cast("string").alias("error"))
    names = routes["xlsx"].select("path")
    if "large_xlsx" in routes:
        names = names.unionByName(routes["large_xlsx"].select("path"))
    for kind in ("docx", "pptx"):
        if kind in parts:
            names = names.unionByName(routes[kind].select("path"))
            failed = office_source.extract_errors(parts[kind])
            found = found.unionByName(failed.select("path", F.lit(None).cast("bigint").alias("n_hits"), "error"))
    for kind in parts:
        if "error" in routes[kind].columns:
            unread = routes[kind].filter(F.col("error").isNotNull())
            found = found.unionByName(unread.select("path", F.lit(None).cast("bigint").alias("n_hits"), "error"))
    packages = names.join(found, "path", "left")
    n_hits, no_reason = F.coalesce("n_hits", F.lit(0)).cast("bigint"), F.lit(None).cast("string")
    outcomes = texts.select("path", "outcome", "reason", "error", "n_hits").unionByName(
        packages.select("path", outcome(F.col("error"), no_reason, n_hits).alias("outcome"),
                        no_reason.alias("reason"), "error", n_hits.alias("n_hits"))
    )
    if "large" in routes:
        segments, files = split_segments(routes["large"])
        more = search_segments(segments.select("path", "idx", "locator", "text"), spec)
        hits = hits.withColumn("seg_idx", F.col("seg_idx").cast("bigint")).unionByName(more)
        counted = files.join(more.groupBy("path").agg(F.count("*").alias("n_hits")), "path", "left")
        reason = F.when(F.col("error").isNull() & ~F.col("is_text"), F.lit("binary"))
        outcomes = outcomes.unionByName(counted.select(
            "path", outcome(F.col("error"), reason, n_hits).alias("outcome"), reason.alias("reason"), "error", n_hits.alias("n_hits")))
    seg_hits = hits.withColumn("seg_idx", F.col("seg_idx").cast("bigint"))
    text_hits = explode_hits(texts).withColumn("seg_idx", F.col("seg_idx").cast("bigint"))
    return outcomes, text_hits.unionByName(seg_hits)
