"""Export snapshots: names, recycle bin, difference to the previous manifest, next manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linetrawl.functions.text import sanitize_name
from linetrawl.operators.ranks import running_total

MANIFEST_TYPE = (
    "STRUCT<version:INT, granularity:STRING, updatedAt:STRING, "
    "items:MAP<STRING, STRUCT<file:STRING, lastModifiedTime:STRING, exportedAt:STRING>>>"
)


def parse_manifest(json: Column) -> Column:
    """Manifest struct of a JSON text; damaged or empty JSON becomes one without items."""
    parsed = F.from_json(json, MANIFEST_TYPE, {"mode": "PERMISSIVE"})
    items = F.create_map().cast("MAP<STRING, STRUCT<file:STRING, lastModifiedTime:STRING, exportedAt:STRING>>")
    return F.struct(
        parsed["version"].alias("version"), parsed["granularity"].alias("granularity"),
        parsed["updatedAt"].alias("updatedAt"), F.coalesce(parsed["items"], items).alias("items"),
    )


def manifest_items(manifests: DataFrame, granularity: str | None = None, json: str = "json") -> DataFrame:
    """``(id, file, last_modified, exported_at)`` rows of manifests.

    With ``granularity``, a manifest written at another one is discarded.
    """
    m = manifests.withColumn("_m", parse_manifest(F.col(json)))
    if granularity is not None:
        known = F.coalesce(F.col("_m.granularity"), F.lit(""))
        m = m.filter((known == "") | (F.lower(known) == granularity.lower()))
    return m.select(F.explode("_m.items").alias("id", "i")).select(
        "id", F.col("i.file").alias("file"), F.col("i.lastModifiedTime").alias("last_modified"),
        F.col("i.exportedAt").alias("exported_at"))


def live_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes outside the recycle bin at every level of the hierarchy."""
    return nodes.filter(~_recycled())


def recycled_count(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count_if(_recycled()).alias("recycled"), F.count_if(~_recycled()).alias("live"))


def _recycled() -> Column:
    flags = ("notebook_recycled", "section_recycled", "section_is_bin", "section_deleted_pages", "page_recycled")
    gone = F.lit(False)
    for flag in flags:
        gone = gone | F.coalesce(F.col(flag), F.lit(False))
    return gone


def target_names(nodes: DataFrame, granularity: str = "page") -> DataFrame:
    """Add ``file``: the sanitised name parts joined by ``__``."""
    parts = ["notebook", "section"] + (["page"] if granularity == "page" else [])
    return nodes.withColumn(
        "file", F.concat(F.concat_ws("__", *[sanitize_name(F.col(p)) for p in parts]), F.lit(".docx")))


def dedupe_names(named: DataFrame, order: str = "ord") -> DataFrame:
    """Make ``file`` unique, ignoring case: the second ``x.docx`` is ``x_1.docx``, and so on."""
    keyed = named.withColumn("_name", F.lower("file"))
    ranked = running_total(keyed, ["_name"], [order], F.lit(1), "_rank")
    stem = F.regexp_extract("file", r"(?s)^(.*?)(\.[^.]*)?$", 1)
    suffixed = F.concat(stem, F.lit("_"), F.col("_rank").cast("string"), F.lit(".docx"))
    return ranked.withColumn("file", F.when(F.col("_rank") > 0, suffixed).otherwise(F.col("file"))).drop("_name", "_rank")


def diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Full outer comparison of the previous manifest and the current targets by ``id``.

    ``prev(id, file, last_modified, exported_at, file_exists)`` and ``cur(id, file, last_modified)``,
    optionally with ``failed`` where the export could not be redone. Ids are unique on both sides, so
    the join has no hot key. Adds class, action and whether the old file has to go.
    """
    c = cur if "failed" in cur.columns else cur.withColumn("failed", F.lit(False))
    p = prev.select("id", F.col("file").alias("prev_file"), F.col("last_modified").alias("prev_modified"),
                    F.col("exported_at").alias("prev_exported_at"), F.col("file_exists").alias("prev_exists"),
                    F.lit(True).alias("in_prev"))
    c = c.select("id", "file", "last_modified", "failed", F.lit(True).alias("in_cur"))
    has_prev, has_cur = F.col("in_prev").isNotNull(), F.col("in_cur").isNotNull()
    exists = F.coalesce("prev_exists", F.lit(False)) & (F.coalesce("prev_file", F.lit("")) != "")
    same_time = has_prev & exists & (F.lower("prev_modified") == F.lower("last_modified"))
    same_name = F.lower("prev_file") == F.lower("file")
    kind = (
        F.when(~has_cur, "deleted")
        .when(same_time & same_name, "unchanged")
        .when(same_time, "renamed")
        .when(F.coalesce("failed", F.lit(False)), "failed")
        .when(~has_prev, "new")
        .otherwise("changed")
    )
    action = (
        F.when(F.col("class").isin("new", "changed"), "export")
        .when(F.col("class") == "renamed", "move")
        .when((F.col("class") == "deleted") & exists, "delete")
        .otherwise("none")
    )
    stale = exists & ((F.col("class") == "deleted") | ((F.col("class") == "changed") & ~same_name))
    return (
        p.join(c, "id", "full_outer").withColumn("class", kind).withColumn("action", action)
        .withColumn("drop_old_file", F.coalesce(stale, F.lit(False)))
        .select("id", "class", "action", "prev_file", "file", "prev_modified", "last_modified",
                "prev_exported_at", "drop_old_file")
    )


def diff_counts(diffed: DataFrame) -> DataFrame:
    of = lambda *names: F.count_if(F.col("class").isin(*names))
    return diffed.agg(
        of("new", "changed").alias("exported"), of("unchanged", "renamed").alias("skipped"),
        of("renamed").alias("renamed"), F.count_if((F.col("class") == "deleted") & F.col("drop_old_file")).alias("deleted"),
        of("failed").alias("failed"),
    )


def deleted_ids(prev: DataFrame, cur: DataFrame) -> DataFrame:
    return prev.select("id").join(cur.select("id"), "id", "left_anti")


def next_manifest(diffed: DataFrame, exported_at: str) -> DataFrame:
    """Rows of the next manifest: exports get the new time, kept ones the old; a failed export
    keeps its previous row."""
    kept = diffed.filter((F.col("class") != "deleted") & ~((F.col("class") == "failed") & F.col("prev_file").isNull()))
    failed = F.col("class") == "failed"
    return kept.select(
        "id", F.when(failed, F.col("prev_file")).otherwise(F.col("file")).alias("file"),
        F.when(failed, F.col("prev_modified")).otherwise(F.col("last_modified")).alias("last_modified"),
        F.when(F.col("class").isin("new", "changed"), F.lit(exported_at)).otherwise(F.col("prev_exported_at")).alias("exported_at"),
    )
