"""Registered queries: segment cache and export snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from linetrawl.functions.text import sanitize_name
from linetrawl.operators import cache, snapshot
from linetrawl.plans import fixtures as fx
from linetrawl.sinks.store import SegmentStore
from linetrawl.spec import SearchSpec
from linetrawl.workspace import shared_dir

RARE = ("license", ".com", "123")
EXPORTED_AT = "2024-06-01T00:00:00"


def _segs(df):
    return df.select("path", F.col("idx").cast("bigint").alias("idx"), "locator", F.md5("text").alias("digest"))


def _put(spark, sf_dir):
    """The cache after every file that misses it was extracted again."""
    stale = cache.misses(fx.files_v(spark, sf_dir), fx.cache_files_v(spark, sf_dir)).select("path")
    fresh = fx.segments_v(spark, sf_dir).drop("line_no").join(stale, "path", "left_semi")
    fresh = fresh.withColumn("text", F.concat(F.lit("v2 "), "text"))
    return _segs(cache.replace(fx.cache_segments_v(spark, sf_dir), stale, fresh))


def _stored_hits(spark, sf_dir):
    """A store filled by two puts, the second of which replaces a third of the files, searched through its index."""
    store = SegmentStore(spark, shared_dir(spark, "store"))
    files, segments = fx.files_v(spark, sf_dir), fx.segments_v(spark, sf_dir).drop("line_no")
    again = files.filter(F.col("file_ord") % 3 == 0)
    store.put(files, segments.withColumn("text", F.when(F.col("path").endswith(".csv"), F.concat(F.lit("old "), "text")).otherwise(F.col("text"))))
    store.put(again.unionByName(files.filter(F.col("path").endswith(".csv"))).distinct(),
              segments.join(again.select("path"), "path", "left_semi").unionByName(segments.filter(F.col("path").endswith(".csv"))).distinct())
    hits = store.search(SearchSpec(RARE, operator="or"))
    return hits.select("path", F.col("seg_idx").cast("int").alias("seg_idx"), "locator", "kw_idx", "position", "matched", "snippet")


def _diff(spark, sf_dir):
    return snapshot.diff(fx.prev_manifest_v(spark, sf_dir), fx.cur_manifest_v(spark, sf_dir))


def _stored_lookup(spark, sf_dir):
    """Lookup of every file in a store of three generations, the last of which replaces entries of the first."""
    store = SegmentStore(spark, shared_dir(spark, "store"))
    cached, nothing = fx.cache_files_v(spark, sf_dir), fx.segments_v(spark, sf_dir).drop("line_no").limit(0)
    turn = F.pmod(F.hash("path"), F.lit(3))
    store.put(cached.filter(turn < 2).withColumn("size", F.col("size") + F.when(turn == 1, 1).otherwise(0)), nothing)
    store.put(cached.filter(turn == 2), nothing)
    store.put(cached.filter(turn == 1), nothing)
    return store.lookup(fx.files_v(spark, sf_dir)).select("path", "is_hit")


QUERIES = {
    "cache_lookup": lambda s, d: cache.lookup(fx.files_v(s, d), fx.cache_files_v(s, d)).select("path", "is_hit"),
    "cache_misses": lambda s, d: cache.misses(fx.files_v(s, d), fx.cache_files_v(s, d)).select("path"),
    "cache_read": lambda s, d: _segs(cache.cached_segments(fx.files_v(s, d), fx.cache_files_v(s, d), fx.cache_segments_v(s, d))).orderBy("path", "idx"),
    "cache_orphans": lambda s, d: _segs(cache.orphans(fx.cache_segments_v(s, d), fx.cache_files_v(s, d))),
    "cache_put": _put,
    "store_search": _stored_hits,
    "store_lookup": _stored_lookup,
    "cache_forget": lambda s, d: _segs(cache.forget(fx.cache_segments_v(s, d), fx.files_v(s, d).filter(F.col("size") > 500))),
    "agg_cache_stats": lambda s, d: cache.stats(fx.cache_files_v(s, d), fx.cache_segments_v(s, d)),
    "agg_cache_hits": lambda s, d: cache.counters(cache.lookup(fx.files_v(s, d), fx.cache_files_v(s, d))),
    "diff_snapshot": lambda s, d: _diff(s, d).select("id", "class", "action", "drop_old_file"),
    "diff_counts": lambda s, d: snapshot.diff_counts(_diff(s, d)),
    "diff_deleted": lambda s, d: snapshot.deleted_ids(fx.prev_manifest_v(s, d), fx.cur_manifest_v(s, d)),
    "diff_manifest": lambda s, d: snapshot.next_manifest(_diff(s, d), EXPORTED_AT),
    "diff_recycle": lambda s, d: snapshot.recycled_count(fx.nodes_v(s, d)),
    "diff_live": lambda s, d: snapshot.live_nodes(fx.nodes_v(s, d)).select("id"),
    "diff_reset": lambda s, d: snapshot.manifest_items(fx.manifest_json_v(s, d), "page"),
    "manifest_json": lambda s, d: snapshot.manifest_items(fx.manifest_json_v(s, d)),
    "dedupe_names": lambda s, d: snapshot.dedupe_names(snapshot.target_names(snapshot.live_nodes(fx.nodes_v(s, d)))).select("id", "file"),
    "sanitize_name": lambda s, d: fx.nodes_v(s, d).select(
        "id", sanitize_name(F.col("section")).alias("section"), sanitize_name(F.col("page")).alias("page")),
}

_HIT = "c.path IS NOT NULL AND c.mtime = f.mtime AND c.size = f.size"
_LOOKUP = f"SELECT f.path, coalesce({_HIT}, false) AS is_hit FROM files_v f LEFT JOIN cache_files_v c USING (path)"
_DIGEST = "SELECT path, CAST(idx AS BIGINT) AS idx, locator, md5(text) AS digest FROM"
_BOTH = fx.with_views("files_v", "cache_files_v", "cache_segments_v", looked=_LOOKUP)

_JOINED = """SELECT coalesce(p.id, c.id) AS id, p.id IS NOT NULL AS hp, c.id IS NOT NULL AS hc, coalesce(p.file_exists, false) AS fe,
  p.file AS prev_file, c.file AS file, p.exported_at AS prev_exported_at, c.last_modified AS last_modified,
  coalesce(p.last_modified = c.last_modified, false) AS same_time, coalesce(lower(p.file) = lower(c.file), false) AS same_name
  FROM prev_manifest_v p FULL OUTER JOIN cur_manifest_v c ON p.id = c.id"""
_CLASSED = """SELECT *, CASE WHEN NOT hc THEN 'deleted' WHEN NOT hp THEN 'new' WHEN fe AND same_time AND same_name THEN 'unchanged'
  WHEN fe AND same_time THEN 'renamed' ELSE 'changed' END AS class FROM joined"""
_SNAP = fx.with_views("prev_manifest_v", "cur_manifest_v", joined=_JOINED, classed=_CLASSED)
_ITEMS = """SELECT 'id' || doc_id || '_' || n AS id, 'doc' || doc_id || '_' || n || '.docx' AS file,
  strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id + n AS INT)), '%Y-%m-%dT%H:%M:%S') AS last_modified,
  '2023-12-31T00:00:00' AS exported_at FROM documents, (VALUES (0), (1)) v(n) WHERE doc_id % 5 <> 2"""
_CLEAN = "trim(regexp_replace({}, '[\\\\/:*?\"<>|]', '_', 'g'))"

ORACLES = {
    "cache_lookup": _BOTH + "SELECT path, is_hit FROM looked",
    "store_lookup": _BOTH + "SELECT path, is_hit FROM looked",
    "cache_misses": _BOTH + "SELECT path FROM looked WHERE NOT is_hit",
    "cache_read": _BOTH + f"{_DIGEST} cache_segments_v WHERE path IN (SELECT path FROM looked WHERE is_hit)",
    "cache_orphans": _BOTH + f"{_DIGEST} cache_segments_v WHERE path NOT IN (SELECT path FROM cache_files_v)",
    "cache_put": _BOTH + f"""{_DIGEST} (SELECT path, idx, locator, text FROM cache_segments_v WHERE path NOT IN (SELECT path FROM looked WHERE NOT is_hit)
      UNION ALL SELECT path, idx, locator, 'v2 ' || text FROM segments_v WHERE path IN (SELECT path FROM looked WHERE NOT is_hit))""",
    "store_search": fx.with_views("segments_v", **fx.keyword_hits_ctes("segments_v", RARE))
      + "SELECT path, seg_idx, locator, kw_idx, position, matched, snippet FROM hits",
    "cache_forget": _BOTH + f"{_DIGEST} cache_segments_v WHERE path NOT IN (SELECT path FROM files_v WHERE size > 500)",
    "agg_cache_stats": _BOTH + """SELECT n_files, n_segments, text_bytes, round(n_segments / n_files, 1) AS segments_per_file FROM
      (SELECT (SELECT count(*) FROM cache_files_v) AS n_files, (SELECT count(*) FROM cache_segments_v) AS n_segments,
      (SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) FROM cache_segments_v) AS text_bytes)""",
    "agg_cache_hits": _BOTH + "SELECT count_if(is_hit) AS hits, count_if(NOT is_hit) AS misses FROM looked",
    "diff_snapshot": _SNAP + """SELECT id, class, CASE WHEN class IN ('new', 'changed') THEN 'export' WHEN class = 'renamed' THEN 'move'
      WHEN class = 'deleted' AND fe THEN 'delete' ELSE 'none' END AS action,
      fe AND (class = 'deleted' OR (class = 'changed' AND NOT same_name)) AS drop_old_file FROM classed""",
    "diff_counts": _SNAP + """SELECT count_if(class IN ('new', 'changed')) AS exported, count_if(class IN ('unchanged', 'renamed')) AS skipped,
      count_if(class = 'renamed') AS renamed, count_if(class = 'deleted' AND fe) AS deleted, CAST(0 AS BIGINT) AS failed FROM classed""",
    "diff_deleted": _SNAP + "SELECT id FROM prev_manifest_v EXCEPT SELECT id FROM cur_manifest_v",
    "diff_manifest": _SNAP + f"""SELECT id, file, last_modified, CASE WHEN class IN ('new', 'changed') THEN '{EXPORTED_AT}' ELSE prev_exported_at END AS exported_at
      FROM classed WHERE class <> 'deleted'""",
    "diff_recycle": fx.with_views("nodes_v") + "SELECT count_if(gone) AS recycled, count_if(NOT gone) AS live FROM nodes_v",
    "diff_live": fx.with_views("nodes_v") + "SELECT id FROM nodes_v WHERE NOT gone",
    "diff_reset": _ITEMS + " AND doc_id % 4 <> 1",
    "manifest_json": _ITEMS,
    "dedupe_names": fx.with_views("nodes_v", named=f"SELECT id, ord, notebook || '__' || {_CLEAN.format('section')} || '__' || {_CLEAN.format('page')} AS stem FROM nodes_v WHERE NOT gone",
                                  ranked="SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY ord) - 1 AS n FROM named")
      + "SELECT id, stem || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.docx' AS file FROM ranked",
    "sanitize_name": fx.with_views("nodes_v") + f"SELECT id, {_CLEAN.format('section')} AS section, {_CLEAN.format('page')} AS page FROM nodes_v",
}
