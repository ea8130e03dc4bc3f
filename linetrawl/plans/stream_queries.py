"""Registered queries: the streaming jobs, run over the given tables until all of it is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from linetrawl.plans import fixtures as fx
from linetrawl.plans.search_queries import HITS, OR_SPEC, ORACLES as SEARCH_SQL
from linetrawl.sinks.store import SegmentStore
from linetrawl.spec import ScanSpec, SearchSpec
from linetrawl.streaming.incremental import StandingSearch, ingest, standing_search
from linetrawl.workspace import shared_dir


def _standing(spark, sf_dir):
    base = shared_dir(spark, "standing")
    hits = standing_search(fx.arriving_documents(spark, sf_dir).select("path", "text"), OR_SPEC)
    query = (
        hits.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start(f"{base}/hits")
    )
    query.awaitTermination()
    return spark.read.schema(hits.schema).parquet(f"{base}/hits").select(*HITS)


def _ingested(spark, sf_dir):
    base = shared_dir(spark, "ingest")
    store = SegmentStore(spark, f"{base}/store")
    files = fx.as_content(fx.arriving_documents(spark, sf_dir)).drop("file_ord")
    ingest(files, store, f"{base}/checkpoint", ScanSpec(extensions=("*",))).awaitTermination()
    return store.segments().select("path", "idx", "locator", F.md5("text").alias("digest"))


def _in_pieces(spark, sf_dir):
    """Turns that arrive in three micro-batches, so that most conversations come in pieces."""
    base = shared_dir(spark, "pieces")
    turns = fx.turns_v(spark, sf_dir)
    for i in range(3):
        turns.filter(F.pmod("idx", F.lit(3)) == i).write.parquet(f"{base}/turns/piece={i}")
    files = -(-len(spark.read.parquet(f"{base}/turns").inputFiles()) // 3)
    arriving = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/turns/piece=*")
    search = StandingSearch(spark, f"{base}/search", SearchSpec(("the", "and", "with")))
    search.start(arriving, f"{base}/checkpoint").awaitTermination()
    return search.hits().withColumn("seg_idx", F.col("seg_idx").cast("int")).select(*HITS)


QUERIES = {"stream_search": _standing, "stream_ingest": _ingested, "stream_pieces": _in_pieces}

ORACLES = {
    "stream_search": SEARCH_SQL["kw_or"],
    "stream_pieces": SEARCH_SQL["kw_segments_and"],
    "stream_ingest": fx.with_views("docs", "segments_v", kinds=f"""SELECT path, file_ord FROM (SELECT *, {fx.EXT_SQL} AS ext, {fx.BASE_SQL} AS base FROM docs)
        WHERE ext NOT IN ('.xlsx', '.docx', '.pdf', '.png', '.ppt', '.tmp') AND NOT starts_with(base, '~$') AND split_part(path, '/', 4) <> '.git'
        AND size <= 100 * 1024 * 1024 AND (file_ord % 11 <> 0 OR file_ord % 7 = 0)""")
      + """SELECT path, CAST(idx AS BIGINT) AS idx, locator, md5(CASE WHEN file_ord % 77 = 0 AND line_no = 1 THEN chr(0) || text ELSE text END) AS digest
      FROM segments_v JOIN kinds USING (path)""",
}
