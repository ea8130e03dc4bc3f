"""Structured Streaming over arriving files."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from linetrawl.operators.scan import by_route, package_parts, package_segments
from linetrawl.operators.search import HIT_COLUMNS, StandingGate, cap_hits, search_segments, search_texts, segment_hits
from linetrawl.sinks.store import SegmentStore
from linetrawl.sources.files import filter_manifest, read_content
from linetrawl.sources.plaintext import decode_text, text_segments
from linetrawl.spec import ScanSpec, SearchSpec
from linetrawl.workspace import shared_dir

FOUND = "path string, seg_idx bigint, hit_ord int, locator string, kw_idx int, position bigint, matched string, snippet string"
PRESENT = "path string, words array<int>"
TEXTS = "path string, seg_idx bigint, text string"
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, directory: str) -> DataFrame:
    """Stream of new files with content. A file changed in place is not delivered again; :func:`follow` catches those."""
    stream = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE)
        .option("recursiveFileLookup", "true").load(directory)
    )
    plain = F.regexp_replace("path", "^file:/*", "/") if "://" not in directory else F.col("path")
    return stream.select(plain.alias("path"), F.col("length").alias("size"),
                         F.col("modificationTime").alias("mtime"), "content")


def extract(files: DataFrame, spec: ScanSpec = ScanSpec(), office: bool = False) -> DataFrame:
    """``(path, idx, locator, text)`` of files with content, over all routes."""
    columns = ["path", "idx", "locator", "text"]
    routes = by_route(files, office)
    texts = text_segments(decode_text(routes["text"], ["path"])).withColumn("idx", F.col("idx").cast("bigint"))
    packages = package_segments(package_parts(routes), spec.xlsx_granularity)
    return texts.select(*columns).unionByName(packages.select(*columns))


def ingest(files: DataFrame, store: SegmentStore, checkpoint: str, spec: ScanSpec = ScanSpec(),
           roots: list[str] | None = None, office: bool = False) -> StreamingQuery:
    """Keep a segment store current with files that arrive below ``roots``.

    Excluded directory names count only below the roots. Each micro-batch is one generation, tagged
    with the identity that its checkpoint keeps and its number, so a batch replayed after a
    failure is recognised and written once, and batches of other checkpoints never are.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        tag = f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}:{epoch}"
        if store.has_tag(tag):
            return
        wanted = filter_manifest(batch, spec, roots)
        store.put(wanted, extract(wanted, spec, office), spec.xlsx_granularity, tag)

    return (
        files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def follow(listed: DataFrame, store: SegmentStore, checkpoint: str, spec: ScanSpec = ScanSpec(), roots: list[str] | None = None,
           office: bool = False, forget_missing: bool = False, interval: str | None = None) -> StreamingQuery:
    """Keep a segment store equal to the files below ``roots``, those edited in place included.

    ``listed`` is a stream of whole listings ``(path, size, mtime)``, as :func:`linetrawl.sources.datasource.listings` gives it. The
    store itself is the state: a file that it holds with the same time and size is left alone, any other is read again, once. A
    file edited after it was listed is stored under the time of the listing, so the next trigger takes it up; one that
    cannot be read is not stored, and is tried again. A batch that is replayed finds the store up to date.

    ``forget_missing`` takes out files below ``roots`` that the listing no longer has; a root that cannot be listed holds
    nothing, so it is off unless asked for. With ``interval`` the query goes on listing, otherwise it lists once and ends.
    """
    if forget_missing and not roots:
        raise ValueError("forget_missing needs the roots that were listed")

    def write(batch: DataFrame, epoch: int) -> None:
        found = shared_dir(batch.sparkSession, "listing")
        filter_manifest(batch, spec, roots).dropDuplicates(["path"]).write.parquet(found)
        current = batch.sparkSession.read.schema("path string, size bigint, mtime timestamp").parquet(found)
        stale = shared_dir(batch.sparkSession, "changed")
        store.misses(current, spec.xlsx_granularity).select("path", "size", "mtime").write.parquet(stale)
        changed = batch.sparkSession.read.schema(current.schema).parquet(stale)
        if not changed.isEmpty():
            loaded = read_content(changed).persist(StorageLevel.DISK_ONLY)  # read once for all routes; lost blocks are read again
            fit = loaded.filter(F.col("error").isNull())
            store.put(fit, extract(fit.drop("error"), spec, office), spec.xlsx_granularity)
            loaded.unpersist()
        if forget_missing:
            below = F.lit(False)
            for root in map(lambda r: r.rstrip("/"), roots):
                below = below | (F.col("path") == root) | F.col("path").startswith(root + "/")
            gone = store.files().filter(below).select("path").join(current, "path", "left_anti")
            if not gone.isEmpty():
                store.forget(gone)

    when = {"processingTime": interval} if interval else {"availableNow": True}
    return listed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**when).start()


def standing_search(texts: DataFrame, spec: SearchSpec) -> DataFrame:
    """Hits of a stream of whole-file rows ``(path, text)``: stateless, for append output."""
    return search_texts(texts, spec)


def standing_segment_search(segments: DataFrame, spec: SearchSpec, sink: str, checkpoint: str) -> StreamingQuery:
    """Hits of a stream of segment rows. A file arrives within one micro-batch, so its cap and AND
    gate are decided there; each batch overwrites its own partition, which makes replays harmless."""
    def write(batch: DataFrame, epoch: int) -> None:
        search_segments(batch, spec).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    return (
        segments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


class StandingSearch:
    """Hits of a stream of segments whose files may arrive in any number of micro-batches, in any order.

    Each batch writes what it adds: its hits, trimmed to the cap of each file, and which keywords its segments hold. Cap and AND gate
    are decided when :meth:`hits` reads, over all batches so far, and so equal one search over all segments. A file whose
    gate opens later has its earlier hits waiting. Nothing is kept in tasks, a batch costs what it holds, and a replayed batch
    overwrites its own partition. Batches that a keyword with line breaks may span keep their texts.
    """

    def __init__(self, spark: SparkSession, root: str, spec: SearchSpec):
        self.spark, self.root, self.spec = spark, root.rstrip("/"), spec
        self.gate = StandingGate(spec)

    def start(self, segments: DataFrame, checkpoint: str) -> StreamingQuery:
        def write(batch: DataFrame, epoch: int) -> None:
            for name, rows in self._added(batch).items():
                rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={epoch}")

        return segments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _added(self, batch: DataFrame) -> dict[str, DataFrame]:
        added = {"found": segment_hits(batch, self.spec)}
        if self.gate.single:
            added["present"] = self.gate.present(batch)
        if self.gate.across:
            added["texts"] = self.gate.normalized(batch)
        return added

    def hits(self) -> DataFrame:
        """Capped and gated hits of everything that has arrived, with the columns of ``search_segments``."""
        found = cap_hits(self._read("found", FOUND), self.spec.max_hits_per_file).select(*HIT_COLUMNS)
        if self.gate.single:
            found = found.join(self.gate.complete(self._read("present", PRESENT)), "path", "left_semi")
        if self.gate.across:
            found = found.join(self.gate.spanned(self._read("texts", TEXTS)), "path", "left_semi")
        return found

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # before the first batch
                raise
            return self.spark.createDataFrame([], schema)
