"""A segment store on parquet that grows by generations.

Each ``put`` or ``forget`` writes one new generation: its segments first, then its file list, whose
commit makes the generation visible. Nothing is rewritten, so a put costs what changed and not what
is stored, and a failed attempt leaves only files that no reader looks at. ``compact`` writes a
fresh store without the superseded rows.

Segments lie in groups of whole files, and each put writes an index of the trigrams in its groups, so that a search for
keywords opens only groups that can hold them. File lists have filters of their paths, so that a lookup opens only the
generations that may hold one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from linetrawl.operators import cache
from linetrawl.operators.search import search_segments
from linetrawl.sinks.index import INDEX, PATHS, generations_with, matching_groups, needed_places, path_filter, trigram_bitmaps
from linetrawl.spec import SearchSpec

FILES = "path string, mtime timestamp, size bigint, granularity string, forgotten boolean, tag string, updated_at timestamp, gen bigint"
SEGMENTS = "path string, idx bigint, locator string, text string, gen bigint, grp int"
#: Groups of a generation.
GROUPS = 16
#: A lookup of at most so many files chooses generations by their filters; a larger one meets about all of them and reads the whole log.
FEW_PATHS = 20_000


class SegmentStore:
    def __init__(self, spark: SparkSession, root: str, groups: int = GROUPS):
        self.spark, self.root, self.groups = spark, root.rstrip("/"), groups

    # ------------------------------------------------------------------ reading
    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # anything else must not pass for an empty store
                raise
            return self.spark.createDataFrame([], schema)

    def _log(self, gens: list[int] | None = None) -> DataFrame:
        log = self._read("files", FILES)
        return log if gens is None else log.filter(F.col("gen").isin(gens))  # on directories alone

    def _latest(self, gens: list[int] | None = None) -> DataFrame:
        """Newest entry per path; a partial aggregate, so a path rewritten often is no hot key."""
        entry = F.struct("gen", "mtime", "size", "granularity", "forgotten", "updated_at")
        return self._log(gens).groupBy("path").agg(F.max_by(entry, "gen").alias("e")).select("path", "e.*")

    def files(self, gens: list[int] | None = None) -> DataFrame:
        """Live files, of the whole store or as generations ``gens`` tell."""
        return self._latest(gens).filter(~F.col("forgotten")).drop("forgotten")

    def generations(self) -> list[int]:
        """Committed generations, from the names of their files; none is opened."""
        return sorted({int(g) for f in self._log().inputFiles() for g in re.findall(r"/gen=(\d+)/", f)})

    def generations_for(self, paths: DataFrame) -> list[int] | None:
        """Generations that may hold one of ``paths``; None for so many paths that all would be read.

        Whatever mentions a path is among them, also what forgets it, so the newest entry of each path asked for is too. A
        generation without a whole filter is always among them.
        """
        if paths.select("path").limit(FEW_PATHS + 1).count() > FEW_PATHS:
            return None
        indexed, met = generations_with(self._read("paths", PATHS), paths)
        return [g for g in self.generations() if g in met or g not in indexed]

    def segments(self, groups: list[tuple[int, int]] | None = None) -> DataFrame:
        """Live segments, of the ``(gen, grp)`` listed or of all. Superseded (path, gen) pairs are few between compactions; they are taken
        out by an anti join whose strategy Spark picks by their actual size."""
        generations = self._log().select("gen").distinct()
        live = self.files().select("path", "gen")
        dead = self._log().select("path", "gen").join(live, ["path", "gen"], "left_anti")
        stored = self._read("segments", SEGMENTS)
        if groups is not None:
            by_gen: dict[int, list[int]] = {}
            for gen, grp in groups:
                by_gen.setdefault(gen, []).append(grp)
            some = F.lit(False)
            for gen, grps in by_gen.items():
                some = some | ((F.col("gen") == gen) & F.col("grp").isin(grps))
            stored = stored.filter(some)  # on directories alone, so the others are not opened
        stored = stored.join(generations, "gen", "left_semi")
        return stored.join(dead, ["path", "gen"], "left_anti").select("path", "idx", "locator", "text")

    def lookup(self, manifest: DataFrame, granularity: str = "cell") -> DataFrame:
        """Manifest rows with ``is_hit``. A manifest of at most ``FEW_PATHS`` files runs small jobs that choose the generations to open."""
        known = self.files(self.generations_for(manifest))
        return cache.lookup(manifest, known.filter(F.col("granularity") == granularity))

    def misses(self, manifest: DataFrame, granularity: str = "cell") -> DataFrame:
        return self.lookup(manifest, granularity).filter(~F.col("is_hit")).drop("is_hit")

    def get(self, manifest: DataFrame, granularity: str = "cell") -> DataFrame:
        """Segments of the manifest files that are unchanged since they were stored."""
        valid = self.lookup(manifest, granularity).filter("is_hit").select("path")
        return self.segments().join(valid, "path", "left_semi")

    def groups_for(self, spec: SearchSpec) -> list[tuple[int, int]] | None:
        """Groups that can hold what ``spec`` looks for; None if that takes all of them."""
        words = needed_places(self.spark, spec)
        if not words:
            return None
        return matching_groups(self._read("index", INDEX), words, spec.operator == "and")

    def search(self, spec: SearchSpec) -> DataFrame:
        """Hits among the live segments. A file lies in one group whole, so its cap and AND gate need no other."""
        return search_segments(self.segments(self.groups_for(spec)), spec)

    def stats(self) -> DataFrame:
        return cache.stats(self.files(), self.segments())

    # ------------------------------------------------------------------ writing
    def has_tag(self, tag: str) -> bool:
        return not self._log().filter(F.col("tag") == tag).isEmpty()

    def _next_generation(self) -> int:
        top = self._log().agg(F.max("gen").alias("g")).first().g
        return 0 if top is None else top + 1

    def put(self, manifest: DataFrame, segments: DataFrame, granularity: str = "cell", tag: str | None = None) -> int:
        """Store the segments of the manifest's files, replacing earlier ones. One writer at a time."""
        gen = self._next_generation()
        self._write_segments(segments, gen)
        self._commit(manifest.select("path", F.col("mtime").cast("timestamp").alias("mtime"), "size"), gen, granularity, False, tag)
        return gen

    def _write_segments(self, segments: DataFrame, gen: int) -> None:
        out = f"{self.root}/segments/gen={gen}"
        grouped = segments.select(
            "path", F.col("idx").cast("bigint").alias("idx"), "locator", "text", F.pmod(F.xxhash64("path"), F.lit(self.groups)).cast("int").alias("grp"))
        # Rebalanced, so that a group is a few files however many tasks there were, and a large one more than one task's.
        grouped.hint("rebalance", "grp").write.mode("overwrite").partitionBy("grp").parquet(out)
        try:
            written = self.spark.read.schema("text string, grp int").parquet(out)
        except AnalysisException as e:
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return
        trigram_bitmaps(written).write.mode("overwrite").parquet(f"{self.root}/index/gen={gen}")

    def forget(self, paths: DataFrame, tag: str | None = None) -> int:
        gen = self._next_generation()
        rows = paths.select("path", F.lit(None).cast("timestamp").alias("mtime"), F.lit(None).cast("bigint").alias("size"))
        self._commit(rows, gen, None, True, tag)
        return gen

    def clear(self) -> int:
        return self.forget(self.files().select("path"))

    def compact(self, root: str) -> "SegmentStore":
        """Copy of this store at ``root`` with live rows only and no orphan segments."""
        fresh = SegmentStore(self.spark, root, self.groups)
        fresh._write_segments(self.segments(), 0)
        live = self.files().select("path", "mtime", "size", "granularity", F.lit(False).alias("forgotten"),
                                   F.lit(None).cast("string").alias("tag"), "updated_at")
        live.write.mode("overwrite").parquet(f"{fresh.root}/files/gen=0")
        fresh._write_filter(0)
        return fresh

    def _commit(self, rows: DataFrame, gen: int, granularity: str | None, forgotten: bool, tag: str | None) -> None:
        rows.select(
            "path", "mtime", "size", F.lit(granularity).cast("string").alias("granularity"),
            F.lit(forgotten).alias("forgotten"), F.lit(tag).cast("string").alias("tag"),
            F.current_timestamp().alias("updated_at"),
        ).write.mode("overwrite").parquet(f"{self.root}/files/gen={gen}")
        self._write_filter(gen)

    def _write_filter(self, gen: int) -> None:
        """Filter of a committed file list. Should the writer die before it is whole, lookups open the generation."""
        written = self.spark.read.schema("path string").parquet(f"{self.root}/files/gen={gen}")
        path_filter(written, written.count()).write.mode("overwrite").parquet(f"{self.root}/paths/gen={gen}")
