"""Incremental extraction: which files changed, and what the segment cache holds afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MTIME_TOLERANCE_US = 1  # fixed value: times within a microsecond are equal


def lookup(manifest: DataFrame, cached: DataFrame) -> DataFrame:
    """Manifest rows with ``is_hit``: cached under the same path, time and size.

    Equality on path is the join key; time and size only decide the flag, so files missing from the
    cache and changed files come out of one left join.
    """
    c = cached.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"))
    micros = lambda col: F.unix_micros(F.col(col).cast("timestamp"))
    same = (F.abs(micros("mtime") - micros("_mtime")) <= MTIME_TOLERANCE_US) & (F.col("size") == F.col("_size"))
    return manifest.join(c, "path", "left").withColumn("is_hit", F.coalesce(same, F.lit(False))).drop("_mtime", "_size")


def misses(manifest: DataFrame, cached: DataFrame) -> DataFrame:
    """Files that have to be extracted."""
    return lookup(manifest, cached).filter(~F.col("is_hit")).drop("is_hit")


def cached_segments(manifest: DataFrame, cached: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments of the files that are still valid in the cache."""
    valid = lookup(manifest, cached).filter("is_hit").select("path")
    return segments.join(valid, "path", "left_semi")


def orphans(segments: DataFrame, cached: DataFrame) -> DataFrame:
    """Segments whose file is no longer in the cache."""
    return segments.join(cached.select("path"), "path", "left_anti")


def replace(segments: DataFrame, replaced: DataFrame, fresh: DataFrame) -> DataFrame:
    """Segment table after the ``replaced`` files were extracted again, with ``fresh`` segments.

    The paths come from the manifest and not from ``fresh``, which may be empty for a file and need
    not be computed twice.
    """
    return forget(segments, replaced).unionByName(fresh)


def forget(table: DataFrame, paths: DataFrame) -> DataFrame:
    return table.join(paths.select("path"), "path", "left_anti")


def stats(cached: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: files, segments, average segments per file, bytes of text."""
    zero = F.lit(0).cast("bigint")
    counted = cached.select(F.lit(1).cast("bigint").alias("f"), zero.alias("s"), zero.alias("b")).unionAll(
        segments.select(zero, F.lit(1).cast("bigint"), F.octet_length("text").cast("bigint")))
    total = lambda c: F.coalesce(F.sum(c), zero).cast("bigint")
    return counted.agg(total("f").alias("n_files"), total("s").alias("n_segments"), total("b").alias("text_bytes")).withColumn(
        "segments_per_file", F.when(F.col("n_files") > 0, F.round(F.col("n_segments") / F.col("n_files"), 1)))


def counters(looked_up: DataFrame) -> DataFrame:
    """Hits and misses of a lookup; every miss is extracted and written."""
    miss: Column = ~F.col("is_hit")
    return looked_up.agg(F.count_if("is_hit").alias("hits"), F.count_if(miss).alias("misses"))
