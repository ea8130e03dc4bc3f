"""File manifests: listing, filtering and reading."""

from __future__ import annotations

import os
import posixpath
from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from linetrawl.functions.paths import basename, dir_parts, extension, glob_to_regex
from linetrawl.sources.route import XLSX, route
from linetrawl.spec import ScanSpec
from linetrawl.workspace import shared_dir

FILE_SCHEMA = "path string, size bigint, mtime timestamp"
#: A value of a column holds no more.
MAX_BYTES = 2**31 - 65536
#: Text files up to this size are one value of a row, larger ones are read in splits.
WHOLE_BYTES = 256 << 20
_LISTING = FILE_SCHEMA + ", root string, is_dir boolean"


def filter_manifest(files: DataFrame, spec: ScanSpec, roots: list[str] | None = None) -> DataFrame:
    """Extension, excluded directory, excluded name and size filters over ``(path, size)``.

    Plain predicates on the manifest, so they run before any content is read. Directory names count
    only below the scanned root.
    """
    name = basename(F.col("path"))
    if spec.extension_filter is not None:
        files = files.filter(extension(F.col("path")).isin(spec.extension_filter))
    if spec.exclude_dirs:
        parts = reduce(
            lambda rest, root: F.when(F.col("path").startswith(root.rstrip("/") + "/"),
                                      dir_parts(F.col("path"), root)).otherwise(rest),
            roots or [], dir_parts(F.col("path")),
        )
        files = files.filter(~F.arrays_overlap(parts, F.array(*map(F.lit, spec.exclude_dirs))))
    for pattern in spec.exclude_patterns:
        files = files.filter(~name.rlike(glob_to_regex(pattern)))
    if spec.manifest_name:
        files = files.filter(name != spec.manifest_name)
    if spec.max_size_mb:
        files = files.filter(F.col("size") <= spec.max_size_mb * 1024 * 1024)
    return files


def union_roots(files: DataFrame, roots: list[str]) -> DataFrame:
    """Files under each root in turn; overlapping roots yield duplicates, unknown ones nothing."""
    def under(root):
        bare = root.rstrip("/")
        return files.filter((F.col("path") == bare) | F.col("path").startswith(bare + "/"))

    live = [r for r in roots if r]
    return reduce(DataFrame.unionAll, map(under, live)) if live else files.filter(F.lit(False))


def with_extra_root(roots: list[str], extra: str | None, exists: bool) -> list[str]:
    """Append an export directory that exists and is not listed yet."""
    return [*roots, extra] if extra and exists and extra not in roots else list(roots)


def read_binary(spark: SparkSession, roots: list[str], spec: ScanSpec = ScanSpec(), names: str | None = None) -> DataFrame:
    """Manifest plus content through the built-in ``binaryFile`` source; ``names`` is a glob that the
    listing already applies.

    It works on every Hadoop file system, lists in parallel and reads content only where a later
    step asks for it, but leaves out names that start with a dot or underscore.
    """
    def one(root):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if names:
            reader = reader.option("pathGlobFilter", names)
        return reader.load(root).select(
            F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "/+", "/").alias("path")
            if "://" not in root else F.col("path"),
            F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content",
        )

    live = [r for r in roots if r and ("://" in r or os.path.exists(r))]
    if not live:
        return spark.createDataFrame([], FILE_SCHEMA + ", content binary")
    return filter_manifest(reduce(DataFrame.unionAll, map(one, live)), spec, live)


def read_routes(spark: SparkSession, roots: list[str], spec: ScanSpec = ScanSpec(), office: bool = False,
                whole_bytes: int = WHOLE_BYTES) -> dict[str, DataFrame]:
    """Files with content, split by route, on mounted directories and on any file system that Arrow reads.

    Files are listed, filtered and routed by name first, and only those that a route searches are opened. One
    that cannot be read gets an ``error`` instead of content. Text files beyond ``whole_bytes`` are the route ``large``,
    workbooks beyond it ``large_xlsx``; both come without content, and the scan reads them in splits and part by part.
    """
    manifest = walk_files(spark, roots, spec)
    kinds = ("docx", "pptx") if office else ()
    routes = {kind: read_content(manifest.filter(route(F.col("path"), office) == kind)) for kind in kinds}
    beyond = F.coalesce(F.col("size") > whole_bytes, F.lit(False))
    large = (route(F.col("path"), office) == "text") & beyond
    routes["xlsx"] = read_content(manifest.filter((route(F.col("path"), office) == "xlsx") & ~beyond))
    routes["large_xlsx"] = manifest.filter((route(F.col("path"), office) == "xlsx") & beyond)
    routes["text"] = read_content(manifest.filter((route(F.col("path"), office) == "text") & ~beyond))
    routes["large"] = manifest.filter(large)
    routes["skip"] = manifest.filter(route(F.col("path"), office) == "skip").withColumns(
        {"content": F.lit(None).cast("binary"), "error": F.lit(None).cast("string")})
    return routes


def _list_local(path: str) -> list[tuple]:
    """``(name, is_dir, size, ms)`` of the entries; size is None for one that cannot be looked at. Linked directories are left out."""
    found = []
    with os.scandir(path) as entries:
        for e in entries:
            is_dir = e.is_dir()
            if is_dir and e.is_symlink():
                continue
            try:
                stat = e.stat()
                found.append((e.name, is_dir, stat.st_size, stat.st_mtime_ns // 1_000_000))
            except OSError:
                found.append((e.name, False, None, None))
    return found


def _list_remote(path: str) -> list[tuple]:
    files, bare = arrow_fs.FileSystem.from_uri(path)
    found = files.get_file_info(arrow_fs.FileSelector(bare))
    return [(f.base_name, f.type == arrow_fs.FileType.Directory, f.size, None if f.mtime_ns is None else f.mtime_ns // 1_000_000) for f in found]


def _stat(root: str) -> tuple[bool, int | None, int | None] | None:
    """``(is_dir, size, ms)`` of a root, None if there is no such path."""
    if "://" in root:
        files, bare = arrow_fs.FileSystem.from_uri(root)
        f = files.get_file_info(bare)
        if f.type == arrow_fs.FileType.NotFound:
            return None
        return f.type == arrow_fs.FileType.Directory, f.size, None if f.mtime_ns is None else f.mtime_ns // 1_000_000
    if not os.path.exists(root):
        return None
    stat = os.stat(root)
    return os.path.isdir(root), stat.st_size, stat.st_mtime_ns // 1_000_000


def walk_files(spark: SparkSession, roots: list[str], spec: ScanSpec = ScanSpec()) -> DataFrame:
    """Manifest of mounted directories and of URIs that Arrow reads, with hidden names included.

    One job per directory level: every task lists some directories of the level, excluded ones are
    never descended into, and each level is a table in the shared folder, so a lost executor costs
    no more than its own tasks and no branch of the tree is walked by one task alone. Times have
    milliseconds, like those of the built-in source.
    """
    excluded = set(spec.exclude_dirs)
    seeds = [(r, found) for r in roots if r and (found := _stat(r))]
    base = shared_dir(spark, "walk")

    def list_level(batches):
        for batch in batches:
            found = []
            for root, path in zip(batch["root"].to_pylist(), batch["path"].to_pylist()):
                try:
                    entries = _list_remote(path) if "://" in path else _list_local(path)
                except OSError:
                    continue
                for name, is_dir, size, ms in entries:
                    if not (is_dir and name in excluded):
                        found.append((posixpath.join(path, name), size, ms, root, is_dir))
            if found:
                paths, sizes, times, rts, dirs = zip(*found)
                yield pa.RecordBatch.from_arrays([
                    pa.array(paths, pa.string()), pa.array(sizes, pa.int64()),
                    pa.array(times, pa.timestamp("ms", tz="UTC")).cast(pa.timestamp("us", tz="UTC")), pa.array(rts, pa.string()),
                    pa.array(dirs, pa.bool_()),
                ], names=["path", "size", "mtime", "root", "is_dir"])

    rows = [(path, size, ms, posixpath.dirname(path)) for path, (is_dir, size, ms) in seeds if not is_dir]
    files = spark.createDataFrame(rows, "path string, size bigint, mtime bigint, root string").select(
        "path", "size", F.timestamp_millis("mtime").alias("mtime"), "root")
    level = spark.createDataFrame(
        [(r, i) for i, (r, (is_dir, _, _)) in enumerate(seeds) if is_dir], "path string, ord int"
    ).select("path", F.col("path").alias("root"))
    depth = 0
    while not level.isEmpty():
        out = f"{base}/level={depth}"
        level.repartition(max(spark.sparkContext.defaultParallelism, level.rdd.getNumPartitions()), "path").mapInArrow(list_level, _LISTING).write.parquet(out)
        listed = spark.read.schema(_LISTING).parquet(out)
        files = files.unionByName(listed.filter(~F.col("is_dir")).drop("is_dir"))
        level = listed.filter("is_dir").select("path", "root")
        depth += 1
    # Exclusion already happened on descent, so only name, extension and size remain.
    rest = replace(spec, exclude_dirs=())
    return filter_manifest(files, rest).select("path", "size", "mtime")


def _content(path: str) -> bytes:
    if "://" in path:
        files, bare = arrow_fs.FileSystem.from_uri(path)
        with files.open_input_file(bare) as f:
            if f.size() > MAX_BYTES:
                raise OSError(f"{f.size()} bytes")
            return f.read()
    with open(path, "rb") as f:
        if os.fstat(f.fileno()).st_size > MAX_BYTES:
            raise OSError(f"{os.fstat(f.fileno()).st_size} bytes")
        return f.read()


def read_content(manifest: DataFrame) -> DataFrame:
    """Add ``content`` to a manifest; a file that cannot be read, or not into one value, gets ``error``."""
    schema = manifest.schema.simpleString()[len("struct<"):-1].replace(":", " ")

    def load(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                try:
                    content, error = _content(row["path"][0].as_py()), None
                except OSError as e:
                    content, error = None, f"extract_error: {e}"
                yield pa.RecordBatch.from_arrays(
                    [*row.columns, pa.array([content], pa.binary()), pa.array([error], pa.string())],
                    names=[*row.schema.names, "content", "error"],
                )

    return manifest.mapInArrow(load, f"{schema}, content binary, error string")
