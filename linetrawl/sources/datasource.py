"""Directory trees as a Spark data source: filters decide before a file is opened, directories are walked by many tasks.

``register(spark)`` makes ``spark.read.format("linetrawl_files")`` known; ``readStream`` gives a listing at every trigger. Its columns are ``path, name, ext, size, mtime, content,
error``; a schema given to the reader chooses among them, and content is only read where it is chosen.
"""

from __future__ import annotations

import json
import operator
import os
import posixpath
import time
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import datasource as ds

from linetrawl.functions.paths import glob_to_regex
from linetrawl.sources.files import _content, _list_local, _list_remote, _stat
from linetrawl.spec import ScanSpec

NAME = "linetrawl_files"
COLUMNS = {
    "path": ("string", pa.string()), "name": ("string", pa.string()), "ext": ("string", pa.string()), "size": ("bigint", pa.int64()),
    "mtime": ("timestamp", pa.timestamp("us", tz="UTC")), "content": ("binary", pa.binary()), "error": ("string", pa.string()),
}
#: The driver lists at most this many directories to plan tasks; everything below is left to the tasks.
PLAN_DIRS = 256
#: A directory that planning has listed is cut into tasks of about this many files, or bytes where content is chosen.
TASK_FILES, TASK_BYTES = 20_000, 256 << 20
#: A batch of rows ends at so many rows or bytes of content.
BATCH_ROWS, BATCH_BYTES = 4096, 32 << 20

Test = Callable[[dict], bool]
_ORDER = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}
_TEXT = {ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: str.__contains__}


def _test(f: ds.Filter) -> Test | None:
    """A pushed filter as a test of what a listing tells of a file; None if it has to be left to Spark.

    A comparison with null is not true, nor is its negation.
    """
    if isinstance(f, ds.Not):
        inner = _test(f.child)
        column = getattr(f.child, "attribute", ())
        if inner is None or isinstance(f.child, ds.IsNotNull | ds.IsNull | ds.Not | ds.EqualNullSafe):
            return None
        return lambda file: file[column[0]] is not None and not inner(file)
    column = getattr(f, "attribute", ())
    if len(column) != 1 or column[0] not in ("path", "name", "ext", "size", "mtime"):
        return None
    key = column[0]
    if isinstance(f, ds.IsNotNull):
        return lambda file: file[key] is not None
    if isinstance(f, ds.In):
        values = frozenset(v for v in f.value if v is not None)
        return lambda file: file[key] is not None and file[key] in values
    compare = _ORDER.get(type(f)) or _TEXT.get(type(f))
    if compare is None or f.value is None or (key == "mtime" and getattr(f.value, "tzinfo", None) is None):
        return None
    value = f.value
    return lambda file: file[key] is not None and compare(file[key], value)


class _Reader(ds.DataSourceReader):
    def __init__(self, roots: list[str], exclude_dirs: list[str], plan_dirs: int, columns: list[str]):
        self.roots, self.excluded, self.plan_dirs, self.columns = roots, frozenset(exclude_dirs), plan_dirs, columns
        self.tests: list[Test] = []
        self.prefixes: list[str] = []

    def pushFilters(self, filters):
        for f in filters:
            test = _test(f)
            if test is None:
                yield f
                continue
            self.tests.append(test)
            if isinstance(f, ds.StringStartsWith | ds.EqualTo) and f.attribute == ("path",):
                self.prefixes.append(f.value)

    def _entries(self, folder: str) -> tuple[list[str], list[tuple]]:
        """Directories to go down to, and files; a directory that cannot be listed holds nothing."""
        try:
            entries = _list_remote(folder) if "://" in folder else _list_local(folder)
        except OSError:
            return [], []
        folders = [posixpath.join(folder, name) for name, is_dir, *_ in entries if is_dir and name not in self.excluded]
        # A prefix of paths is met below a folder only if one begins like the other.
        folders = [d for d in folders if all(p.startswith(d + "/") or (d + "/").startswith(p) for p in self.prefixes)]
        return folders, [(posixpath.join(folder, name), size, ms) for name, is_dir, size, ms in entries if not is_dir]

    def partitions(self):
        """Tasks from the first levels of the tree: some directories whole, and those already gone through without what is below."""
        whole, alone = [], []
        for root in self.roots:
            found = _stat(root) if root else None
            if found:
                (whole.append(root) if found[0] else alone.append((root, False, 0, 1)))
        while whole and len(whole) + len(alone) < self.plan_dirs:
            folder = whole.pop(0)
            below, files = self._entries(folder)
            whole += below
            size = sum(size or 0 for _, size, _ in files) if "content" in self.columns else 0
            parts = 1 + max(len(files) // TASK_FILES, size // TASK_BYTES)
            alone += [(folder, False, i, parts) for i in range(parts if files else 0)]
        return [ds.InputPartition(value) for value in [(folder, True, 0, 1) for folder in whole] + alone]

    def _files(self, folder: str, deep: bool, part: int, parts: int) -> Iterator[dict]:
        found = None if deep else _stat(folder)
        if found and not found[0]:
            yield from self._kept([(folder, *found[1:])])
            return
        waiting = [folder]
        while waiting:
            below, files = self._entries(waiting.pop())
            waiting += below if deep else []
            yield from self._kept(f for f in files if parts == 1 or zlib.crc32(os.fsencode(f[0])) % parts == part)

    def _kept(self, files) -> Iterator[dict]:
        for path, size, ms in files:
            name = posixpath.basename(path)
            mtime = None if ms is None else datetime.fromtimestamp(ms // 1000, timezone.utc).replace(microsecond=ms % 1000 * 1000)
            file = {"path": path, "name": name, "ext": os.path.splitext(name)[1].lower(), "size": size, "mtime": mtime}
            if all(test(file) for test in self.tests):
                yield file

    def read(self, partition):
        if partition is None:  # what Spark makes of no partitions at all
            return
        rows, held = [], 0
        for file in self._files(*partition.value):
            if "content" in self.columns or "error" in self.columns:
                try:
                    file |= {"content": _content(file["path"]), "error": None}
                except OSError as e:
                    file |= {"content": None, "error": f"extract_error: {e}"}
                held += len(file["content"] or b"")
            rows.append(file)
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], COLUMNS[c][1]) for c in self.columns], names=self.columns)


class _Listings(ds.DataSourceStreamReader):
    """Every trigger gives the whole listing as it is then, walked by tasks as in a batch.

    An offset only says when: listings are not kept, so a batch that is replayed lists anew. Whoever reads them
    compares with what it knows, and then a replay finds nothing left to do.
    """

    def __init__(self, reader: _Reader):
        self.reader = reader

    def initialOffset(self):
        return {"listed_at": 0}

    def latestOffset(self):
        return {"listed_at": time.time_ns()}

    def partitions(self, start, end):
        return [] if start == end else self.reader.partitions()

    def read(self, partition):
        return self.reader.read(partition)


class FilesSource(ds.DataSource):
    """Options: ``paths`` (a JSON list of roots) or ``path``; ``exclude_dirs`` (a JSON list of names that are not entered);
    ``plan_dirs``. Roots that do not exist hold nothing; overlapping ones give duplicates."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return ", ".join(f"{name} {kind}" for name, (kind, _) in COLUMNS.items())

    def streamReader(self, schema):
        return _Listings(self.reader(schema))

    def reader(self, schema):
        unknown = set(schema.names) - set(COLUMNS)
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        roots = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return _Reader(roots, json.loads(self.options.get("exclude_dirs", "[]")), int(self.options.get("plan_dirs", PLAN_DIRS)), schema.names)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilesSource)


def source_files(spark: SparkSession, roots: list[str], spec: ScanSpec = ScanSpec(), columns: tuple[str, ...] = ("path", "size", "mtime")) -> DataFrame:
    """The files that ``spec`` lets pass, as ``walk_files`` lists them, with any of the source's columns.

    Names, extensions and sizes are plain predicates on columns of the source, which takes them over; only globs with anything but one
    star at an end stay with Spark. Excluded directories are never entered.
    """
    register(spark)
    needed = [c for c in COLUMNS if c in {*columns, "name", "ext", "size"}]
    files = (
        spark.read.format(NAME).schema(", ".join(f"{c} {COLUMNS[c][0]}" for c in needed))
        .option("paths", json.dumps([r for r in roots if r])).option("exclude_dirs", json.dumps(list(spec.exclude_dirs))).load()
    )
    name = F.col("name")
    if spec.extension_filter is not None:
        files = files.filter(F.col("ext").isin(spec.extension_filter))
    for pattern in spec.exclude_patterns:
        literal = pattern.strip("*")
        if any(c in literal for c in "*?[") or pattern.count("*") > 1 or not literal:
            files = files.filter(~name.rlike(glob_to_regex(pattern)))
        elif pattern == literal:
            files = files.filter(name != literal)
        else:
            files = files.filter(~(name.startswith(literal) if pattern.endswith("*") else name.endswith(literal)))
    if spec.manifest_name:
        files = files.filter(name != spec.manifest_name)
    if spec.max_size_mb:
        files = files.filter(F.col("size") <= spec.max_size_mb * 1024 * 1024)
    return files.select(*columns)


def listings(spark: SparkSession, roots: list[str], spec: ScanSpec = ScanSpec()) -> DataFrame:
    """Stream of ``(path, size, mtime)``: at every trigger all files below ``roots``, whether they are new or not."""
    register(spark)
    return (
        spark.readStream.format(NAME).schema("path string, size bigint, mtime timestamp")
        .option("paths", json.dumps([r for r in roots if r])).option("exclude_dirs", json.dumps(list(spec.exclude_dirs))).load()
    )
