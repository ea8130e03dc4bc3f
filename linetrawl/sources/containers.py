"""Workbooks by their parts: a container's directory is read by range, then each sheet or object part is a row for some task."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linetrawl.functions.batches import SLICE_BYTES
from linetrawl.sources import packages
from linetrawl.sources.splits import _open
from linetrawl.workspace import shared_dir

#: Compressed bytes of parts that a task takes, about.
TASK_BYTES = 16 << 20
_UNITS = pa.schema([("path", pa.string()), ("unit", pa.int32()), ("kind", pa.string()), ("part", pa.string()), ("sheet", pa.string()), ("bytes", pa.int64())])
_UNIT_SCHEMA = "path string, unit int, kind string, part string, sheet string, bytes bigint"


class _Book:
    """What all parts of one workbook share, each read once, when it is first needed."""

    def __init__(self, path: str):
        self.path, self.file = path, _open(path)
        self.zip = zipfile.ZipFile(self.file)  # seeks to the directory at the end
        self.actual = {n.lower(): n for n in self.zip.namelist()}
        self._held: dict = {}

    def once(self, name: str, make):
        if name not in self._held:
            self._held[name] = make()
        return self._held[name]

    def close(self):
        self.zip.close()
        self.file.close()

    def sheets(self):
        return self.once("sheets", lambda: packages._sheets(self.zip))

    def links(self):
        return self.once("links", lambda: [
            {"sheet": name, "base": part, "target": target, "type": kind}
            for name, part in self.sheets() for _, kind, target in packages._rels(self.zip, part)])

    def people(self):
        return self.once("people", lambda: list(packages.people(self.zip, self.actual).items()))

    def units(self) -> Iterator[dict]:
        """Sheets in the order of the book, then the object parts in the order of the archive."""
        found = [(name, self.actual[part]) for name, part in self.sheets() if part in self.actual]
        for name, entry in found:
            yield {"kind": "sheet", "part": entry, "sheet": name, "bytes": self.zip.getinfo(entry).compress_size}
        for entry in self.zip.namelist():
            if packages.object_kind(entry):
                yield {"kind": "object", "part": entry, "sheet": None, "bytes": self.zip.getinfo(entry).compress_size}

    def rows(self, unit: int, kind: str, part: str, sheet: str | None) -> Iterator[dict]:
        """Part rows of a unit. A drawing gives two lists of items, so each unit has two numbers."""
        if kind == "sheet":
            shared = self.once("cells", lambda: (
                packages._strings(self.zip, self.actual), packages._date_styles(self.zip, self.actual), packages._epoch(self.zip)))
            yield {"part_ord": 2 * unit, "part": part.lower(), "kind": "sheet", "sheet": sheet, "row": 0}
            with self.zip.open(part) as stream:
                for row, items in packages._sheet_rows(stream, *shared):
                    yield {"part_ord": 2 * unit, "part": part.lower(), "kind": "row", "sheet": sheet, "row": row, "items": items}
            return
        for i, (name, items, authors) in enumerate(packages._object_items(self.zip, part)):
            yield {"part_ord": 2 * unit + i, "part": part, "kind": name, "row": 0, "items": items, "links": self.links(), "people": self.people(), "authors": authors}


def list_units(manifest: DataFrame) -> DataFrame:
    """``(path, unit, kind, part, sheet, bytes)``: sheets and object parts of the workbooks of a manifest.

    Only the directory of a container, its book and its relations are read. A container that cannot be opened has no units.
    """
    def run(batches):
        for batch in batches:
            rows = []
            for path in batch["path"].to_pylist():
                try:
                    book = _Book(path)
                    rows += [{"path": path, "unit": n, **unit} for n, unit in enumerate(book.units())]
                    book.close()
                except Exception:  # any malformed container is data, not a task failure
                    continue
            yield pa.RecordBatch.from_pylist(rows, schema=_UNITS)

    cores = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.select("path").repartition(max(cores, manifest.rdd.getNumPartitions())).mapInArrow(run, _UNIT_SCHEMA)


def workbook_parts(manifest: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Part rows like those of ``xlsx_parts``, of workbooks of any size, read part by part.

    The units are a table in the shared folder, dealt in the order of path and unit: small books stay with one
    task, the sheets of a large one go to many. A task seeks to the parts it owns and streams them; of a book it
    holds the shared strings, once. A damaged part, or one whose shared strings are damaged, gives the rows before the damage and hides no other.
    """
    spark = manifest.sparkSession
    out = shared_dir(spark, "units")
    list_units(manifest).write.parquet(out)
    units = spark.read.schema(_UNIT_SCHEMA).parquet(out)
    total, count = units.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(count, max(spark.sparkContext.defaultParallelism, total // task_bytes + 1)))

    def run(batches):
        rows, held, book = [], 0, None
        for batch in batches:
            for unit in batch.to_pylist():
                try:
                    if book is None or book.path != unit["path"]:
                        if book is not None:
                            book.close()
                        book = _Book(unit["path"])
                    for row in book.rows(unit["unit"], unit["kind"], unit["part"], unit["sheet"]):
                        rows.append({**row, "path": unit["path"]})
                        held += packages.weight(row)
                        if len(rows) >= packages._BATCH_ROWS or held >= SLICE_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=packages._ARROW)
                            rows, held = [], 0
                except Exception:  # as above: what is left of the part is unreadable
                    continue
        if book is not None:
            book.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=packages._ARROW)

    dealt = units.repartitionByRange(tasks, "path", "unit").sortWithinPartitions("path", "unit")
    return dealt.mapInArrow(run, packages.PART_SCHEMA)
