"""Text files of any size: byte ranges read by many tasks, repaired at line ends, numbered by prefix sums."""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, Window, functions as F

from linetrawl.functions.batches import SLICE_BYTES
from linetrawl.functions.text import is_blank, line_locator, line_segments, once, split_lines
from linetrawl.sources.files import MAX_BYTES, read_content
from linetrawl.sources.plaintext import HEAD_BYTES, decode_text, looks_like_text, text_segments
from linetrawl.workspace import shared_dir

#: Bytes of a split.
SPLIT_BYTES = 64 << 20
_BLOCK = 1 << 20
_SPLIT = "path string, size bigint, split bigint, start bigint, stop bigint"


def plan_splits(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(path, size, split, start, stop)``: the byte ranges of the files of a manifest, dealt evenly over tasks.

    A file of many splits is read by many tasks. The number of tasks follows from the number of splits, which one
    aggregate over the manifest tells, and is given explicitly, since the rows say nothing about the bytes behind them.
    """
    last = F.greatest(F.ceil(F.col("size") / split_bytes) - 1, F.lit(0))
    cut = manifest.filter(F.col("size").isNotNull()).select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("split"))
    ranges = cut.select(
        "path", "size", "split", (F.col("split") * split_bytes).alias("start"), F.least(F.col("size"), (F.col("split") + 1) * split_bytes).alias("stop"))
    return _dealt(ranges, manifest.agg(F.sum(last + 1)).first()[0] or 0, split_bytes)


def _dealt(ranges: DataFrame, splits: int, split_bytes: int) -> DataFrame:
    """At least a task for each core while there are splits for it, and about ``SPLIT_BYTES`` for each task."""
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(max(1, min(splits, max(cores, splits * split_bytes // SPLIT_BYTES))))


def _open(path: str):
    files, bare = arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), os.path.abspath(path))
    return files.open_input_file(bare)


def _line_start(file, at: int, stop: int) -> int:
    """The first line start in ``at`` to ``stop``, or ``stop``; a line starts at 0 and behind every LF."""
    if at == 0:
        return 0
    file.seek(at - 1)
    place = at - 1
    while place < stop - 1:
        block = file.read(min(_BLOCK, stop - 1 - place))
        if not block:
            break
        found = block.find(b"\n")
        if found >= 0:
            return place + found + 1
        place += len(block)
    return stop


def _lines(file, start: int, stop: int) -> bytes:
    """The lines that start in ``start`` to ``stop``, the last one to its end."""
    begin = _line_start(file, start, stop)
    if begin >= stop:
        return b""
    file.seek(begin)
    parts, place = [], begin
    while True:
        block = file.read(_BLOCK if place >= stop - 1 else min(_BLOCK, stop - 1 - place))
        if not block:
            break
        found = block.find(b"\n") if place >= stop - 1 else -1
        parts.append(block if found < 0 else block[:found + 1])
        place += len(block)
        if found >= 0:
            break
        if place - begin > MAX_BYTES:
            raise OSError(f"a line beyond {MAX_BYTES} bytes")
    return b"".join(parts)


def read_splits(splits: DataFrame) -> DataFrame:
    """Add ``head`` (the first bytes of a file, in its first split only), ``content`` and ``error``.

    ``content`` holds the lines that start inside the split, whole: each line of a file lies in exactly one split, and
    none is cut, nor a character of it. A split inside a line is empty. A split that cannot be read has an ``error`` instead.
    """
    schema = splits.schema.simpleString()[len("struct<"):-1].replace(":", " ")

    kinds = (pa.binary(), pa.binary(), pa.string())

    def load(batches):
        for batch in batches:
            part = lambda begin, read: pa.RecordBatch.from_arrays(
                [*batch.slice(begin, len(read)).columns, *(pa.array(list(values), kind) for values, kind in zip(zip(*read), kinds))],
                names=[*batch.schema.names, "head", "content", "error"])
            begin, held, read = 0, 0, []
            for path, start, stop in zip(*(batch[c].to_pylist() for c in ("path", "start", "stop"))):
                head, content, error = None, None, None
                try:
                    with _open(path) as file:
                        head = file.read(HEAD_BYTES) if start == 0 else None
                        content = _lines(file, start, stop)
                except OSError as e:
                    error = f"extract_error: {e}"
                size = len(head or b"") + len(content or b"")
                if read and held + size > SLICE_BYTES:  # small splits are handed on together, a large one by itself
                    yield part(begin, read)
                    begin, held, read = begin + len(read), 0, []
                held += size
                read.append((head, content, error))
            if read:
                yield part(begin, read)

    return splits.mapInArrow(load, f"{schema}, head binary, content binary, error string")


def _text(content: Column, split: Column) -> Column:
    """A split as text; the byte-order mark at the start of the file is none of it."""
    text = content.cast("string")
    marked = (split == 0) & text.startswith("\ufeff")
    return F.when(F.is_valid_utf8(text), F.when(marked, text.substr(F.lit(2), F.char_length(text))).otherwise(text))


def count_splits(splits: DataFrame) -> DataFrame:
    """``splits`` with ``lines_before, segments_before`` and what became of the whole file: ``error``, ``is_text``, ``is_utf8``.

    First of the two passes over the files: lines are counted in every split, and a running sum over the few rows of a file, one
    per split, numbers the first line of each. The counts are a table in the shared folder.
    """
    read = read_splits(splits).withColumn("text", _text(F.col("content"), F.col("split")))
    lines = read.select(
        *splits.columns, "error", F.when(F.col("split") == 0, looks_like_text(F.col("head"))).alias("is_text"),
        (F.col("text").isNotNull() | F.col("content").isNull()).alias("is_utf8"), once(split_lines(F.coalesce("text", F.lit("")))).alias("lines"))
    # Every split but the last one of a file ends with LF, behind which there is one more, empty, piece.
    counted = lines.select(
        *splits.columns, "error", "is_text", "is_utf8", (F.size("lines") - 1).cast("bigint").alias("lines"),
        F.size(F.filter("lines", lambda line: ~is_blank(line))).cast("bigint").alias("segments"))
    out = shared_dir(splits.sparkSession, "split-counts")
    counted.write.parquet(out)
    counted = splits.sparkSession.read.schema(counted.schema).parquet(out)
    file = Window.partitionBy("path")
    earlier = file.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda name: F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_before")
    return counted.select(
        *splits.columns, before("lines"), before("segments"), F.min("error").over(file).alias("error"),
        F.coalesce(F.bool_or("is_text").over(file), F.lit(False)).alias("is_text"), F.bool_and("is_utf8").over(file).alias("is_utf8"),
        F.sum("segments").over(file).alias("segments"))


def split_segments(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(segments, files)`` of text files of any size.

    ``segments`` are those that ``text_segments`` makes of whole files: ``(path, idx, line_no, locator, text)`` of every non-blank
    line; ``files`` has one row per path, ``(path, error, is_text)``, where a file without any segment counts as no text. Files are read twice, to count and to cut, and the text
    of a segment is never shuffled: what a split has to add to its line numbers comes with it before it is read.

    Ranges are cut at LF, which is inside no UTF-8 character; all other line breaks count within a line of a split. A file that is
    text but not UTF-8 is decoded as a whole, up to the size of a value; a larger one gets an ``error``.
    """
    counts = count_splits(plan_splits(manifest.select("path", "size"), split_bytes))
    out = shared_dir(manifest.sparkSession, "splits")
    counts.write.parquet(out)
    counts = manifest.sparkSession.read.schema(counts.schema).parquet(out)
    files = counts.filter("split = 0")
    odd = files.filter("error IS NULL AND is_text AND NOT is_utf8").select("path", "size")
    whole = read_content(odd.filter(F.col("size") <= MAX_BYTES))
    plain = counts.filter("error IS NULL AND is_text AND is_utf8")
    kept = ["path", "size", "split", "start", "stop", "lines_before", "segments_before"]
    read = read_splits(_dealt(plain.select(*kept), plain.count(), split_bytes))
    cut = read.select(
        "path", "lines_before", "segments_before", once(line_segments(_text(F.col("content"), F.col("split")))).alias("segs"))
    line = F.col("s.line_no") + F.col("lines_before")
    numbered = cut.select("path", "lines_before", "segments_before", F.explode("segs").alias("s")).select(
        "path", (F.col("s.seg_idx") + F.col("segments_before")).cast("bigint").alias("idx"), line.cast("bigint").alias("line_no"),
        line_locator(line).alias("locator"), F.col("s.text").alias("text"))
    decoded = text_segments(decode_text(whole, ["path"])).withColumn("idx", F.col("idx").cast("bigint"))
    large = F.when(F.col("is_text") & ~F.col("is_utf8") & (F.col("size") > MAX_BYTES), F.concat(F.lit("extract_error: "), F.col("size"), F.lit(" bytes")))
    is_text = F.col("is_text") & ((F.col("segments") > 0) | ~F.col("is_utf8"))
    return numbered.unionByName(decoded), files.select("path", F.coalesce("error", large).alias("error"), is_text.alias("is_text"))
