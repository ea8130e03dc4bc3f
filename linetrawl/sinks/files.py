"""Rows as files: one file per row, written by the tasks."""

from __future__ import annotations

import os
import posixpath
import uuid

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, functions as F


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Write ``content`` of every row to ``root`` + ``path``; returns ``(path, size)`` of what was written, and runs when read.

    A file appears under its name only when it is complete, so a repeated task does no harm. ``root`` is a folder or
    URI that every executor reaches; two rows of one path are a race between them.
    """
    root = root.rstrip("/")

    def write(batches):
        target, base = arrow_fs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")
        for batch in batches:
            sizes = []
            for path, content in zip(batch["path"], batch["content"]):
                path, content = path.as_py(), content.as_py()
                place = f"{base}/{path.lstrip('/')}"
                folder, name = posixpath.split(place)
                target.create_dir(folder, recursive=True)
                part = f"{folder}/.{uuid.uuid4().hex}.part"
                with target.open_output_stream(part) as out:
                    out.write(content or b"")
                target.move(part, place)
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(sizes, pa.int64())], names=["path", "size"])

    return rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(write, "path string, size bigint")
