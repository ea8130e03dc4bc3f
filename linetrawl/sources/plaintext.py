"""Bytes to text: binary sniffing, UTF-8 in the JVM, guessed charsets for what is left."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from linetrawl.functions.batches import sliced
from linetrawl.functions.text import line_locator, line_segments, once

# Sniffed head size and byte-order marks.
HEAD_BYTES = 8192
BOMS = ("FFFE", "FEFF", "EFBBBF")


def looks_like_text(content: Column) -> Column:
    """A byte-order mark makes it text; otherwise an empty file or a NUL in the head makes it binary."""
    head = F.substring(content, 1, HEAD_BYTES)
    has_bom = F.lit(False)
    for bom in BOMS:
        has_bom = has_bom | F.startswith(head, F.to_binary(F.lit(bom), F.lit("hex")))
    nul = F.contains(head, F.to_binary(F.lit("00"), F.lit("hex")))
    return F.coalesce((F.length(head) > 0) & (has_bom | ~nul), F.lit(False))


def decode_utf8(content: Column) -> Column:
    """Text of valid UTF-8 without its byte-order mark; NULL for anything else."""
    text = content.cast("string")
    return F.when(
        F.is_valid_utf8(text),
        F.when(text.startswith("\ufeff"), text.substr(F.lit(2), F.char_length(text))).otherwise(text),
    )


@F.arrow_udf(T.StringType())
def guess_decode(content: pa.Array) -> pa.Array:
    """Text under the most likely charset; NULL in, NULL out, and NULL where none fits."""
    from charset_normalizer import from_bytes  # a worker without it fails: another guess would be another text

    def decode(data):
        best = None if data is None else from_bytes(data).best()
        return None if best is None else str(best).encode("utf-8", "replace").decode("utf-8")

    return sliced(content, lambda some: pa.array([decode(v.as_py()) for v in some], pa.string()))


guess_decode = guess_decode.asNondeterministic()  # evaluated once, never copied into a filter


def decode_text(files: DataFrame, keep: list[str], guess: bool = True) -> DataFrame:
    """``keep`` columns plus ``text``, NULL for binary content.

    Only content that is text but not UTF-8 is handed to the Python worker; every other row sends
    NULL there.
    """
    files = files.select(
        *keep,
        F.when(looks_like_text(F.col("content")), decode_utf8(F.col("content"))).alias("text"),
        F.when(looks_like_text(F.col("content")) & ~F.is_valid_utf8(F.col("content").cast("string")),
               F.col("content")).alias("_odd"),
    )
    if guess:
        files = files.withColumn("text", F.coalesce("text", guess_decode("_odd")))
    return files.drop("_odd")


def text_segments(texts: DataFrame) -> DataFrame:
    """``(path, idx, line_no, locator, text)`` of ``(path, text)``: one row per non-blank line."""
    lines = texts.select("path", once(line_segments(F.col("text"))).alias("segs"))
    return lines.select("path", F.explode("segs").alias("s")).select(
        "path", F.col("s.seg_idx").alias("idx"), F.col("s.line_no").cast("bigint").alias("line_no"),
        line_locator(F.col("s.line_no")).alias("locator"), F.col("s.text").alias("text"),
    )
