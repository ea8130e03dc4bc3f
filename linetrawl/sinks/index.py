"""What can be left closed: groups of segments without a keyword's trigrams, generations without any of the paths asked for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linetrawl.functions.batches import cuts, row_sizes
from linetrawl.functions.text import normalize, normalize_literal
from linetrawl.spec import SearchSpec

#: Trigrams are hashed to this many bits.
BITS = 1 << 20
#: Bits of a bitmap; groups whose bits a task holds at a time, 128 KB each; characters of a text that are taken at a time.
BUCKET_BITS, HELD, WINDOW = 32768, 64, 1 << 20
_XX = tuple(map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)))
INDEX = "grp int, bucket bigint, bits binary, gen bigint"


def _places(text: Column) -> Column:
    """The bits of a text's trigrams."""
    starts = F.when(F.char_length(text) > 2, F.sequence(F.lit(1), F.char_length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.pmod(F.xxhash64(text.substr(i, F.lit(3))), F.lit(BITS)))


def trigram_bitmaps(segments: DataFrame) -> DataFrame:
    """``(grp, bucket, bits)`` of ``(grp, text)``: the trigrams of the folded texts, a bitmap for each filled bucket.

    Tasks gather the bits of whole slices of texts, so no trigram becomes a row: each hands on at most one bitmap per
    group and bucket for each ``HELD`` groups it meets, whatever its texts.
    """
    texts = segments.select("grp", normalize(F.col("text")).alias("text")).filter(F.col("text").isNotNull())
    return texts.mapInArrow(_bitmaps, "grp int, bucket bigint, bits binary").groupBy("grp", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        groups, texts = np.asarray(batch.column(0)), batch.column(1)
        for begin, end in cuts(row_sizes(texts)):
            for grp in np.unique(groups[begin:end]).tolist():
                if grp not in held and len(held) == HELD:
                    yield _filled(held)
                    held = {}
                here = np.zeros(BITS, bool)
                for trigrams in _trigrams(texts.slice(begin, end - begin).filter(pa.array(groups[begin:end] == grp)).to_pylist()):
                    here[_hashed(trigrams) & np.uint64(BITS - 1)] = True
                packed = np.packbits(here, bitorder="little")
                held[grp] = held[grp] | packed if grp in held else packed
    yield _filled(held)


def _filled(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    rows = [(grp, i + 1, bits.tobytes()) for grp, whole in held.items() for i, bits in enumerate(whole.reshape(-1, BUCKET_BITS // 8)) if bits.any()]
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()))], names=["grp", "bucket", "bits"])


def _trigrams(texts: list[str]) -> Iterator[np.ndarray]:
    """Distinct trigrams of texts, three code points of 21 bits each; long texts in windows that overlap by two."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    inside = np.ones(len(points), bool)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    for back in (1, 2):  # no trigram runs from one text into the next
        inside[ends[ends >= back] - back] = False
    for at in range(0, max(len(points) - 2, 0), WINDOW):
        window = points[at:at + WINDOW + 2].astype(np.uint64)
        packed = window[:-2] | window[1:-1] << np.uint64(21) | window[2:] << np.uint64(42)
        yield np.unique(packed[inside[at:at + len(packed)]])


def _hashed(trigrams: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of each trigram (XXH64 with seed 42 of its 3 to 12 bytes of UTF-8)."""
    points = np.column_stack([trigrams >> np.uint64(s) & np.uint64(0x1FFFFF) for s in (0, 21, 42)]).astype(np.uint32)
    flat = np.frombuffer(points.tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
    begins = np.flatnonzero(flat & 0xC0 != 0x80)[::3]
    sizes = np.diff(begins, append=len(flat))
    out = np.empty(len(trigrams), np.uint64)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        data = flat[begins[rows][:, None] + np.arange(size)]
        word = lambda a, b: (data[:, a:b].astype(np.uint64) << np.arange(0, 8 * (b - a), 8, dtype=np.uint64)).sum(1, dtype=np.uint64)
        h, at = np.full(len(rows), 42 + size, np.uint64) + _XX[4], 0
        if size >= 8:
            h, at = _turned(h ^ _turned(word(0, 8) * _XX[1], 31) * _XX[0], 27) * _XX[0] + _XX[3], 8
        if size - at >= 4:
            h, at = _turned(h ^ word(at, at + 4) * _XX[0], 23) * _XX[1] + _XX[2], at + 4
        for i in range(at, size):
            h = _turned(h ^ word(i, i + 1) * _XX[4], 11) * _XX[0]
        h = (h ^ h >> np.uint64(33)) * _XX[1]
        h = (h ^ h >> np.uint64(29)) * _XX[2]
        out[rows] = h ^ h >> np.uint64(32)
    return out


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return h << np.uint64(by) | h >> np.uint64(64 - by)


def needed_places(spark: SparkSession, spec: SearchSpec) -> list[list[int]] | None:
    """The bits of each keyword; None if the index cannot tell.

    It can for keywords of three characters or more over width-folded text. Other modes and texts as they are have no index.
    """
    if spec.mode != "keyword" or not spec.normalize_width or not spec.keywords:
        return None
    words = [normalize_literal(k, False, True) for k in spec.keywords]
    if spec.operator == "or" and any(len(w) < 3 for w in words):
        return None
    rows = spark.createDataFrame([(w,) for w in words if len(w) > 2 and "\n" not in w], "word string").select(_places(F.col("word")).alias("p")).collect()
    return [sorted(set(r.p)) for r in rows]


def matching_groups(index: DataFrame, words: list[list[int]], every: bool) -> list[tuple[int, int]]:
    """``(gen, grp)`` of the groups that can hold one of the keywords, or with ``every`` all of them.

    A keyword may be there if all its bits are set. The answer has at most a pair for each group of the store.
    """
    wanted = [(w, p // 32768 + 1, p % 32768) for w, places in enumerate(words) for p in places]
    bits = index.sparkSession.createDataFrame(wanted, "word int, bucket bigint, bit int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.pow(F.lit(2), F.col("bit") % 8).cast("int")) != 0
    met = index.join(F.broadcast(bits), "bucket").filter(is_set).groupBy("gen", "grp", "word").count()
    sizes = index.sparkSession.createDataFrame([(w, len(p)) for w, p in enumerate(words)], "word int, size bigint")
    found = met.join(F.broadcast(sizes), "word").filter("count = size").groupBy("gen", "grp").count()
    return sorted((r[0], r[1]) for r in found.filter(F.col("count") >= (len(words) if every else 1)).select("gen", "grp").collect())


# ------------------------------------------------------------------------------ paths of a generation
#: A block of a generation's filter of paths is one bitmap of this many bits, in which each path sets ``PATH_BITS``.
BLOCK_BITS = 32768
PATH_BITS = 4
#: Paths that share a block on average: 16 bits a path.
BLOCK_PATHS = BLOCK_BITS // 16
PATHS = "block bigint, bits binary, paths bigint, blocks bigint, rows bigint, gen bigint"


def _block(path: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(path), blocks)


def _bits_of(path: Column) -> Column:
    """The bits of a path in its block."""
    return F.array(*[F.pmod(F.xxhash64(path, F.lit(i)), F.lit(BLOCK_BITS)) for i in range(PATH_BITS)])


def path_filter(paths: DataFrame, rows: int) -> DataFrame:
    """A blocked Bloom filter of ``path``, one row for each filled block; ``rows`` is how many paths there are.

    A partial aggregate on the block. Each row says how many paths its block took and how many there are in all, so that a filter that
    was not written to its end is known by its sum.
    """
    blocks = max(1, rows // BLOCK_PATHS)
    placed = paths.select(_block(F.col("path"), F.lit(blocks)).alias("block"), F.explode(_bits_of(F.col("path"))).alias("bit"))
    return placed.groupBy("block").agg(
        F.bitmap_construct_agg("bit").alias("bits"), (F.count(F.lit(1)) / PATH_BITS).cast("bigint").alias("paths")
    ).select("*", F.lit(blocks).cast("bigint").alias("blocks"), F.lit(rows).cast("bigint").alias("rows"))


def generations_with(filters: DataFrame, paths: DataFrame) -> tuple[set[int], set[int]]:
    """Generations whose whole filter is there, and those of them that may hold one of ``paths``.

    ``paths`` must be few, as they go to every task; the filters stay where they are. A generation that holds a path is never left out.
    """
    whole = filters.groupBy("gen", "rows").agg(F.sum("paths").alias("paths")).filter("paths = rows").select("gen", "rows")
    indexed = {r.gen for r in whole.collect()}
    sizes = [r.blocks for r in filters.select("blocks").distinct().collect()]
    if not sizes:
        return indexed, set()
    asked = paths.select("path").distinct().select(
        F.explode(F.array(*[F.lit(n).cast("bigint") for n in sorted(sizes)])).alias("blocks"), "path"
    ).select("blocks", _block(F.col("path"), F.col("blocks")).alias("block"), _bits_of(F.col("path")).alias("asked"))
    byte = lambda b: F.conv(F.hex(F.substring("bits", F.floor(b / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = lambda b: byte(b).bitwiseAND(F.pow(F.lit(2), b % 8).cast("int")) != 0
    met = filters.join(F.broadcast(asked), ["blocks", "block"]).filter(F.forall("asked", is_set))
    return indexed, {r.gen for r in met.select("gen").distinct().collect()}
