"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from linetrawl.llm import texts
from linetrawl.llm.common import NULL_ID, groups, merged, stored
from linetrawl.llm.components import components

NGRAM, THRESHOLD = 5, 0.8
#: Chance that a pair at the threshold shares a band, and how many minima a document may have.
RECALL, HASHES = 0.9999, 128
#: Documents are compared in blocks of about this many at most, fewer if their sets are larger than ``SET`` on average.
BLOCK, SET = 2048, 512
_P = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands reach the recall at the threshold."""
    for rows in range(hashes, 0, -1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold ** rows)))) if threshold < 1 else 1
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("the recall needs more hashes")


class _Words(dict):
    """Hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def ngram_set(text: str, words: _Words, n: int = NGRAM) -> np.ndarray:
    """Sorted hashes of the runs of ``n`` lower-case words; a shorter text is one run, one without words has none."""
    found = text.lower().encode("utf-8", "surrogatepass").split()
    hashes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    if not len(hashes):
        return hashes
    width = min(n, len(hashes))
    runs = np.full(len(hashes) - width + 1, width, np.uint64)
    for i in range(width):
        runs = (runs ^ hashes[i:len(hashes) - width + 1 + i]) * _P
        runs ^= runs >> np.uint64(32)
    return np.unique(runs)


def _signatures(sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over each (filled) set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(factors)), np.uint64)
    for i, factor in enumerate(factors):
        out[:, i] = np.minimum.reduceat(flat * factor, starts)
    return out


def _features(bands: int, rows: int):
    factors = np.random.default_rng(11).integers(0, 2 ** 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            at = 0
            ids, text_keys = batch.column(0), batch.column(2)
            for chunk in texts.chunks((t.as_py() for t in batch.column(1))):
                sets = [ngram_set(t, words) for t in chunk]
                filled = [s for s in sets if len(s)]
                keys = np.zeros((len(filled), bands), np.uint64)
                if filled:
                    minima = _signatures(filled, factors).reshape(len(filled), bands, rows)
                    for r in range(rows):
                        keys = (keys ^ minima[:, :, r]) * _P
                        keys ^= keys >> np.uint64(29)
                    keys = keys * _P + np.arange(bands, dtype=np.uint64)
                whole = np.array([len(s) > 0 for s in sets])
                offsets = np.concatenate([[0], np.cumsum(whole * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(chunk)), text_keys.slice(at, len(chunk)),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).reshape(-1))),
                ], names=["doc_id", "text_key", "set_key", "n", "bands"])
                at += len(chunk)

    return run


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, text_key``: id and digest of the text name a row, up to repeated ones, also where ids are null or occur twice."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _text_key(text).alias("text_key"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, keys: bool = False) -> DataFrame:
    """``doc_id, class_id, n_links`` for every row of ``doc_id, text``; with ``keys`` also ``text_key`` and ``root``, which
    tell classes apart whose ids do not.

    Two documents are linked if the Jaccard similarity of their sets of five-word runs (lower case,
    white space between words does not count) is ``threshold`` or more. A class is what links connect, named by its least
    doc_id; ``n_links`` counts the other rows a row is linked to. A text of fewer words is one run; null
    texts and texts without words have no links and are classes of their own. Rows of a null id count as
    documents, but name a class only if it has no other; repeated rows are linked like any copies. An empty table gives no rows.

    Equal sets become one node with a number of copies. Nodes shuffle on their band hashes, and each bucket names
    its least node; what these names connect is a candidate group, which holds every pair that shares a band. A group of up to a
    block is compared as a whole. In a larger one, either its buckets are compared, each pair in the first band that it shares, or the
    whole group, whichever copies fewer sets: chained documents share few buckets, near copies almost all. Both go
    in blocks ordered by size of set, and blocks whose sizes exclude the threshold never meet. Full sets are compared inside
    tasks; only a row per node and pair of blocks leaves them, with a sum and one link of a spanning forest. So
    near copies never become rows of pairs. The work still grows with the square of a group of near copies, whose links it counts.
    """
    ids = _keyed(docs)
    features = stored(ids.mapInArrow(_features(*banding(threshold, recall)), "doc_id long, text_key binary, set_key binary, n int, bands array<long>"), "features")
    nodes = features.filter("set_key IS NOT NULL").groupBy("set_key").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.min(_row()).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    entries = nodes.select("node", F.explode("bands").alias("band"))
    leaders = entries.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("m")).filter("m > 1").drop("m")
    stars = merged(entries, leaders, "band").filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    groups_ = components(stars)
    compared = stored(_compared(_units(groups_, entries, nodes, threshold), _sets(ids, nodes, groups_), threshold), "compared")
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(compared.select(F.col("node").alias("a"), F.col("linked").alias("b")))
    placed = stored(
        merged(merged(nodes.select("node", "set_key", "copies", "first"), links, "node", "left"), classes, "node", "left").select(
            "set_key", F.coalesce("root", "node").alias("root"), "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "placed")
    placed = merged(placed, placed.groupBy("root").agg(F.min("first").alias("class_id")), "root").select("set_key", "class_id", "n_links", *(["root"] if keys else []))
    more = ["text_key", "root"] if keys else []
    met = merged(features.select("doc_id", "text_key", "set_key"), placed, "set_key").select("doc_id", "class_id", "n_links", *more)
    lone = features.filter("set_key IS NULL").select(  # never joined, so they are no hot key
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "text_key", F.lit(None).cast("long").alias("root"))
    return met.unionByName(lone.select("doc_id", "class_id", "n_links", *more))


def _row() -> Column:
    """What orders rows: the id, null last, then the text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"), "text_key")


def _sets(ids: DataFrame, nodes: DataFrame, groups_: DataFrame) -> DataFrame:
    """``node, copies, grams`` of every node in a group, from one of its documents, met by id and text."""
    wanted = merged(groups_.select("node"), nodes.select("node", "copies", "row.key", "row.text_key"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sets = [ngram_set(t.as_py() or "", words).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["node", "copies", "grams"])

    found = merged(ids.withColumn("key", F.coalesce("doc_id", F.lit(NULL_ID))), wanted, ["key", "text_key"]).select("node", "copies", "text")
    return stored(found.dropDuplicates(["node"]).mapInArrow(run, "node long, copies long, grams binary"), "sets")


def _units(groups_: DataFrame, entries: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``unit, low, high, block, node, bands`` for every node and pair of blocks to compare it in; a unit without bands is a group."""
    # at most one node in BLOCK names a large group, so these names are broadcast, and no group is a hot key
    large = stored(groups_.groupBy("root").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK), "large")
    members = merged(entries, groups_.join(F.broadcast(large.select("root")), "root"), "node")
    buckets = stored(members.groupBy("root", "band").agg(F.count("*").alias("shared")).filter("shared > 1"), "buckets")
    copied = buckets.groupBy("root").agg(F.sum(F.col("shared") * F.ceil(F.col("shared") / BLOCK)).alias("copied"))
    chained = copied.join(F.broadcast(large), "root").filter(F.col("copied") < F.col("m") * F.ceil(F.col("m") / BLOCK)).select("root")
    whole = groups_.join(F.broadcast(chained), "root", "left_anti").select(F.col("root").alias("unit"), "node", F.lit(False).alias("by_band"))
    parted = merged(members.join(F.broadcast(chained), "root", "left_semi"), buckets.select("root", "band"), ["root", "band"])
    sized = nodes.select("node", "n", "bands")
    placed = whole.union(parted.select(F.col("band").alias("unit"), "node", F.lit(True).alias("by_band")))
    rows = stored(merged(placed, sized, "node").select(
        "by_band", "unit", "node", "n", F.when(F.col("by_band"), F.col("bands")).alias("bands")), "units")
    unit = ["by_band", "unit"]
    before = Window.partitionBy(*unit).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    cost = F.greatest("n", F.lit(SET)).cast("long")
    sizes = rows.groupBy(*unit, "n").agg(F.count("*").alias("m")).withColumn("start", F.coalesce(F.sum(cost * F.col("m")).over(before), F.lit(0)))
    within = F.pmod(F.xxhash64("node"), F.col("m")) * cost  # sets of a size are dealt by hash: no unit is sorted
    rows = merged(rows, sizes, [*unit, "n"]).withColumn("block", F.floor((F.col("start") + within) / (BLOCK * SET)))
    blocks = rows.groupBy(*unit, "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = blocks.select(*unit, *[F.col(c).alias(f"other_{c}") for c in ("block", "least", "most")])
    near = merged(blocks, other, unit).filter(F.greatest("least", "other_least") <= F.least("most", "other_most") / threshold * (1 + 1e-9))
    pairs = near.select(*unit, "block", F.least("block", "other_block").alias("low"), F.greatest("block", "other_block").alias("high"))
    return merged(rows, pairs, [*unit, "block"]).select(*unit, "low", "high", "block", "node", "bands")


def _compared(units: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``node, links, linked`` per node and pair of blocks: copies it is linked to, and a node that links lead to."""
    members = merged(units, sets, "node").select("by_band", "unit", "low", "high", "block", "node", "copies", "grams", "bands")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (by_band, unit, low, high), rows in groups(batches, 4):
            block, nodes, copies = (np.array(rows[i]) for i in (4, 5, 6))
            earlier = None
            if by_band:
                bands = np.array(rows[8], np.int64)
                earlier = bands[:, :int(np.flatnonzero(bands[0] == unit)[0])]
            links, linked = count_links([np.frombuffer(g, np.uint64) for g in rows[7]], copies, block if low != high else None, threshold, earlier)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(links, pa.int64()), pa.array(nodes[linked], pa.int64())], names=["node", "links", "linked"])

    keys = ["by_band", "unit", "low", "high"]
    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "node long, links long, linked long")


def count_links(sets: list[np.ndarray], copies: np.ndarray, block: np.ndarray | None, threshold: float, earlier: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Copies that each set is linked to, among all or between two blocks only, and a member of its component.

    Pairs that agree in a column of ``earlier`` do not count.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes, weights = np.array([len(sets[i]) for i in order]), copies[order]
    side = None if block is None else block[order]
    earlier = None if earlier is None or not earlier.shape[1] else earlier[order]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, names = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    marked = np.zeros(names.max() + 1, np.int64)
    links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))
    for i in range(len(sets) - 1):
        end = np.searchsorted(sizes, sizes[i] / threshold * (1 + 1e-9), side="right")
        if end <= i + 1:
            continue
        mine = names[starts[i]:starts[i + 1]]
        marked[mine] = 1
        shared = np.add.reduceat(marked[names[starts[i + 1]:starts[end]]], starts[i + 1:end] - starts[i + 1])
        marked[mine] = 0
        similar = shared / (sizes[i] + sizes[i + 1:end] - shared) >= threshold
        if side is not None:
            similar &= side[i + 1:end] != side[i]
        similar = i + 1 + np.flatnonzero(similar)
        if earlier is not None and len(similar):
            similar = similar[~(earlier[similar] == earlier[i]).any(1)]
        if len(similar):
            links[order[i]] += weights[similar].sum()
            links[order[similar]] += weights[i]
            met = np.unique(root[np.append(similar, i)])
            root[np.isin(root, met)] = met[0]
    linked = np.empty(len(sets), np.int64)
    linked[order] = order[root]
    return links, linked


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Exactly one row of each class, all columns kept: that of the least id, null last; of repeated rows any one.

    ``classes`` are the near duplicates of ``docs`` with their ``keys``. Rows in no class of others, those without words, all stay.
    """
    alone = classes.filter("root IS NULL").select(_row().alias("row"))
    first = classes.filter("root IS NOT NULL").groupBy("root").agg(F.min(_row()).alias("row"))
    lone = alone.select("row.key", "row.text_key").distinct().withColumn("__lone", F.lit(True))
    names = lone.union(first.select("row.key", "row.text_key", F.lit(False)))
    names = names.select(F.col("key").alias("__key"), F.col("text_key").alias("__text_key"), "__lone")
    columns = [f"`{c}`" for c in docs.columns]
    keyed = docs.withColumns({"__key": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "__text_key": _text_key(F.col("text").cast("string"))})
    met = merged(keyed, names, ["__key", "__text_key"]).withColumn("__lone", F.when(F.col("__lone"), F.monotonically_increasing_id()))
    return met.dropDuplicates(["__key", "__text_key", "__lone"]).select(*columns)
