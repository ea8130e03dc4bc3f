"""Benchmark decontamination: q-gram counts in overlapping diagonal bands, verified by banded alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from linetrawl.llm import texts
from linetrawl.llm.common import without

Q = 8
#: A text matches an item if at most this share of the item's characters is edited.
ERROR = 0.1
#: Items are searched for in blocks of about this many characters.
BLOCK_CHARS = 1 << 20
#: Pairs of a place in a text and one in an item that are looked at together.
PAIRS = 1 << 20
#: Of a long text so many code points are looked at together; pieces overlap by the longest match.
PIECE = 1 << 21
LEAKS = "array<struct<item_id: long, start: long, end: long, edits: int>>"
_SLOTS = 24
_SPACE = 32
_GAP = np.uint32(0xFFFFFFFF)


@dataclass
class Items:
    """Benchmark items of one length of q-grams: normalised texts, edit budgets and a q-gram index."""

    q: int
    ids: list
    points: list[np.ndarray]
    budget: np.ndarray
    needed: np.ndarray
    shift: np.ndarray
    filled: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    count: np.ndarray
    item: np.ndarray
    place: np.ndarray
    reach: int


def _normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower case with runs of white space as one space, and where each character comes from."""
    raw = texts.points(text)
    blank = texts.spaces(raw)
    kept = np.flatnonzero(~(blank & np.concatenate([[True], blank[:-1]]))) if len(raw) else np.empty(0, np.int64)
    return np.where(blank[kept], np.uint32(_SPACE), texts.lower(raw[kept])), kept


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of each q-gram."""
    if len(points) < q:
        return np.empty(0, np.uint64)
    out, length = points.astype(np.uint64), 1
    while length < q:  # doubles the length that a hash covers, the last time with an overlap
        step = min(length, q - length)
        out = out[:-step] * np.uint64(0x9E3779B97F4A7C15) + out[step:] * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(31)
        length += step
    return out * np.uint64(0x9E3779B97F4A7C15)


def _trimmed(text: str) -> np.ndarray:
    points = _normal(text)[0]
    points = points[1:] if len(points) and points[0] == _SPACE else points
    return points[:-1] if len(points) and points[-1] == _SPACE else points


def index(ids: list, item_texts: list[str], error: float = ERROR) -> list[Items]:
    """Items by the length of their q-grams: ``Q``, or for short items the longest with which the lemma holds for all their edits."""
    points = [_trimmed(t) for t in item_texts]
    lengths = [min(Q, len(p) // (int(len(p) * error) + 1)) for p in points]
    return [_index([i for i, n in zip(ids, lengths) if n == q], [p for p, n in zip(points, lengths) if n == q], q, error) for q in sorted({*lengths} - {0})]


def _index(ids: list, points: list[np.ndarray], q: int, error: float) -> Items:
    budget = np.array([int(len(p) * error) for p in points])
    needed = np.array([len(p) + 1 - q * (k + 1) for p, k in zip(points, budget)])
    grams = [_grams(p, q) for p in points]
    item = np.repeat(np.arange(len(points)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams])
    every = np.concatenate(grams)
    order = np.argsort(every, kind="stable")
    hashes, first, count = np.unique(every[order], return_index=True, return_counts=True)
    filled = np.zeros(1 << _SLOTS, bool)
    filled[(hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True
    shift = np.array([max(3, math.ceil(math.log2(k + 1))) for k in budget])
    return Items(q, ids, points, budget, needed, shift, filled, hashes, first, count, item[order], place[order], max(map(len, points)) + int(budget.max()))


def find_leaks(docs: DataFrame, benchmark: DataFrame, error: float = ERROR) -> DataFrame:
    """Add ``leaks`` to documents: the benchmark items (``item_id, text``) that their texts hold, with where.

    Letter case and lengths of white space do not count. An item is found where at most ``error`` of its
    characters are inserted, deleted or replaced; ``start`` and ``end`` are code points of the text, ``edits`` the
    edit distance, of the best place (ties: the first). By the q-gram lemma such a place shares
    at least ``length + 1 - Q * (edits + 1)`` q-grams with the item on neighbouring diagonals. The diagonals are cut into
    overlapping bands wide enough that one of them holds the whole place; bands with
    fewer common q-grams are dropped and the others aligned.

    Items too short for the lemma with all their edits are sought by shorter q-grams, down to single characters, under the
    same rule. White space at the ends of an item does not count; null items and those without characters are never found. A null text holds
    none. Items are unique by id and text; equal items are each reported. Other columns are kept, one named ``leaks`` is replaced.

    The benchmark is read to the driver in blocks of about ``BLOCK_CHARS`` characters, and each block is one pass
    over the documents, which are never moved. Places of a text that repeats a q-gram are counted as runs, and pairs of places
    in a text and in the items ``PAIRS`` at a time, so memory does not grow with repetition in either.
    """
    docs = without(docs, "leaks")
    found = docs.withColumn("leaks", F.array().cast(LEAKS))
    for block in _blocks(benchmark, error):
        found = found.withColumn("leaks", F.concat("leaks", _search(block)("text")))
    return found.select(*[f"`{c}`" for c in docs.columns], F.array_sort("leaks").alias("leaks"))


def _blocks(benchmark: DataFrame, error: float) -> Iterator[list[Items]]:
    rows = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().orderBy("item_id", "text")
    ids, held, size = [], [], 0
    for item_id, text in rows.toLocalIterator():
        if len(_trimmed(text)):
            ids.append(item_id)
            held.append(text)
            size += len(text)
        if size >= BLOCK_CHARS:
            yield index(ids, held, error)
            ids, held, size = [], [], 0
    if held:
        yield index(ids, held, error)


def _search(items: list[Items]):
    @pandas_udf(LEAKS)
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([x for chunk in texts.chunks(part, 2 * PIECE) for x in search_chunk(chunk, items)])

    return search


def search_chunk(chunk: list[str], items: list[Items]) -> list[list[dict]]:
    """The leaks of each text."""
    found = [_found(chunk, some) for some in items]
    return [sorted((leak for leaks in one for leak in leaks), key=lambda x: str(x["item_id"])) for one in zip(*found)] if found else [[] for _ in chunk]


def _found(chunk: list[str], items: Items) -> list[list[dict]]:
    found: list[dict[int, tuple]] = [{} for _ in chunk]
    pieces, held = [], 0
    for owner, text in enumerate(chunk):
        points, kept = _normal(text)
        step = max(PIECE, 4 * items.reach)
        for at in range(0, max(1, len(points) - items.reach), step):
            pieces.append((owner, points[at:at + step + items.reach], kept[at:at + step + items.reach]))
            held += len(pieces[-1][1])
            if held >= step:
                _search_pieces(pieces, items, found)
                pieces, held = [], 0
    if pieces:
        _search_pieces(pieces, items, found)
    return [[{"item_id": items.ids[i], "start": s, "end": e, "edits": d} for i, (d, s, e) in sorted(one.items())] for one in found]


def _search_pieces(pieces, items: Items, found) -> None:
    gap = np.full(items.reach + items.q, _GAP)
    flat = [gap]
    begins = []
    at = len(gap)
    for _, points, _ in pieces:
        begins.append(at)
        flat += [points, gap]
        at += len(points) + len(gap)
    flat, begins = np.concatenate(flat), np.array(begins)
    for item, low, high in _candidates(flat, items):
        for i, d, s, e in _align(flat, items, item, low, high):
            piece = max(0, np.searchsorted(begins, (s + e) // 2, side="right") - 1)
            owner, _, kept = pieces[piece]
            s, e = np.clip((s - begins[piece], e - 1 - begins[piece]), 0, len(kept) - 1)
            s, e = int(kept[s]), int(kept[e]) + 1
            best = found[owner].get(i)
            if best is None or (d, s, e) < best:
                found[owner][i] = (d, s, e)


def _candidates(flat: np.ndarray, items: Items):
    """Bands of diagonals with enough common q-grams: lists of items, first and last diagonal."""
    grams = _grams(flat, items.q)
    hits = np.flatnonzero(items.filled[(grams >> np.uint64(64 - _SLOTS)).view(np.int64)])
    rank = np.searchsorted(items.hashes, grams[hits])
    rank[rank == len(items.hashes)] = 0
    real = items.hashes[rank] == grams[hits]
    hits, rank = hits[real], rank[real]
    if not len(hits):
        return
    # Runs: the same q-gram at places one after the other; long ones in parts.
    start = np.flatnonzero(np.append(True, (np.diff(hits) != 1) | (np.diff(rank) != 0)))
    length = np.diff(np.append(start, len(hits)))
    most = np.clip(PAIRS * 4 // items.count[rank[start]], 1, 4096)
    parts = -(-length // most)
    run = np.repeat(np.arange(len(start)), parts)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, size = hits[start][run] + nth * most[run], np.minimum(most[run], length[run] - nth * most[run])
    rank = rank[start][run]
    load = np.cumsum(items.count[rank] * (size // 8 + 3))
    keys, shared = np.zeros(0, np.int64), np.zeros(0)
    at = 0
    while at < len(begin):
        end = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + PAIRS, "right")))
        more, counts = _shared(items, begin[at:end], size[at:end], rank[at:end])
        keys, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
        shared = np.bincount(place, np.concatenate([shared, counts]), len(keys))
        at = end
    item, band = keys >> 40, keys & ((1 << 40) - 1)
    enough = shared >= np.maximum(items.needed[item], 1)
    item, band = item[enough], band[enough]
    low = band << items.shift[item]
    yield item, low, low + (1 << items.shift[item]) + items.budget[item] - 1


def _shared(items: Items, begin, size, rank) -> tuple[np.ndarray, np.ndarray]:
    """Common q-grams of some runs by item and band.

    A run of places and one place of an item meet on as many diagonals in a row; a band counts those inside it.
    """
    count = items.count[rank]
    posting = np.repeat(items.first[rank] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    item = items.item[posting]
    low = np.repeat(begin, count) - items.place[posting]
    high = low + np.repeat(size, count) - 1
    shift = items.shift[item]
    first = np.maximum((low >> shift) - 1, 0)
    spans = (high >> shift) - first + 1
    one = np.repeat(np.arange(len(item)), spans)
    band = first[one] + np.arange(len(one)) - np.repeat(np.cumsum(spans) - spans, spans)
    item = item[one]
    left = band << shift[one]
    common = np.minimum(high[one], left + (1 << shift[one]) + items.budget[item] - 1) - np.maximum(low[one], left) + 1
    met = common > 0
    keys, place = np.unique((item[met].astype(np.int64) << 40) | band[met], return_inverse=True)
    return keys, np.bincount(place, common[met], len(keys))


def _align(flat, items: Items, item, low, high, together: int = 512):
    """Verify bands: ``(item, edits, start, end)`` of those whose best alignment keeps the budget.

    Row by row over the item's characters, with a column per diagonal; a cell holds the edits times a
    large number plus the diagonal where its alignment begins.
    """
    order = np.argsort([len(items.points[i]) for i in item], kind="stable")
    for at in range(0, len(order), together):
        now = order[at:at + together]
        many, length = item[now], np.array([len(items.points[i]) for i in item[now]])
        base, width = low[now], int((high[now] - low[now]).max()) + 1
        pattern = np.zeros((len(now), length.max()), np.uint32)
        for row, i in enumerate(many):
            pattern[row, :length[row]] = items.points[i]
        columns = np.arange(width)
        edit = np.int64(1) << 20
        closed = columns[None, :] > (high[now] - base)[:, None]
        cost = np.where(closed, edit * edit, columns[None, :]).astype(np.int64)
        best = np.full((len(now), width), edit * edit)
        padded = np.concatenate([flat, np.full(length.max() + width, _GAP)])
        for i in range(int(length.max())):
            window = padded[(base + i)[:, None] + columns]
            new = cost + np.where(window == pattern[:, i, None], 0, edit)
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + edit)
            new = np.minimum.accumulate(new - columns * edit, axis=1) + columns * edit
            new[closed] = edit * edit
            cost = new
            ended = length == i + 1
            if ended.any():
                best[ended] = cost[ended]
        column = best.argmin(1)
        value = best[np.arange(len(now)), column]
        edits = value // edit
        for row in np.flatnonzero(edits <= items.budget[many]):
            start, end = int(base[row] + value[row] % edit), int(base[row] + column[row] + length[row])
            yield int(many[row]), int(edits[row]), start, end
