"""Nearest neighbours by cosine: stable projections to few dimensions, kd-trees, and a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from linetrawl.llm.common import stored

#: Projected dimensions (even), points per leaf of a cell's tree, points per cell, points that shape the cells.
DIMS, LEAF, CELL, SAMPLE = 8, 128, 8192, 65536
#: Chance that a true neighbour is not passed over when the search for it stops.
CONFIDENCE = 0.97
#: Queries that meet a cell are dealt in groups of about this many.
PROBES = 4096
_HITS = "array<struct<score: double, vec_id: long, own: boolean>>"


def usable(vector: Column) -> Column:
    """Not null, with components that are all numbers and not all zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, number) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, confidence: float = CONFIDENCE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its ``k`` nearest other rows by cosine.

    ``vectors`` holds ``vec_id, embedding``. Rows whose vector is null, zero or holds a null or non-finite
    component take no part, nor rows of a null id. Vectors of different lengths have no cosine, so each length is searched by itself, one
    after the other. A query's candidates are all other rows: one that repeats it in id and vector is another row too.
    Ties go to the smaller id; with fewer than ``k`` others all are returned.

    Equal vectors become one point with its ``k`` + 1 smallest ids, which is all that a result can show.
    Points are dealt to the cells of a kd-tree over Gaussian projections of their directions (shaped by at most
    ``SAMPLE`` points; every point is indexed). Each distinct query vector searches its own cell, then those cells whose
    distance does not yet pass the test. In a cell, leaves of a kd-tree come in the order of
    their projected distance ``r``, and their points are verified until ``r*r / d*d`` reaches the ``confidence`` quantile of the chi-square
    distribution, where ``d`` is the distance of the last of the best so far.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
    found = rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    for length, in rows.filter("asks").select(F.size("embedding")).distinct().collect():
        found = found.union(_nearest(rows.filter(F.size("embedding") == length), length, k, confidence))
    return found


def _nearest(rows: DataFrame, length: int, k: int, confidence: float) -> DataFrame:
    """The search among vectors of one length."""
    same = Window.partitionBy("embedding").orderBy("vec_id")
    points = rows.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1) \
        .groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = stored(points.withColumn("uid", F.monotonically_increasing_id()), "points")
    queries = rows.filter("asks").join(points, "embedding").select(F.col("vec_id").alias("query_id"), "uid")
    queries = stored(queries.withColumn("query", F.monotonically_increasing_id()), "queries")

    space = _Space(length, _cells(points, length))
    placed = stored(points.mapInArrow(space.place, "uid long, embedding array<double>, ids array<long>, cell int"), "cells")
    asked = placed.join(queries.select("uid").distinct(), "uid", "left_semi").select("uid", "embedding", F.lit(4.0).alias("within"), "cell")
    own = stored(_probe(placed, asked, k + 1, confidence), "own")
    asked = asked.drop("within").join(own.select("uid", "within"), "uid").select("uid", "embedding", "within", "cell")
    others = stored(asked.mapInArrow(lambda b: space.others(b, confidence), "uid long, embedding array<double>, within double, cell int"), "others")
    found = own.union(_probe(placed, others, k + 1, confidence)).select("uid", F.inline("hits"))
    best = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    # A query is among the hits of its own point, unless that many others of smaller ids are: one hit of its id goes.
    met = queries.join(found, "uid").withColumn("__self", F.col("own") & (F.col("vec_id") == F.col("query_id")))
    turn = Window.partitionBy("query").orderBy(F.desc("__self"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (
        met.withColumn("r", F.row_number().over(turn)).filter(~F.col("__self") | (F.col("r") > 1)).withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def _directions(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _matrix(column, length: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, length)


def _projection(length: int) -> np.ndarray:
    return np.random.default_rng(5).standard_normal((length, DIMS))


def _cells(points: DataFrame, length: int) -> list[tuple]:
    """Inner nodes ``(dimension, cut, left, right)`` of the tree of cells; a negative child is cell ``-1 - child``."""
    sample = points.orderBy(F.xxhash64("uid")).limit(SAMPLE).select("embedding").toArrow()
    at = _directions(_matrix(sample.column(0).combine_chunks(), length)) @ _projection(length)
    depth = max(0, math.ceil(math.log2(max(1, min(points.count() / CELL, len(at) / 16)))))
    nodes: list[tuple] = []
    cells = 0

    def grow(rows, left):
        nonlocal cells
        dim = int(np.argmax(np.ptp(at[rows], axis=0))) if left else 0
        cut = float(np.median(at[rows, dim])) if left else 0.0
        below = at[rows, dim] <= cut
        if not left or below.all():
            cells += 1
            return -cells
        me = len(nodes)
        nodes.append(())
        nodes[me] = (dim, cut, grow(rows[below], left - 1), grow(rows[~below], left - 1))
        return me

    grow(np.arange(len(at)), depth)
    return nodes


class _Space:
    """The cells: which one holds a point, and which a query has to ask."""

    def __init__(self, length: int, nodes: list[tuple]):
        self.length, self.nodes = length, nodes
        boxes: dict[int, tuple] = {}
        stack = [(0 if nodes else -1, np.full(DIMS, -np.inf), np.full(DIMS, np.inf))]
        while stack:
            node, low, high = stack.pop()
            if node < 0:
                boxes[-1 - node] = (low, high)
                continue
            dim, cut, left, right = nodes[node]
            below, above = high.copy(), low.copy()
            below[dim] = above[dim] = cut
            stack += [(left, low, below), (right, above, high)]
        self.low, self.high = (np.array([boxes[c][i] for c in sorted(boxes)]) for i in (0, 1))

    def place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection = _projection(self.length)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = _directions(_matrix(batch.column("embedding"), self.length)) @ projection
            cell = np.zeros(len(at), np.int32)
            stack = [(0 if self.nodes else -1, np.arange(len(at)))]
            while stack:
                node, rows = stack.pop()
                if node < 0:
                    cell[rows] = -1 - node
                    continue
                dim, cut, left, right = self.nodes[node]
                below = at[rows, dim] <= cut
                stack += [(left, rows[below]), (right, rows[~below])]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("embedding"), batch.column("ids"), pa.array(cell)], names=["uid", "embedding", "ids", "cell"])

    def others(self, batches: Iterator[pa.RecordBatch], confidence: float) -> Iterator[pa.RecordBatch]:
        projection, most = _projection(self.length), _quantile(confidence)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = _directions(_matrix(batch.column("embedding"), self.length)) @ projection
            within, cell = np.asarray(batch.column("within")), np.asarray(batch.column("cell"))
            for start in range(0, len(at), 1024):
                some = slice(start, start + 1024)
                away = _box_distance(at[some], self.low, self.high)
                ask = away < most * within[some, None]
                ask[np.arange(len(ask)), cell[some]] = False
                rows, cells = np.nonzero(ask)
                rows = pa.array(rows + start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("uid").take(rows), batch.column("embedding").take(rows), batch.column("within").take(rows), pa.array(cells, pa.int32())],
                    names=["uid", "embedding", "within", "cell"])


def _box_distance(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(at), len(low)))
    for d in range(at.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, d] - at[:, d, None], at[:, d, None] - high[None, :, d]), 0)
        out += gap * gap
    return out


def _quantile(confidence: float) -> float:
    """Quantile of the chi-square distribution with ``DIMS`` degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(DIMS // 2))
        low, high = (x, high) if below < confidence else (low, x)
    return high


def _probe(placed: DataFrame, asked: DataFrame, k: int, confidence: float) -> DataFrame:
    """``uid, within, hits`` for each query and cell that it asks; ``within`` is the squared distance of the last hit."""
    many = {r[0]: -(-r[1] // PROBES) for r in asked.groupBy("cell").count().filter(F.col("count") > PROBES).collect()}
    parts = F.lit(1)
    for cell, n in many.items():
        parts = F.when(F.col("cell") == cell, n).otherwise(parts)
    points = placed.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    part = F.pmod(F.xxhash64("uid"), parts).cast("int").alias("part")
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns], part)  # columns of their own: both sides may stem from one table

    def run(key: tuple, points: pa.Table, queries: pa.Table) -> pa.Table:
        rows = _search_cell(points, queries, k, confidence) if points.num_rows and queries.num_rows else []
        return pa.table({
            "uid": pa.array([r[0] for r in rows], pa.int64()), "within": pa.array([r[1] for r in rows], pa.float64()),
            "hits": pa.array([r[2] for r in rows], pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64()), ("own", pa.bool_())])))})

    keys = ("cell", "part")
    return points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, f"uid long, within double, hits {_HITS}")


def _search_cell(points: pa.Table, queries: pa.Table, k: int, confidence: float) -> list[tuple]:
    matrix = lambda t: np.stack([np.asarray(x.values) for x in t.column("embedding")])
    original, asked = matrix(points), matrix(queries)
    ids, uids = points.column("ids").to_pylist(), points.column("uid").to_pylist()
    unit = _directions(original)
    projection, most = _projection(unit.shape[1]), _quantile(confidence)
    at = unit @ projection
    order, starts = _leaves(at)
    original, unit, at, ids = original[order], unit[order], at[order], [ids[i] for i in order]
    uids = [uids[i] for i in order]
    low, high = np.minimum.reduceat(at, starts), np.maximum.reduceat(at, starts)
    ends = [*starts[1:], len(order)]
    copies = np.array(list(map(len, ids)))
    scaled = original / np.abs(original).max(1, keepdims=True)
    norms = np.linalg.norm(scaled, axis=1)
    rows = []
    asked_unit = _directions(asked)
    for uid, query, direction, within in zip(queries.column("uid").to_pylist(), asked, asked_unit, queries.column("within").to_pylist()):
        away = _box_distance(direction[None] @ projection, low, high)[0]
        best_at, best = np.empty(0, np.int64), np.empty(0)
        for leaf in np.argsort(away, kind="stable"):
            if away[leaf] >= most * within:
                break
            span = np.arange(starts[leaf], ends[leaf])
            best_at, best = np.concatenate([best_at, span]), np.concatenate([best, unit[span] @ direction])
            if len(best) > k:
                keep = _top(best, k)
                best_at, best = best_at[keep], best[keep]
            reach = np.searchsorted(np.cumsum(copies[best_at]), k)
            if reach < len(best):
                within = min(within, max(0.0, 2 - 2 * best[reach]))
        scale = query / np.abs(query).max()
        scores = (scaled[best_at] @ scale) / (norms[best_at] * np.linalg.norm(scale))
        hits = sorted(((float(s), v, uids[i] == uid) for s, i in zip(scores, best_at) for v in ids[i]), key=lambda x: (-x[0], x[1]))[:k]
        rows.append((uid, within, [dict(zip(("score", "vec_id", "own"), hit)) for hit in hits]))
    return rows


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """The best ``k`` scores and all that could tie with the last, best first."""
    last = -np.partition(-scores, k - 1)[k - 1]
    keep = np.flatnonzero(scores >= last - 1e-12)
    return keep[np.argsort(-scores[keep], kind="stable")]


def _leaves(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points in the order of the leaves of a kd-tree, and where each leaf starts."""
    order, starts, stack = [], [], [np.arange(len(at))]
    while stack:
        rows = stack.pop()
        if len(rows) <= LEAF:
            starts.append(starts[-1] + len(order[-1]) if starts else 0)
            order.append(rows)
            continue
        dim = int(np.argmax(np.ptp(at[rows], axis=0)))
        ranked = rows[np.argpartition(at[rows, dim], len(rows) // 2)]
        stack += [ranked[len(rows) // 2:], ranked[:len(rows) // 2]]
    return np.concatenate(order), np.array(starts)
