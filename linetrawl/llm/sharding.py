"""K-d tree sharding: recursive cuts at distributed weighted medians along the widest dimension."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from linetrawl.llm.common import SPREAD, earlier_sum, spread, stored, without

BINS = 8192
_TIE = 2 ** 31


@dataclass
class Node:
    """A box of the tree; an inner one sends keys up to ``cut`` to the left.

    Rows of the one key ``split`` are parted by the hash of their id: up to ``split_at`` to the left. Of these, rows of the one
    hash ``split_id`` are parted by a hash of their place in the table: up to ``split_row``.
    """

    shards: int
    dim: int = -1
    cut: int | None = None
    split: int | None = None
    split_at: int = 0
    split_id: int | None = None
    split_row: int = 0
    left: "Node | None" = None
    right: "Node | None" = None


def text_dims(text: Column) -> list[Column]:
    """Metadata that equal texts share, each in parts of 2**20: white space, bytes beyond ASCII, line length.

    None of them orders documents by size, so long documents spread over the boxes.
    """
    t = F.coalesce(text, F.lit(""))
    chars, size = F.greatest(F.char_length(t), F.lit(1)), F.greatest(F.octet_length(t), F.lit(1))
    count = lambda c: F.char_length(t) - F.char_length(F.replace(t, F.lit(c), F.lit("")))
    share = lambda part, whole: F.call_function("div", part.cast("long") * 2 ** 20, whole)
    return [share(count(" "), chars), share(size - F.char_length(t), size), share(F.least(chars, F.lit(1024) * (count("\n") + 1)), F.lit(1024) * (count("\n") + 1))]


def shard(docs: DataFrame, shards: int = 16, dims: Callable[[Column], list[Column]] = text_dims,
          slack: float = 0.001, whole: float = 0.02) -> DataFrame:
    """Add ``size, text_crc32, shard, slot`` to documents; shards hold nearly equal bytes.

    The space of ``dims`` (integers below 2**31, nulls count as 0) is cut again and again at the
    byte-weighted median of the dimension whose range in the box is the widest share of its whole range,
    until each leaf holds the target, all bytes over ``shards``. A median is found by counting bytes per
    bin and looking closer into the bin that holds it, so a pass sends at most ``BINS`` numbers per box.
    Ties in the dimension are broken by a hash of the text, so equal texts fall into one shard, unless
    the group lies across a cut that would miss the median by more than ``whole`` targets: then the hash of
    the id divides it, and a hash of the place where a row is read divides those of one id, repeated rows for example. Other cuts miss it by ``slack`` targets or one document at most.

    Size is the UTF-8 length of the text plus 1; a null text has none. ``slot`` counts from 0 in a shard
    without gaps, in the order of a hash of the id, then id and text; equal rows are interchangeable. An
    empty table gives no rows; with fewer rows than shards some shards stay empty. Other columns are
    kept; those named like the four added ones are replaced.
    """
    docs = without(docs, "size", "text_crc32", "shard", "slot")
    points = stored(_points(docs, dims).select("__size", "__dims", "__tie", "__id", "__row"), "kd")
    tree = _fit(points, len(dims(F.col("text"))), shards, slack, whole)
    placed = _points(docs, dims).withColumn("shard", _route(tree, 0))
    numbered = earlier_sum(
        placed.withColumn("__one", F.lit(1)), ["shard"], ["__id", "__crc", "__size"], "__one", "slot", blocks=1024)
    return numbered.select(*[f"`{c}`" for c in docs.columns], F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), "shard", "slot")


def _points(docs, dims):
    t = F.coalesce(F.col("text"), F.lit(""))
    bounded = [F.greatest(F.least(F.coalesce(d, F.lit(0)).cast("long"), F.lit(_TIE - 1)), F.lit(0)) for d in dims(F.col("text"))]
    return docs.withColumns({
        "__size": (F.octet_length(t) + 1).cast("long"),
        "__dims": F.array(*bounded),
        "__tie": F.pmod(F.xxhash64(t), F.lit(_TIE)),
        "__id": spread("doc_id"),
        "__row": F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 2),
        "__crc": F.crc32(F.encode(t, "UTF-8")),
    })


def _route(node: Node, first: int) -> Column:
    """The tree as one expression that gives the shard of a row."""
    if node.left is None:
        return F.lit(first)
    return F.when(_goes_left(node), _route(node.left, first)).otherwise(_route(node.right, first + node.left.shards))


def _goes_left(node: Node) -> Column:
    """Along a dimension rows are placed by its value, then by the hash of their text."""
    key = F.element_at("__dims", node.dim + 1) * F.lit(_TIE) + F.col("__tie")
    if node.split is None:
        return key <= node.cut
    left = F.col("__id") <= node.split_at
    if node.split_id is not None:
        left = F.when(F.col("__id") == node.split_id, F.col("__row") <= node.split_row).otherwise(left)
    return F.when(key == node.split, left).otherwise(key <= node.cut)


def _fit(points: DataFrame, n: int, shards: int, slack: float, whole_groups: float) -> Node:
    ends = [f(F.element_at("__dims", d + 1)) for d in range(n) for f in (F.min, F.max)]
    whole = points.agg(F.sum("__size"), *ends).first()
    root = Node(shards)
    if not whole[0]:
        return root
    span = [max(1, whole[2 + 2 * d] - whole[1 + 2 * d]) for d in range(n)]
    allowed = slack * whole[0] / shards
    level, boxes = [root] if shards > 1 else [], points.withColumn("__box", F.lit(0))
    while level:
        found = {r[0]: r for r in boxes.groupBy("__box").agg(F.sum("__size"), *ends).collect()}
        level = {i: level[i] for i in found}
        for i, node in level.items():
            lo, hi = found[i][2::2], found[i][3::2]
            node.dim = max(range(n), key=lambda d: ((hi[d] - lo[d]) / span[d], -d))
        aims = {i: found[i][1] * (node.shards // 2) / node.shards for i, node in level.items()}
        bounds = {i: (found[i][2 + 2 * x.dim] * _TIE, found[i][3 + 2 * x.dim] * _TIE + _TIE - 1) for i, x in level.items()}
        keyed = boxes.withColumn("__key", F.element_at("__dims", _per_box({i: x.dim + 1 for i, x in level.items()}).cast("int")) * F.lit(_TIE) + F.col("__tie"))
        heavy, repeated = {}, {}
        for i, (at, below, weight) in _medians(keyed, "__key", bounds, aims, allowed).items():
            level[i].cut, off = _nearer(at, below, weight, aims[i])
            if off > max(allowed, whole_groups * whole[0] / shards):  # a group of equal texts that is too heavy to stay whole
                heavy[i], level[i].split = aims[i] - below, at
        if heavy:
            group = keyed.filter(F.col("__key") == _per_box({i: level[i].split for i in heavy}))
            for i, median in _medians(group, "__id", dict.fromkeys(heavy, (0, SPREAD - 1)), heavy, allowed).items():
                level[i].split_at, off = _nearer(*median, heavy[i])
                if off > max(allowed, whole_groups * whole[0] / shards):  # an id that is too heavy, however often it occurs
                    repeated[i], level[i].split_id = heavy[i] - median[1], median[0]
        if repeated:
            group = group.filter(F.col("__id") == _per_box({i: level[i].split_id for i in repeated}))
            for i, median in _medians(group, "__row", dict.fromkeys(repeated, (0, SPREAD - 1)), repeated, allowed).items():
                level[i].split_row, _ = _nearer(*median, repeated[i])
        next_level, side = [], {}
        for i, node in level.items():
            node.left, node.right = Node(node.shards // 2), Node(node.shards - node.shards // 2)
            side[i] = []
            for x in (node.left, node.right):
                side[i].append(len(next_level) if x.shards > 1 else -1)
                next_level += [x] if x.shards > 1 else []
        if next_level:
            left = _any([(F.col("__box") == i) & _goes_left(x) for i, x in level.items()])
            boxes = stored(boxes.withColumn("__box", F.when(left, _per_box({i: x[0] for i, x in side.items()})).otherwise(_per_box({i: x[1] for i, x in side.items()})).cast("int")).filter("__box >= 0"), "kd")
        level = next_level
    return root


def _any(conditions):
    found = conditions[0]
    for c in conditions[1:]:
        found = found | c
    return found


def _per_box(values: dict[int, int]) -> Column:
    """The value for the row's box; null for boxes without one."""
    return F.get(F.array(*[F.lit(values.get(i)).cast("long") for i in range(max(values) + 1)]), F.col("__box"))


def _nearer(at: int, below: float, weight: float, aim: float) -> tuple[int, float]:
    """Whether the value itself belongs below the cut, and how far the cut then is from the aim."""
    return (at, below + weight - aim) if below + weight - aim <= aim - below else (at - 1, aim - below)


def _medians(rows: DataFrame, key: str, bounds: dict, aims: dict, allowed: float) -> dict[int, tuple[int, float, float]]:
    """For each box: a value, the weight below it, and its own weight, with which the aim is reached.

    The value ends a bin that is no heavier than ``allowed`` or holds one value only.
    """
    state = {i: (lo, hi, 0) for i, (lo, hi) in bounds.items()}
    done: dict[int, tuple[int, float, float]] = {}
    while state:
        width = {i: -(-(hi - lo + 1) // BINS) for i, (lo, hi, _) in state.items()}
        low, high = (_per_box({i: x[side] for i, x in state.items()}) for side in (0, 1))
        bin_ = F.call_function("div", F.col(key) - low, _per_box(width)).cast("int")
        counts: dict[int, list] = {i: [] for i in state}
        for box, b, w in rows.filter(F.col(key).between(low, high)).groupBy("__box", bin_.alias("bin")).agg(F.sum("__size")).collect():
            counts[box].append((b, w))
        for i, (lo, hi, below) in list(state.items()):
            for b, w in sorted(counts[i]):
                if below + w >= aims[i]:
                    break
                below += w
            start, end = lo + b * width[i], min(hi, lo + (b + 1) * width[i] - 1)
            if start == end or w <= allowed:
                done[i] = (end, below, w)
                del state[i]
            else:
                state[i] = (start, end, below)
    return done
