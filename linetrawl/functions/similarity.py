"""Approximate matching: a native bound that rules lines out, and the exact ratio for the rest."""

from __future__ import annotations

import math
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Every character that str.strip() removes.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_SLACK = 1e-9


def window_width(n: int) -> int:
    return max(n, int(n * 1.5))


def cluster_pattern(needle: str, threshold: float) -> str | None:
    """Regex for long lines: as many neighbouring needle pairs as any matching window must hold, close
    enough to share one. None where a single pair is enough or nothing can be demanded; a pattern that
    never matches where no long line can.

    Always stepping to the nearest next pair loses nothing, so the steps are atomic and the search is
    linear. Java and Python read the pattern alike.
    """
    n, width = len(needle), window_width(len(needle))
    needed = math.ceil(threshold * (width + n) / 2 - _SLACK)
    if needed > n:
        return "(?!)"
    pairs = 3 * needed - n - width - 1
    if pairs < 2:
        return None
    any_pair = "|".join(sorted({re.escape(needle[i:i + 2]) for i in range(n - 1)}))
    return f"(?s)(?=(?:{any_pair}))(?>.{{1,{width - pairs}}}?(?=(?:{any_pair}))){{{pairs - 1}}}"


def could_match(line: Column, needle: str, threshold: float) -> Column:
    """False only where no window of ``line`` can reach ``threshold`` against ``needle``.

    With M matched characters the ratio is 2M / (n + c) for a chunk of c characters. M is at most
    the multiset overlap of needle and line; and M matched characters fall into at most
    1 + (n - M) + (c - M) blocks, so at least 3M - n - c - 1 neighbouring pairs of the needle must
    occur in the line, and in a long line within one window. Both bounds grow with M, so the smallest M
    that reaches the threshold decides.
    """
    n, width = len(needle), window_width(len(needle))
    if 2 * n / (n + width) < threshold - _SLACK:
        reachable = lambda length: length <= 2 * n
    else:
        reachable = lambda length: F.lit(True)

    # Counting on the untrimmed line can only raise the bounds.
    overlap = sum(
        (F.least(F.lit(k), F.char_length(line) - F.char_length(F.replace(line, F.lit(ch), F.lit(""))))
         for ch, k in sorted(Counter(needle).items())),
        F.lit(0),
    )
    pairs = sum(
        (F.when(F.contains(line, F.lit(needle[i:i + 2])), 1).otherwise(0) for i in range(n - 1)),
        F.lit(0),
    )

    cluster = cluster_pattern(needle, threshold)

    def enough(length):
        chunk = F.when(length <= 2 * n, length).otherwise(F.lit(width))
        needed = F.ceil(F.lit(threshold) * (chunk + n) / 2 - _SLACK)
        return (
            (length > 0) & reachable(length)
            & (pairs >= 3 * needed - n - chunk - 1) & (overlap >= needed)
            & ((length <= 2 * n) | line.rlike(cluster) if cluster else F.lit(True))
        )

    return F.exists(F.array(F.char_length(F.trim(line, F.lit(WHITESPACE)))), enough)


def best_match(line: str, needle: str, threshold: float, cluster: re.Pattern | None = None) -> tuple[int, float] | None:
    """Offset and ratio of the best window of ``line``, or None below ``threshold``.

    Short lines are compared whole; longer ones at strided windows, earliest best window first.
    The needle's character counts bound every window at once, so only windows that can still win
    pay for the exact ratio. ``cluster`` is the compiled :func:`cluster_pattern`.
    """
    n = len(needle)
    if len(line) <= 2 * n:
        ratio = SequenceMatcher(None, needle, line).ratio()
        return (0, ratio) if ratio >= threshold else None
    if cluster is not None and not cluster.search(line):
        return None
    width = window_width(n)
    starts = np.arange(0, len(line) - width + 1, max(1, n // 2))
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    chars, counts = np.unique(np.frombuffer(needle.encode("utf-32-le", "surrogatepass"), dtype="<u4"), return_counts=True)
    seen = np.zeros((len(chars), len(line) + 1), dtype=np.int32)
    np.cumsum(codes == chars[:, None], axis=1, out=seen[:, 1:])
    overlap = np.minimum(seen[:, starts + width] - seen[:, starts], counts[:, None]).sum(axis=0)
    ceiling = 2.0 * overlap / (n + width)
    found = None
    for i in np.flatnonzero(ceiling >= threshold - _SLACK):
        if found and (found[1] >= 0.99 or ceiling[i] <= found[1]):
            continue
        at = int(starts[i])
        ratio = SequenceMatcher(None, needle, line[at:at + width]).ratio()
        if ratio >= threshold and ratio > (found[1] if found else 0.0):
            found = (at, ratio)
    return found


@F.arrow_udf(T.DoubleType())
def ratio(needle: pa.Array, text: pa.Array) -> pa.Array:
    """Similarity of two strings in 0..1; the order of the arguments matters."""
    pairs = zip(needle.to_pylist(), text.to_pylist())
    return pa.array([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in pairs], pa.float64())
