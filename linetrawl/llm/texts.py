"""Texts as arrays of code points, for operators that look at every character."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterable, Iterator

import numpy as np


@functools.cache
def _table(kind: str) -> np.ndarray:
    """Per code point: its simple lower case, or whether it is a letter or white space."""
    chars = map(chr, range(sys.maxunicode + 1))
    if kind == "lower":
        lowered = (c.lower() for c in chars)
        return np.fromiter((ord(x) if len(x) == 1 else i for i, x in enumerate(lowered)), np.uint32, sys.maxunicode + 1)
    return np.fromiter((c.isalpha() if kind == "letter" else c.isspace() for c in chars), bool, sys.maxunicode + 1)


def lower(points: np.ndarray) -> np.ndarray:
    return _table("lower")[points]


def letters(points: np.ndarray) -> np.ndarray:
    return _table("letter")[points]


def spaces(points: np.ndarray) -> np.ndarray:
    return _table("space")[points]


def points(text: str) -> np.ndarray:
    """Code points, as numpy counts them: as many as the text has characters."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(texts: Iterable[str | None], chars: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``chars`` characters; null counts as empty."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held
