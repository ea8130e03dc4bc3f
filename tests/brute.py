"""Plain-Python expectations, written for tests only."""

import re
import unicodedata
from difflib import SequenceMatcher


def norm(text, spec):
    if spec.normalize_width:
        text = unicodedata.normalize("NFKC", text)
    return text if spec.case_sensitive else text.casefold()


def segments(text):
    return [(n, line) for n, line in enumerate(text.splitlines(), 1) if line.strip()]


def cut(text, a, b, n):
    lo, hi = max(0, a - n), min(len(text), b + n)
    body = text[lo:hi]
    for c in "\r\n\t":
        body = body.replace(c, " ")
    return "..." * (lo > 0) + body + "..." * (hi < len(text))


def finds(text, kw):
    return [m.start() for m in re.finditer(re.escape(kw), text)]


def window(hay, needle, t):
    n = len(needle)
    if len(hay) <= 2 * n:
        r = SequenceMatcher(None, needle, hay).ratio()
        return (0, r) if r >= t else None
    w = max(n, int(1.5 * n))
    best = (-1, 0.0)
    for i in range(0, len(hay) - w + 1, max(1, n // 2)):
        r = SequenceMatcher(None, needle, hay[i:i + w]).ratio()
        if r > best[1]:
            best = (i, r)
        if best[1] >= 0.99:
            break
    return best if best[0] >= 0 and best[1] >= t else None


def search(segs, spec):
    """segs: list of (locator, raw text) of one file -> capped (locator, position, matched, snippet)."""
    if not segs or not spec.keywords:
        return []
    out = []
    if spec.mode == "regex":
        flags = 0 if spec.case_sensitive else re.IGNORECASE
        for loc, t in segs:
            for k in spec.keywords:
                out += [(loc, m.start(), m.group() or k, cut(t, m.start(), m.end(), spec.snippet_chars))
                        for m in re.finditer(k, t, flags)]
        return out[:spec.max_hits_per_file]
    texts = [(loc, norm(t, spec)) for loc, t in segs]
    kws = [(k, norm(k, spec)) for k in spec.keywords]
    if spec.mode == "keyword":
        whole = "\n".join(t for _, t in texts)
        if spec.operator == "and" and not all(k in whole for _, k in kws):
            return []
        for loc, t in texts:
            for raw, k in kws:
                out += [(loc, p, raw, cut(t, p, p + len(k), spec.snippet_chars)) for p in finds(t, k)]
        return out[:spec.max_hits_per_file]
    for loc, t in texts:
        off = 0
        for line in t.splitlines(keepends=True):
            s = line.strip()
            for _, k in kws if s else []:
                hit = window(s, k, spec.fuzzy_threshold)
                if hit:
                    p = off + line.find(s) + hit[0]
                    out.append((loc, p, f"{k} (sim={hit[1]:.2f})", cut(t, p, p + len(k), spec.snippet_chars)))
            off += len(line)
    return out[:spec.max_hits_per_file]
