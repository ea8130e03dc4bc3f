"""Match expressions: an array of segments in, an ordered array of hits out.

A row holds ``segs ARRAY<STRUCT<seg_idx INT, line_no INT, text STRING>>``: all lines of a file when a
row is a file, a single element when a row is a segment. Hits come out in reporting order.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession, functions as F

from linetrawl.functions.batches import sliced
from linetrawl.functions.literals import java_test, required
from linetrawl.functions.similarity import best_match, cluster_pattern, could_match
from linetrawl.functions.text import (
    has_rare_break, normalize_literal, quote_literal, snippet, split_lines,
)
from linetrawl.operators.automaton import CHUNK as CHUNK_CHARS, Keywords, code_points
from linetrawl.spec import SearchSpec

HIT_TYPE = (
    "array<struct<seg_idx:int,line_no:int,kw_idx:int,position:bigint,matched:string,snippet:string>>"
)
_HIT_ARROW = pa.list_(pa.struct([
    ("seg_idx", pa.int32()), ("line_no", pa.int32()), ("kw_idx", pa.int32()),
    ("position", pa.int64()), ("matched", pa.string()), ("snippet", pa.string()),
]))

# Regex building blocks that mean the same to Java (with flags iuUd) and to Python.
# Anything else (word classes, look-around, back-references, named groups, ...) takes the exact lane, and so
# do groups that repeat: Java matches each round of a group on the stack, which a long line overflows.
_PORTABLE = re.compile(
    r"(?:(?:[^\\\[\](){}.*+?^$|&]"          # ordinary character
    r"|\\[\\.\[\](){}*+?^$|/\-]"           # escaped punctuation
    r"|\\d|\\t|\\n|\."
    r"|\[\^?(?:[A-Za-z0-9_ .,:;@%#/+](?:-[A-Za-z0-9])?|\\d|\\[.\-\\\]\[])+\])"
    r"(?:(?:[*+?]|\{\d+(?:,\d*)?\})\??(?![*+?{]))?"
    r"|\((?:\?:)?|\)\??(?![*+?{])|\||\^|\$)*\Z"
)


#: Elements of an array that grows element by element, and segments whose hits are concatenated at once.
CHUNK, SEGMENTS = 256, 16


def keyword_array(spec: SearchSpec) -> Column:
    """The keywords as one literal array, so the plan does not grow with their number."""
    rows = []
    for i, raw in enumerate(spec.keywords):
        norm = normalize_literal(raw, spec.case_sensitive, spec.normalize_width)
        if norm:
            rows.append(F.struct(
                F.lit(i).alias("kw_idx"), F.lit(raw).alias("raw"), F.lit(norm).alias("norm"),
                F.lit(quote_literal(norm)).alias("quoted"),
            ))
    return F.array(*rows)


def literal_positions(text: Column, norm: Column, quoted: Column, limit: int) -> Column:
    """Offsets of the first ``limit`` non-overlapping occurrences, left to right."""
    size = F.char_length(norm)
    pieces = F.call_function("split", text, quoted, F.lit(min(limit + 1, 2**31 - 1)))
    steps = F.transform(pieces, lambda p: (F.char_length(p) + size).cast("bigint"))
    return F.transform(_let(steps, lambda s: F.slice(running_sums(s), F.lit(1), F.size(s) - 1)), lambda end: end - size)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running_sums(steps: Column, chunk: int = CHUNK) -> Column:
    """Sums up to each element of an ``array<bigint>``.

    An array grows by copying, so it only grows within chunks and by one element a chunk.
    """
    none = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("bigint")
    sums = lambda xs, start: F.aggregate(
        xs, F.struct(start.alias("off"), none.alias("at")),
        lambda acc, x: F.struct((acc["off"] + x).alias("off"), F.array_append(acc["at"], acc["off"] + x).alias("at")),
        lambda acc: acc["at"])

    def in_chunks(xs):
        chunks = F.transform(
            F.sequence(F.lit(0), ((F.size(xs) - 1) / chunk).cast("int")), lambda i: F.slice(xs, i * chunk + 1, F.lit(chunk)))
        return _let(chunks, lambda cs: _let(
            F.array_insert(sums(F.transform(cs, lambda c: F.aggregate(c, zero, lambda a, x: a + x)), zero), 1, zero),
            lambda starts: F.flatten(F.transform(cs, lambda c, i: sums(c, F.get(starts, i))))))

    return F.when(F.size(steps) <= chunk, sums(steps, zero)).otherwise(in_chunks(steps))


def _hit(seg, kw_idx, position, end, matched, spec: SearchSpec) -> Column:
    return F.struct(
        seg["seg_idx"].cast("int").alias("seg_idx"),
        seg["line_no"].cast("int").alias("line_no"),
        kw_idx.cast("int").alias("kw_idx"),
        position.cast("bigint").alias("position"),
        matched.alias("matched"),
        snippet(seg["text"], position.cast("int"), end.cast("int"), spec.snippet_chars, seg["size"]).alias("snippet"),
    )


def _sized(segs: Column) -> Column:
    """Segments with their length in characters, counted once for all hits of a segment."""
    return F.transform(segs, lambda s: F.struct(
        s["seg_idx"].alias("seg_idx"), s["line_no"].alias("line_no"), s["text"].alias("text"),
        F.char_length(s["text"]).alias("size")))


def _until_full(segs: Column, hits_of, limit: int) -> Column:
    """Concatenate the hits of the segments in order and stop evaluating soon after ``limit`` hits.

    Segments are taken ``SEGMENTS`` at a time, as each concatenation copies what there is.
    """
    at_a_time = lambda all_: F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(SEGMENTS)),
        F.array().cast(HIT_TYPE),
        lambda acc, i: F.when(F.size(acc) >= limit, acc).otherwise(
            F.concat(acc, F.flatten(F.transform(F.slice(all_, i + 1, F.lit(SEGMENTS)), hits_of)))))
    return F.slice(_let(_sized(segs), at_a_time), 1, limit)


def keyword_hits(segs: Column, present: Column, spec: SearchSpec) -> Column:
    """Hits of the ``present`` keywords."""
    limit = spec.max_hits_per_file

    def hits_of(seg):
        found = F.filter(present, lambda k: F.contains(seg["text"], k["norm"]))
        return F.flatten(F.transform(found, lambda k: F.transform(
            literal_positions(seg["text"], k["norm"], k["quoted"], limit),
            lambda p: _hit(seg, k["kw_idx"], p, p + F.char_length(k["norm"]), k["raw"], spec),
        )))

    matching = F.filter(segs, lambda s: F.exists(present, lambda k: F.contains(s["text"], k["norm"])))
    return _until_full(matching, hits_of, limit)


# ------------------------------------------------------------------------------- many keywords
#: Up to this many distinct keywords are sought one by one in the JVM, more by one pass of an automaton.
AUTOMATON_FROM = 32


def is_many(spec: SearchSpec) -> bool:
    return spec.mode == "keyword" and len({norm for _, norm in _needles(spec)}) > AUTOMATON_FROM


def share_keywords(spark: SparkSession, spec: SearchSpec) -> Broadcast:
    """The automata of the keywords, built here once; a broadcast as large as the list that the caller wrote."""
    return spark.sparkContext.broadcast(Keywords(_needles(spec)))


def _pieces(sizes: list[int], texts: list[str], whole: bool):
    """Lists of ``(row, from, to)``: segments of about ``CHUNK_CHARS`` characters; a row is cut between segments unless ``whole``."""
    held, chars, at = [], 0, 0
    for row, size in enumerate(sizes):
        begin, at = at, at + size
        for j in range(begin, at):
            chars += len(texts[j]) + 1
            if chars >= CHUNK_CHARS and (not whole or j == at - 1):
                yield [*held, (row, begin, j + 1)]
                held, chars, begin = [], 0, j + 1
        if begin < at:
            held.append((row, begin, at))
    if held:
        yield held


def _found(keywords: Keywords, pieces: list[tuple[int, int, int]], texts: list[str]):
    """``(row, segment, position, word)`` of occurrences, and ``(row, word)`` of those that cross segments.

    The segments of a row are laid end to end with line breaks between, so a keyword with line breaks can be seen to be there.
    """
    points, starts = code_points(["\n".join(texts[a:b]) for _, a, b in pieces])
    at, words = keywords.occurrences(points, starts)
    segments = np.concatenate([np.arange(a, b) for _, a, b in pieces])
    rows = np.repeat([r for r, _, _ in pieces], [b - a for _, a, b in pieces])
    sizes = np.fromiter((len(texts[j]) for j in segments), np.int64, len(segments))
    # One more for the break after a segment, but for the last one of its piece.
    steps = sizes + 1
    steps[np.cumsum([b - a for _, a, b in pieces]) - 1] -= 1
    begins = np.cumsum(steps) - steps
    nth = np.searchsorted(begins, at, "right") - 1
    inside = at + keywords.lengths[words] <= begins[nth] + sizes[nth]
    crossing = rows[nth[~inside]], words[~inside]
    nth, at, words = nth[inside], at[inside] - begins[nth[inside]], words[inside]
    order = np.lexsort((at, words, nth))
    nth, at, words = nth[order], at[order], words[order]
    kept = keywords.apart(nth, at, words)
    nth, at, words = nth[kept], at[kept], words[kept]
    return (rows[nth], segments[nth], at, words), crossing


def automaton_hits(segs: Column, spec: SearchSpec, shared: Broadcast, gate: bool) -> Column:
    """Hits of all keywords in one pass; with ``gate`` a row has hits only if it holds every keyword."""
    limit, chars, raws = spec.max_hits_per_file, spec.snippet_chars, spec.keywords
    breaks = gate and any("\n" in norm for _, norm in _needles(spec))

    def find(segs: pa.Array) -> pa.Array:
        keywords: Keywords = shared.value
        flat, sizes = segs.flatten(), pc.list_value_length(segs).fill_null(0).to_pylist()
        texts = flat.field("text").fill_null("").to_pylist()
        idxs, lines = flat.field("seg_idx").to_pylist(), flat.field("line_no").to_pylist()
        out: list[list[dict]] = [[] for _ in sizes]
        present = [np.zeros(0, np.int64)]
        for pieces in _pieces(sizes, texts, breaks):
            if not gate:
                pieces = [p for p in pieces if len(out[p[0]]) < limit]
            if not pieces:
                continue
            (row, segment, at, word), (over_row, over_word) = _found(keywords, pieces, texts)
            if gate:
                present.append(np.unique(np.concatenate([row, over_row]) * len(keywords.words) + np.concatenate([word, over_word])))
            which, place = keywords.listed(word)
            order = np.lexsort((at[which], place, segment[which]))
            which, place = which[order], place[order]
            row = row[which]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            few = rank < limit
            for r, j, p, w, k in zip(row[few].tolist(), segment[which[few]].tolist(), at[which[few]].tolist(), word[which[few]].tolist(), place[few].tolist()):
                if len(out[r]) < limit:
                    out[r].append({"seg_idx": idxs[j], "line_no": lines[j], "kw_idx": k, "position": p, "matched": raws[k],
                                   "snippet": _cut(texts[j], p, p + int(keywords.lengths[w]), chars)})
        if gate:
            rows = np.unique(np.concatenate(present)) // len(keywords.words)
            full = np.bincount(rows, minlength=len(sizes)) == len(keywords.words)
            out = [hits if ok else [] for hits, ok in zip(out, full.tolist())]
        return pa.array(out, type=_HIT_ARROW)

    return _lane(find, HIT_TYPE)(segs)


def _lane(find, returns: str):
    """UDF of a function over slices of a batch. Not deterministic, which keeps the optimizer from evaluating it a second
    time inside a filter on the result."""
    @F.arrow_udf(returns)
    def lane(values: pa.Array) -> pa.Array:
        return sliced(values, find)

    return lane.asNondeterministic()


def _per_text(texts: pa.Array, keywords: Keywords):
    """``(row, position, word)`` of occurrences in every text, chunk by chunk; null counts as empty."""
    listed = [t or "" for t in texts.to_pylist()]
    for pieces in _pieces([1] * len(listed), listed, True):
        (row, _, at, word), _ = _found(keywords, pieces, listed)
        yield row, at, word


def _as_lists(rows: list[np.ndarray], n: int, values: pa.Array) -> pa.Array:
    counts = np.bincount(np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)


def automaton_places(text: Column, shared: Broadcast) -> Column:
    """Every hit of every keyword, ``array<struct<kw_idx, position>>``, by keyword and position."""
    def find(texts: pa.Array) -> pa.Array:
        keywords: Keywords = shared.value
        none = np.zeros(0, np.int64)
        rows, places, positions = [none], [none], [none]
        for row, at, word in _per_text(texts, keywords):
            which, place = keywords.listed(word)
            order = np.lexsort((at[which], place, row[which]))
            rows.append(row[which][order])
            places.append(place[order])
            positions.append(at[which][order])
        values = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(positions), pa.int64())], names=["kw_idx", "position"])
        return _as_lists(rows, len(texts), values)

    return _lane(find, "array<struct<kw_idx:int,position:bigint>>")(text)


def automaton_present(text: Column, shared: Broadcast) -> Column:
    """The distinct keywords in a text, numbered in the order of :class:`Keywords`."""
    def find(texts: pa.Array) -> pa.Array:
        keywords: Keywords = shared.value
        keys = [np.unique(row * len(keywords.words) + word) for row, _, word in _per_text(texts, keywords)]
        keys = np.concatenate([np.zeros(0, np.int64), *keys])
        return _as_lists([keys // len(keywords.words)], len(texts), pa.array(keys % len(keywords.words), pa.int32()))

    return _lane(find, "array<int>")(text)


# ---------------------------------------------------------------------------------------- regex
def is_portable(pattern: str) -> bool:
    """Whether Java finds exactly what Python finds, with a positive width for every match."""
    return bool(_PORTABLE.match(pattern)) and pattern.isascii() and not re.search(pattern, "")


def java_pattern(pattern: str, case_sensitive: bool) -> str:
    return ("(?Ud)" if case_sensitive else "(?iuUd)") + pattern


def regex_hits_native(segs: Column, spec: SearchSpec) -> Column:
    limit = spec.max_hits_per_file
    patterns = [java_pattern(p, spec.case_sensitive) for p in spec.keywords]

    def hits_of(seg):
        def of_pattern(i, pattern):
            pieces = F.split(seg["text"], pattern, limit + 1)
            matches = F.slice(F.regexp_extract_all(seg["text"], F.lit(pattern), F.lit(0)), 1, limit)
            located = _let(matches, lambda ms: _let(
                running_sums(F.zip_with(F.slice(pieces, F.lit(1), F.size(ms)), ms, lambda a, b: (F.char_length(a) + F.char_length(b)).cast("bigint"))),
                lambda ends: F.zip_with(ends, ms, lambda end, m: F.struct((end - F.char_length(m)).alias("at"), m.alias("m")))))
            return F.when(seg["text"].rlike(pattern), F.transform(
                located,
                lambda x: _hit(seg, F.lit(i), x["at"], x["at"] + F.char_length(x["m"]), x["m"], spec),
            )).otherwise(F.array().cast(HIT_TYPE))

        return F.concat(*[of_pattern(i, p) for i, p in enumerate(patterns)])

    matching = F.filter(segs, lambda s: reduce(lambda a, b: a | b, [s["text"].rlike(p) for p in patterns]))
    return _until_full(matching, hits_of, limit)


# ------------------------------------------------------------------------- Arrow lanes (Python)
def _cut(text: str, start: int, end: int, chars: int) -> str:
    lo, hi = max(0, start - chars), min(len(text), end + chars)
    body = re.sub("[\r\n\t]", " ", text[lo:hi])
    return ("..." if lo else "") + body + ("..." if hi < len(text) else "")


def _arrow_hits(matcher, spec: SearchSpec):
    """UDF over ``segs``: ``matcher(text)`` yields (kw_idx, position, length, matched)."""
    limit, chars = spec.max_hits_per_file, spec.snippet_chars

    def find(segs: pa.Array) -> pa.Array:
        flat = segs.flatten()
        texts = flat.field("text").to_pylist()
        idxs, lines = flat.field("seg_idx").to_pylist(), flat.field("line_no").to_pylist()
        out, at = [], 0
        for size in pc.list_value_length(segs).fill_null(0).to_pylist():
            hits = []
            for j in range(at, at + size):
                for kw_idx, position, length, matched in matcher(texts[j]):
                    hits.append((idxs[j], lines[j], kw_idx, position, matched,
                                 _cut(texts[j], position, position + length, chars)))
                    if len(hits) >= limit:
                        break
                if len(hits) >= limit:
                    break
            at += size
            out.append(hits)
        names = [_HIT_ARROW.value_type.field(i).name for i in range(6)]
        return pa.array([[dict(zip(names, h)) for h in hits] for hits in out], type=_HIT_ARROW)

    return _lane(find, HIT_TYPE)


def exact_test(spec: SearchSpec) -> str | None:
    """A Java pattern that finds something in every text that any of the patterns matches; None if there is none."""
    runs = [required(p, not spec.case_sensitive) for p in spec.keywords]
    return java_test([run for alternatives in runs for run in alternatives]) if all(runs) else None


def regex_candidates(segs: Column, spec: SearchSpec) -> Column:
    """Segments that hold what some pattern cannot match without; only they go to Python."""
    test = exact_test(spec)
    return segs if test is None else F.filter(segs, lambda s: s["text"].rlike(test))


def regex_hits_exact(segs: Column, spec: SearchSpec) -> Column:
    """Patterns outside the portable subset, with Python's own regex semantics."""
    flags = 0 if spec.case_sensitive else re.IGNORECASE
    patterns = [(i, p) for i, p in enumerate(spec.keywords)]

    def matcher(text):
        for i, raw in patterns:
            for m in re.compile(raw, flags).finditer(text):
                yield i, m.start(), m.end() - m.start(), m.group(0) or raw

    return _arrow_hits(matcher, spec)(segs)


def _needles(spec: SearchSpec) -> list[tuple[int, str]]:
    norms = [(i, normalize_literal(raw, spec.case_sensitive, spec.normalize_width)) for i, raw in enumerate(spec.keywords)]
    return [(i, norm) for i, norm in norms if norm]


def fuzzy_candidates(segs: Column, spec: SearchSpec, multiline: bool) -> Column:
    """Segments that the native bound cannot rule out."""
    threshold = float(spec.fuzzy_threshold)

    def possible(line):
        return reduce(lambda a, b: a | b, [could_match(line, n, threshold) for _, n in _needles(spec)])

    def keep(seg):
        if not multiline:
            return possible(seg["text"])
        return F.when(
            seg["text"].contains("\n") | has_rare_break(seg["text"]),
            F.exists(split_lines(seg["text"]), possible),
        ).otherwise(possible(seg["text"]))

    return F.filter(segs, keep)


def fuzzy_hits(segs: Column, spec: SearchSpec) -> Column:
    """Exact similarity of :func:`fuzzy_candidates`."""
    threshold = float(spec.fuzzy_threshold)
    needles = [
        (i, needle, re.compile(pattern) if (pattern := cluster_pattern(needle, threshold)) else None)
        for i, needle in _needles(spec)
    ]

    def matcher(text):
        offset = 0
        for line in text.splitlines(keepends=True):
            core = line.strip()
            indent = len(line) - len(line.lstrip())
            for i, needle, cluster in needles if core else ():
                found = best_match(core, needle, threshold, cluster)
                if found:
                    yield i, offset + indent + found[0], len(needle), f"{needle} (sim={found[1]:.2f})"
            offset += len(line)

    return _arrow_hits(matcher, spec)(segs)
