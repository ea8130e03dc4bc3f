"""Searching whole files (one row per file) and segment tables (many rows per file)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from linetrawl.functions.text import (
    line_locator, line_segments, normalize, normalize_literal, once, split_lines,
)
from linetrawl.operators import matching
from linetrawl.operators.ranks import running_total
from linetrawl.spec import SearchSpec
from linetrawl.workspace import shared_dir

HIT_COLUMNS = ["path", "seg_idx", "locator", "kw_idx", "position", "matched", "snippet"]
# Largest cap served by one window per file; the optimizer trims each task to the cap before the
# shuffle. Beyond it, ranks come from block counts so that no file is sorted in one task.
WINDOW_CAP = 100
BLOCK = 4096


def _in_python(spec: SearchSpec) -> bool:
    return spec.mode == "fuzzy" or (spec.mode == "regex" and not all(map(matching.is_portable, spec.keywords)))


def _with_hits(rows: DataFrame, kept: list[str], segs: Column, spec: SearchSpec, multiline: bool = False) -> DataFrame:
    """``kept`` columns and the ``hits`` of ``segs``; keyword mode reads ``_present`` as well.

    Expensive arrays pass through :func:`once`, Python functions get a plain column and give one.
    """
    empty = F.array().cast(matching.HIT_TYPE)
    if _in_python(spec):
        if spec.mode == "fuzzy":
            segs = matching.fuzzy_candidates(segs, spec, multiline)
        else:
            segs = matching.regex_candidates(segs, spec)
        rows = rows.select(*kept, once(segs).alias("_segs"))
        lane = matching.fuzzy_hits if spec.mode == "fuzzy" else matching.regex_hits_exact
        return rows.select(*kept, F.coalesce(lane(F.col("_segs"), spec), empty).alias("hits"))
    if spec.mode == "keyword":
        hits = matching.keyword_hits(segs, F.col("_present"), spec)
    else:
        hits = matching.regex_hits_native(segs, spec)
    return rows.select(*kept, once(F.coalesce(hits, empty)).alias("hits"))


def _has_break(keyword: str) -> bool:
    return len(keyword.splitlines()) > 1 or keyword != keyword.strip()


def file_hits(files: DataFrame, spec: SearchSpec, text: str = "text") -> DataFrame:
    """Add ``hits`` to rows that each hold a whole file. No shuffle: order, AND gate and cap are
    all decided inside the row. Files without a hit keep an empty array."""
    if not spec.keywords:
        return files.withColumn("hits", F.array().cast(matching.HIT_TYPE))
    kept = files.columns
    if spec.mode == "regex":
        segs = line_segments(F.col(text))
        if _in_python(spec) and (test := matching.exact_test(spec)):
            segs = F.when(F.col(text).rlike(test), segs)
        return _with_hits(files, kept, segs, spec)

    normal = files.withColumn("_norm", normalize(F.col(text), spec.case_sensitive, spec.normalize_width))
    if spec.mode == "fuzzy":
        return _with_hits(normal, kept, line_segments(F.col("_norm")), spec)

    if matching.is_many(spec):
        rows = normal.select(*kept, once(line_segments(F.col("_norm"))).alias("_segs"))
        shared = matching.share_keywords(files.sparkSession, spec)
        hits = matching.automaton_hits(F.col("_segs"), spec, shared, gate=spec.operator == "and")
        return rows.select(*kept, F.coalesce(hits, F.array().cast(matching.HIT_TYPE)).alias("hits"))

    keywords = matching.keyword_array(spec)
    normal = normal.withColumn(
        "_present", F.filter(keywords, lambda k: F.contains(F.col("_norm"), k["norm"]))
    )
    breaks = spec.operator == "and" and any(_has_break(k) for k in spec.keywords)
    wanted = F.size("_present") == F.size(keywords) if spec.operator == "and" and not breaks else F.size("_present") > 0
    segs = F.when(wanted, line_segments(F.col("_norm")))
    if breaks:
        # Blank lines and line-break variants matter to such keywords: gate on the joined segments alone.
        normal = normal.withColumn("_segs", segs)
        joined = F.array_join(F.transform("_segs", lambda s: s["text"]), "\n")
        segs = F.when(F.forall(keywords, lambda k: F.contains(joined, k["norm"])), F.col("_segs"))
    return _with_hits(normal, kept, segs, spec)


def explode_hits(searched: DataFrame, *carry: str) -> DataFrame:
    """One row per hit of :func:`file_hits`, with the line locator; ``carry`` keeps more columns."""
    return searched.select("path", *carry, F.explode("hits").alias("h")).select(
        "path", *carry, "h.seg_idx", line_locator(F.col("h.line_no")).alias("locator"),
        "h.kw_idx", "h.position", "h.matched", "h.snippet",
    )


def search_texts(files: DataFrame, spec: SearchSpec) -> DataFrame:
    """Hits of a ``(path, text)`` table whose rows are whole files."""
    return explode_hits(file_hits(files.select("path", "text"), spec))


def limit_hit_files(searched: DataFrame, n: int, order: str = "file_ord") -> DataFrame:
    """Only the first ``n`` files that have hits, in input order (a bounded top-k)."""
    return searched.filter(F.size("hits") > 0).orderBy(order).limit(n)


def first_hit_files(files: DataFrame, spec: SearchSpec, n: int, order: str = "file_ord", parts: int = 4096, growth: int = 8) -> DataFrame:
    """What ``limit_hit_files`` gives of the searched ``files``, but only as many files are searched as it takes.

    ``order`` is a whole number. Ranges of it are searched one after the other, the first a ``parts``-th of all and each next one
    ``growth`` times as wide, until ``n`` files have hits; a filter on the range reaches the scan, so a table that is laid out in this order
    is read no further. The rounds are few, whatever the hits: with none at all every file is searched once. Found
    files, ``n`` at most, are kept in the shared folder. Files without a number come first.
    """
    low, high = files.agg(F.min(order), F.max(order)).first()
    found, missing, start = [], n, low
    width = 1 if low is None else max(1, (high - low + 1) // parts)
    place = F.col(order)
    while missing > 0:
        inside = F.lit(True) if low is None else (place >= start) & (place < start + width)
        some = files.filter(inside | place.isNull() if start == low else inside)
        out = shared_dir(files.sparkSession, "first-files")
        limit_hit_files(file_hits(some, spec), missing, order).write.parquet(out)
        part = files.sparkSession.read.parquet(out)
        found.append(part)
        missing -= part.count()
        if low is None or start + width > high:
            break
        start, width = start + width, width * growth
    return reduce(DataFrame.unionByName, found) if found else file_hits(files, spec).limit(0)


# --------------------------------------------------------------------------------- segment tables
def search_segments(segments: DataFrame, spec: SearchSpec) -> DataFrame:
    """Hits of a ``(path, idx, locator, text)`` table, capped per file across its segments."""
    raw = segments.select("path", F.col("idx").alias("seg_idx"), "locator", "text")
    if not spec.keywords:
        return raw.filter(F.lit(False)).select(
            "path", "seg_idx", "locator", F.lit(0).alias("kw_idx"), F.lit(0).cast("bigint").alias("position"),
            F.lit("").alias("matched"), F.lit("").alias("snippet"),
        )
    if spec.mode != "regex":
        raw = raw.withColumn("text", normalize(F.col("text"), spec.case_sensitive, spec.normalize_width))
    found = cap_hits(_segment_hits(raw, spec), spec.max_hits_per_file).select(*HIT_COLUMNS)
    if spec.mode == "keyword" and spec.operator == "and":
        gate = _files_with_many if matching.is_many(spec) else _files_with_all
        found = found.join(gate(raw, list(_norms(spec).values())), "path", "left_semi")
    return found


def _norms(spec: SearchSpec) -> dict[int, str]:
    norms = {
        i: normalize_literal(k, spec.case_sensitive, spec.normalize_width)
        for i, k in enumerate(spec.keywords)
    }
    return {i: n for i, n in norms.items() if n}


def _segment_hits(raw: DataFrame, spec: SearchSpec) -> DataFrame:
    one = F.array(F.struct(
        F.lit(0).alias("seg_idx"), F.lit(None).cast("int").alias("line_no"), F.col("text").alias("text")
    ))
    if matching.is_many(spec):
        shared = matching.share_keywords(raw.sparkSession, spec)
        rows = raw.select("path", "seg_idx", "locator", once(one).alias("_segs"))
        found = rows.select("path", "seg_idx", "locator", matching.automaton_hits(F.col("_segs"), spec, shared, gate=False).alias("hits"))
        return _exploded(found)
    if spec.mode == "keyword":
        keywords = matching.keyword_array(spec)
        raw = raw.withColumn("_present", F.filter(keywords, lambda k: F.contains(F.col("text"), k["norm"])))
        raw = raw.filter(F.size("_present") > 0)
    return _exploded(_with_hits(raw, ["path", "seg_idx", "locator"], one, spec, multiline=True))


def _exploded(found: DataFrame) -> DataFrame:
    return (
        found.select("path", "seg_idx", "locator", F.posexplode("hits").alias("hit_ord", "h"))
        .select("path", "seg_idx", "locator", "hit_ord",
                "h.kw_idx", "h.position", "h.matched", "h.snippet")
    )


def _with_following(raw: DataFrame, span: int, block: int = BLOCK) -> DataFrame:
    """``(path, joined)``: every segment followed by its next ``span`` ones, joined by newlines.

    Neighbours are looked up inside blocks of a file. The segments at the edges of the blocks are a
    small table of their own, in which the last ones of a block meet the first ones of the next.
    """
    inside = Window.partitionBy("path", "_block").orderBy("seg_idx")
    backward = Window.partitionBy("path", "_block").orderBy(F.desc("seg_idx"))
    across = Window.partitionBy("path").orderBy("seg_idx")

    def joined(window):
        return F.concat_ws("\n", "text", *[F.lead("text", i).over(window) for i in range(1, span + 1)])

    ranked = (
        raw.withColumn("_block", F.floor(F.col("seg_idx") / block))
        .withColumn("_joined", joined(inside))
        .withColumn("_first", F.row_number().over(inside)).withColumn("_last", F.row_number().over(backward))
    )
    interior = ranked.filter(F.col("_last") > span)
    edges = ranked.filter((F.col("_last") <= span) | (F.col("_first") <= span))
    edges = edges.withColumn("_joined", joined(across)).filter(F.col("_last") <= span)
    return interior.select("path", "_joined").unionAll(edges.select("path", "_joined"))


def _files_with_all(raw: DataFrame, norms: list[str]) -> DataFrame:
    """AND gate on the newline-joined segments: a plain boolean aggregate per file.

    A keyword with m line breaks touches at most m + 1 neighbouring segments, so each segment is
    then extended by its next ones.
    """
    span = max(k.count("\n") for k in norms)
    flags = [F.bool_or(F.contains(F.col("_joined"), F.lit(k))).alias(f"k{i}") for i, k in enumerate(norms)]
    joined = _with_following(raw, span) if span else raw.select("path", F.col("text").alias("_joined"))
    verdict = joined.groupBy("path").agg(*flags)
    for i in range(len(norms)):
        verdict = verdict.filter(F.col(f"k{i}"))
    return verdict.select("path")


def _files_with_many(raw: DataFrame, norms: list[str]) -> DataFrame:
    """The same gate for many keywords: the distinct ones per file are counted, partially in every task.

    The few with line breaks, which may lie across segments, are gated as before.
    """
    single = sorted({n for n in norms if "\n" not in n})
    if not single:
        return _files_with_all(raw, norms)
    spec = SearchSpec(tuple(single), case_sensitive=True, normalize_width=False)
    shared = matching.share_keywords(raw.sparkSession, spec)
    present = raw.select("path", F.explode(matching.automaton_present(F.col("text"), shared)).alias("_word"))
    full = present.distinct().groupBy("path").count().filter(F.col("count") == len(single)).select("path")
    across = sorted({n for n in norms if "\n" in n})
    return full.join(_files_with_all(raw, across), "path", "left_semi") if across else full


def segment_hits(segments: DataFrame, spec: SearchSpec) -> DataFrame:
    """Hits of segments before gate and cap over a whole file: no more of each file than its cap takes, with ``hit_ord`` to go on from."""
    raw = segments.select("path", F.col("idx").cast("bigint").alias("seg_idx"), "locator", "text")
    columns = ["path", "seg_idx", "hit_ord", "locator", "kw_idx", F.col("position").cast("bigint").alias("position"), "matched", "snippet"]
    if not spec.keywords:
        nothing = raw.filter(F.lit(False)).withColumn("hits", F.array().cast(matching.HIT_TYPE))
        return _exploded(nothing).select(*columns)
    if spec.mode != "regex":
        raw = raw.withColumn("text", normalize(F.col("text"), spec.case_sensitive, spec.normalize_width))
    return cap_hits(_segment_hits(raw, spec), spec.max_hits_per_file).select(*columns)


class StandingGate:
    """The AND gate in two steps, so that the segments of a file may come at different times.

    ``present`` keeps which keywords each file's segments hold, by their place among the distinct ones; ``complete`` puts any
    number of such tables together. Keywords with line breaks may lie across segments of different times, so for them the texts
    are kept (``normalized``) and gated as a whole (``spanned``).
    """

    def __init__(self, spec: SearchSpec):
        self.spec = spec
        norms = sorted(set(_norms(spec).values())) if spec.mode == "keyword" and spec.operator == "and" else []
        self.single = [n for n in norms if "\n" not in n]
        self.across = [n for n in norms if "\n" in n]

    def normalized(self, segments: DataFrame) -> DataFrame:
        text = normalize(F.col("text"), self.spec.case_sensitive, self.spec.normalize_width)
        return segments.select("path", F.col("idx").cast("bigint").alias("seg_idx"), text.alias("text"))

    def present(self, segments: DataFrame) -> DataFrame:
        """``(path, words)``: a row for each file with any; partial in every task, bounded by the keywords."""
        raw = self.normalized(segments)
        if len(self.single) > matching.AUTOMATON_FROM:
            shared = matching.share_keywords(segments.sparkSession, SearchSpec(tuple(self.single), case_sensitive=True, normalize_width=False))
            words = matching.automaton_present(F.col("text"), shared)
        else:
            held = F.array(*[F.when(F.contains("text", F.lit(n)), F.lit(i)) for i, n in enumerate(self.single)])
            words = F.filter(held, lambda w: w.isNotNull())
        found = raw.select("path", F.explode(words).alias("word")).distinct()
        return found.groupBy("path").agg(F.collect_set(F.col("word").cast("int")).alias("words"))

    def complete(self, present: DataFrame) -> DataFrame:
        """Paths whose rows hold every keyword between them."""
        found = present.select("path", F.explode("words").alias("word")).distinct()
        return found.groupBy("path").count().filter(F.col("count") == len(self.single)).select("path")

    def spanned(self, texts: DataFrame) -> DataFrame:
        return _files_with_all(texts, self.across)


def cap_hits(hits: DataFrame, n: int) -> DataFrame:
    """First ``n`` hits of each file in (segment, hit) order."""
    order = [F.col("seg_idx"), F.col("hit_ord")]
    if n <= WINDOW_CAP:
        rank = F.row_number().over(Window.partitionBy("path").orderBy(*order))
        return hits.withColumn("_rn", rank).filter(F.col("_rn") <= n).drop("_rn")
    ranked = running_total(hits, ["path"], ["seg_idx", "hit_ord"], F.lit(1), "_before", BLOCK)
    return ranked.filter(F.col("_before") < n).drop("_before")


# ------------------------------------------------------------------------------ without a cap
def all_positions(segments: DataFrame, spec: SearchSpec) -> DataFrame:
    """Every non-overlapping occurrence of every keyword: ``(path, seg_idx, kw_idx, position)``.

    Decided inside the row: the text is cut at the keyword and the lengths of the pieces are summed up, or, for many
    keywords, one pass of an automaton finds them all.
    """
    normal = segments.select(
        "path", F.col("idx").alias("seg_idx"),
        normalize(F.col("text"), spec.case_sensitive, spec.normalize_width).alias("_t"))
    if matching.is_many(spec):
        places = matching.automaton_places(F.col("_t"), matching.share_keywords(segments.sparkSession, spec))
        return normal.select("path", "seg_idx", F.explode(places).alias("h")).select("path", "seg_idx", "h.kw_idx", "h.position")
    keywords = matching.keyword_array(spec)
    found = normal.withColumn("k", F.explode(F.filter(keywords, lambda k: F.contains(F.col("_t"), k["norm"]))))
    every = matching.literal_positions(F.col("_t"), F.col("k.norm"), F.col("k.quoted"), 2**31 - 2)
    return found.select("path", "seg_idx", "k.kw_idx", F.explode(every).alias("position"))


def line_offsets(texts: DataFrame) -> DataFrame:
    """``(path, line_no, offset)``: where each line of ``(path, text)`` starts, in characters.

    A CR LF pair is one terminator of two characters; every other terminator is one. Sums inside the row, no shuffle.
    """
    unified = F.replace(F.col("text"), F.lit("\r\n"), F.lit("\x00\n"))  # keeps the width of the pair
    lines = split_lines(F.when(F.col("text").contains("\r\n"), unified).otherwise(F.col("text")))
    steps = F.transform(lines, lambda line: (F.char_length(line) + 1).cast("bigint"))
    cut = texts.select("path", once(steps).alias("_steps"))
    ends = cut.select("path", "_steps", once(matching.running_sums(F.col("_steps"))).alias("_ends"))
    starts = F.zip_with("_ends", "_steps", lambda end, step: end - step)
    return ends.select("path", F.posexplode(starts).alias("i", "offset")).select(
        "path", (F.col("i") + 1).cast("bigint").alias("line_no"), "offset")
