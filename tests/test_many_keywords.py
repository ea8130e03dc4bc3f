"""The automaton lane against brute force and against the lane of single keywords."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from linetrawl import SearchSpec
from linetrawl.operators import automaton, matching
from linetrawl.operators.search import all_positions, file_hits, search_segments, search_texts


def every(text, word):
    return [i for i in range(len(text)) if text.startswith(word, i)]


@pytest.mark.parametrize("cells", [automaton.CELLS, 60])
def test_occurrences_equal_brute_force(monkeypatch, cells):
    """Also with many automata, long texts in pieces, empty texts and words inside words."""
    monkeypatch.setattr(automaton, "CELLS", cells)
    rng = random.Random(cells)
    for _ in range(60):
        words = sorted({"".join(rng.choice("ab c\U0001f600") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))})
        texts = ["".join(rng.choice("ab cdé\U0001f600") for _ in range(rng.choice([0, 1, 5, 40, 900]))) for _ in range(5)]
        keywords = automaton.Keywords(list(enumerate(words)))
        points, starts = automaton.code_points(texts)
        positions, found = keywords.occurrences(points, starts)
        want = sorted((int(s) + p, i) for s, t in zip(starts, texts) for i, w in enumerate(words) for p in every(t, w))
        assert sorted(zip(positions.tolist(), found.tolist())) == want
    assert len(keywords.automata) == 1 or cells == 60


def test_repeats_of_one_keyword_do_not_overlap():
    keywords = automaton.Keywords([(0, "aa"), (1, "aba"), (2, "aa")])
    assert (keywords.words, keywords.places.tolist(), keywords.bordered.tolist()) == (["aa", "aba"], [0, 2, 1], [True, True])
    text = np.array([0, 0, 0, 1, 1])
    kept = keywords.apart(text, np.array([0, 1, 2, 0, 2]), np.array([0, 0, 0, 0, 1]))
    assert kept.tolist() == [True, False, True, True, True]
    which, place = keywords.listed(np.array([1, 0]))
    assert (which.tolist(), place.tolist()) == ([0, 1, 1], [1, 0, 2])


FILES = [("a", "x aaaa B\n\n abé aa\r\nbab"), ("b", ""), ("c", None), ("d", "aa" * 5000 + "\nstraße STRASSE ｆｕｌｌ"), ("e", "no\nhit"), ("f", "a\x0bb c")]
WORDS = ["aa", "a", "ab", "b", "bab", "strasse", "full", "é", "AA", "x aa", "o\nh", "zz", "  "]


@pytest.mark.parametrize("words, operator, cap", [
    (WORDS, "or", 20), (WORDS, "or", 3), (["a", "b", "aa"], "and", 20), (["a", "b", "a\nb"], "and", 20), (["o", "hit", "o\nh"], "and", 20), (WORDS, "or", 300)])
def test_both_lanes_agree(spark, monkeypatch, words, operator, cap):
    files = spark.createDataFrame(FILES, "path string, text string")
    segments = spark.createDataFrame(
        [(p, i, f"l{i}", line) for p, t in FILES for i, line in enumerate((t or "").split("\n"))] + [("g", 0, "", None), ("g", 1, "", "two\nlines aa")],
        "path string, idx int, locator string, text string")
    spec = SearchSpec(tuple(words), operator=operator, max_hits_per_file=cap)
    runs = [lambda: search_texts(files, spec), lambda: search_segments(segments, spec), lambda: all_positions(segments, spec)]
    want = [sorted(map(tuple, run().collect())) for run in runs]
    assert any(want)
    monkeypatch.setattr(matching, "AUTOMATON_FROM", 0)
    for chars in (automaton.CHUNK, 5):
        monkeypatch.setattr(matching, "CHUNK_CHARS", chars)
        assert [sorted(map(tuple, run().collect())) for run in runs] == want


def test_many_keywords_equal_brute_force(spark):
    rng = random.Random(7)
    words = tuple({"".join(rng.choice("abcde ") for _ in range(rng.randrange(2, 5))) for _ in range(400)})
    assert len(words) > matching.AUTOMATON_FROM
    texts = [(f"f{i}", "\n".join("".join(rng.choice("abcdef ") for _ in range(rng.randrange(60))) for _ in range(6))) for i in range(40)]
    spec = SearchSpec(words, operator="or", max_hits_per_file=30)
    rows = search_texts(spark.createDataFrame(texts, "path string, text string"), spec).collect()
    want = [(p, *h) for p, t in texts for h in brute.search([(f"行 {n}", line) for n, line in brute.segments(t)], spec)]
    got = sorted(rows, key=lambda r: (r.path, r.seg_idx, r.kw_idx, r.position))
    assert [(r.path, r.locator, r.position, r.matched, r.snippet) for r in got] == sorted(want, key=lambda w: w[0])


def test_ten_thousand_keywords_take_at_most_three_times_as_long_as_ten(spark):
    """Both in the JVM's warm state, over the same texts; the automaton is built and shared within the time."""
    rng = random.Random(5)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    vocabulary = list({"".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5))) for _ in range(40_000)})
    rows = [(f"f{i}", "\n".join(" ".join(rng.choices(vocabulary, k=12)) for _ in range(40))) for i in range(3000)]
    files = spark.createDataFrame(rows, "path string, text string").repartition(4).persist()
    files.count()

    def seconds(n):
        spec = SearchSpec(tuple(vocabulary[:n]), operator="or")
        times = []
        for _ in range(3):
            start = time.perf_counter()
            hits = file_hits(files, spec).agg(F.sum(F.size("hits"))).first()[0]
            times.append(time.perf_counter() - start)
        return min(times), hits

    (few, some), (many, all_) = seconds(10), seconds(10_000)
    files.unpersist()
    assert all_ > 50 * some > 0
    assert many <= 3 * few + 1, (few, many)
