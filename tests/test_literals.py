"""The native test in front of the exact regex lane: it never drops a match, and little reaches Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from linetrawl import SearchSpec
from linetrawl.functions.literals import java_test, required
from linetrawl.functions.text import line_segments
from linetrawl.operators import matching
from linetrawl.operators.search import search_segments, search_texts


def spelt(runs):
    return ["".join(sorted(c)[0] if len(c) == 1 else "[" + "".join(sorted(c)) + "]" for c in run) for run in runs]


@pytest.mark.parametrize("pattern, want", [
    (r"(?P<host>[a-z0-9]+)\.(?:com|org|net)", ["com", "org", "net"]), (r"\bfoo(?:bar)?baz\b", ["foo"]), ("colou?r|gray", ["colo", "gray"]),
    ("(?=abc)\\w+", ["abc"]), ("(?!abc)\\w+", []), (r"(\w)\1", []), ("(?:abc){0,3}", []), ("(?:abc){2}x", ["abc"]), ("a(b)c(?:d|ef)", ["abc"]),
    ("x|", []), ("(?>long)er", ["long"]), ("[ab]c[^d]ee", ["[ab]c"]), ("", []), ("(?P<q>['\"]).*?(?P=q)", ["[\"']"])])
def test_what_a_match_must_hold(pattern, want):
    assert spelt(required(pattern, False)) == want


def test_case_is_ignored_as_python_ignores_it():
    assert spelt(required("sk", True)) == ["[Ss\u017f][Kk\u212a]"]
    assert spelt(required("(?i:a)b", False)) == ["[Aa]b"]


def _pattern(rng, depth=3):
    kind = rng.randrange(9) if depth else 0
    if kind < 3:
        return "".join(rng.choice(["a", "b", "k", "S", "é", "-", r"\.", "[ab]", r"\w", ".", "ß"]) for _ in range(rng.randrange(1, 4)))
    one, two = _pattern(rng, depth - 1), _pattern(rng, depth - 1)
    return {3: f"(?:{one}|{two})", 4: f"(?:{one}){rng.choice(['?', '*', '+', '{2}', '{0,2}', '{1,2}?'])}", 5: one + two, 6: f"({one}){two}",
            7: f"(?={one}){two}", 8: f"(?i:{one}){two}"}[kind]


def test_no_match_is_ever_dropped(spark):
    rng = random.Random(11)
    rows, tests = [], []
    while len(tests) < 150:
        pattern = _pattern(rng)
        ignore = rng.random() < 0.5
        runs = required(pattern, ignore)
        if not runs:
            continue
        tests.append(pattern)
        for _ in range(40):
            text = "".join(rng.choice("abkK\u017fSs\u212aé-.ß\u1e9e1") for _ in range(rng.randrange(9)))
            found = bool(re.search(pattern, text, re.IGNORECASE if ignore else 0))
            rows.append((pattern, java_test(runs), text, found))
    frame = spark.createDataFrame(rows, "pattern string, test string, text string, found boolean")
    assert sum(r[3] for r in rows) > 300
    assert frame.filter("found AND NOT text RLIKE test").collect() == []
    assert frame.filter("NOT found AND NOT text RLIKE test").count() > 1000


SPEC = SearchSpec((r"(?P<who>\w+)@(?P=who)\.org", r"(?<=id=)\d+(?!\d)"), mode="regex")


def test_hits_are_the_same_and_few_rows_reach_python(spark, monkeypatch):
    texts = [(f"f{i}", f"plain line {i}\nuser{i % 7}\n" + ("bob@bob.ORG ID=17\n" if i % 50 == 0 else "") + "bob at org") for i in range(1000)]
    files = spark.createDataFrame(texts, "path string, text string")
    segments = files.select("path", F.posexplode(F.split("text", "\n")).alias("idx", "text")).withColumn("locator", F.lit(""))
    runs = [lambda: search_texts(files, SPEC), lambda: search_segments(segments, SPEC)]
    got = [sorted(map(str, run().collect())) for run in runs]
    reaching = files.select(F.explode(matching.regex_candidates(line_segments(F.col("text")), SPEC)))
    assert reaching.count() == 20 and files.select(F.explode(line_segments(F.col("text")))).count() == 3020
    monkeypatch.setattr(matching, "required", lambda *_: [])
    assert matching.exact_test(SPEC) is None
    assert [sorted(map(str, run().collect())) for run in runs] == got and len(got[0]) == 40
