import random
import re
import unicodedata

import brute
import pytest
from pyspark.sql import functions as F

from linetrawl import SearchSpec
from linetrawl.functions.similarity import best_match, cluster_pattern, could_match
from linetrawl.functions.text import casefold, nfkc, normalize
from linetrawl.operators.matching import is_portable
from linetrawl.plans import fixtures as fx
from linetrawl.operators.search import _with_following, cap_hits, search_segments, search_texts


def rows(hits):
    got = hits.select("path", "locator", "position", "matched", "snippet").collect()
    by_path = {}
    for r in got:
        by_path.setdefault(r.path, []).append(tuple(r)[1:])
    return {p: sorted(v) for p, v in by_path.items()}


def expect(files, spec):
    out = {p: sorted(brute.search(segs, spec)) for p, segs in files.items()}
    return {p: v for p, v in out.items() if v}


def check_segments(spark, files, spec):
    df = spark.createDataFrame(
        [(p, i, loc, t) for p, segs in files.items() for i, (loc, t) in enumerate(segs)],
        "path string, idx int, locator string, text string",
    ).repartition(3)
    assert rows(search_segments(df, spec)) == expect(files, spec)


def check_texts(spark, texts, spec):
    df = spark.createDataFrame(list(texts.items()), "path string, text string")
    files = {p: [(f"行 {n}", t) for n, t in brute.segments(text)] for p, text in texts.items()}
    assert rows(search_texts(df, spec)) == expect(files, spec)


NOISE = ["foo", "FOO", "bar", "Straße", "ＡＢＣ１２３", "abc123", "東京", "六本木", "カフェ", "ｶﾌｪ", "ﬁne", "Σίσυφος",
         "x", " ", "\t", "　", "\n", "\r\n", "\x85", " ", "\x1c", "a.b", "(c)", "\\E", "😀", "é", "İ"]


def noise_text(rng, n):
    return "".join(rng.choice(NOISE) for _ in range(n))


KEYWORDS = [("foo", "bar"), ("FOO",), ("strasse",), ("abc123",), ("東京", "六本木"), ("カフェ",), ("fine", "foo", "foo"),
            ("σίσυφοσ",), ("\\E", "(c)"), ("o\nb",), (" ",), ("😀", "é"), ("ofo",)]


@pytest.mark.parametrize("operator", ["and", "or"])
@pytest.mark.parametrize("keywords", KEYWORDS)
def test_keyword_modes_equal_brute_force(spark, operator, keywords):
    rng = random.Random(repr(keywords))
    texts = {f"/f{i}": noise_text(rng, rng.choice([3, 20, 120])) for i in range(60)}
    case, width, cap = ((False, True, 20), (True, False, 3))[(operator == "and") ^ (len(keywords) > 1)]
    spec = SearchSpec(keywords, "keyword", operator, case, width, snippet_chars=7, max_hits_per_file=cap)
    check_texts(spark, texts, spec)


@pytest.mark.parametrize("operator", ["and", "or"])
@pytest.mark.parametrize("keywords", [("foo", "bar"), ("東京", "六本木", "foo"), ("o\nb", "foo"), ("foo", "foo")])
@pytest.mark.parametrize("cap", [3, 150])
def test_segment_tables_equal_brute_force(spark, operator, keywords, cap):
    rng = random.Random(7)
    files = {
        f"/f{i}": [(f"L{j}", noise_text(rng, rng.choice([1, 8, 60]))) for j in range(rng.choice([1, 4, 30]))]
        for i in range(25)
    }
    check_segments(spark, files, SearchSpec(keywords, "keyword", operator, snippet_chars=5, max_hits_per_file=cap))


def test_and_gate_sees_keywords_beyond_the_cap(spark):
    files = {"/a": [("1", "foo " * 50 + "bar")], "/b": [("1", "foo " * 50)], "/c": [("1", "foo"), ("2", "bar")]}
    spec = SearchSpec(("foo", "bar"), max_hits_per_file=3)
    check_segments(spark, files, spec)
    check_texts(spark, {p: "\n".join(t for _, t in s) for p, s in files.items()}, spec)


PATTERNS = [(r"[A-Z]{3}\d{3}",), (r"fo+", "ba?r"), (r"(foo|bar)x?",), (r"^foo", "bar$"), (r"a.b",), (r"\w+",), (r"x*",),
            (r"(?P<q>o)(?P=q)",), (r"\bfoo\b",), (r"(?<=f)oo",), (r"[^a-z]o",), (r"東京|foo",)]


@pytest.mark.parametrize("patterns", PATTERNS)
def test_regex_lanes_equal_brute_force(spark, patterns):
    rng = random.Random(repr(patterns))
    texts = {f"/f{i}": noise_text(rng, 60) for i in range(40)}
    files = {f"/s{i}": [(f"L{j}", noise_text(rng, 30)) for j in range(5)] for i in range(15)}
    for case in (False, True):
        spec = SearchSpec(patterns, "regex", case_sensitive=case, snippet_chars=4, max_hits_per_file=12)
        check_texts(spark, texts, spec)
    check_segments(spark, files, spec)


def test_portable_patterns():
    assert all(map(is_portable, [r"fo+", r"[A-Z]{3}\d{3}", r"(a|b)?c", r"a\.b", r"lic[a-z]+"]))
    assert not any(map(is_portable, [r"\w+", r"x*", r"(?P<n>a)", r"\bfoo", r"(?=a)b", r"[[a]", r"é+", r"a++b", r"a\Z", r"(a|b)+c?", r"([a-z]+ )+", r"(?:ab){2,}", r"(ab){3}"]))


WORDS = ["quick", "quik", "brown", "bron", "fox", "the", "lazy", "dog", "license", "licnse", "ＱＵＩＣＫ"]


@pytest.mark.parametrize("threshold", [0.0, 0.6, 0.7, 0.8, 0.9, 1.0])
def test_fuzzy_equals_brute_force(spark, threshold):
    rng = random.Random(threshold)
    line = lambda k: rng.choice(["", "  ", "\t"]) + " ".join(rng.choice(WORDS) for _ in range(k))
    texts = {f"/f{i}": "\n".join(line(rng.choice([1, 2, 3, 12, 60])) for _ in range(12)) for i in range(30)}
    spec = SearchSpec(("quick brown fox", "license", "q"), "fuzzy", fuzzy_threshold=threshold,
                      snippet_chars=6, max_hits_per_file=15)
    check_texts(spark, texts, spec)
    files = {p: [("A", t), ("B", t[:30])] for p, t in texts.items()}
    check_segments(spark, files, spec)


def test_fuzzy_bound_never_drops_a_match(spark):
    rng = random.Random(5)
    cases = []
    for _ in range(4000):
        needle = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 12))).strip() or "a"
        hay = "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 60)))
        if rng.random() < 0.5:
            at = rng.randint(0, len(hay))
            hay = hay[:at] + needle[:rng.randint(0, len(needle))] + hay[at:]
        cases.append((needle, hay))
    for needle in {n for n, _ in cases[:10]}:
        lines = [h for _, h in cases[:600]]
        for t in (0.5, 0.8):
            df = spark.createDataFrame([(h,) for h in lines], "t string")
            kept = {r.t for r in df.filter(could_match(F.col("t"), needle, t)).collect()}
            hits = {h for h in lines if h.strip() and brute.window(h.strip(), needle, t)}
            assert hits <= kept
    for needle, hay in cases:
        for t in (0.5, 0.8, 0.95):
            want, cluster = brute.window(hay, needle, t), cluster_pattern(needle, t)
            assert best_match(hay, needle, t) == want
            assert best_match(hay, needle, t, cluster and re.compile(cluster)) == want


def test_icu_equals_python_on_every_assigned_character(spark):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    rng = random.Random(1)
    odd = [c for c in chars if c.casefold() != c or unicodedata.normalize("NFKC", c) != c or unicodedata.combining(c)]
    chars += ["".join(rng.choice(odd) for _ in range(6)) for _ in range(20000)]
    df = spark.createDataFrame([(c,) for c in chars], "t string")
    got = df.select("t", nfkc(F.col("t")).alias("n"), casefold(F.col("t")).alias("f"), normalize(F.col("t")).alias("b")).collect()
    bad = [r.t for r in got if r.n != unicodedata.normalize("NFKC", r.t) or r.f != r.t.casefold()
           or r.b != unicodedata.normalize("NFKC", r.t).casefold()]
    assert bad == []


def test_null_and_empty_inputs(spark):
    df = spark.createDataFrame([("/a", None), ("/b", ""), ("/c", "foo")], "path string, text string")
    for mode in ("keyword", "regex", "fuzzy"):
        assert [r.path for r in search_texts(df, SearchSpec(("foo",), mode)).collect()] == ["/c"]
        assert search_texts(df, SearchSpec((), mode)).count() == 0
    segs = df.selectExpr("path", "0 as idx", "'' as locator", "text")
    assert [r.path for r in search_segments(segs, SearchSpec(("foo",))).collect()] == ["/c"]
    assert search_segments(segs, SearchSpec(())).count() == 0


@pytest.mark.parametrize("bad", [
    dict(mode="nope"), dict(operator="xor"), dict(fuzzy_threshold=1.5), dict(snippet_chars=-1),
    dict(max_hits_per_file=0), dict(mode="regex", keywords=("[open",)),
])
def test_invalid_specs_are_rejected(bad):
    with pytest.raises((ValueError, re.error)):
        SearchSpec(**{"keywords": ("x",), **bad})


def test_block_ranks_equal_window_ranks(spark):
    hits = spark.range(20000).selectExpr(
        "case when id % 3 = 0 then 'hot' else concat('p', id % 50) end path", "cast(id * 7 % 20011 as int) seg_idx", "0 hit_ord")
    want = hits.selectExpr("*", "row_number() over (partition by path order by seg_idx, hit_ord) rn")
    got = cap_hits(hits, 130)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.filter("rn <= 130").drop("rn").collect()))


def test_whole_file_search_does_not_shuffle(spark):
    df = spark.createDataFrame([("/a", "foo")], "path string, text string")
    for mode in ("keyword", "regex", "fuzzy"):
        plan = search_texts(df, SearchSpec(("foo",), mode))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_segment_and_gate_shuffles_trimmed_rows_only(spark):
    segs = spark.createDataFrame([("/a", 0, "L", "foo")], "path string, idx int, locator string, text string")
    plan = search_segments(segs, SearchSpec(("foo", "bar")))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "collect_set" not in plan and plan.count("LeftSemi") == 1


@pytest.mark.parametrize("span", [1, 3])
def test_neighbours_across_blocks(spark, span):
    df = spark.range(300).selectExpr("if(id % 3 = 0, 'hot', concat('p', id % 9)) path", "cast(id * id as int) seg_idx", "concat('t', id) text")
    by_path = {}
    for r in df.orderBy("seg_idx").collect():
        by_path.setdefault(r.path, []).append(r.text)
    want = sorted((p, "\n".join(t[i:i + span + 1])) for p, t in by_path.items() for i in range(len(t)))
    for block in (1, 2000, 10 ** 6):
        assert sorted(map(tuple, _with_following(df, span, block).collect())) == want


def test_registered_fuzzy_queries_equal_brute_force(spark, sf_dir):
    from linetrawl.plans import catalog, search_queries
    docs = fx.documents(spark, sf_dir).select("path", "text").collect()
    spec = SearchSpec(search_queries.FUZZY, mode="fuzzy")
    files = {r.path: [(f"行 {n}", t) for n, t in brute.segments(r.text)] for r in docs}
    assert rows(catalog.QUERIES["fz_hits"](spark, sf_dir)) == expect(files, spec)
    turns, spec = {}, SearchSpec(("than the", "ention"), mode="fuzzy")
    for r in fx.turns_v(spark, sf_dir).orderBy("path", "idx").collect():
        turns.setdefault(r.path, []).append((r.locator, r.text))
    assert rows(catalog.QUERIES["fz_segments"](spark, sf_dir)) == expect(turns, spec)
    from difflib import SequenceMatcher
    want = {(r.path, i): SequenceMatcher(None, "license", t).ratio() for r in docs for i, (_, t) in enumerate(brute.segments(r.text))}
    got = {(r.path, r.idx): r.ratio for r in catalog.QUERIES["fz_ratio"](spark, sf_dir).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_looped_groups_over_long_lines(spark):
    """Java would match every round of the group on its stack."""
    text = "ab" * 500_000 + "c"
    for pattern in (r"(a|b)+c?", r"[a-z]+"):
        spec = SearchSpec((pattern,), mode="regex", max_hits_per_file=3)
        got = search_texts(spark.createDataFrame([("/a", text)], "path string, text string"), spec).select("position", F.length("matched").alias("n")).collect()
        want = [(m.start(), len(m[0])) for m in re.finditer(pattern, text, re.I)][:3]
        assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("n", [1, 255, 256, 257, 512, 513, 3000])
def test_many_hits_in_a_line_and_in_many_lines(spark, n):
    spec = SearchSpec(("ab",), max_hits_per_file=10**7)
    one = spark.createDataFrame([("/a", "xab" * n), ("/b", "xab\n" * n)], "path string, text string")
    got = search_texts(one, spec).orderBy("path", "seg_idx", "position").select("path", "seg_idx", "position").collect()
    assert [tuple(r) for r in got] == [("/a", 0, 3 * i + 1) for i in range(n)] + [("/b", i, 1) for i in range(n)]
    rx = SearchSpec(("a[b]",), mode="regex", max_hits_per_file=10**7)
    assert [r.position for r in search_texts(one.filter("path = '/a'"), rx).orderBy("position").collect()] == [3 * i + 1 for i in range(n)]


def test_column_letters_of_large_numbers(spark):
    from linetrawl.functions.paths import column_letters

    def want(n):
        out = ""
        while n > 0:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out
    numbers = [0, 1, 26, 27, 702, 703, 8_353_082_582, 8_353_082_583, 2**63 - 1]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", column_letters(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == {n: want(n) for n in numbers}
