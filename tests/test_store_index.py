"""Searching the store through its trigram index: the same hits, other groups never opened."""

import collections
import time

import pytest
from pyspark.sql import functions as F

from linetrawl import SearchSpec
from linetrawl.operators.search import search_segments
from linetrawl.sinks import index
from linetrawl.sinks.store import SegmentStore

_Row = collections.namedtuple("_Row", "grp bucket bits")


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    """300 files in three puts; the last replaces some files of the first."""
    ids = spark.range(300)
    text = F.concat(F.lit("Some Text number x"), F.col("id") * 7919, F.lit(" Straße ｆｕｌｌ "), F.when(F.col("id") % 100 == 7, F.lit("needle")).otherwise(F.lit("hay")))
    segments = ids.select(F.concat(F.lit("f"), "id").alias("path"), F.explode(F.array(F.lit(0), F.lit(1))).alias("idx"), F.lit("l").alias("locator"), text.alias("text"))
    segments = segments.withColumn("text", F.when(F.col("idx") == 0, F.col("text")).otherwise(F.concat(F.lit("second line of "), "path")))
    store = SegmentStore(spark, str(tmp_path_factory.mktemp("store") / "s"), groups=8)
    files = lambda rows: rows.select("path").distinct().select("path", F.lit("2024-01-01").cast("timestamp").alias("mtime"), F.lit(1).cast("bigint").alias("size"))
    first, second = segments.filter("path < 'f2'"), segments.filter("path >= 'f2'")
    stale = first.withColumn("text", F.concat(F.lit("outdated "), "text"))
    for rows in (stale, second, first.filter("path < 'f15'"), first.filter("path >= 'f15'"), segments.limit(0)):
        store.put(files(rows), rows)
    return store, segments


def hits(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("words, operator, mode", [
    (("needle",), "or", "keyword"), (("NEEDLE", "x55433 "), "and", "keyword"), (("x7919 ", "x15838 "), "or", "keyword"), (("strasse", "full"), "and", "keyword"),
    (("nowhere at all",), "or", "keyword"), (("le", "needle"), "or", "keyword"), (("le", "needle"), "and", "keyword"), (("e\nl", "needle"), "and", "keyword"),
    (("second line of f7", "needle"), "and", "keyword"), (("outdated",), "or", "keyword"), (("need[l]e",), "or", "regex")])
def test_hits_are_those_of_all_segments(filled, words, operator, mode):
    store, segments = filled
    spec = SearchSpec(words, operator=operator, mode=mode)
    assert hits(store.search(spec)) == hits(search_segments(segments, spec))
    exact = SearchSpec(words, operator=operator, mode=mode, normalize_width=False, case_sensitive=True)
    assert hits(store.search(exact)) == hits(search_segments(segments, exact))


def test_groups_are_left_out(filled):
    store, _ = filled
    every = store.groups_for(SearchSpec(("number",)))
    assert len(every) == 32 and store.groups_for(SearchSpec(("le",), operator="or")) is None
    assert len(store.groups_for(SearchSpec(("needle",)))) <= 6 and store.groups_for(SearchSpec(("nowhere at all",))) == []
    assert 0 < len(store.groups_for(SearchSpec(("x55433 ",)))) <= 2
    assert store.groups_for(SearchSpec(("number",), mode="regex")) is None


def test_other_groups_are_not_opened(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "s"), groups=4)
    rows = spark.createDataFrame([(f"p{i}", 0, "", "the needle" if i == 5 else f"hay {i}") for i in range(40)], "path string, idx int, locator string, text string")
    store.put(rows.select("path", F.current_timestamp().alias("mtime"), F.lit(1).cast("bigint").alias("size")), rows)
    spec = SearchSpec(("needle",))
    (gen, grp), = store.groups_for(spec)
    for other in (tmp_path / "s" / "segments" / f"gen={gen}").glob("grp=*/*.parquet"):
        if other.parent.name != f"grp={grp}":
            other.write_bytes(b"unreadable")
    assert [r.path for r in store.search(spec).collect()] == ["p5"]
    with pytest.raises(Exception):
        store.search(SearchSpec(("hay",))).collect()


def test_a_compacted_store_has_an_index(filled, tmp_path):
    store, segments = filled
    small = store.compact(str(tmp_path / "c"))
    spec = SearchSpec(("needle", "second line of f2"), operator="or")
    assert hits(small.search(spec)) == hits(search_segments(segments, spec)) and {g for g, _ in small.groups_for(spec)} == {0}


def test_places_of_short_and_long_texts(spark):
    assert index.needed_places(spark, SearchSpec(("ab",), operator="or")) is None
    assert index.needed_places(spark, SearchSpec(("ab", "abcd"))) == index.needed_places(spark, SearchSpec(("abcd",)))
    (places,) = index.needed_places(spark, SearchSpec(("abcabc",)))
    assert len(places) == 3 and all(0 <= p < index.BITS for p in places)


ODD = [None, "", "a", "ab", "abc", "AbC", "\x00\x01\x02", "é\U0001f600ｆ€", "Straße ﬁ", "two\nlines", "\U00010000\U0010ffff퟿x", "  \t "]


def test_bitmaps_hold_the_places_of_every_trigram(spark, monkeypatch):
    rows = spark.createDataFrame([(g, t) for g in (0, 3, -5) for t in ODD] + [(9, "ab"), (9, "c")], "grp int, text string")
    folded = rows.select("grp", index.normalize(F.col("text")).alias("text")).filter("text IS NOT NULL")
    want = {(r[0], r[1] // index.BUCKET_BITS + 1, r[1] % index.BUCKET_BITS) for r in folded.select("grp", F.explode(index._places(F.col("text")))).collect()}

    def places(rows):
        return [(r.grp, r.bucket, i * 8 + b) for r in rows for i, byte in enumerate(r.bits) for b in range(8) if byte >> b & 1]

    got = places(index.trigram_bitmaps(rows.repartition(3)).collect())
    assert len(got) == len(set(got)) and set(got) == want
    for held, window in ((1, 2), (64, 1)):
        monkeypatch.setattr(index, "HELD", held)
        monkeypatch.setattr(index, "WINDOW", window)
        batches = [b.select(["grp", "text"]) for b in folded.toArrow().to_batches(max_chunksize=5)]
        assert {p for b in index._bitmaps(batches) for p in places([_Row(*r.values()) for r in b.to_pylist()])} == want


def test_a_trigram_is_no_row_and_a_long_line_takes_linear_time(spark):
    """Seeking each trigram from the line's beginning walks 45 GB here, and sorts a row for each."""
    line = "".join(chr(97 + i * i % 26) for i in range(300_000))
    found = index.trigram_bitmaps(spark.createDataFrame([(0, line)], "grp int, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    start = time.perf_counter()
    assert found.select(F.sum(F.bitmap_count("bits"))).first()[0] == len({line[i:i + 3] for i in range(len(line) - 2)})
    assert time.perf_counter() - start < 20
