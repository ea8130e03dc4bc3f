"""A standing search whose files arrive in pieces equals one search over all segments."""

import pytest
from pyspark.sql import functions as F

from linetrawl import SearchSpec
from linetrawl.operators.search import StandingGate, search_segments
from linetrawl.streaming.incremental import StandingSearch

MANY = tuple(f"w{i:02}" for i in range(40))
ROWS = [("/a", 5, "foo last"), ("/b", 0, "foo foo foo foo"), ("/c", 0, "only foo"), ("/e", 0, "tail"), ("/m", 0, " ".join(MANY[:25])),
        ("/a", 1, "bar foo"), ("/b", 2, "bar foo"), ("/d", 9, None), ("/e", 2, "foo one"), ("/m", 1, " ".join(MANY[20:])),
        ("/a", 0, "foo ＢＡＲ foo"), ("/b", 1, "bar"), ("/d", 0, ""), ("/e", 1, "bar"), ("/n", 0, " ".join(MANY[1:]))]


def rows(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    """Three files of five segments each: one micro-batch each."""
    folder = tmp_path_factory.mktemp("arriving") / "segments"
    schema = "path string, idx bigint, locator string, text string"
    for i in range(3):
        part = [(p, n, f"l{n}", t) for p, n, t in ROWS[i * 5:i * 5 + 5]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return stream, spark.read.schema(schema).parquet(str(folder))


@pytest.mark.parametrize("spec", [
    SearchSpec(("foo", "bar"), max_hits_per_file=2), SearchSpec(("foo", "bar"), operator="or", max_hits_per_file=3),
    SearchSpec(("bar\nfoo", "foo")), SearchSpec(MANY), SearchSpec((r"fo+\b", "b.r"), mode="regex", max_hits_per_file=120),
    SearchSpec(())], ids=["and", "or", "breaks", "many", "regex", "none"])
def test_pieces_equal_the_whole(spark, arriving, tmp_path, spec):
    stream, whole = arriving
    search = StandingSearch(spark, str(tmp_path / "s"), spec)
    assert search.hits().count() == 0
    search.start(stream, str(tmp_path / "cp")).awaitTermination()
    assert len(list((tmp_path / "s/found").glob("batch=*"))) == 3
    got, want = search.hits(), search_segments(whole, spec)
    assert got.columns == want.columns and rows(got) == rows(want)
    assert spec.keywords == () or want.count() > 0


def test_a_replayed_batch_counts_once(spark, arriving, tmp_path):
    stream, whole = arriving
    spec = SearchSpec(("foo",), operator="or", max_hits_per_file=200)
    search = StandingSearch(spark, str(tmp_path / "s"), spec)
    search.start(stream, str(tmp_path / "cp")).awaitTermination()
    for commit in (tmp_path / "cp/commits").glob("*2*"):
        commit.unlink()  # as if the job had died before the last batch counted as done
    search.start(stream, str(tmp_path / "cp")).awaitTermination()
    assert rows(search.hits()) == rows(search_segments(whole, spec))


def test_a_gate_opens_with_its_last_keyword(spark):
    gate = StandingGate(SearchSpec(("foo", "bar", "FOO")))
    part = lambda *texts: gate.present(spark.createDataFrame([("/a", i, t) for i, t in enumerate(texts)], "path string, idx int, text string"))
    first, second = part("foo", "Foo foo"), part("x", "bar")
    assert gate.complete(first).count() == 0 and [r.path for r in gate.complete(first.unionByName(second)).collect()] == ["/a"]
    assert first.first().words == [gate.single.index("foo")]
    assert StandingGate(SearchSpec(("foo",), operator="or")).single == []
