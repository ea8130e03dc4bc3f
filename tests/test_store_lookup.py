"""Lookups in a store of many generations: those that cannot hold a path are never opened."""

import pytest
from pyspark.sql import functions as F

from linetrawl.operators import cache
from linetrawl.sinks import index, store as store_module
from linetrawl.sinks.store import SegmentStore

SEGMENTS = "path string, idx bigint, locator string, text string"


def manifest(spark, rows):
    return spark.createDataFrame(rows, "path string, mtime string, size bigint").withColumn("mtime", F.col("mtime").cast("timestamp"))


def listed(names, day="2024-01-01", size=1):
    return [(n, day, size) for n in names]


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    """50 generations of 20 files; one forgets files of the first, another rewrites one of the second."""
    root = tmp_path_factory.mktemp("lookup") / "s"
    store = SegmentStore(spark, str(root), groups=1)
    nothing = spark.createDataFrame([], SEGMENTS)
    for g in range(48):  # file lists alone: lookups read no segments
        store._commit(manifest(spark, listed([f"g{g}/f{i}" for i in range(20)])).coalesce(1), g, "cell", False, None)
    store.forget(spark.createDataFrame([("g0/f1",), ("g0/f2",)], "path string"))
    store.put(manifest(spark, listed(["g1/f3"], "2024-02-02", 7)), nothing)
    return store, root


def hits(frame):
    return sorted((r.path, r.is_hit) for r in frame.collect())


def everything(store, rows):
    return cache.lookup(rows, store.files().filter("granularity = 'cell'"))


def test_only_generations_that_may_hold_a_path(spark, filled):
    store, _ = filled
    assert store.generations() == list(range(50))
    chosen = lambda *names: store.generations_for(spark.createDataFrame([(n,) for n in names], "path string"))
    for names, needed in ((["g7/f3"], {7}), (["g0/f1"], {0, 48}), (["g1/f3", "g9/f19"], {1, 9, 49}), (["nowhere"], set())):
        got = set(chosen(*names))
        assert needed <= got and len(got) <= len(needed) + 2, (names, got)
    assert set(chosen(*[f"g{g}/f0" for g in range(48)])) >= set(range(48))


@pytest.mark.parametrize("names", [["g7/f3", "g0/f1", "g0/f3", "g1/f3", "new"], [], ["new"], ["g5/f1", "g5/f1"], [None, "g4/f4"]])
def test_a_lookup_equals_one_of_the_whole_log(spark, filled, names):
    store, _ = filled
    rows = manifest(spark, listed(names))
    key = lambda got: sorted((str(r.path), r.is_hit) for r in got.collect())
    assert key(store.lookup(rows)) == key(everything(store, rows))
    changed = manifest(spark, listed(names, "2024-02-02", 7))
    assert key(store.lookup(changed)) == key(everything(store, changed))
    assert store.lookup(rows, "row").filter("is_hit").count() == 0


def test_many_paths_read_the_whole_log(spark, filled, monkeypatch):
    store, _ = filled
    rows = manifest(spark, listed([f"g{g}/f{i}" for g in range(48) for i in range(0, 20, 3)]))
    few = hits(store.lookup(rows))
    monkeypatch.setattr(store_module, "FEW_PATHS", 10)
    assert store.generations_for(rows) is None and hits(store.lookup(rows)) == few
    assert few == [(p, p not in ("g0/f1", "g0/f2", "g1/f3")) for p, _ in few]


def test_other_generations_are_not_opened(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "s"), groups=1)
    for g in range(4):
        store.put(manifest(spark, listed([f"g{g}/f{i}" for i in range(5)])), spark.createDataFrame([], SEGMENTS))
    rows = manifest(spark, listed(["g2/f1", "g9/f9"]))
    chosen = store.generations_for(rows)
    assert 2 in chosen and len(chosen) < 4
    for other in (tmp_path / "s" / "files").glob("gen=*/*.parquet"):
        if int(other.parent.name[4:]) not in chosen:
            other.write_bytes(b"unreadable")
    assert hits(store.lookup(rows)) == [("g2/f1", True), ("g9/f9", False)]
    with pytest.raises(Exception):
        store.files().collect()


def test_a_generation_without_a_whole_filter_is_opened(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "s"), groups=1)
    for g in range(3):
        store.put(manifest(spark, listed([f"g{g}/f{i}" for i in range(5)])), spark.createDataFrame([], SEGMENTS))
    half = index.path_filter(spark.createDataFrame([("g1/f0",)], "path string"), 5)  # one of five paths arrived
    half.write.mode("overwrite").parquet(str(tmp_path / "s/paths/gen=1"))
    spark.createDataFrame([], index.PATHS).drop("gen").write.mode("overwrite").parquet(str(tmp_path / "s/paths/gen=2"))
    rows = manifest(spark, listed(["g1/f4", "g2/f4"]))
    assert {1, 2} <= set(store.generations_for(rows)) and hits(store.lookup(rows)) == [("g1/f4", True), ("g2/f4", True)]


def test_filters_of_many_blocks(spark):
    """5,000 paths over two blocks: none is missed, and few others pass."""
    paths = spark.range(5000).select(F.concat(F.lit("p"), "id").alias("path"))
    filters = index.path_filter(paths, 5000).withColumn("gen", F.lit(3).cast("bigint")).cache()
    assert filters.count() == 2 and filters.agg(F.sum("paths")).first()[0] == 5000
    for i in (0, 1, 77, 4999):
        assert index.generations_with(filters, paths.filter(F.col("path") == f"p{i}")) == ({3}, {3})
    strangers = [index.generations_with(filters, spark.createDataFrame([(f"q{i}",)], "path string"))[1] for i in range(12)]
    assert sum(map(bool, strangers)) <= 2
    filters.unpersist()


def test_empty_and_compacted_stores(spark, filled, tmp_path):
    empty = SegmentStore(spark, str(tmp_path / "none"))
    rows = manifest(spark, listed(["a"]))
    assert empty.generations() == [] and hits(empty.lookup(rows)) == [("a", False)]
    store, _ = filled
    small = store.compact(str(tmp_path / "small"))
    rows = manifest(spark, listed(["g0/f1", "g1/f4", "g1/f3"]))
    assert small.generations_for(rows) == [0] and hits(small.lookup(rows)) == [("g0/f1", False), ("g1/f3", False), ("g1/f4", True)]
    assert small.generations_for(manifest(spark, listed(["nowhere else"]))) == []
