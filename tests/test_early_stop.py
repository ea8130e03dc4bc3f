"""Stopping after the first files with hits: the same files as a limit over all of them, found in a prefix."""

import pytest
from pyspark.sql import functions as F

from linetrawl import SearchSpec
from linetrawl.operators import search

SPEC = SearchSpec(("needle",))


def files(spark, n=20_000, every=100):
    text = F.when(F.col("id") % every == every - 1, F.concat(F.lit("a needle "), "id")).otherwise("hay")
    return spark.range(n).select((F.col("id") * 3 - 7).alias("file_ord"), F.concat(F.lit("f"), "id").alias("path"), text.alias("text"))


@pytest.fixture
def searched(monkeypatch):
    seen = []
    plain = search.file_hits

    def counting(some, spec, text="text"):
        seen.append(some.count())
        return plain(some, spec, text)

    monkeypatch.setattr(search, "file_hits", counting)
    return seen


@pytest.mark.parametrize("n, most", [(1, 400), (7, 3000), (200, 20_000), (1000, 20_000)])
def test_equal_to_a_limit_over_all(spark, searched, n, most):
    got = search.first_hit_files(files(spark), SPEC, n)
    rows = sum(searched)
    want = search.limit_hit_files(search.file_hits(files(spark), SPEC), n)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert rows <= most and len(searched) <= 8


def test_the_range_reaches_the_scan(spark, tmp_path):
    files(spark).write.parquet(str(tmp_path / "t"))
    some = spark.read.parquet(str(tmp_path / "t")).filter((F.col("file_ord") >= 0) & (F.col("file_ord") < 50))
    assert "PushedFilters: [IsNotNull(file_ord), GreaterThanOrEqual(file_ord,0)" in some._jdf.queryExecution().executedPlan().toString()


def test_no_files_no_hits_and_no_numbers(spark, searched):
    none = files(spark).filter("false")
    assert search.first_hit_files(none, SPEC, 3).count() == 0
    assert search.first_hit_files(files(spark), SearchSpec(("nowhere",)), 3).count() == 0
    assert sum(searched) == 20_000
    assert search.first_hit_files(files(spark, 500), SPEC, 0).count() == 0
    unnumbered = files(spark, 500).withColumn("file_ord", F.when(F.col("path") != "f399", F.col("file_ord")))
    assert [r.path for r in search.first_hit_files(unnumbered, SPEC, 2).orderBy("file_ord").collect()] == ["f399", "f99"]
    assert search.first_hit_files(files(spark, 300).withColumn("file_ord", F.lit(None).cast("long")), SPEC, 9).count() == 3
    assert search.first_hit_files(files(spark, 300).withColumn("file_ord", F.lit(5)), SPEC, 2).count() == 2
