"""What grows with the input is not broadcast, whatever size Spark gives it."""

import pytest

import corpus_pipeline
from linetrawl.llm import components, neardup

#: Near copies in pairs, and as many texts without any.
PAIRS = 150


@pytest.fixture
def small_broadcasts(spark):
    """Broadcasts of a megabyte or more fail here; one row by a long key counts as that much, none as nothing."""
    name = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(name, "1m")
    yield
    spark.conf.unset(name)


@pytest.fixture(scope="module")
def docs(spark):
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, words(i)) for i in range(PAIRS)] + [(PAIRS + i, words(i) + " more") for i in range(PAIRS)] + [(2 * PAIRS + i, words(-1 - i)) for i in range(PAIRS)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()


def test_the_limit_of_this_file_is_one(spark, docs, small_broadcasts):
    with pytest.raises(Exception, match="[Bb]roadcast"):
        docs.alias("a").join(docs.hint("broadcast").alias("b"), "doc_id").collect()


def test_components_are_not_broadcast(spark, small_broadcasts):
    edges = [(i, i + 1) for i in range(300) if i % 30] + [(1000, i) for i in range(1001, 1200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: (i - 1) // 30 * 30 + 1 for i in range(1, 301)} | {i: 1000 for i in range(1000, 1200)}


def test_near_duplicates_are_not_broadcast(docs, small_broadcasts):
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: (i % PAIRS, 1) if i < 2 * PAIRS else (i, 0) for i in range(3 * PAIRS)}


def test_the_rows_that_stay_are_not_broadcast(spark, docs, small_broadcasts):
    kept = corpus_pipeline.deduplicate(spark, docs, None)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(PAIRS), *range(2 * PAIRS, 3 * PAIRS)]
