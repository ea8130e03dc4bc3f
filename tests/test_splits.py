"""Text files in byte ranges against the same files read whole."""

import os
import random

import pytest
from pyspark.sql import functions as F

from linetrawl import ScanSpec, SearchSpec
from linetrawl.operators.scan import scan
from linetrawl.sinks.files import write_files
from linetrawl.sources import files as fs
from linetrawl.sources import splits
from linetrawl.sources.plaintext import decode_text, text_segments

ALL = ScanSpec(("*",), (), (), None)
BREAKS = ["\n", "\n", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " "]


def odd_text(rng, lines):
    words = ["hit", "ünï", "漢字", "\U0001f600", "", "  ", "x" * 90, "﻿mark"]
    return "".join(rng.choice(words) + rng.choice(BREAKS) for _ in range(lines)) + rng.choice(["", "tail"])


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    rng = random.Random(2)
    root = tmp_path_factory.mktemp("tree")
    data = {f"t{i}.txt": odd_text(rng, 30).encode() for i in range(6)} | {
        "long.txt": b"a\n" + b"y" * 3000 + b" hit\nb\n", "one.txt": b"no end", "empty.txt": b"", "blank.txt": b" \n\n\t\n", "lf.txt": b"\n" * 200,
        "bom.txt": b"\xef\xbb\xbffirst\nsecond hit\n", "wide.txt": "breit hit\nzwei\n".encode("utf-16"), "sjis.txt": "検索対象の文章です。\n日本語のテキスト\n".encode("cp932") * 30,
        "bin.dat": b"\x00\x01\n" * 100, "late.dat": b"text\n" * 2000 + b"\x00 nul behind the head\n",
    }
    for name, content in data.items():
        (root / name).write_bytes(content)
    return root


def whole(spark, tree):
    content = fs.read_content(fs.walk_files(spark, [str(tree)], ALL))
    return sorted(tuple(r) for r in text_segments(decode_text(content, ["path"])).collect())


@pytest.mark.parametrize("size", [1, 7, 64, 1024, 1 << 20])
def test_segments_equal_those_of_whole_files(spark, tree, size):
    few = fs.walk_files(spark, [str(tree)], ALL)
    if size < 64:
        few = few.filter("size < 700")
    segments, files = splits.split_segments(few, size)
    assert segments.columns == ["path", "idx", "line_no", "locator", "text"]
    want = whole(spark, tree)
    if size < 64:
        kept = {r.path for r in few.collect()}
        want = [w for w in want if w[0] in kept]
    assert sorted(tuple(r) for r in segments.collect()) == want
    verdict = {os.path.basename(r.path): (r.error, r.is_text) for r in files.collect()}
    assert len(verdict) == few.count() and all(e is None for e, _ in verdict.values())
    assert [n for n, (_, text) in sorted(verdict.items()) if not text] == [
        n for n in ("bin.dat", "blank.txt", "empty.txt", "lf.txt") if n in verdict]


def test_one_file_is_read_by_many_tasks(spark, tree):
    manifest = fs.walk_files(spark, [str(tree)], ALL).filter("path LIKE '%late.dat'")
    read = splits.read_splits(splits.plan_splits(manifest, 1024)).select("path", "split", F.spark_partition_id().alias("task"), "content")
    rows = read.collect()
    assert len(rows) == 10 and len({r.task for r in rows}) == 4
    assert b"".join(r.content for r in sorted(rows, key=lambda r: r.split)) == (tree / "late.dat").read_bytes()


def test_no_text_is_shuffled(spark, tree):
    segments, _ = splits.split_segments(fs.walk_files(spark, [str(tree)], ALL), 1024)
    plan = segments._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_a_file_that_is_gone_is_an_error(spark, tree):
    manifest = spark.createDataFrame([(str(tree / "gone.txt"), 3000), (str(tree / "one.txt"), 6)], "path string, size bigint")
    segments, files = splits.split_segments(manifest, 1000)
    assert [r.text for r in segments.collect()] == ["no end"]
    assert {os.path.basename(r.path): bool(r.error) for r in files.collect()} == {"gone.txt": True, "one.txt": False}
    none, files = splits.split_segments(manifest.limit(0))
    assert none.count() == files.count() == 0


def test_scan_reads_large_files_in_splits(spark, tree, monkeypatch):
    spec = SearchSpec(("hit",), operator="or", max_hits_per_file=5)
    monkeypatch.setattr(splits.split_segments, "__defaults__", (256,))
    results = []
    for size in (fs.WHOLE_BYTES, 100):
        routes = fs.read_routes(spark, [str(tree)], ALL, whole_bytes=size)
        outcomes, hits = scan(routes, spec)
        results.append((sorted(map(str, outcomes.collect())), sorted(map(str, hits.collect()))))
        assert (routes["large"].count() > 0) == (size == 100)
    assert results[0] == results[1]


def test_written_files_are_whole(spark, tmp_path):
    rows = spark.createDataFrame([("/a/b.txt", b"one"), ("c.txt", None)], "path string, content binary")
    assert sorted(map(tuple, write_files(rows, str(tmp_path)).collect())) == [("/a/b.txt", 3), ("c.txt", 0)]
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["a/b.txt", "c.txt"]
