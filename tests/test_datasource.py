"""The file source: equal to the walk, filters pushed into it, content read on demand."""

import json
import os

import pytest
from pyspark.sql import functions as F

from linetrawl import ScanSpec
from linetrawl.sources import datasource as src
from linetrawl.sources import files as fs


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    names = ["a.txt", "b.LOG", "c", "~$lock.docx", "x.tmp", "Thumbs.db", ".git/no.txt", "sub/d.TXT", "sub/.hidden.txt", "sub/deep/er/e.txt", "odd/Ü [1].txt"]
    for name in names + [f"many/f{i:03}.csv" for i in range(60)]:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode() * 3)
    return str(root)


def rows(frame):
    return sorted(map(tuple, frame.collect()))


SPECS = [
    ScanSpec(), ScanSpec(("*",), (), (), None), ScanSpec((".txt", ".LOG"), ("deep",), ("a*", "?.txt", "*[1]*", "f01*", "*9.csv"), 1),
    ScanSpec((), (".git",), ("*",)), ScanSpec(manifest_name="a.txt"), ScanSpec(("*",), (), ("*.*sv",)),
]


@pytest.mark.parametrize("spec", SPECS)
@pytest.mark.parametrize("plan_dirs", [1, 3, 256])
def test_source_equals_the_walk(spark, tree, spec, plan_dirs, monkeypatch):
    monkeypatch.setattr(src, "PLAN_DIRS", plan_dirs)
    monkeypatch.setattr(src, "TASK_FILES", 7)
    roots = [tree, f"{tree}/sub", f"{tree}/a.txt", f"{tree}/missing", ""]
    assert rows(src.source_files(spark, roots, spec)) == rows(fs.walk_files(spark, roots, spec))


def test_uri_roots(spark, tree):
    uri = f"file://{tree}"
    assert rows(src.source_files(spark, [uri])) == rows(fs.walk_files(spark, [uri]))


def test_filters_reach_the_source_and_content_is_chosen(spark, tree):
    few = src.source_files(spark, [tree], ScanSpec((".txt",)))
    plan = spark._jvm.PythonSQLUtils.explainString(few._jdf.queryExecution(), "formatted")
    for part in ("In(ext, [.txt])", "LessThanOrEqual(size,104857600)", "Not(StringStartsWith(name,~$))", "Not(StringEndsWith(name,.tmp))", "Not(EqualTo(name,Thumbs.db))"):
        assert part in plan or part.replace("In(ext, [.txt])", "EqualTo(ext,.txt)") in plan
    assert "Filter" not in plan.replace("PushedFilters", "").replace("RuntimeFilters", "") and "content" not in plan
    whole = src.source_files(spark, [tree], ScanSpec(), ("path", "content", "error"))
    assert all(r.error is None and r.content == os.path.relpath(r.path, tree).encode() * 3 for r in whole.collect())


def test_other_filters_stay_right(spark, tree):
    src.register(spark)
    files = spark.read.format(src.NAME).option("path", tree).option("plan_dirs", "2").load()
    every = [r.asDict() for r in files.collect()]
    assert len(every) == 71
    for condition in (
        "size > 30", "size BETWEEN 12 AND 20", f"path LIKE '{tree}/sub/%'", f"path = '{tree}/sub/d.TXT'", "name LIKE '%1%'", "NOT size > 30", "ext IN ('.csv', '.db')",
        "ext NOT IN ('.csv')", "name <=> 'c'", "size IS NULL", "NOT (name LIKE 'f%' OR ext = '')", "mtime > timestamp'2000-01-01'", "NOT name LIKE 'f%' AND ext <> '.txt'", "error IS NULL"):
        got = sorted(r.path for r in files.filter(condition).collect())
        want = sorted(r.path for r in spark.createDataFrame(every, files.schema).filter(condition).collect())
        assert got == want, condition
    assert files.filter(F.col("content").contains(b"deep")).count() == 1


def test_a_directory_is_shared_by_tasks(spark, tree, monkeypatch):
    monkeypatch.setattr(src, "TASK_FILES", 10)
    reader = src._Reader([tree], [], 256, ["path"])
    parts = [p.value for p in reader.partitions() if p.value[0].endswith("many")]
    assert len(parts) == 7
    sizes = [sum(b.num_rows for b in reader.read(src.ds.InputPartition(p))) for p in parts]
    assert sum(sizes) == 60 and max(sizes) < 25
    assert src._Reader([f"{tree}/none"], [], 256, ["path"]).partitions() == []
    assert spark.read.format(src.NAME).option("paths", json.dumps([f"{tree}/none"])).load().count() == 0
