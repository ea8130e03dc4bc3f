"""Workbooks read part by part against the same books read whole."""

import os

import pytest
from pyspark.sql import functions as F

from linetrawl import ScanSpec, SearchSpec
from linetrawl.operators.scan import scan
from linetrawl.plans import office_fixtures as of
from linetrawl.sources import containers, files as fs, office
from linetrawl.sources.packages import SS

ALL = ScanSpec(("*",), (), (), None)


def book(sheets, rows=20, damaged=()):
    names = [f"S{i}" for i in range(sheets)]
    parts = {"xl/workbook.xml": f"<workbook {of._ns(x=SS, r='{' + of.R + '}')}><sheets>" + "".join(
        f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": of._rels(*[(f"r{i}", of.REL_SHEET, f"worksheets/s{i}.xml") for i in range(sheets)]),
        "xl/sharedStrings.xml": f"<sst {of._ns(x=SS)}><si><t>needle</t></si><si><t>hay</t></si></sst>"}
    for i in range(sheets):
        cells = "".join(f'<row r="{r}"><c r="A{r}" t="s"><v>{int(r % 7 > 0)}</v></c><c r="B{r}"><v>{i}.5</v></c></row>' for r in range(1, rows + 1))
        parts[f"xl/worksheets/s{i}.xml"] = f"<worksheet {of._ns(x=SS)}><sheetData>{cells}</sheetData>" + ("<broken" if i in damaged else "</worksheet>")
    return of._zip(parts)


@pytest.fixture(scope="module")
def tree(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("books")
    for r in of.books_v(spark, sf_dir).limit(6).collect():
        (root / os.path.basename(r.path)).write_bytes(r.content)
    (root / "large.xlsx").write_bytes(book(50))
    (root / "none.xlsx").write_bytes(b"not a container")
    (root / "empty.xlsx").write_bytes(of._zip({"x.txt": "no book"}))
    return root


def segments(parts):
    return sorted(((r.path, r.kind, r.locator, r.text) for r in office.xlsx_segments(parts).collect()), key=str)


def test_parts_equal_whole_books(spark, tree):
    manifest = fs.walk_files(spark, [str(tree)], ALL)
    whole = office.xlsx_parts(fs.read_content(manifest))
    for task_bytes in (containers.TASK_BYTES, 300):
        assert segments(containers.workbook_parts(manifest, task_bytes)) == segments(whole)
    order = lambda parts: [(r.path, r.locator) for r in office.xlsx_segments(parts).orderBy("path", "idx").collect()]
    assert order(containers.workbook_parts(manifest)) == order(whole)
    assert containers.workbook_parts(manifest.limit(0)).count() == 0


def test_sheets_of_one_book_go_to_several_tasks(spark, tree):
    manifest = fs.walk_files(spark, [str(tree)], ALL).filter("path LIKE '%large.xlsx'")
    parts = containers.workbook_parts(manifest).select("sheet", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r.sheet for r in parts}) == len(parts) == 50 and len({r.task for r in parts}) == 4


def test_a_damaged_sheet_hides_no_other(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(book(4, 3, damaged=(1,)))
    (tmp_path / "gone.xlsx").write_bytes(book(1))
    manifest = fs.walk_files(spark, [str(tmp_path)], ALL).persist()
    manifest.count()
    (tmp_path / "gone.xlsx").unlink()
    got = [r.locator for r in office.xlsx_segments(containers.workbook_parts(manifest)).filter("kind = 'row'").collect()]
    assert {g.split("!")[0] for g in got} >= {"S0", "S2", "S3"} and len(got) >= 18


def test_scan_reads_large_books_by_part(spark, tree):
    spec = SearchSpec(("needle", "user"), operator="or", max_hits_per_file=30)
    results = []
    for size in (fs.WHOLE_BYTES, 2000):
        routes = fs.read_routes(spark, [str(tree)], ALL, whole_bytes=size)
        outcomes, hits = scan(routes, spec)
        results.append((sorted(map(str, outcomes.collect())), sorted(map(str, hits.drop("seg_idx").collect()))))
        assert (routes["large_xlsx"].count() > 0) == (size == 2000)
    assert results[0] == results[1] and len(results[0][1]) > 40
