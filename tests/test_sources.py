import fnmatch
import os
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from linetrawl import ScanSpec, SearchSpec
from linetrawl.functions import paths
from linetrawl.operators.scan import scan
from linetrawl.sources import files as fs
from linetrawl.sources import office
from linetrawl.sources.plaintext import decode_text, looks_like_text, text_segments

ALL = ScanSpec(("*",), (), (), None)


@pytest.fixture
def tree(tmp_path):
    for name, data in {
        "a.txt": b"hello", "b.log": b"log line", "c.bin": b"\x00\x01", "~$tmp.docx": b"lock", "sub/d.TXT": b"nested",
        "sub/.hidden.txt": b"dot", "_under.txt": b"under", ".git/ignored.txt": b"no", "sub/deep/er/e.txt": b"deep",
    }.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return tmp_path


def names(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.collect())


def test_walk_lists_hidden_names_and_prunes(spark, tree):
    got = names(fs.walk_files(spark, [str(tree)], ScanSpec((".txt",))), tree)
    assert got == ["_under.txt", "a.txt", "sub/.hidden.txt", "sub/d.TXT", "sub/deep/er/e.txt"]
    everything = names(fs.walk_files(spark, [str(tree)], ScanSpec((), (".git",), ())), tree)
    assert "c.bin" in everything and "~$tmp.docx" in everything and not any(".git" in n for n in everything)


def test_walk_roots(spark, tree):
    one = str(tree / "a.txt")
    assert [r.path for r in fs.walk_files(spark, [one], ALL).collect()] == [one]
    assert fs.walk_files(spark, ["", str(tree / "missing")], ALL).count() == 0
    twice = fs.walk_files(spark, [str(tree), str(tree / "sub")], ScanSpec((".txt",)))
    assert names(twice, tree).count("sub/d.TXT") == 2
    row = fs.walk_files(spark, [one], ALL).first()
    assert row["size"] == 5 and abs(row["mtime"].timestamp() - os.stat(one).st_mtime) < 1e-3


def test_size_limit_and_content(spark, tree):
    (tree / "big.txt").write_bytes(b"x" * (2 * 1024 * 1024 + 1))
    listed = fs.walk_files(spark, [str(tree)], ScanSpec((".txt",), (), (), 1))
    assert "big.txt" not in names(listed, tree)
    got = {os.path.basename(r.path): bytes(r.content) for r in fs.read_content(listed).collect()}
    assert got["a.txt"] == b"hello" and got[".hidden.txt"] == b"dot"
    missing = listed.limit(1).withColumn("path", F.lit("/nowhere/x.txt"))
    assert fs.read_content(missing).first().error.startswith("extract_error: ")


def test_binary_file_source(spark, tree):
    got = fs.read_binary(spark, [str(tree)], ScanSpec((".txt", ".log")))
    assert names(got, tree) == ["a.txt", "b.log", "sub/d.TXT", "sub/deep/er/e.txt"]
    assert fs.read_binary(spark, ["/missing/root"]).count() == 0
    plan = got.select("path", "size")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan  # content stays unread where only the manifest is asked for


def test_excluded_directories_count_below_the_root_only(spark):
    df = spark.createDataFrame([("/x/.git/a.txt", 1), ("/x/.git/b/.git/c.txt", 1)], "path string, size bigint")
    assert [r.path for r in fs.filter_manifest(df, ScanSpec(("*",)), ["/x/.git"]).collect()] == ["/x/.git/a.txt"]


def test_extra_root():
    assert fs.with_extra_root(["/a"], "/b", True) == ["/a", "/b"]
    assert fs.with_extra_root(["/a"], "/b", False) == fs.with_extra_root(["/a"], "/a", True) == ["/a"]


def test_globs_equal_fnmatch(spark):
    rng = random.Random(3)
    globs = ["*", "~$*", "*.tmp", "a?c", "[ab]*", "[!ab]*", "x[", "[]a]*", "a.b", "[a-c]?", "*[0-9].txt", "é*", "(a)*", "[!]]", "a\\b", "[^a]", "[b-a]x", "[!b-a]", "[a-]*"]
    words = ["".join(rng.choice("abcx~$.[]!0^\\é(A)") for _ in range(rng.randint(0, 5))) for _ in range(400)]
    words += ["a.tmp", "~$x", "d1.txt", "line\nbreak.tmp"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = df.select("w", *[F.col("w").rlike(paths.glob_to_regex(g)).alias(f"g{i}") for i, g in enumerate(globs)]).collect()
    for r in rows:
        for i, g in enumerate(globs):
            assert r[f"g{i}"] == fnmatch.fnmatchcase(r.w, g), (r.w, g)


def test_path_functions_equal_python(spark):
    rng = random.Random(4)
    words = ["/d/" + "".join(rng.choice("ab.X é\n") for _ in range(rng.randint(1, 8))) for _ in range(500)] + ["/d/.bashrc", "/d/a.", "/d/.a.b"]
    rows = spark.createDataFrame([(w,) for w in words], "p string").select("p", paths.extension(F.col("p")).alias("e")).collect()
    assert all(r.e == os.path.splitext(os.path.basename(r.p))[1].lower() for r in rows)
    def human(n):
        if n < 1024:
            return f"{n} B"
        size = float(n)
        for u in ("KB", "MB", "GB"):
            size /= 1024
            if size < 1024:
                return f"{size:.1f} {u}"
        return f"{size / 1024:.1f} TB"
    sizes = [0, 1023, 1024, 1075, 1076, 1587, 2099, 1024**2 - 1, 1024**2, 51 * 1024 + 512 // 5, 1024**4 * 7, 3 * 1024**5] + \
            [rng.randint(0, 1024**k) for k in range(1, 5) for _ in range(300)] + [1024 * k + 1024 * j // 20 for k in range(1, 40) for j in (1, 3, 5, 15)]
    rows = spark.createDataFrame([(s,) for s in sizes], "s bigint").select("s", paths.human_bytes(F.col("s")).alias("h")).collect()
    assert [(r.s, r.h) for r in rows if r.h != human(r.s)] == []
    letters = spark.range(-2, 20000).select("id", paths.column_letters(F.col("id")).alias("c")).collect()
    want = {1: "A", 26: "Z", 27: "AA", 702: "ZZ", 703: "AAA", 16384: "XFD", 18278: "ZZZ", 18279: "AAAA", 0: "", -2: ""}
    assert {r.id: r.c for r in letters if r.id in want} == want


CONTENT = {
    "lf.md": b"# Title\n\nHello world\nSecond line\n\n  \nFourth\n", "crlf.txt": b"line one\r\nline two\r\n", "empty.txt": b"",
    "nul.bin2": b"\x89PNG\r\n\x00\x00", "utf16.txt": b"\xff\xfe" + "Hello\nWorld\n".encode("utf-16-le"),
    "bom.txt": b"\xef\xbb\xbf" + "東京\n大阪".encode(), "all.dat": bytes(range(256)), "blank.txt": b" \n\t\n",
    "sjis.txt": ("東京タワーは1958年に完成しました。\n大阪城は16世紀後半に建てられた歴史的建造物です。\n"
                 "京都には多くの寺院や神社が点在しています。\n横浜は1859年に開港し、貿易の中心地として発展しました。\n").encode("cp932"),
}


def test_text_decoding(spark):
    df = spark.createDataFrame([(f"/{n}", bytearray(b)) for n, b in CONTENT.items()], "path string, content binary")
    is_text = {r.path: r.t for r in df.select("path", looks_like_text(F.col("content")).alias("t")).collect()}
    assert [n for n in CONTENT if not is_text["/" + n]] == ["empty.txt", "nul.bin2", "all.dat"]
    segs = {}
    for r in text_segments(decode_text(df, ["path"])).orderBy("path", "idx").collect():
        segs.setdefault(r.path[1:], []).append((r.locator, r.text))
    assert segs["lf.md"] == [("行 1", "# Title"), ("行 3", "Hello world"), ("行 4", "Second line"), ("行 7", "Fourth")]
    assert segs["crlf.txt"] == [("行 1", "line one"), ("行 2", "line two")]
    assert segs["bom.txt"] == [("行 1", "東京"), ("行 2", "大阪")]
    assert [t.lstrip("﻿") for _, t in segs["utf16.txt"]] == ["Hello", "World"]
    assert segs["sjis.txt"][0][1].startswith("東京タワー") and len(segs["sjis.txt"]) == 4
    assert "nul.bin2" not in segs and "blank.txt" not in segs


def test_lines_equal_splitlines(spark):
    rng = random.Random(9)
    chars = "ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85  　\xa0"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    got = {}
    for r in text_segments(df).collect():
        got.setdefault(r.path, []).append((r.idx, r.line_no, r.text))
    for i, t in enumerate(texts):
        want = [(n, x) for n, x in enumerate(t.splitlines(), 1) if x.strip()]
        assert sorted(got.get(i, [])) == [(k, n, x) for k, (n, x) in enumerate(want)]


# ------------------------------------------------------------------------------------------ Office
def _book(tmp_path, parts):
    p = tmp_path / "b.xlsx"
    with zipfile.ZipFile(p, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return bytearray(p.read_bytes())


SS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
OD = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
BOOK = {
    "xl/workbook.xml": f'<workbook {SS} xmlns:r="{OD}"><sheets><sheet name="売上" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                                  f'<Relationship Id="r1" Type="{OD}/worksheet" Target="/xl/worksheets/Sheet1.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet {SS}><numFmts><numFmt numFmtId="170" formatCode="yyyy/mm/dd"/><numFmt numFmtId="171" formatCode="[Red]0.0&quot;d&quot;"/></numFmts>'
                     f'<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="20"/></cellXfs></styleSheet>',
    "xl/worksheets/Sheet1.xml": f'<worksheet {SS}><sheetData><row r="2"><c r="A2"><v>100</v></c><c r="B2"><v>1.5</v></c><c r="C2"/>'
                                f'<c r="D2" s="1"><v>45292</v></c><c r="E2" s="2"><v>45292.5</v></c><c r="F2" s="3"><v>2</v></c>'
                                f'<c r="G2" t="e"><v>#DIV/0!</v></c><c r="H2" t="b"><v>1</v></c><c r="I2" t="str"><f>A1</f><v>calc</v></c>'
                                f'<c r="AA2" s="4"><v>0.25</v></c></row><row r="5"><c r="A5" t="inlineStr"><is><t></t></is></c></row></sheetData></worksheet>',
}


def _segs(spark, data, granularity="cell"):
    df = spark.createDataFrame([("/b.xlsx", data)], "path string, content binary")
    return [(r.locator, r.text) for r in office.xlsx_segments(office.xlsx_parts(df), granularity).orderBy("idx").collect()]


def test_workbook_values(spark, tmp_path):
    got = dict(_segs(spark, _book(tmp_path, BOOK)))
    assert got == {
        "シート名: 売上": "売上", "売上!A2": "100", "売上!B2": "1.5", "売上!D2": "2024-01-01 00:00:00", "売上!E2": "2024-01-01 12:00:00",
        "売上!F2": "2", "売上!G2": "#DIV/0!", "売上!H2": "True", "売上!I2": "calc", "売上!AA2": "06:00:00", "売上!A5": "",
    }
    rows = dict(_segs(spark, _book(tmp_path, BOOK), "row"))
    assert rows["売上!Row 2"] == "100\t1.5\t2024-01-01 00:00:00\t2024-01-01 12:00:00\t2\t#DIV/0!\tTrue\tcalc\t06:00:00"
    assert "売上!Row 5" not in rows


def test_damaged_parts_do_not_hide_the_rest(spark, tmp_path):
    comment = f'<comments {SS}><authors><author>A</author></authors><commentList><comment ref="B5" authorId="7"><text><t> memo </t></text></comment></commentList></comments>'
    broken = {**BOOK, "xl/worksheets/Sheet1.xml": "<worksheet", "xl/comments1.xml": comment, "xl/drawings/drawing1.xml": "not xml"}
    assert _segs(spark, _book(tmp_path, broken)) == [("シート名: 売上", "売上"), ("B5 コメント", "memo")]
    assert _segs(spark, bytearray(b"not a workbook")) == []


def test_threads_without_sheet_and_empty_ones(spark, tmp_path):
    tc = "http://schemas.microsoft.com/office/spreadsheetml/2018/threadedcomments"
    xml = (f'<ThreadedComments xmlns="{tc}"><threadedComment ref="B5" personId="p1" id="1"><text>first</text></threadedComment>'
           f'<threadedComment ref="B5" personId="p2" id="2" parentId="1"><text>reply</text></threadedComment>'
           f'<threadedComment ref="A1" personId="p1" id="3"><text>  </text></threadedComment></ThreadedComments>')
    people = f'<personList xmlns="{tc}"><person id="p1" displayName="山田太郎"/></personList>'
    got = _segs(spark, _book(tmp_path, {"xl/threadedComments/threadedComment1.xml": xml, "xl/persons/person.xml": people}))
    assert got == [("B5 スレッドコメント (山田太郎)", "first"), ("B5 スレッド返信", "reply")]


def test_scan_outcomes_over_all_routes(spark, tmp_path):
    good = _book(tmp_path, BOOK)
    rows = [("/a.txt", b"needle here"), ("/b.txt", b"nothing"), ("/c.pdf", b"needle"), ("/d.png", b""), ("/e.doc", b""), ("/f.txt", b"\x00needle"),
            ("/g.xlsx", good), ("/h.docx", b"broken"), ("/i.xlsx", b"broken"), ("/j.json", b'{"needle": "calc"}')]
    df = spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary")
    outcomes, hits = scan(df, SearchSpec(("needle", "calc"), operator="or"), office=True)
    got = {r.path: (r.outcome, r.reason, r.error, r.n_hits) for r in outcomes.collect()}
    assert got == {
        "/a.txt": ("hit", None, None, 1), "/b.txt": ("no_hit", None, None, 0), "/c.pdf": ("skip", "scope_out", None, 0),
        "/d.png": ("skip", "binary", None, 0), "/e.doc": ("skip", "no_office", None, 0), "/f.txt": ("skip", "binary", None, 0),
        "/g.xlsx": ("hit", None, None, 1), "/h.docx": ("error", None, "extract_error: File is not a zip file", 0),
        "/i.xlsx": ("no_hit", None, None, 0), "/j.json": ("hit", None, None, 2),
    }
    assert sorted((r.path, r.locator, r.matched) for r in hits.collect()) == [
        ("/a.txt", "行 1", "needle"), ("/g.xlsx", "売上!I2", "calc"), ("/j.json", "行 1", "calc"), ("/j.json", "行 1", "needle")]
    assert re.match("^no_office$", {p: r[1] for p, r in
                    {r.path: tuple(r) [1:] for r in scan(df, SearchSpec(("x",)))[0].select("path", "outcome", "reason").collect()}.items()}["/h.docx"])


def test_routes_are_split_when_listed(spark, tmp_path):
    for name in ("a.txt", "B.TXT", "c.Xlsx", "d.docx", "e.pdf", "f.md", "g", "h.pptx", "i.doc"):
        (tmp_path / name).write_bytes(b"needle")
    for spec, office_on in ((ScanSpec(("*",)), True), (ScanSpec((".txt", ".xlsx", ".doc", ".docx")), False)):
        listed = fs.read_binary(spark, [str(tmp_path)], spec)
        routes = fs.read_routes(spark, [str(tmp_path)], spec, office_on)
        assert sorted(r.path for df in routes.values() for r in df.collect()) == sorted(r.path for r in listed.collect())
        outcomes = [sorted(map(tuple, scan(f, SearchSpec(("needle",)), office_on)[0].collect())) for f in (routes, listed)]
        assert outcomes[0] == outcomes[1]


@pytest.mark.parametrize("uri", [False, True])
def test_routes_open_only_what_is_searched(spark, tmp_path, uri):
    """Hidden names are read, files skipped by name never are, and unreadable ones become errors."""
    top = tmp_path / "share"
    (top / "deep").mkdir(parents=True)
    (top / "deep" / "_list.txt").write_text("foo here")
    (top / ".notes.md").write_text("foo there")
    (top / "bad.xlsx").write_text("no package")
    os.mkfifo(top / "film.mp4")  # opening it would wait for ever
    (top / "gone.txt").symlink_to(top / "missing")
    root = f"file://{top}" if uri else str(top)
    routes = fs.read_routes(spark, [root], ScanSpec(("*",)))
    outcomes, hits = scan(routes, SearchSpec(("foo",)))
    got = {os.path.basename(r.path): (r.outcome, r.n_hits) for r in outcomes.collect()}
    assert got.pop("gone.txt", ("error", 0)) == ("error", 0)
    if uri:  # a pipe has no size there, so the size limit drops it
        got["film.mp4"] = ("skip", 0)
    assert got == {"_list.txt": ("hit", 1), ".notes.md": ("hit", 1), "bad.xlsx": ("no_hit", 0), "film.mp4": ("skip", 0)}
    assert sorted(os.path.basename(r.path) for r in hits.collect()) == [".notes.md", "_list.txt"]
