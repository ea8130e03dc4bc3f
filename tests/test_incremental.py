import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from linetrawl import ScanSpec, SearchSpec
from linetrawl.operators import report, snapshot
from linetrawl.operators.ranks import running_total
from linetrawl.operators.search import search_segments, search_texts
from linetrawl.sinks.results import read_runs, write_run
from linetrawl.sinks.store import SegmentStore
from linetrawl.streaming import incremental
from linetrawl.workspace import shared_dir

T0 = dt.datetime(2024, 1, 1)


def manifest(spark, *rows):
    return spark.createDataFrame([(p, T0 + dt.timedelta(seconds=s), n) for p, s, n in rows], "path string, mtime timestamp, size bigint")


def segs(spark, *rows):
    return spark.createDataFrame([(p, i, f"行 {i + 1}", t) for p, i, t in rows], "path string, idx bigint, locator string, text string")


def texts(df):
    return sorted((r.path, r.idx, r.text) for r in df.collect())


def test_store_round_trip(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "store"))
    m = manifest(spark, ("/a", 0, 5), ("/b", 0, 6))
    assert store.misses(m).count() == 2 and store.segments().count() == 0
    store.put(m, segs(spark, ("/a", 0, "hello"), ("/a", 1, "world"), ("/b", 0, "bee")))
    assert texts(store.get(m)) == [("/a", 0, "hello"), ("/a", 1, "world"), ("/b", 0, "bee")]
    assert store.misses(m).count() == 0
    changed = manifest(spark, ("/a", 9, 5), ("/b", 0, 7), ("/c", 0, 1))
    assert sorted(r.path for r in store.misses(changed).collect()) == ["/a", "/b", "/c"]
    assert store.misses(m, granularity="row").count() == 2
    store.put(manifest(spark, ("/a", 9, 5)), segs(spark, ("/a", 0, "new")))
    again = SegmentStore(spark, str(tmp_path / "store"))
    assert texts(again.segments()) == [("/a", 0, "new"), ("/b", 0, "bee")]
    again.forget(spark.createDataFrame([("/b",)], "path string"))
    assert texts(again.segments()) == [("/a", 0, "new")]
    small = again.compact(str(tmp_path / "compact"))
    assert texts(small.segments()) == [("/a", 0, "new")] and small.misses(manifest(spark, ("/a", 9, 5))).count() == 0
    row = small.stats().first()
    assert (row.n_files, row.n_segments, row.segments_per_file, row.text_bytes) == (1, 1, 1.0, 3)
    again.clear()
    assert again.segments().count() == 0 and again.files().count() == 0


def test_segments_without_commit_are_invisible(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "s"))
    store.put(manifest(spark, ("/a", 0, 1)), segs(spark, ("/a", 0, "x")))
    segs(spark, ("/a", 0, "half"), ("/z", 0, "half")).withColumn("grp", F.lit(3)).write.partitionBy("grp").parquet(str(tmp_path / "s/segments/gen=1"))
    assert texts(store.segments()) == [("/a", 0, "x")]
    store.put(manifest(spark, ("/b", 0, 1)), segs(spark, ("/b", 0, "y")))
    assert texts(store.segments()) == [("/a", 0, "x"), ("/b", 0, "y")]


def test_ingest_equals_batch_and_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("foo\nbar")
    (src / "b.pdf").write_text("foo")
    store = SegmentStore(spark, str(tmp_path / "store"))
    run = lambda name: incremental.ingest(incremental.arriving_files(spark, str(src)), store, str(tmp_path / name), ScanSpec(("*",))).awaitTermination()
    run("cp")
    assert texts(store.segments()) == [(str(src / "a.txt"), 0, "foo"), (str(src / "a.txt"), 1, "bar")]
    (src / "c.md").write_text("later foo")
    run("cp")
    assert len(texts(store.segments())) == 3
    generations = store.files().select("gen").distinct().count()
    run("cp")  # nothing new
    assert store.files().select("gen").distinct().count() == generations
    (src / "d.txt").write_text("only the fresh checkpoint sees this first")
    run("fresh checkpoint")  # its batches have numbers that the store knows from the other
    assert str(src / "d.txt") in {r.path for r in store.files().collect()} and len(texts(store.segments())) == 4
    (src / "a.txt").write_text("changed in place")
    os.utime(src / "a.txt", (time.time() + 5, time.time() + 5))
    from linetrawl.sources.files import walk_files
    listed = walk_files(spark, [str(src)], ScanSpec((".txt", ".md")))
    assert [os.path.basename(r.path) for r in store.misses(listed).collect()] == ["a.txt"]


def test_ingest_two_folders_below_an_excluded_name(spark, tmp_path):
    """Excluded names count below the root only, and two checkpoints never take each other's batches for replays."""
    store = SegmentStore(spark, str(tmp_path / "store"))
    for name in ("one", "two"):
        src = tmp_path / "venv" / name
        (src / ".git").mkdir(parents=True)
        (src / "a_b_meta.json").write_text("{}")
        (src / "_x_meta.json").write_text("mine")
        (src / f"{name}.txt").write_text(name)
        (src / ".git" / "hidden.txt").write_text("no")
        files = incremental.arriving_files(spark, str(src))
        incremental.ingest(files, store, str(tmp_path / f"cp-{name}"), ScanSpec(("*",)), [str(src)]).awaitTermination()
    assert sorted(os.path.basename(r.path) for r in store.files().collect()) == ["a_b_meta.json", "a_b_meta.json", "one.txt", "two.txt"]


def test_replayed_batch_is_stored_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("foo")
    store = SegmentStore(spark, str(tmp_path / "store"))
    run = lambda: incremental.ingest(incremental.arriving_files(spark, str(src)), store, str(tmp_path / "cp"), ScanSpec(("*",))).awaitTermination()
    run()
    for commit in (tmp_path / "cp/commits").glob("*0*"):
        commit.unlink()  # as if the job had died before the batch counted as done
    run()
    assert store.files().select("gen").distinct().count() == 1 and store._next_generation() == 1


def test_unreadable_log_is_not_an_empty_store(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "store"))
    (tmp_path / "store/files/gen=0").mkdir(parents=True)
    (tmp_path / "store/files/gen=0/part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="part-0|CANNOT_READ|footer|FAILED"):
        store._next_generation()


def test_standing_searches_equal_batch(spark, tmp_path):
    spec = SearchSpec(("foo", "bar"), max_hits_per_file=3)
    whole = spark.createDataFrame([("/a", "foo bar foo foo"), ("/b", "foo"), ("/c", "x\nbar foo")], "path string, text string")
    whole.write.parquet(str(tmp_path / "texts"))
    stream = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "texts"))
    hits = incremental.standing_search(stream, spec)
    hits.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start(
        str(tmp_path / "h1")).awaitTermination()
    got = spark.read.schema(hits.schema).parquet(str(tmp_path / "h1"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search_texts(whole, spec).collect()))
    rows = segs(spark, ("/a", 0, "foo"), ("/a", 1, "bar foo"), ("/b", 0, "foo"))
    rows.write.parquet(str(tmp_path / "segs"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "segs"))
    incremental.standing_segment_search(stream, spec, str(tmp_path / "h2"), str(tmp_path / "c2")).awaitTermination()
    batch = search_segments(rows, spec)
    got = spark.read.schema(batch.schema).parquet(str(tmp_path / "h2/batch=*"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_runs_and_latest(spark, tmp_path):
    root, latest = str(tmp_path / "runs"), str(tmp_path / "latest")
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    write_run(df, root, "20240101-000000", latest)
    write_run(df.withColumn("a", F.lit(2)), root, "20240102-000000", latest)
    assert sorted((r.a, r.run_ts) for r in read_runs(spark, root).collect()) == [(1, "20240101-000000"), (2, "20240102-000000")]
    assert [r.a for r in spark.read.parquet(latest).collect()] == [2]
    write_run(df, root, "20240103-000000", f"{root}/run_ts=20240103-000000")
    assert spark.read.parquet(f"{root}/run_ts=20240103-000000").count() == 1


def diffed(spark, prev, cur):
    p = spark.createDataFrame(prev, "id string, file string, last_modified string, exported_at string, file_exists boolean")
    c = spark.createDataFrame(cur, "id string, file string, last_modified string, failed boolean")
    return snapshot.diff(p, c)


def test_snapshot_classes_and_next_manifest(spark):
    prev = [(i, f, "t1", "e0", e) for i, f, e in [
        ("same", "a.docx", True), ("case", "B.docx", True), ("ren", "old.docx", True), ("chg", "c.docx", True), ("both", "d0.docx", True),
        ("gone", "e.docx", True), ("lost", "f.docx", False), ("void", "g.docx", False), ("fail", "h.docx", True)]]
    cur = [("same", "a.docx", "t1", False), ("case", "b.docx", "t1", False), ("ren", "new.docx", "t1", False), ("chg", "c.docx", "t2", False),
           ("both", "d.docx", "t2", False), ("lost", "f.docx", "t1", False), ("fail", "h2.docx", "t2", True), ("new", "n.docx", "t2", False),
           ("newfail", "m.docx", "t2", True)]
    d = diffed(spark, prev, cur)
    got = {r.id: (r["class"], r.action, r.drop_old_file) for r in d.collect()}
    assert got == {
        "same": ("unchanged", "none", False), "case": ("unchanged", "none", False), "ren": ("renamed", "move", False),
        "chg": ("changed", "export", False), "both": ("changed", "export", True), "gone": ("deleted", "delete", True),
        "lost": ("changed", "export", False), "void": ("deleted", "none", False), "fail": ("failed", "none", False),
        "new": ("new", "export", False), "newfail": ("failed", "none", False)}
    assert tuple(snapshot.diff_counts(d).first()) == (4, 3, 1, 1, 2)
    nxt = {r.id: (r.file, r.last_modified, r.exported_at) for r in snapshot.next_manifest(d, "E1").collect()}
    assert nxt == {
        "same": ("a.docx", "t1", "e0"), "case": ("b.docx", "t1", "e0"), "ren": ("new.docx", "t1", "e0"), "chg": ("c.docx", "t2", "E1"),
        "both": ("d.docx", "t2", "E1"), "lost": ("f.docx", "t1", "E1"), "fail": ("h.docx", "t1", "e0"), "new": ("n.docx", "t2", "E1")}


def test_names_are_deduplicated_across_blocks(spark):
    df = spark.range(200000).selectExpr("id as ord", "if(id % 3 = 0, 'Hot.docx', if(id % 2 = 0, 'hot.docx', concat('n', id, '.docx'))) as file")
    got = snapshot.dedupe_names(df)
    hot = got.filter(F.lower("file").startswith("hot")).orderBy("ord").select("file").collect()
    assert [r.file.lower() for r in hot] == ["hot.docx"] + [f"hot_{i}.docx" for i in range(1, len(hot))]
    assert got.count() == 200000


def test_running_total_equals_window(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 0, id % 7) k", "id * 31 % 5003 o", "id % 5 v")
    got = running_total(df, ["k"], ["o"], F.col("v"), "t", block=100)
    want = df.selectExpr("*", "coalesce(sum(v) over (partition by k order by o rows between unbounded preceding and 1 preceding), 0) t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_manifest_parsing_tolerates_damage(spark):
    df = spark.createDataFrame([('{"granularity": "page", "items": {"a": {"file": "x"}}}',), ("{oops",), ("",), ('{"granularity": "section", "items": {"b": {}}}',),
                                ('{"items": {"c": {"file": "y"}}}',)], "json string")
    assert sorted(r.id for r in snapshot.manifest_items(df).collect()) == ["a", "b", "c"]
    assert sorted(r.id for r in snapshot.manifest_items(df, "page").collect()) == ["a", "c"]


def test_highlight_is_one_pass(spark):
    df = spark.createDataFrame([("a <b> span & SPAN $1 \\E",)], "t string")
    show = lambda *k, **o: df.select(report.highlight(F.col("t"), SearchSpec(k, **o))).first()[0]
    hl = lambda s: f'<span class="hl">{s}</span>'
    assert show("span", "a") == f'{hl("a")} &lt;b&gt; {hl("span")} &amp; {hl("SPAN")} $1 \\E'
    assert show("amp", "&") == f'a &lt;b&gt; span {hl("&amp;")} SPAN $1 \\E'
    assert show(r"\bspan\b", "b>", mode="regex") == f'a &lt;{hl("b&gt;")} {hl("span")} &amp; {hl("SPAN")} $1 \\E'
    assert show("<b>", "\\E") == f'a {hl("&lt;b&gt;")} span &amp; SPAN $1 {hl(chr(92) + "E")}'
    assert show("span", case_sensitive=True) == f'a &lt;b&gt; {hl("span")} &amp; SPAN $1 \\E'
    assert show("s[a-z]+n", mode="regex") == f'a &lt;b&gt; {hl("span")} &amp; {hl("SPAN")} $1 \\E'


def test_summary_and_skips(spark):
    out = spark.createDataFrame([("/a", "hit", None, None, 2), ("/b", "skip", "binary", None, 0), ("/c", "skip", "binary", None, 0),
                                 ("/d", "skip", "scope_out", None, 0), ("/e", "error", None, "extract_error: x\x07", 0)],
                                "path string, outcome string, reason string, error string, n_hits bigint")
    row = report.run_summary(out, SearchSpec(("foo", "bar"))).first()
    assert (row.n_files, row.n_hit_files, row.n_hits, row.n_skipped, row.n_errors) == (5, 1, 2, 3, 1)
    assert row.keywords == "foo, bar" and row.skip_breakdown == "binary=2, scope_out=1"
    pairs = {r.key: r.value for r in report.summary_rows(report.run_summary(out, SearchSpec(("foo",)))).collect()}
    assert pairs["走査ファイル数"] == "5" and pairs["スキップ内訳"] == "binary=2, scope_out=1"
    assert report.errors(out).first().error == "extract_error: x "
    assert sorted((r.reason, r.path) for r in report.skipped(out).collect()) == [("binary", "/b"), ("binary", "/c"), ("scope_out", "/d")]
    empty = out.filter("false")
    assert report.run_summary(empty, SearchSpec(("foo",))).first().n_files == 0


def test_shared_dir_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark, "x").startswith(base) and shared_dir(spark, "x") != shared_dir(spark, "x")


@pytest.mark.parametrize("name", ["notes.txt", "_index.html", "search_result_latest.html"])
def test_report_index_excludes(spark, name):
    runs = spark.createDataFrame([(name, T0, 1), ("search_result_1.html", T0, 2048), ("search_result_2.HTML", T0, 5)], "name string, mtime timestamp, size bigint")
    got = report.report_index(runs, ".html", ("search_result_latest.html",)).orderBy("name").collect()
    assert [(r.name, r.size) for r in got] == [("search_result_1.html", "2.0 KB"), ("search_result_2.HTML", "5 B")]
