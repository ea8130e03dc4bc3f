"""What the Python lanes hold at a time does not grow with the rows of an Arrow batch."""

import re
import tracemalloc

import charset_normalizer
import numpy as np
import pyarrow as pa
import pytest

from linetrawl import SearchSpec
from linetrawl.functions.batches import SLICE_BYTES, SLICE_ROWS, cuts, row_sizes, sliced
from linetrawl.operators import matching
from linetrawl.operators.automaton import Keywords
from linetrawl.plans import office_fixtures
from linetrawl.sources import packages, splits
from linetrawl.sources.plaintext import guess_decode

SEGS = pa.list_(pa.struct([("seg_idx", pa.int32()), ("line_no", pa.int32()), ("text", pa.string())]))


class Rows:
    """Gives the function that a frame would run on its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


class Lane:
    """A Python function of columns that calls nothing."""

    def asNondeterministic(self):
        return lambda *columns: None


def peak(run) -> tuple:
    """The result of a call, and the most MB of Python objects held during it."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def segs(rows, text):
    lines = [{"seg_idx": i, "line_no": i + 1, "text": text} for i in range(5)]
    return pa.array([None, [], *[lines] * rows], SEGS)


def test_cuts_hold_every_row_once_in_order():
    sizes = np.array([0, SLICE_BYTES * 3, 1, *[SLICE_BYTES // 4] * 9, *[0] * (SLICE_ROWS * 2 + 1)])
    ranges = list(cuts(sizes))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(len(sizes)))
    assert all(b - a <= SLICE_ROWS and (b - a == 1 or sizes[a:b].sum() <= SLICE_BYTES) for a, b in ranges)
    assert list(cuts(np.zeros(0, np.int64))) == []


def test_slices_of_a_sliced_array_keep_their_rows():
    rows = pa.array([[{"seg_idx": i, "line_no": None, "text": "é" * i}] * (i % 3) if i % 7 else None for i in range(5000)], SEGS)[13:]
    assert sliced(rows, lambda some: some).to_pylist() == rows.to_pylist()
    assert row_sizes(rows).tolist() == [sum(64 + len(s["text"].encode()) for s in r or []) for r in rows.to_pylist()]
    assert sliced(rows[:0], lambda some: some).to_pylist() == []


@pytest.mark.parametrize("mode, keywords", [("regex", ("(?:a|b)+c?",)), ("keyword", tuple(f"w{i:02}" for i in range(50)))])
def test_hits_are_held_for_a_slice_only(monkeypatch, mode, keywords):
    spec = SearchSpec(keywords, mode=mode, operator="or")
    rows = segs(4000, "w01 ab w02 abc w03 b w04 a " * 4)
    shared = type("Shared", (), {"value": Keywords(matching._needles(spec))})
    lanes = []
    monkeypatch.setattr(matching.F, "arrow_udf", lambda returns: lambda lane: lanes.append(lane) or Lane())
    matching.regex_hits_exact(None, spec) if mode == "regex" else matching.automaton_hits(None, spec, shared, False)
    found, most = peak(lambda: lanes[0](rows))
    assert found[:2].to_pylist() == [[], []] and len(found) == len(rows) and len(found[2]) == len(found[-1]) == 20
    assert found[2:].value_lengths().unique().to_pylist() == [20]
    assert most < 30


def test_guessed_texts_are_held_for_a_slice_only(monkeypatch):
    best = lambda data: type("Match", (), {"best": lambda self: bytes(data).decode("utf-16")})()
    monkeypatch.setattr(charset_normalizer, "from_bytes", best)
    content = pa.array([None, *[("text " * 800).encode("utf-16")] * 6000], pa.binary())
    texts, most = peak(lambda: guess_decode.func(content))
    assert texts[0].as_py() is None and len(texts) == 6001 and set(texts[1:].unique().to_pylist()) == {"text " * 800}
    assert most < 15


def test_packages_are_handed_on_before_many_are_held():
    run = office_fixtures._write(Rows(), lambda row: row["text"].encode())
    batch = pa.RecordBatch.from_pylist([{"path": f"p{i}", "text": "x" * 60_000} for i in range(200)])
    out = list(run([batch, batch.slice(0, 0)]))
    assert [p for b in out for p in b["path"].to_pylist()] == [f"p{i}" for i in range(200)]
    assert max(b.nbytes for b in out) < 2 * SLICE_BYTES


def test_part_rows_are_handed_on_by_their_size():
    reader = lambda z: ({"kind": "row", "row": n, "items": [{"ord": 0, "text": "y" * 100_000}]} for n in range(100))
    book = office_fixtures._zip({"a.xml": "<a/>"})
    batch = pa.RecordBatch.from_arrays([pa.array(["b1", "b2", "bad"]), pa.array([book, book, b"no zip"], pa.binary())], names=["path", "content"])
    out = list(packages.unpack(Rows(), reader)([batch]))
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["path"], r["row"]) for r in rows[:-1]] == [(p, n) for p in ("b1", "b2") for n in range(100)]
    assert re.match("extract_error", rows[-1]["error"]) and max(b.nbytes for b in out) < 2 * SLICE_BYTES


def test_small_splits_are_handed_on_together(tmp_path):
    lines = "".join(f"line {n}\n" for n in range(400)).encode()
    (tmp_path / "a.txt").write_bytes(lines)
    (tmp_path / "big.txt").write_bytes(b"z" * (3 * SLICE_BYTES))
    ranges = [(str(tmp_path / "a.txt"), n, n + 10) for n in range(0, len(lines), 10)]
    ranges += [(str(tmp_path / "big.txt"), 0, 3 * SLICE_BYTES), (str(tmp_path / "gone.txt"), 0, 10)]
    batch = pa.RecordBatch.from_pylist([{"path": p, "start": a, "stop": b} for p, a, b in ranges])
    frame = Rows()
    frame.schema = type("Schema", (), {"simpleString": lambda self: "struct<path:string,start:bigint,stop:bigint>"})()
    out = list(splits.read_splits(frame)([batch, batch.slice(0, 0)]))
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["path"], r["start"], r["stop"]) for r in rows] == ranges
    assert b"".join(r["content"] for r in rows[:-2]) == lines and rows[0]["head"] == lines[:8192] and rows[1]["head"] is None
    assert len(rows[-2]["content"]) == 3 * SLICE_BYTES and rows[-1]["content"] is None and "extract_error" in rows[-1]["error"]
    assert [b.num_rows for b in out] == [len(ranges) - 2, 1, 1]
