"""A store that follows a tree: new, edited, unreadable and vanished files between triggers."""

import os

import pytest

from linetrawl import ScanSpec
from linetrawl.sinks.store import SegmentStore
from linetrawl.sources import datasource as src
from linetrawl.streaming.incremental import follow

SPEC = ScanSpec((".txt", ".md"))


def write(path, text, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


@pytest.fixture
def followed(spark, tmp_path):
    root, store = tmp_path / "in", SegmentStore(spark, str(tmp_path / "store"), groups=2)
    root.mkdir()

    def trigger(**more):
        files = src.listings(spark, [str(root)], SPEC)
        follow(files, store, str(tmp_path / "cp"), SPEC, [str(root)], **more).awaitTermination()
        return sorted((os.path.relpath(r.path, root), r.text) for r in store.segments().collect())

    return root, store, trigger


def test_edited_files_are_taken_up(followed):
    root, store, trigger = followed
    write(root / "a.txt", "one\ntwo", 1_700_000_000)
    write(root / "sub/b.md", "bee", 1_700_000_000)
    write(root / ".git/no.txt", "no", 1_700_000_000)
    write(root / "c.pdf", "no", 1_700_000_000)
    assert trigger() == [("a.txt", "one"), ("a.txt", "two"), ("sub/b.md", "bee")]
    assert trigger() and store.generations() == [0]  # nothing changed: no generation
    write(root / "a.txt", "changed in place", 1_700_000_009)
    write(root / "late.txt", "older than all others", 1_600_000_000)
    assert trigger() == [("a.txt", "changed in place"), ("late.txt", "older than all others"), ("sub/b.md", "bee")]
    assert store.generations() == [0, 1] and store._log([1]).count() == 2  # only what changed


def test_vanished_and_unreadable_files(spark, followed, tmp_path):
    root, store, trigger = followed
    write(root / "a.txt", "stays", 1_700_000_000)
    write(root / "b.txt", "goes", 1_700_000_000)
    (root / "broken.txt").symlink_to(root / "nothing.txt")
    assert trigger() == [("a.txt", "stays"), ("b.txt", "goes")]
    (root / "b.txt").unlink()
    (root / "broken.txt").unlink()
    write(root / "broken.txt", "mended", 1_700_000_000)
    assert trigger() == [("a.txt", "stays"), ("b.txt", "goes"), ("broken.txt", "mended")]
    assert trigger(forget_missing=True) == [("a.txt", "stays"), ("broken.txt", "mended")]
    with pytest.raises(ValueError, match="roots"):
        follow(src.listings(spark, [str(root)], SPEC), store, str(tmp_path / "other"), SPEC, forget_missing=True)


def test_a_replayed_listing_changes_nothing(followed, tmp_path):
    root, store, trigger = followed
    write(root / "a.txt", "one", 1_700_000_000)
    trigger()
    for commit in (tmp_path / "cp/commits").glob("*0*"):
        commit.unlink()  # as if the job had died before the batch counted as done
    assert trigger() == [("a.txt", "one")] and store.generations() == [0]


def test_an_empty_tree(followed):
    _, store, trigger = followed
    assert trigger() == [] and store.generations() == []
