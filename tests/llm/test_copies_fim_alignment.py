"""Filling in the middle, cross-tokenizer alignment and exact duplicates against brute force and hard cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from linetrawl.llm import alignment, common, exactdup, fim, queries

DOCS = "doc_id long, text string, lang string, n long, form string, digest string, row string"
ODD = ["a b<M>c", "<P>", "ab<", "x" * 200_000, "word, " * 40_000, "漢字\U0001f600 ünï ", "\r\n\t \x0b", " \x00 ", "\\1 $2 \\E", "tail <S"]
HARD = [(i, text, "en", 7, "f", "d", "r") for i, text in enumerate(ODD)] + [
    (20, None, None, None, None, None, None), (21, "", None, None, None, None, None), (None, "no id  here", None, 1, "f", "d", "r"),
    (23, "same  text", None, None, None, None, None), (23, "same  text", None, None, None, None, None), (24, "sametext", None, None, None, None, None),
    (22, "same text ", None, None, None, None, None), (None, "noidhere", None, 1, "f", "d", "r"), (25, "<|endoftext|></s><unk> <0x41>▁", None, 1, "f", "d", "r"),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# ------------------------------------------------------------------------------------ 11 fill-in-middle
def expected_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return len(units), "plain", text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if h[3] % 100 < 20 else (len(units), "psm", f"<P>{prefix}<S>{suffix}<M>{middle}")


def test_fim_equals_brute_force_and_restores(spark, hard, sf_dir):
    docs = hard.select("doc_id", "text").unionAll(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = fim.restore(fim.transform(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n, r.form, r.fim) == expected_fim(r.doc_id, r.text)
        assert r.restored == (r.text or "")
        assert (r.prefix is None) == (r.form == "plain")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_fim_keeps_other_columns_and_replaces_its_own(hard, nothing):
    out = fim.restore(fim.transform(hard))
    assert out.columns == ["doc_id", "text", "lang", "digest", "row", "n", "form", "fim", "prefix", "middle", "suffix", "restored"]
    assert fim.restore(fim.transform(nothing)).count() == 0
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_fim_with_other_marks_and_shares(spark):
    marks = ("$1\\", "[S]", "(M")
    rows = spark.createDataFrame([(i, f"some words (number {i}) and more") for i in range(300)], "doc_id long, text string")
    out = fim.restore(fim.transform(rows, seed=5, plain_percent=0, spm_percent=100, marks=marks), marks).collect()
    assert {r.form for r in out} == {"spm"}
    assert all(r.restored == r.text and r.fim.startswith("[S]") for r in out)
    assert len({len(r.prefix) for r in out}) > 5


# ------------------------------------------------------------------------------------ 12 alignment
@pytest.fixture(scope="module")
def reference_encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.VOCABULARY_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.VOCABULARY_B)
    letters = alignment._byte_letters()
    bytes_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    bytes_b = lambda i: alignment._piece_bytes(b.id_to_piece(i))
    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids), b.encode, bytes_a, bytes_b


def expected_groups(text, encoders):
    """Groups as pairs of id lists, by walking both sides to their common ends."""
    encode_a, encode_b, bytes_a, bytes_b = encoders
    if not text:
        return []
    a, b = encode_a(text), encode_b(text)
    whole = (" " + text).encode()
    if b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
        return []
    ends_a, ends_b = np.cumsum([len(bytes_a(i)) for i in a]), np.cumsum([len(bytes_b(i)) for i in b])
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
        k, m = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return groups


def expected_scores(docs, encoders):
    grouped = [(doc, expected_groups(text, encoders)) for doc, text in docs]
    held = [collections.Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in grouped]
    counts = collections.Counter(pair for links in held for pair in links)
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (doc, groups), links in zip(grouped, held):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()),
                    sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
key = lambda row: tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 300])
def test_alignment_equals_brute_force(spark, hard, sf_dir, reference_encoders, broadcast_pairs):
    few = common.table(spark, sf_dir, "documents").orderBy("doc_id").limit(60).select("doc_id", "text")
    docs = hard.select("doc_id", "text").unionAll(few)
    got = alignment.score_links(docs, broadcast_pairs=broadcast_pairs)
    assert got.columns == ALIGNED
    want = expected_scores([tuple(r) for r in docs.collect()], reference_encoders)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_alignment_columns_spell_the_groups(hard, nothing, reference_encoders):
    for r in alignment.align(hard).collect():
        text = dict((d, t) for d, t, *_ in HARD)[r.doc_id] if r.doc_id not in (None, 23) else None
        assert sum(r.a_sizes) == len(r.a_ids) and sum(r.b_sizes) == len(r.b_ids)
        if text is not None:
            groups, i, j = [], 0, 0
            for x, y in zip(r.a_sizes, r.b_sizes):
                groups.append((r.a_ids[i:i + x], r.b_ids[j:j + y]))
                i, j = i + x, j + y
            assert groups == expected_groups(text, reference_encoders)
    assert alignment.align(nothing).count() == alignment.score_links(nothing).count() == 0


def test_pieces_and_parts_equal_the_whole(monkeypatch, spark, reference_encoders):
    rng = random.Random(3)
    words = ["alpha", "Beta's", "1,234", "ünï", "漢字", "x" * 40, "  ", "\n", "a-b", "\U0001f600"]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(6)]
    monkeypatch.setattr(alignment, "PIECE_CHARS", 100)
    assert len(list(alignment._pieces(" " + texts[0]))) > 5
    with open(alignment.VOCABULARY_A, encoding="utf-8") as a, open(alignment.VOCABULARY_B, "rb") as b:
        encoders = alignment.Encoders(a.read(), b.read())
    for text, (a, b) in zip(texts, encoders.encode(texts)):
        assert (a.tolist(), b) == (reference_encoders[0](text), reference_encoders[1](text))
    counts = np.array([1, 3, 2])
    doc = np.repeat(np.arange(3), counts)
    ids = np.array([5, 5, 2, 5, 9, 9])
    group = np.array([0, 1, 1, 2, 3, 3])
    whole = list(alignment._pairs(doc, doc, ids, ids, group, group, 32))
    monkeypatch.setattr(alignment, "PAIRS", 2)
    parts = list(alignment._pairs(doc, doc, ids, ids, group, group, 32))
    assert len(whole) == 1 and len(parts) > 1
    assert [np.concatenate(x).tolist() for x in zip(*parts)] == [np.concatenate(x).tolist() for x in zip(*whole)]


def test_a_long_group_is_counted_not_expanded():
    """100,000 tokens of one id against as many of another are 10 billion links of one pair."""
    n = 100_000
    one = np.zeros(n, np.int64)
    (doc, a, b, times), = alignment._pairs(one, one, one + 3, one + 4, one, one, 32)
    assert (doc.tolist(), a.tolist(), b.tolist(), times.tolist()) == ([0], [3], [4], [n * n])


def test_groups_by_pointer_jumping():
    rng = random.Random(1)
    for _ in range(200):
        total = rng.randrange(1, 60)
        cuts = [sorted({total, *(rng.randrange(1, total + 1) for _ in range(rng.randrange(30)))}) for _ in range(2)]
        common_ends = sorted(set(cuts[0]) & set(cuts[1]))
        for got, ends in zip(alignment.label_groups(*map(np.array, cuts)), cuts):
            assert got.tolist() == np.searchsorted(common_ends, ends).tolist()
    odd = np.arange(1, 100_001) * 2
    shifted = np.append(odd[:-1] + 1, odd[-1])
    a, b = alignment.label_groups(odd, shifted)
    assert not a.any() and not b.any()


# ------------------------------------------------------------------------------------ 13 exact duplicates
def expected_copies(rows):
    groups = collections.defaultdict(list)
    for at, (doc, text) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, at, doc))
    out = []
    for normal, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m is best, hashlib.sha256(normal.encode()).hexdigest()) for m in members]
    return out


@pytest.mark.parametrize("support", [exactdup.SUPPORT, 0.1, 0.5])
def test_copies_equal_brute_force(spark, hard, sf_dir, support):
    table = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = hard.select("doc_id", "text").unionAll(table).unionAll(table.filter("doc_id % 3 = 0"))
    got = exactdup.mark_copies(docs, support=support)
    want = expected_copies([tuple(r) for r in docs.collect()])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_a_hot_group_is_settled_before_the_shuffle(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = exactdup.digests(docs)
    best, = exactdup.winners(rows, 0.01).collect()
    assert (best.group_size, best.best.id) == (1000, 0)
    assert sum(r.kept for r in exactdup.mark_copies(docs).collect()) == 2001
    assert exactdup.winners(exactdup.digests(docs.limit(0)), 0.01).count() == 0


def test_dropped_copies_leave_whole_rows(spark, hard, nothing):
    docs = hard.unionAll(hard.filter("doc_id < 5"))
    for support in (exactdup.SUPPORT, 0.15):
        left = exactdup.drop_copies(docs, support=support)
        assert left.schema == docs.schema
        kept = sorted((r.doc_id is not None, r.doc_id or 0) for r in exactdup.mark_copies(docs, support=support).filter("kept").collect())
        assert sorted((r.doc_id is not None, r.doc_id or 0) for r in left.collect()) == kept
    assert exactdup.drop_copies(nothing).count() == exactdup.mark_copies(nothing).count() == 0


def test_queries_of_this_file_keep_their_columns(spark, sf_dir):
    for name, columns in {
        "op11_fim": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
        "op12_align": ALIGNED, "op13_exact": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    }.items():
        assert queries.QUERIES[name](spark, sf_dir).columns == columns
    plan = queries.QUERIES["op13_exact"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
