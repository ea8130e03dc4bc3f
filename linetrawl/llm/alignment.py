"""Alignment of two tokenizers: tokens that overlap in bytes form groups, found by pointer jumping."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linetrawl.llm.common import stored

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Pre-tokens of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are encoded in pieces of about this many characters; pairs of tokens are expanded about as many at a time.
PIECE_CHARS, CHUNK_CHARS, PAIRS = 1 << 17, 1 << 18, 1 << 19
#: Counts of at most this many pairs of ids are broadcast.
BROADCAST_PAIRS = 1 << 19
#: Where a long text may be cut: neither tokenizer joins a letter to a space after it, nor looks across.
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")

TOKENS = "row long, doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"
LINKS = ("row long, part int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "a array<int>, b array<int>, times array<long>")


# --------------------------------------------------------------------------------- tokenizers
class Encoders:
    """Both tokenizers, with the bytes of every token; made once in each worker."""

    def __init__(self, vocabulary_a: str, model_b: bytes):
        import sentencepiece
        import tiktoken

        model = json.loads(vocabulary_a)["model"]
        shown = _byte_letters()
        self.bytes_a = [b""] * (max(model["vocab"].values()) + 1)
        for token, number in model["vocab"].items():
            self.bytes_a[number] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
        # Merges in the order of their results' ids are what a table of ranks expresses.
        ranks = {self.bytes_a[model["vocab"][c]]: model["vocab"][c] for c in shown}
        for merge in model["merges"]:
            merged = "".join(merge.split(" ") if isinstance(merge, str) else merge)
            number = model["vocab"][merged]
            if number != len(ranks):
                raise ValueError("the merges of this vocabulary are not in the order of their ids")
            ranks[self.bytes_a[number]] = number
        self.a = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        self.bytes_b = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, list[int]]]:
        """Ids of space + text in both; nothing where the bytes of either differ from it.

        Merging bytes loses none, so for the first side their number tells.
        """
        pieces, owner = [], []
        for i, text in enumerate(texts):
            for piece in _pieces(" " + text) if text else ():
                pieces.append(piece)
                owner.append(i)
        found: list[tuple[list, list]] = [([], []) for _ in texts]
        of_b = self.b.encode([p[1:] for p in pieces], num_threads=1) if pieces else []
        for i, piece, b in zip(owner, pieces, of_b):
            found[i][0].append(self.a.encode_to_numpy(piece, disallowed_special=()))
            found[i][1].extend(b)
        out = []
        for text, (parts, b) in zip(texts, found):
            a = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
            whole = (" " + text).encode()
            same = self.size_a[a].sum() == len(whole) and b"".join(map(self.bytes_b.__getitem__, b)) == whole
            out.append((a, b) if same else (a[:0], []))
        return out


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _piece_bytes(piece: str) -> bytes:
    byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


def _pieces(text: str):
    """The text in pieces that begin with a space and are encoded one by one as in the whole."""
    start = 0
    while len(text) - start > PIECE_CHARS:
        cut = _CUT.search(text, start + PIECE_CHARS)
        if not cut:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


_ENCODERS: dict[int, Encoders] = {}


def _encoders(vocabulary_a: str, model_b: bytes) -> Encoders:
    key = hash((vocabulary_a, model_b))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoders(vocabulary_a, model_b)
    return _ENCODERS[key]


# --------------------------------------------------------------------------------- groups
def label_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of every token, counted from 0 in text order, given where the tokens of both sides end.

    Each token points to the farthest-right token that it overlaps on the other side, which holds its last byte; a
    token of the first side that ends where that one ends is terminal and points to itself. The successors are doubled
    until they stand still, in as many rounds as the logarithm of the longest chain. Both sides must end at the same byte.
    """
    n, total = len(ends_a), int(ends_a[-1])
    over_b, over_a = _ends_before(ends_b, total)[ends_a - 1], _ends_before(ends_a, total)[ends_b - 1]
    successor = np.concatenate([np.where(ends_b[over_b] == ends_a, np.arange(n), n + over_b), over_a])
    while True:
        doubled = successor[successor]
        if np.array_equal(doubled, successor):
            break
        successor = doubled
    terminal = successor[:n] == np.arange(n)
    groups = (np.cumsum(terminal) - 1)[successor]
    return groups[:n], groups[n:]


def _ends_before(ends: np.ndarray, total: int) -> np.ndarray:
    """For every byte, how many tokens have ended when it begins: the number of the token that holds it."""
    marks = np.zeros(total, np.int64)
    marks[ends[:-1]] = 1
    return np.cumsum(marks)


def _batch(encoders: Encoders, texts: list[str]):
    """Flat ids, lengths per text, and the group of every token over all texts of a chunk."""
    encoded = encoders.encode(texts)
    count_a = np.array([len(a) for a, _ in encoded], np.int64)
    count_b = np.array([len(b) for _, b in encoded], np.int64)
    a = np.concatenate([np.zeros(0, np.int64), *[ids for ids, _ in encoded]])
    b = np.fromiter(itertools.chain.from_iterable(ids for _, ids in encoded), np.int64, count_b.sum())
    if not len(a):
        return a, b, count_a, count_b, a, b
    # The two sides of a text have equally many bytes, so texts can be laid end to end.
    group_a, group_b = label_groups(np.cumsum(encoders.size_a[a]), np.cumsum(encoders.size_b[b]))
    return a, b, count_a, count_b, group_a, group_b


def _bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _chunks(batches):
    """Rows of Arrow batches ``(row, doc_id, text)`` as lists of about ``CHUNK_CHARS`` characters."""
    rows, texts, size = [], [], 0
    for batch in batches:
        for row, doc, text in zip(*[c.to_pylist() for c in batch.columns]):
            rows.append((row, doc))
            texts.append(text or "")
            size += len(texts[-1]) + 16  # empty texts count as well
            if size >= CHUNK_CHARS:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _lists(values: np.ndarray, bounds: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _tokens(batches, vocabulary_a, model_b):
    encoders = _encoders(vocabulary_a, model_b)
    for rows, texts in _chunks(batches):
        a, b, count_a, count_b, group_a, group_b = _batch(encoders, texts)
        groups = int(group_a[-1]) + 1 if len(a) else 0
        first = _bounds(np.bincount(group_a, minlength=groups))[:-1]
        owner = np.repeat(np.arange(len(rows)), count_a)[first]
        bounds = _bounds(np.bincount(owner, minlength=len(rows)))
        ids, docs = zip(*rows)
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(docs, pa.int64()),
            _lists(a, _bounds(count_a), pa.int32()), _lists(b, _bounds(count_b), pa.int32()),
            _lists(np.bincount(group_a, minlength=groups), bounds, pa.int32()), _lists(np.bincount(group_b, minlength=groups), bounds, pa.int32()),
        ], names=["row", "doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes"])


def _ship(docs: DataFrame, vocabulary_a: str, vocabulary_b: str):
    """``row, doc_id, text`` and the two vocabularies, read on the driver, for the tasks."""
    with open(vocabulary_a, encoding="utf-8") as file:
        a = file.read()
    with open(vocabulary_b, "rb") as file:
        b = file.read()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows, a, b


def align(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """``row, doc_id, a_ids, b_ids, a_sizes, b_sizes``: the tokens of every text in both vocabularies and their groups.

    Both encode space + text, as plain text throughout. Byte offsets where tokens of both end cut the tokens into
    groups: group g holds the next ``a_sizes[g]`` of ``a_ids`` and the next ``b_sizes[g]`` of ``b_ids``. Texts that are null, empty or whose
    tokens do not spell space + text exactly have no tokens. ``row`` numbers the rows, for repeated and null ids; other
    columns are ignored; an empty table gives no rows. Long texts are encoded in pieces cut where a space lies between
    ASCII letters, which neither tokenizer looks across; only a text without such a place is encoded at once.
    """
    rows, a, b = _ship(docs, vocabulary_a, vocabulary_b)
    return rows.mapInArrow(lambda batches: _tokens(batches, a, b), TOKENS)


# --------------------------------------------------------------------------------- links
def links(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """The groups of :func:`align` as links: parts of rows with ``a[i], b[i]`` linked ``times[i]`` times.

    A link is a pair of an occurrence of a first-side and one of a second-side token in one group. A row lists each pair of ids
    once over all its parts; its first part (0) also holds the counts of tokens, groups and links and the
    digest of its groups, written ``a1,a2|b1;a3|b2,b3`` in ids. A large group never becomes all its occurrence pairs: equal ids in it are
    counted first, and pairs are expanded a range of first-side ids at a time, each range a part. Rows without tokens have part 0, with
    zeros, an empty digest and no pairs.
    """
    rows, a, b = _ship(docs, vocabulary_a, vocabulary_b)
    return rows.mapInArrow(lambda batches: _links(batches, a, b), LINKS)


@functools.cache
def _digits(ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the ids below ``ids``, and how many they are."""
    text = np.array([str(i) for i in range(ids)], "S")
    return text.view(np.uint8).reshape(ids, -1), np.char.str_len(text)


def _spelt(a, b, group_a, group_b, count_a, count_b, ids: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups as bytes, and where each text begins and ends in them."""
    groups = int(group_a[-1]) + 1
    first_a, first_b = (_bounds(np.bincount(g, minlength=groups)) for g in (group_a, group_b))
    # A token's place: all earlier ones of its side, and those of the other side in earlier groups (or this one).
    at_a, at_b = np.arange(len(a)) + first_b[group_a], np.arange(len(b)) + first_a[group_b + 1]
    token, behind = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    token[at_a], token[at_b] = a, b
    behind[at_a[first_a[1:] - 1]], behind[at_b[first_b[1:] - 1]] = ord("|"), ord(";")
    digits, width = _digits(ids)
    width = width[token]
    ends = np.cumsum(width + 1)
    out = np.empty(ends[-1], np.uint8)
    out[ends - 1] = behind
    for place in range(int(width.max())):
        there = np.flatnonzero(width > place)
        out[ends[there] - width[there] - 1 + place] = digits[token[there], place]
    return out, np.append(0, ends)[_bounds(count_a + count_b)]


def _counted(doc: np.ndarray, group: np.ndarray, ids: np.ndarray, many: np.ndarray):
    """``doc, group, id, times``: equal ids of a group together where ``many`` marks it, sorted by document and id."""
    some = many[group]
    width = int(ids.max(initial=0)) + 1
    keys, times = np.unique(group[some] * width + ids[some], return_counts=True)
    group_doc = np.zeros(len(many), np.int64)
    group_doc[group] = doc
    groups = np.concatenate([group[~some], keys // width])
    ids = np.concatenate([ids[~some], keys % width])
    times = np.concatenate([np.ones(np.count_nonzero(~some), np.int64), times])
    return group_doc[groups], groups, ids, times


def _pairs(doc_a, doc_b, a, b, group_a, group_b, width_b):
    """Parts of the pairs of a chunk: sorted ``doc, a, b`` without repeats and how often each is linked."""
    groups = int(group_a[-1]) + 1
    sizes_a, sizes_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    many = sizes_a * sizes_b > 256
    doc, group, ids, times = _counted(doc_a, group_a, a, many)
    order = np.argsort((doc << 40) + ids)
    doc, group, ids, times = doc[order], group[order], ids[order], times[order]
    _, group_other, other, times_other = _counted(doc_b, group_b, b, many)
    if many.any():
        order = np.argsort(group_other)
        group_other, other, times_other = group_other[order], other[order], times_other[order]
    first = _bounds(np.bincount(group_other, minlength=groups))
    fan = first[group + 1] - first[group]
    before = _bounds(fan)
    changes = np.append(np.flatnonzero((doc[1:] != doc[:-1]) | (ids[1:] != ids[:-1])) + 1, len(doc))
    start = 0
    while start < len(doc):
        at = np.searchsorted(before[changes], before[start] + PAIRS, "right") - 1
        at = max(at, np.searchsorted(changes, start, "right"))
        end = int(changes[at])
        mine = np.repeat(np.arange(start, end), fan[start:end])
        theirs = np.arange(len(mine)) - (before[mine] - before[start]) + first[group[mine]]
        keys = (doc[mine] << 40) + ids[mine] * width_b + other[theirs]
        order = np.argsort(keys)
        keys = keys[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        if many.any():
            linked = np.add.reduceat((times[mine] * times_other[theirs])[order], heads)
        else:
            linked = np.diff(np.append(heads, len(keys)))
        pairs = keys[heads] & ((1 << 40) - 1)
        yield keys[heads] >> 40, pairs // width_b, pairs % width_b, linked
        start = end


def _links(batches, vocabulary_a, model_b):
    encoders = _encoders(vocabulary_a, model_b)
    names = [field.split()[0] for field in LINKS.split(", ")]
    for rows, texts in _chunks(batches):
        a, b, count_a, count_b, group_a, group_b = _batch(encoders, texts)
        n = len(rows)
        groups = int(group_a[-1]) + 1 if len(a) else 0
        doc_a, doc_b = np.repeat(np.arange(n), count_a), np.repeat(np.arange(n), count_b)
        owner = doc_a[_bounds(np.bincount(group_a, minlength=groups))[:-1]]
        per_doc = np.bincount(owner, minlength=n)
        linked = np.zeros(n, np.int64)
        np.add.at(linked, owner, np.bincount(group_a, minlength=groups) * np.bincount(group_b, minlength=groups))
        largest = max(len(encoders.bytes_a), len(encoders.bytes_b))
        spelt, ends = _spelt(a, b, group_a, group_b, count_a, count_b, largest) if groups else (a, np.zeros(n + 1, np.int64))
        shas = [hashlib.sha256(spelt[s:e - 1]).hexdigest() if e > s else "" for s, e in zip(ends.tolist(), ends[1:].tolist())]
        ids, docs = zip(*rows)
        parts = _pairs(doc_a, doc_b, a, b, group_a, group_b, len(encoders.bytes_b)) if groups else iter(())
        parts_of = np.zeros(n, np.int64)
        for doc, of_a, of_b, times in parts:
            here = np.unique(doc)
            bounds = np.append(np.searchsorted(doc, here), len(doc))
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[i] for i in here.tolist()], pa.int64()), pa.array(parts_of[here] + 1, pa.int32()), *[pa.nulls(len(here), pa.int64())] * 5,
                pa.nulls(len(here), pa.string()), _lists(of_a, bounds, pa.int32()), _lists(of_b, bounds, pa.int32()), _lists(times, bounds, pa.int64())], names=names)
            parts_of[here] += 1
        none = np.zeros(n + 1, np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(np.zeros(n), pa.int32()), pa.array(docs, pa.int64()), pa.array(count_a), pa.array(count_b), pa.array(per_doc),
            pa.array(linked), pa.array(shas), _lists(none[:0], none, pa.int32()), _lists(none[:0], none, pa.int32()), _lists(none[:0], none, pa.int64())], names=names)


def score_links(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``.

    The count of a pair of ids is the number of rows, corpus-wide, that hold it linked. ``count_sum`` adds the counts of a row's links, ``n_best`` are
    its links whose count is the highest of their first-side id, ties included. Hard cases are those of :func:`links`.

    Links are found once and stored. Counts are a partial aggregate. Of all rows' pairs, a pair that more than
    1 in ``broadcast_pairs`` is, is frequent; there are at most ``broadcast_pairs`` such, whose counts are broadcast, so frequent pairs meet them
    where they lie. The others, none of which is hot, are shuffled by pair to their counts. Highest counts are one row an id of the vocabulary.
    """
    found = stored(links(docs, vocabulary_a, vocabulary_b), "links")
    pairs = found.filter("part > 0").select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select(
        "row", (F.shiftleft(F.col("p.a").cast("long"), 32) + F.col("p.b")).alias("pair"), F.col("p.times").alias("times"))
    counts = stored(pairs.groupBy("pair").agg(F.count("*").alias("count")), "pair-counts")
    a_id = F.shiftright("pair", 32).cast("int")
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("count").alias("highest"))
    known = stored(counts.withColumn("a", a_id).join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "pairs")
    total = known.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    frequent = F.col("count") > total / broadcast_pairs

    def summed(joined: DataFrame) -> DataFrame:
        return joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))

    hot = known.filter(frequent)
    near = summed(pairs.join(F.broadcast(hot), "pair"))
    far = summed(pairs.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(known.filter(~frequent), "pair"))
    sums = near.unionAll(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    return found.filter("part = 0").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
