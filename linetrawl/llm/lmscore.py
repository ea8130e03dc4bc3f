"""Language-model scores by logistic context mixing of hashed-context bit predictors."""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from linetrawl.llm.common import groups, shuffles_let_go, stored

#: Slots of each hashed table of bit counts.
SLOTS = 1 << 20
#: Bytes of a token whose whole prefix is a context; the first ``SHORT`` come from tables, the others from the sorted vocabulary.
DEEP, SHORT = 64, 4
#: Documents are scored in blocks of about this many tokens, the vocabulary in chunks of so many entries.
BLOCK_TOKENS, CHUNK = 4 << 20, 1 << 16
#: Predictors: 1 to 3 bytes before, the whole prefix, the whole prefix after this kind of token.
PREDICTORS = 5
_GATES, _STEPS = 48, 33
#: Rate of learning, and the weights to begin with, of the predictors and a constant.
_RATE, _START = 0.03, (0.0, 0.0, 0.05, 0.7, 0.3, 0.0)
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: The end of a text, and any token that learning has not seen; neither can be a word.
_END, _NEW = b"", b" "

BLOCKS = ("block long, doc_id long, held_out boolean, n_bytes long, n_tokens int, ids binary, "
          "token binary, kind int, n long, place int, bucket int, keys binary, counts binary, words binary")
#: As blocks are stored: a row of texts, and rows of entries by their heads.
PACKED = ("block long, docs array<struct<doc_id:bigint,held_out:boolean,n_bytes:bigint,n_tokens:int,ids:binary>>, words binary, "
          "bucket int, tokens binary, sizes binary, kinds binary, n binary, places binary")
RUNS = "bucket int, block long, keys binary, counts binary"
#: Entries are dealt by their heads to so many buckets; texts are cut into words about so many bytes at a time.
HEADS, SLICE_BYTES = 256, 4 << 20
TYPES = "token binary, kind int, n long, c long, first boolean"
#: Kinds of the token before: start, sentence end, other mark, word.
KINDS = 4
#: Runs of two and of three tokens are counted by hashes of so many bits, in so many ranges each.
RUN_BITS, _RANGE_BITS = 48, 9
RANGES = 1 << _RANGE_BITS
#: Classes of how often a word context was seen, by powers of two; tokens that one step of learning their weights takes.
SEEN, STEP = 32, 1 << 16


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, score_unknown_class`` of every row.

    Texts (null: empty) are lower-cased in A to Z and cut into words at the six ASCII white spaces; one end follows. A
    word is coded as its bytes and a space, the end as one byte, and so, for ``score_unknown_class``, any word not seen in learning, bit by bit. Every bit is predicted from
    the counts of its context: the last 1, 2 and 3 bytes of the token, its whole prefix, and the prefix and the kind
    of token before (start, sentence end, other mark, word). The predictions are mixed in the
    logistic domain with weights gated by the counts of the two last, and refined by an adaptive map of
    the mixed probability. That probability of a token is then mixed with the shares it has after the previous word and after the
    previous two, ``(1 - v)((1 - u) p1 + u p2) + v p3``, with weights ``u`` and ``v`` gated by how often the one or two
    words were seen; so what is mixed stays a distribution over tokens. All counts are those of the rows that are not held out; weights, gates and map are learned online from
    the same tokens, each without its own occurrence: so a word that occurs once teaches how likely a new one is.
    ``score`` is the log10 probability of the text: a new word costs the bits that spell it. ``bits_per_byte``
    divides it by the bytes of the text and its end. ``score_unknown_class`` leaves the spelling out, so that new words
    count as one unknown word, as they do in ``base_score``.

    ``base_score`` is the smoothed unigram score of the same tokens, ``n_known`` counts those seen in learning. Without
    rows to learn from all predictions are even. Repeated rows count and are scored each; an empty
    table gives no rows; other columns are ignored.

    Tokens are counted per block of documents, so a frequent word is one entry a block, and scored once: its
    bit-wise probability then goes to the blocks that hold it. A block's entries travel by buckets of their heads. Runs of two and three tokens are counted per
    block as well, when they are summed by ranges of their hashes, so no run is hot and none is stored but its sum; the sums go back to the blocks, whose texts are
    mixed token by token. Rows to learn from do not count their own token in its word contexts. The counts of prefixes beyond ``SHORT`` bytes stay in the
    partition of those bytes; the other contexts are tables of ``SLOTS`` slots, broadcast.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    with shuffles_let_go(docs.sparkSession):
        blocks = stored(rows.mapInArrow(_blocks, PACKED), "blocks")
        entries = blocks.filter("tokens IS NOT NULL").drop("docs", "words").repartition("bucket").sortWithinPartitions("bucket")
        types = stored(entries.mapInArrow(_types, TYPES), "types")
        once = F.when((F.col("c") == 1) & (F.col("n") == 1), 1).otherwise(0)
        sums = types.agg(F.sum("n"), F.count(F.when(F.col("first") & (F.col("c") > 0), 1)), *[F.sum(F.when(F.col("kind") == k, once)) for k in range(KINDS)]).first()
        total, distinct, new = sums[0] or 0, sums[1], np.array([x or 0 for x in sums[2:]], np.int64)

        tables = _tables(types.select("token", "kind", "n"), new)
        shared = docs.sparkSession.sparkContext.broadcast(zstandard.compress(tables.tobytes(), 1))  # mostly zeros; each executor keeps it on disk
        weights, refine = _learned(_by_head(types.filter("n > 0").select("token", "kind", "n")), shared, new)
        unknown = Mixer(tables, weights, refine).run([_NEW] * KINDS, np.arange(KINDS, dtype=np.int32), np.zeros(KINDS, np.int64))

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mixer = Mixer(_opened(shared.value), weights, refine)
            for buckets in _filled(map(_Bucket, _by_bucket(batches))):
                token, kind, n = [w for b in buckets for w in b.token], np.concatenate([b.kind for b in buckets]), np.concatenate([b.n for b in buckets])
                logp, at = _in_cuts(mixer, token, kind, n), 0
                for bucket in buckets:
                    mine, at = logp[at:at + len(bucket.n)], at + len(bucket.n)
                    yield from bucket.scores(mine)

        known = stored(entries.mapInArrow(scores, "block long, place binary, c binary, kind binary, logp binary, large array<long>"), "known")
        runs = blocks.filter("words IS NOT NULL").select("block", "docs", "words").mapInArrow(_block_runs, RUNS).repartition("bucket").sortWithinPartitions("bucket")
        runs = stored(runs.mapInArrow(_run_sums, "block long, bucket int, sums binary"), "runs")
        words = blocks.filter("words IS NOT NULL").select("block", "words")
        parts = known.unionByName(runs, allowMissingColumns=True).unionByName(words, allowMissingColumns=True).groupBy("block")
        texts_ = blocks.filter("docs IS NOT NULL").select(F.col("block").alias("block"), F.inline("docs")).drop("n_tokens").groupBy("block")

        def gates(key: tuple, parts: pa.Table, docs: pa.Table) -> pa.Table:
            stats = _gate_stats(_Texts(parts, docs, unknown))
            return pa.table({"i": pa.array(np.arange(stats.size), pa.int32()), "value": pa.array(stats.ravel())})

        found = parts.cogroup(texts_)
        sums = found.applyInArrow(gates, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).orderBy("i").toArrow()
    gate = _gate_weights(np.asarray(sums.column("value")).reshape(4, SEEN) if sums.num_rows else np.zeros((4, SEEN)))
    floor = math.log10(total + 0.5 * (distinct + 1))

    def total_up(key: tuple, parts: pa.Table, docs: pa.Table) -> pa.Table:
        t = _Texts(parts, docs, unknown)
        score = t.per_doc(t.mixed(gate))
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(t.sizes, pa.int64()),
            "n_known": pa.array(t.per_doc((t.c > 0)[t.ids].astype(float)).astype(np.int64)), "train_tokens": pa.array([total] * len(t.sizes), pa.int64()),
            "base_score": pa.array(t.per_doc((np.log10(t.c + 0.5) - floor)[t.ids]), pa.float64()), "score": pa.array(score, pa.float64()),
            "bits_per_byte": pa.array(-score * math.log2(10) / (np.asarray(docs.column("n_bytes")) + 1), pa.float64()),
            "score_unknown_class": pa.array(t.per_doc(t.mixed(gate, spells=False)), pa.float64())})

    return found.applyInArrow(
        total_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double, score_unknown_class double")


def _by_head(entries: DataFrame) -> DataFrame:
    """All entries whose tokens begin alike in one task, sorted."""
    return entries.withColumn("head", F.substring("token", 1, SHORT - 1)).repartition("head").sortWithinPartitions("head", "token", "kind")


# ------------------------------------------------------------------------------------ tokens
def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _kind_after(token: bytes) -> int:
    """Kind that a token is for the next one; 0 is the start of a text."""
    last = token[-1:]
    return 1 if last in b".!?" else 3 if last.isalnum() or last >= b"\x80" else 2


#: By the last byte of a token the kind that it is for the next one.
_AFTER = np.array([_kind_after(bytes([b])) for b in range(256)], np.uint8)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    block = _Block()
    number = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
    for batch in batches:
        size = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(2)).fill_null(0)) + 1)
        cuts = np.searchsorted(size, np.arange(0, size[-1] if len(size) else 0, SLICE_BYTES), "right").tolist()
        for at, end in zip(cuts, [*cuts[1:], batch.num_rows]):
            while at < end:
                at += block.add_all(*batch.slice(at, end - at).columns)
                if block.size >= BLOCK_TOKENS:
                    yield from block.packed(number)
                    block, number = _Block(), number + 1
    if block.docs:
        yield from block.packed(number)


class _Block:
    def __init__(self):
        self.docs, self.size = [], 0
        #: Words in the order of their coming, and the kind that each is for the next one.
        self.words, self.after = {}, np.empty(0, np.uint8)
        #: By word and kind the place of their entry, or -1; by place its word and kind.
        self.places, self.entries, self.many = np.full(KINDS, -1, np.int32), [], 0
        self.counts = np.zeros(1, np.int64)

    def add(self, doc_id, held_out, text) -> None:
        self.add_all(pa.array([doc_id], pa.int64()), pa.array([held_out], pa.bool_()), pa.array([text], pa.string()))

    def _numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of all texts, the end after each, and how many each text has."""
        lists = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts))
        found, cuts = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
        filled = np.asarray(pa.compute.binary_length(found)) > 0
        sizes = np.diff(np.concatenate([[0], np.cumsum(filled)])[cuts - cuts[0]]) + 1
        found = found.filter(pa.array(filled)).dictionary_encode()
        distinct, last = found.dictionary, [_END]
        if len(distinct):
            offsets, data = _buffers(distinct)
            last = np.concatenate([_AFTER[data[offsets[1:] - 1]], [0]])
        number, many = self.words, len(self.words)
        number = np.array([number.setdefault(w, len(number)) for w in [*distinct.cast(pa.binary()).to_pylist(), _END]], np.int64)
        self.after = np.concatenate([self.after, last[number >= many] if len(distinct) else np.zeros(len(self.words) - many, np.uint8)]).astype(np.uint8)
        word, ends = np.full(sizes.sum(), number[-1]), np.cumsum(sizes) - 1
        inner = np.ones(len(word), bool)
        inner[ends] = False
        word[inner] = number[np.asarray(found.indices)]
        return word, sizes

    def add_all(self, doc_ids: pa.Array, held_out: pa.Array, texts: pa.Array) -> int:
        """Add texts until the block is full; returns how many."""
        texts = texts.fill_null("")
        word, sizes = self._numbered(texts)
        sizes = sizes[:np.searchsorted(np.cumsum(sizes), BLOCK_TOKENS - self.size) + 1]
        word = word[:sizes.sum()]
        key = word * KINDS
        key[1:] += self.after[word[:-1]]
        short = KINDS * len(self.words) - len(self.places)
        if short > 0:
            self.places = np.concatenate([self.places, np.full(max(short, len(self.places)), -1, np.int32)])
        new = key[self.places[key] < 0]
        if len(new):
            order = np.arange(len(new), dtype=np.int32)
            self.places[new[::-1]] = order[::-1]  # of equal ones the first stays
            new = new[self.places[new] == order]
            self.places[new] = np.arange(self.many, self.many + len(new))
            self.entries.append(new)
            self.many += len(new)
        ids = self.places[key]
        if self.many > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(max(self.many, 2 * len(self.counts)) - len(self.counts), np.int64)])
        held = held_out.to_pylist()[:len(sizes)]
        found = np.bincount(ids[np.repeat([not h for h in held], sizes)])
        self.counts[:len(found)] += found
        ends = np.cumsum(sizes)
        for doc_id, h, n_bytes, end, size in zip(doc_ids.to_pylist(), held, pa.compute.binary_length(texts).to_pylist(), ends.tolist(), sizes.tolist()):
            self.docs.append((doc_id, h, n_bytes, size, _packed(ids[end - size:end])))
        self.size += len(ids)
        return len(sizes)

    def rows(self, number: int, runs: bool = True) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.docs), 1000):
            some = list(zip(*self.docs[at:at + 1000]))
            yield _batch(BLOCKS, len(some[0]), block=[number] * len(some[0]), doc_id=some[0], held_out=some[1], n_bytes=some[2], n_tokens=some[3], ids=some[4])
        counts = np.zeros(self.many, np.int64)
        counts[:len(self.counts)] = self.counts[:len(counts)]
        word, kind = np.divmod(np.concatenate(self.entries), KINDS)
        listed = pa.array(self.words, pa.binary())
        rank = np.empty(len(listed), np.int64)
        rank[np.asarray(pa.compute.array_sort_indices(listed))] = np.arange(len(listed))
        order = np.argsort(rank[word] * KINDS + kind)  # neighbours share their beginnings and compress
        for at in range(0, len(order), 50000):
            some = order[at:at + 50000]
            yield _batch(BLOCKS, len(some), block=[number] * len(some), token=listed.take(pa.array(word[some])), kind=kind[some], n=counts[some], place=some)
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))[word]
        yield _batch(BLOCKS, 1, block=[number], words=[words.tobytes()])
        if runs:
            yield from _run_rows(number, words, [d[4] for d in self.docs], [d[1] for d in self.docs])

    def packed(self, number: int) -> Iterator[pa.RecordBatch]:
        """The rows to be stored: no runs, which are made when they are counted."""
        table = pa.Table.from_batches(self.rows(number, runs=False))
        docs = table.filter(pa.compute.is_valid(table.column("ids"))).select(["doc_id", "held_out", "n_bytes", "n_tokens", "ids"]).to_struct_array().combine_chunks()
        words = table.column("words").drop_null().combine_chunks()
        yield _batch(PACKED, 1, block=[number], docs=pa.ListArray.from_arrays([0, len(docs)], docs), words=words)
        table = table.filter(pa.compute.is_valid(table.column("token"))).select(["token", "kind", "n", "place"]).combine_chunks()
        bucket = _bucket_of(table.column("token").combine_chunks())
        table = table.take(pa.array(np.argsort(bucket, kind="stable"))).combine_chunks()
        offsets, data = _buffers(table.column("token").combine_chunks())
        kind, n, place = (np.asarray(table.column(c)) for c in ("kind", "n", "place"))
        cuts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=HEADS))]).tolist()
        some = [(b, at, end) for b, (at, end) in enumerate(zip(cuts, cuts[1:])) if end > at]
        yield _batch(
            PACKED, len(some), block=[number] * len(some), bucket=[b for b, _, _ in some],
            tokens=[zstandard.compress(data[offsets[at]:offsets[end]].tobytes(), 1) for _, at, end in some],
            sizes=[_packed(np.diff(offsets[at:end + 1])) for _, at, end in some], kinds=[_planes(kind[at:end], 1) for _, at, end in some],
            n=[_planes(n[at:end], 5) for _, at, end in some], places=[_packed(place[at:end]) for _, at, end in some])


def _batch(schema: str, many: int, **columns) -> pa.RecordBatch:
    """Rows of a schema; columns that are not given are null."""
    struct = pa.list_(pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary())]))
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names = {name: kinds.get(kind, struct) for name, kind in (f.split() for f in schema.split(", "))}
    return pa.RecordBatch.from_arrays(
        [(columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], kind)) if c in columns else pa.nulls(many, kind) for c, kind in names.items()], names=list(names))


def _buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of strings or binaries."""
    _, offsets, data = values.buffers()
    return np.frombuffer(offsets, np.int32)[values.offset:values.offset + len(values) + 1], np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)


def _heads(token: pa.Array) -> np.ndarray:
    """Of each token the bytes before ``SHORT`` and how many they are, as a number."""
    offsets, data = _buffers(token)
    sizes, head = np.minimum(np.diff(offsets), SHORT - 1), np.zeros(len(token), np.uint64)
    for i in range(SHORT - 1):
        rows = np.flatnonzero(sizes > i)
        head[rows] |= data[offsets[rows] + i].astype(np.uint64) << np.uint64(8 * i)
    return head | sizes.astype(np.uint64) << np.uint64(8 * (SHORT - 1))


def _bucket_of(token: pa.Array) -> np.ndarray:
    """Tokens that begin alike share a bucket."""
    return ((_heads(token) + np.uint64(1)) * _M[0] >> np.uint64(40)).astype(np.int64) % HEADS


def _run_rows(number: int, words: np.ndarray, ids: list[bytes], held_out: list) -> Iterator[pa.RecordBatch]:
    """How often each run of a block's words was learned, by order and range of the runs' hashes."""
    ids, sizes = _joined(ids)
    learned = np.repeat(np.array([not h for h in held_out]), sizes)
    for order in range(2):
        runs = _run_hashes(words, ids, sizes, order)
        runs <<= np.uint64(1)
        runs |= learned
        runs.sort()
        cuts = _range_cuts(runs, 1)
        filled = np.flatnonzero(np.diff(cuts))
        for at in range(0, len(filled), 64):
            some, keys, counts = filled[at:at + 64], [], []
            for i in some:
                part = runs[cuts[i]:cuts[i + 1]]
                flags, part = (part & np.uint64(1)).astype(np.uint8), part >> np.uint64(1)
                starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                keys.append(_planes(np.diff(part[starts], prepend=np.uint64(int(i) << RUN_BITS - _RANGE_BITS)), 5))
                counts.append(_planes(np.add.reduceat(flags, starts, dtype=np.int64), 4))
            yield _batch(BLOCKS, len(some), block=[number] * len(some), bucket=some + order * RANGES, keys=keys, counts=counts)


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, and how many each has."""
    found = [_unpacked(x) for x in ids]
    return np.concatenate(found), np.array([len(x) for x in found])


def _block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            docs = batch.column(1).slice(i, 1).flatten()
            words = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
            for rows in _run_rows(batch.column(0)[i].as_py(), words, docs.field("ids").to_pylist(), docs.field("held_out").to_pylist()):
                yield rows.select(["bucket", "block", "keys", "counts"])


def _packed(ids: np.ndarray) -> bytes:
    """Byte planes, compressed: most ids are small."""
    return zstandard.compress(np.ascontiguousarray(ids.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.int32)
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).reshape(-1)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each value as planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def _from_planes(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


# ------------------------------------------------------------------------------------ word contexts
def _runs(words: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of each token with the one and with the two before it; texts of ``sizes`` tokens follow each other."""
    first = np.cumsum(sizes) - sizes
    run = before = words
    for start, factor in ((1, _M[0]), (2, _M[1])):
        before = _previous(before, first, np.uint64(start))
        run = run ^ before * factor
        run *= _M[0]
        run ^= run >> np.uint64(29)
        yield run * _M[1] >> np.uint64(64 - RUN_BITS)


def _previous(values: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    out = np.concatenate([values[:1], values[:-1]])
    out[first] = start
    return out


def _run_hashes(words: np.ndarray, ids: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
    """The runs of one order of all texts, made some texts at a time."""
    out, ends = np.empty(len(ids), np.uint64), np.cumsum(sizes)
    cuts = np.unique(np.searchsorted(ends, np.arange(0, len(ids), 4 * STEP), "right"))
    for at, end in zip(cuts, [*cuts[1:], len(sizes)]):
        rows = slice(ends[at] - sizes[at], ends[end - 1])
        out[rows] = next(itertools.islice(_runs(words[ids[rows]], sizes[at:end]), order, None))
    return out


def _range_cuts(keys: np.ndarray, flags: int = 0) -> np.ndarray:
    """Where the ranges of sorted hashes begin, that so many bits follow."""
    return np.searchsorted(keys, np.arange(RANGES + 1, dtype=np.uint64) << np.uint64(RUN_BITS - _RANGE_BITS + flags))


def _run_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and range the sums over all blocks, in the order of the block's hashes."""
    for (bucket,), rows in groups(batches, 1):
        keys = [np.cumsum(_from_planes(k, 5)) for k in rows[2]]
        n = np.concatenate([_from_planes(c, 4) for c in rows[3]]).astype(float)
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(place, n)[place].astype(np.int64)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[1], pa.int64()), pa.array([bucket] * len(keys), pa.int32()), pa.array([_planes(x, 6) for x in np.split(sums, cuts)], pa.binary())],
            names=["block", "bucket", "sums"])


class _Texts:
    """The tokens of a block's texts with their counts, alone and after one and two words."""

    def __init__(self, parts: pa.Table, docs: pa.Table, unknown: np.ndarray):
        vocabulary = parts.filter(pa.compute.is_valid(parts.column("place")))
        place = np.concatenate([_unpacked(x.as_py()) for x in vocabulary.column("place")])
        found = np.concatenate([_unpacked(x.as_py()) for x in vocabulary.column("c")]).astype(float)
        found[found >= 2**31 - 1] = np.array([x for large in vocabulary.column("large").to_pylist() for x in large])
        #: By place: count in learning, log10 probability that spells a token, and that of a new token.
        self.c, self.spelt, self.escape = np.zeros((3, len(place)))
        self.c[place], self.spelt[place] = found, np.concatenate([np.frombuffer(x.as_py(), np.float32) for x in vocabulary.column("logp")])
        self.escape[place] = unknown[np.concatenate([_unpacked(x.as_py()) for x in vocabulary.column("kind")])]

        self.ids, self.sizes = _joined(docs.column("ids").to_pylist())
        self.first = np.cumsum(self.sizes) - self.sizes
        self.own = np.repeat(~np.asarray(docs.column("held_out").combine_chunks().fill_null(False)).astype(bool), self.sizes)
        words = np.frombuffer(next(x for x in parts.column("words").to_pylist() if x is not None), np.uint64)
        texts_ = self.c[self.ids[self.sizes.cumsum()[0] - 1]]  # the end of a text: as many as texts were learned
        sums = parts.filter(pa.compute.is_valid(parts.column("sums"))).select(["bucket", "sums"]).sort_by("bucket")
        bucket = np.asarray(sums.column("bucket"))
        #: By token: how often its context was seen, and it after that; each without the token itself where it was learned.
        self.seen, self.after = [], []
        context = _whole(self.c)[self.ids]
        for order in range(2):
            part = sums.column("sums").filter(pa.array(bucket // RANGES == order))
            after = _by_rank(_run_hashes(words, self.ids, self.sizes, order), np.concatenate([_whole(_from_planes(x.as_py(), 6)) for x in part]))
            self.seen.append(np.maximum(_previous(context, self.first, texts_) - self.own, 0))
            self.after.append(np.maximum(after - self.own, 0))
            context = after

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first)

    def gates(self, some=slice(None)) -> list[np.ndarray]:
        return [np.minimum(np.frexp(seen[some])[1], SEEN - 1) for seen in self.seen]

    def shares(self, some=slice(None)) -> list[np.ndarray]:
        return [after[some] / np.maximum(seen[some], 1) for seen, after in zip(self.seen, self.after)]

    def mixed(self, weights: np.ndarray, spells: bool = True) -> np.ndarray:
        """log10 probability of each token; unless it ``spells``, any new token is the same one.

        The bits of a new word lead off the known ones, which pays for its being new. What is spelt never takes
        the code of an unknown word, whose probability goes to all others.
        """
        alone = self.spelt - np.log1p(-10 ** self.escape) / math.log(10) if spells else np.where(self.c == 0, self.escape, self.spelt)
        out = np.empty(len(self.ids))
        for at in range(0, len(out), STEP):
            some = slice(at, at + STEP)
            u, v = (w[g] for w, g in zip(weights, self.gates(some)))
            p2, p3 = self.shares(some)
            with np.errstate(divide="ignore"):
                after = np.log((1 - v) * u * p2 + v * p3)
            out[some] = np.logaddexp(alone[self.ids[some]] * math.log(10) + np.log((1 - u) * (1 - v)), after) / math.log(10)
        return out


def _whole(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where they fit."""
    return counts.astype(np.int32 if counts.max(initial=0) < 2**31 else np.int64)


def _by_rank(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each run the value of its rank among the different runs; some ranges are sorted at a time."""
    out, before = np.empty(len(keys), values.dtype), 0
    part = keys.astype("<u8", copy=False).view(np.uint8)[RUN_BITS // 8 - 1::8] >> 5  # their first three bits
    for i in range(8):
        rows = np.flatnonzero(part == i).astype(np.int32 if len(keys) < 2**31 else np.int64)
        mine = keys[rows]
        order = np.argsort(mine)
        rows, mine = rows[order], mine[order]
        if len(rows):
            rank = np.concatenate([[before], mine[1:] != mine[:-1]]).cumsum()
            out[rows], before = values[rank], int(rank[-1]) + 1
    return out


def _gate_stats(t: _Texts) -> np.ndarray:
    """By gate of the previous word and of the two: what their shares explain of the learned tokens, and all there is to explain.

    Expectation-maximisation in steps: each takes ``STEP`` tokens with the weights of the steps before. A token
    learned once is a new one without itself.
    """
    alone = np.where(t.c <= 1, t.escape + t.spelt, t.spelt)
    stats = np.zeros((4, SEEN))
    rows = np.flatnonzero(t.own).astype(np.int32 if len(t.own) < 2**31 else np.int64)
    for at in range(0, len(rows), STEP):
        some = rows[at:at + STEP]
        p1, (p2, p3), (g2, g3) = 10 ** alone[t.ids[some]], t.shares(some), t.gates(some)
        for _ in range(1 if at else 5):
            u, v = (w[g] for w, g in zip(_gate_weights(stats), (g2, g3)))
            one, two, three = (1 - v) * (1 - u) * p1, (1 - v) * u * p2, v * p3
            whole = np.maximum(one + two + three, 1e-300)
            step = np.stack([np.bincount(g, w, SEEN) for g, w in ((g2, two / whole), (g2, (one + two) / whole), (g3, three / whole), (g3, np.ones(len(some))))])
            if not at:
                stats = step
        if at:
            stats += step
    return stats


def _gate_weights(stats: np.ndarray) -> np.ndarray:
    """Weights of the previous word and of the two by gate; an unseen context has none."""
    weights = np.clip((stats[::2] + 0.5) / (stats[1::2] + 1), 0, 1 - 1e-6)
    weights[:, 0] = 0
    return weights


def _chunks(batches: Iterator[pa.RecordBatch]):
    """Entries ``(tokens, kinds, counts, and any further columns)`` in the order of their codes, cut only between different heads."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            table = pa.Table.from_batches(held).combine_chunks()
            head = table.column("head").to_pylist()
            cut = next((i for i in range(len(head) - 1, 0, -1) if head[i] != head[i - 1]), 0)
            if cut:
                yield _sorted(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size = len(head) - cut
    if size:
        yield _sorted(pa.Table.from_batches(held))


def _sorted(table: pa.Table) -> tuple:
    token = table.column("token").to_pylist()
    columns = [np.asarray(table.column(c)) for c in ("kind", "n", "block", "place") if c in table.column_names]
    if re.search(rb"[\x00-\x1f]", b"".join(token)):  # a byte below the space that ends a code
        order = sorted(range(len(token)), key=lambda i: (_code(token[i]), columns[0][i]))
        token, columns = [token[i] for i in order], [c[order] for c in columns]
    return token, *columns


class _Bucket:
    """All entries of a bucket: each token and kind once, in the order of codes, and which one each entry of a block is."""

    def __init__(self, rows: list[list]):
        _, self.blocks, tokens, sizes, kinds, n, places = rows
        kind, n = (np.concatenate([_from_planes(x, width) for x in some]).astype(np.int64) for some, width in ((kinds, 1), (n, 5)))
        self.sizes = [_unpacked(x) for x in sizes]
        self.places = places
        data = b"".join(map(zstandard.decompress, tokens))
        offsets = np.concatenate([[0], *self.sizes]).cumsum()
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        distinct = found.dictionary
        order = np.asarray(pa.compute.array_sort_indices(distinct)).astype(np.int64)
        words = distinct.take(pa.array(order)).to_pylist()
        if re.search(rb"[\x00-\x1f]", data):  # a byte below the space that ends a code
            again = sorted(range(len(words)), key=lambda i: _code(words[i]))
            words, order = [words[i] for i in again], order[again]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = rank[np.asarray(found.indices)] * KINDS + kind
        #: By entry of a block the one of the bucket.
        filled = np.bincount(key, minlength=KINDS * len(words)) > 0
        self.entry = (np.cumsum(filled) - 1)[key]
        own, self.kind = np.divmod(np.flatnonzero(filled), KINDS)
        self.kind = self.kind.astype(np.int32)
        self.token = [words[i] for i in own.tolist()]
        sums = np.zeros(KINDS * len(words), np.int64)
        np.add.at(sums, key, n)
        self.n, self.c = sums[filled], sums.reshape(-1, KINDS).sum(1)[own]
        self.first = np.concatenate([[True], own[1:] != own[:-1]])

    def scores(self, logp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """For each block its entries with the counts of their tokens and what they cost."""
        at = 0
        for block, sizes, place in zip(self.blocks, self.sizes, self.places):
            entry, at = self.entry[at:at + len(sizes)], at + len(sizes)
            c = self.c[entry]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([place]), pa.array([_packed(np.minimum(c, 2**31 - 1))]), pa.array([_packed(self.kind[entry])]),
                 pa.array([logp[entry].astype(np.float32).tobytes()]), pa.array([c[c >= 2**31 - 1].tolist()], pa.list_(pa.int64()))],
                names=["block", "place", "c", "kind", "logp", "large"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The rows of each bucket, by column."""
    return (rows for _, rows in groups((b.select(["bucket", "block", "tokens", "sizes", "kinds", "n", "places"]) for b in batches), 1))


def _filled(buckets: Iterator[_Bucket]) -> Iterator[list[_Bucket]]:
    """Buckets in lists of about ``CHUNK`` entries, as many as are worth one run of the mixer."""
    held: list[_Bucket] = []
    for bucket in buckets:
        held.append(bucket)
        if sum(len(b.n) for b in held) >= CHUNK:
            yield held
            held = []
    if held:
        yield held


def _in_cuts(mixer: Mixer, token: list[bytes], kind: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What entries cost, in runs of about ``CHUNK`` that are cut only between different heads."""
    cuts = [0]
    while len(token) - cuts[-1] > 2 * CHUNK:
        at = cuts[-1] + CHUNK
        while at < len(token) and token[at][:SHORT - 1] == token[at - 1][:SHORT - 1]:
            at += 1
        cuts.append(at)
    return np.concatenate([mixer.run(token[a:b], kind[a:b], n[a:b]) for a, b in zip(cuts, [*cuts[1:], len(token)]) if b > a])


def _types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each token and kind once, with its count, that of the token, and whether it is the token's first."""
    for bucket in map(_Bucket, _by_bucket(batches)):
        for at in range(0, len(bucket.n), 50000):
            some = slice(at, at + 50000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.token[some], pa.binary()), pa.array(bucket.kind[some]), pa.array(bucket.n[some]), pa.array(bucket.c[some]), pa.array(bucket.first[some])],
                names=["token", "kind", "n", "c", "first"])


def _per_token(token: list[bytes], n: np.ndarray) -> np.ndarray:
    """For each entry the count of its token after whatever kind; equal tokens are neighbours."""
    starts = np.flatnonzero(np.array([True] + [a != b for a, b in zip(token, token[1:])]))
    return np.repeat(np.add.reduceat(n, starts), np.diff([*starts, len(token)]))


# ------------------------------------------------------------------------------------ contexts
def _coded(token: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens as they are coded, after three zero bytes each; where each begins; lengths."""
    parts = [_code(w) for w in token]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer(b"".join(b"\0\0\0" + p for p in parts), np.uint8).astype(np.uint64)
    return flat, np.cumsum(sizes + 3) - sizes, sizes


def _code(word: bytes) -> bytes:
    """No code begins another: the two marks are single bytes, words that begin with them or with 2 get a 2 in front."""
    if word in (_END, _NEW):
        return b"\0" if word == _END else b"\1"
    return (b"\2" if word[0] < 3 else b"") + word + b" "


def _slot(table: int, context: np.ndarray, node: np.ndarray) -> np.ndarray:
    mixed = (context + np.uint64((table + 1) << 48)) * _M[0]
    mixed = (mixed ^ (mixed >> np.uint64(32)) ^ (node * _M[1])) * _M[0]
    return (mixed >> np.uint64(44)).astype(np.int64) + table * SLOTS


def _before(flat: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The last 1, 2 and 3 bytes before a place."""
    one, two, three = (flat[at - i] for i in (1, 2, 3))
    return [one, one | two << np.uint64(8), one | two << np.uint64(8) | three << np.uint64(16)]


def _tables(types: DataFrame, new: np.ndarray) -> np.ndarray:
    """Counts of zeros and ones by slot, ``PREDICTORS * SLOTS x 2``; at most so many sums reach the driver."""
    grams = types.filter("n > 0").mapInArrow(_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    sums = grams.mapInArrow(_gram_bits, "slot int, zeros long, ones long").groupBy("slot").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()
    tables = np.zeros((PREDICTORS * SLOTS, 2), np.float32)
    tables[np.asarray(sums.column("slot"))] = np.column_stack([np.asarray(sums.column("zeros")), np.asarray(sums.column("ones"))])
    unseen = pa.RecordBatch.from_arrays([pa.array([_NEW] * KINDS, pa.binary()), pa.array(range(KINDS), pa.int32()), pa.array(new)], names=["token", "kind", "n"])
    for batch in _gram_bits(_grams(iter([unseen]))):
        tables[np.asarray(batch.column(0))] += np.column_stack([np.asarray(batch.column(1)), np.asarray(batch.column(2))])
    return tables


def _opened(tables: bytes) -> np.ndarray:
    """The broadcast tables; each task opens them, so that idle workers hold none."""
    return np.frombuffer(zstandard.decompress(tables), np.float32).reshape(-1, 2)


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, np.bincount(place, np.concatenate(n), len(keys)).astype(np.int64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how often four bytes follow each other in a token, and each short prefix after each kind."""
    keys, sums = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for batch in batches:
        if not batch.num_rows:
            continue
        token, kind, n = batch.column(0).to_pylist(), np.asarray(batch.column(1)), np.asarray(batch.column(2))
        flat, begins, sizes = _coded(token)
        owner = np.repeat(np.arange(len(token)), sizes)
        at = begins[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keys.append((_before(flat, at)[2] << np.uint64(8) | flat[at]).astype(np.int64))
        sums.append(n[owner])
        for depth in range(SHORT):
            rows = np.flatnonzero(sizes > depth)
            prefix = np.zeros(len(rows), np.uint64)
            for i in range(depth + 1):
                prefix = prefix << np.uint64(8) | flat[begins[rows] + i]
            keys.append(prefix.astype(np.int64) | kind[rows].astype(np.int64) << 32 | (depth + 1) << 40)
            sums.append(n[rows])
        merged = _summed(keys, sums)
        keys, sums = [merged[0]], [merged[1]]
    yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(sums[0])], names=["gram", "n"])


def _gram_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zeros, ones = np.zeros(PREDICTORS * SLOTS), np.zeros(PREDICTORS * SLOTS)
    for batch in batches:
        gram, n = np.asarray(batch.column(0)).astype(np.uint64), np.asarray(batch.column(1)).astype(float)
        value = gram & np.uint64(255)
        depth, kind = (gram >> np.uint64(40)).astype(np.int64), gram >> np.uint64(32) & np.uint64(255)
        plain, context = depth == 0, gram >> np.uint64(8) & np.uint64(0xFFFFFF)
        for table in range(PREDICTORS):
            rows = plain if table < 3 else ~plain
            if table < 3:
                now = context[rows] & np.uint64((1 << 8 * (table + 1)) - 1)
            else:
                now = _prefix_context(context[rows], depth[rows] - 1, kind[rows] if table == 4 else None)
            for i in range(8):
                v = value[rows]
                slot = _slot(table, now, np.uint64(1 << i) | v >> np.uint64(8 - i))
                bit = (v >> np.uint64(7 - i) & np.uint64(1)).astype(bool)
                zeros += np.bincount(slot[~bit], n[rows][~bit], len(zeros))
                ones += np.bincount(slot[bit], n[rows][bit], len(ones))
    filled = np.flatnonzero(zeros + ones)
    yield pa.RecordBatch.from_arrays(
        [pa.array(filled, pa.int32()), pa.array(zeros[filled].astype(np.int64)), pa.array(ones[filled].astype(np.int64))], names=["slot", "zeros", "ones"])


def _prefix_context(prefix: np.ndarray, depth, kind: np.ndarray | None) -> np.ndarray:
    depth = np.asarray(depth).astype(np.uint64)
    return prefix | depth << np.uint64(32) | (np.uint64(0) if kind is None else (kind + np.uint64(1)) << np.uint64(40))


# ------------------------------------------------------------------------------------ mixing
def _stretch(p):
    return np.log(p / (1 - p))


class Mixer:
    """Mixes the predictions of bits; with ``learns`` it also adapts, each token without itself."""

    def __init__(self, tables: np.ndarray, weights: np.ndarray | None = None, refine: np.ndarray | None = None, learns: bool = False):
        self.tables, self.learns = tables, learns
        self.weights = np.tile(_START, (_GATES, 1)) if weights is None else weights.copy()
        self.slopes = np.full((_GATES, PREDICTORS + 1), 1e-3)
        self.mass = np.zeros(_GATES)
        self.refine = np.zeros((_GATES, _STEPS, 2)) if refine is None else refine
        self.ones, self.seen = self.refine[:, :, 1].ravel(), self.refine.sum(2).ravel()

    def run(self, token: list[bytes], kind: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 probability of each entry; entries are sorted by token."""
        flat, begins, sizes = _coded(token)
        bits = np.zeros(len(token))
        once = (_per_token(token, n) == 1) & np.array([w != _NEW for w in token]) if self.learns else np.zeros(len(token), bool)
        known = np.where(once, 0, n)
        rows, group = np.arange(len(token)), np.zeros(len(token), np.int64)
        prefix = np.zeros(len(token), np.uint64)
        for depth in range(min(DEEP, int(sizes.max(initial=0)))):
            more = sizes[rows] > depth
            rows, group, prefix = rows[more], group[more], prefix[more]
            at = begins[rows] + depth
            value = flat[at]
            after = np.cumsum(np.concatenate([[0], (np.diff(group) != 0) | (value[1:] != value[:-1])]))
            # Entries that agree so far, in this byte and in kind are predicted alike: one of each, with their sums, stands for them.
            key = after * KINDS + kind[rows]
            cell = (np.cumsum(np.bincount(key) > 0) - 1)[key]
            one = np.empty(int(cell.max()) + 1, np.int64)
            one[cell] = np.arange(len(rows))
            sums, kept = np.bincount(cell, n[rows]), np.bincount(cell, known[rows])
            inside, byte, own = group[one], value[one], kind[rows[one]]
            before = _before(flat, at[one])
            if depth < SHORT:
                before += [_prefix_context(prefix[one], depth, None), _prefix_context(prefix[one], depth, own.astype(np.uint64))]
                prefix = prefix << np.uint64(8) | value
            found = np.zeros(len(one))
            for i in range(8):
                deep = None
                if depth >= SHORT:
                    deep = self._deep(inside, byte >> np.uint64(8 - i), byte, i, own, sums)
                found += self._bit(before, byte, i, sums, deep, kept)
            bits[rows] += found[cell]
            group = after
        if sizes.max(initial=0) > DEEP:
            owner = np.repeat(np.arange(len(token)), np.maximum(sizes - DEEP, 0))
            rank = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(sizes - DEEP, 0)) - np.maximum(sizes - DEEP, 0), np.maximum(sizes - DEEP, 0))
            for some in np.array_split(np.arange(len(owner)), len(owner) // CHUNK + 1):
                at = begins[owner[some]] + DEEP + rank[some]
                empty = np.zeros(len(some))
                for i in range(8):
                    np.add.at(bits, owner[some], self._bit(_before(flat, at), flat[at], i, n[owner[some]], (empty, empty, empty, empty), known[owner[some]]))
        return bits / math.log(10)

    def _deep(self, group, top, value, i, kind, n):
        """Zeros and ones of the whole prefix, without and with the kind, from the sorted entries themselves."""
        changed = np.concatenate([[0], (np.diff(group) != 0) | (top[1:] != top[:-1])])
        node = np.cumsum(changed)
        bit = (value >> np.uint64(7 - i) & np.uint64(1)).astype(np.int64)
        sums = np.bincount((node * 4 + kind) * 2 + bit, n, 8 * (int(node[-1]) + 1) if len(node) else 0).reshape(-1, 4, 2)
        whole, own = sums.sum(1)[node], sums[node, kind]
        return whole[:, 0], whole[:, 1], own[:, 0], own[:, 1]

    @functools.cached_property
    def logs(self) -> np.ndarray:
        """What each slot of the bytes before predicts; in learning two numbers, for a bit of 0 and of 1 without itself."""
        zeros, ones = self.tables[:3 * SLOTS].T
        filled = np.flatnonzero(zeros + ones)  # the others predict 0
        zeros, ones = zeros[filled], ones[filled]
        counts = [(np.maximum(zeros - 1, 0), ones), (zeros, np.maximum(ones - 1, 0))] if self.learns else [(zeros, ones)]
        out = np.zeros((3 * SLOTS, len(counts)), np.float32)
        for k, (no, yes) in enumerate(counts):
            out[filled, k] = np.log((yes + np.float32(0.4)) / (no + np.float32(0.4)))
        return out.ravel()

    def _bit(self, contexts, value, i, n, deep, known):
        """Log probability of bit ``i`` of each value, which comes ``n`` times, ``known`` times in tokens that come more than once."""
        node = np.uint64(1 << i) | value >> np.uint64(8 - i)
        one = (value >> np.uint64(7 - i) & np.uint64(1)).astype(bool)
        bit = one.astype(np.float32)
        slots = [_slot(table, context, node) for table, context in enumerate(contexts)]
        counts = [self.tables[slot].T for slot in slots[3:]] if deep is None else [deep[:2], deep[2:]]
        inputs = np.empty((PREDICTORS + 1, len(value)), np.float32)
        inputs[-1] = 1
        for k, slot in enumerate(slots[:3]):
            inputs[k] = self.logs[slot * 2 + one if self.learns else slot]
        gate = []
        for k, (zeros, ones) in enumerate(counts, 3):
            zeros, ones = zeros.astype(np.float32), ones.astype(np.float32)
            if self.learns:
                zeros, ones = np.maximum(zeros - (1 - bit), 0), np.maximum(ones - bit, 0)
            np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)), out=inputs[k])
            gate.append(np.frexp(zeros + ones)[1])
        gate = np.minimum(gate[0], 15) * 3 + np.minimum(gate[1], 2)
        raw = np.zeros(len(value), np.float32)
        for k in range(PREDICTORS + 1):
            raw += inputs[k] * self.weights[:, k].astype(np.float32)[gate]
        np.clip(raw, -12, 12, out=raw)
        p = 1 / (1 + np.exp(-raw))
        step = np.rint((raw + 12) * np.float32((_STEPS - 1) / 24)).astype(np.int64)
        cell = gate * _STEPS + step
        if self.learns:
            n = np.where(gate >= 3, known, n)  # without itself a word that comes once is new: it teaches spelling only
            self.refine += np.bincount(cell * 2 + one, n, self.refine.size).reshape(self.refine.shape)
            error = (bit - p) * n
            mass = np.bincount(gate, n, _GATES)
            slopes = np.stack([np.bincount(gate, error * inputs[k], _GATES) for k in range(PREDICTORS + 1)], 1) / np.maximum(mass, 1)[:, None]
            self.slopes += slopes * slopes
            self.weights += _RATE * slopes / np.sqrt(self.slopes)
            self.mass += mass
            return 0.0
        p = np.clip((p + (self.ones[cell] + 8 * p) / (self.seen[cell] + 8)) / 2, 1e-7, 1 - 1e-7)
        return np.log(np.where(one, p, 1 - p))


def _with_new(ordered: DataFrame, new: np.ndarray) -> DataFrame:
    """The entries, and in a partition of their own how often a new word comes after each kind."""
    rows = [(_NEW, k, int(n), _NEW) for k, n in enumerate(new) if n]
    return ordered.unionByName(ordered.sparkSession.createDataFrame(rows, "token binary, kind int, n long, head binary")) if rows else ordered


def _learned(ordered: DataFrame, tables, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights, averaged over the tasks by what each has seen of a gate, and the summed refinement map."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(_opened(tables.value), learns=True)
        for token, kind, n in _chunks(batches):
            mixer.run(token, kind, n)
        values = np.concatenate([(mixer.weights * mixer.mass[:, None]).ravel(), mixer.mass, mixer.refine.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["i", "value"])

    sums = _with_new(ordered, new).mapInArrow(learn, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).orderBy("i").toArrow()
    values = np.asarray(sums.column("value")) if sums.num_rows else np.zeros(_GATES * (PREDICTORS + 2 + 2 * _STEPS))
    cut = _GATES * (PREDICTORS + 1)
    mass = values[cut:cut + _GATES]
    start = Mixer(np.zeros((1, 2), np.float32)).weights
    weights = np.where(mass[:, None] > 0, values[:cut].reshape(_GATES, -1) / np.maximum(mass, 1e-9)[:, None], start)
    return weights, values[cut + _GATES:].reshape(_GATES, _STEPS, 2)
