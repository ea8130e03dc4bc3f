"""Chat formatting: whole conversations rendered, encoded once with offsets, and masked by turn spans."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The template: START role SEP text END newline, for each turn. All three are tokens of their own, so a
#: token never lies across the edge of a text, and blocks of turns encode exactly like the whole.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: A conversation is rendered and encoded in blocks of whole turns of about this many characters.
BLOCK_CHARS = 1 << 20

BLOCKS = ("conv_id long, block long, last boolean, formatted string, input_ids array<int>, token_starts array<int>, "
          "token_ends array<int>, loss_mask array<boolean>, loss_starts array<int>, loss_ends array<int>")
DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long, n_tokens long, loss_tokens long")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    """Text without control strings; ``unescape`` gives it back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def format_conversations(turns: DataFrame, vocabulary: str = VOCABULARY, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Blocks of rendered conversations with their tokens, token offsets and loss mask.

    ``turns`` holds ``conv_id, turn, role, text``; null roles and texts are empty, rows without conv_id form one
    conversation, a null turn comes first, and rows of the same turn come in the order of role and
    text. A token is under the mask if its span meets a text of a ``trained`` role; ``loss_starts`` and
    ``loss_ends`` are the characters under it. Offsets count code points of ``formatted``. An empty table
    gives no rows; other columns are ignored.

    The rows of a conversation stream through one task in order, a block at a time, so its length
    is bounded by one turn's text only. A conversation's blocks lie together and in order.
    """
    with open(vocabulary, encoding="utf-8") as file:
        tokenizer = file.read()
    ordered = (
        turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return ordered.mapInArrow(lambda batches: _format(batches, tokenizer, frozenset(trained)), BLOCKS)


def _format(batches, tokenizer, trained):
    encoder = _encoder(tokenizer)
    conv, block, parts, spans, chars, begun = None, 0, [], [], 0, False
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            if begun and (conv_id != conv or chars > BLOCK_CHARS):
                yield _block(encoder, conv, block, conv_id != conv, parts, spans)
                block, parts, spans, chars = (0 if conv_id != conv else block + 1), [], [], 0
            conv, begun = conv_id, True
            head, body = START + escape(role) + SEP, escape(text)
            if role in trained and body:
                spans.append((chars + len(head), chars + len(head) + len(body)))
            parts.append(head + body + END + "\n")
            chars += len(parts[-1])
    if begun:
        yield _block(encoder, conv, block, True, parts, spans)


def _encoder(tokenizer):
    from tokenizers import AddedToken, Tokenizer, processors

    encoder = Tokenizer.from_str(tokenizer)
    encoder.post_processor = processors.ByteLevel(trim_offsets=False)
    encoder.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, SEP, END)])
    return encoder


def _block(encoder, conv, block, last, parts, spans):
    text = "".join(parts)
    encoded = encoder.encode(text, add_special_tokens=False)
    ids, offsets = encoded.ids, np.array(encoded.offsets, np.int64).reshape(-1, 2)
    mask, starts, ends = intersect(np.array(spans, np.int64).reshape(-1, 2), offsets)
    lists = [ids, offsets[:, 0], offsets[:, 1], mask, starts, ends]
    kinds = [pa.int32()] * 3 + [pa.bool_()] + [pa.int32()] * 2
    arrays = [pa.array([x]) for x in (conv, block, last, text)]
    arrays[0] = pa.array([conv], pa.int64())
    arrays += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind)) for x, kind in zip(lists, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in BLOCKS.split(", ")])


def intersect(turns: np.ndarray, tokens: np.ndarray):
    """Which tokens meet a turn, and the characters they cover of it.

    Both lists of spans are sorted; turns are disjoint, tokens may share a character that they split.
    """
    first = np.searchsorted(tokens[:, 1], turns[:, 0], side="right")
    count = np.maximum(np.searchsorted(tokens[:, 0], turns[:, 1], side="left") - first, 0)
    token = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    turn = np.repeat(np.arange(len(turns)), count)
    mask = np.zeros(len(tokens), bool)
    mask[token] = True
    starts, ends = np.maximum(tokens[token, 0], turns[turn, 0]), np.minimum(tokens[token, 1], turns[turn, 1])
    if len(starts):
        starts = np.maximum(starts, np.concatenate([[0], np.maximum.accumulate(ends)[:-1]]))
    fresh = starts < ends
    return mask, starts[fresh], ends[fresh]


def digest_conversations(blocks: DataFrame) -> DataFrame:
    """One row per conversation, read back from its rendered blocks in the order they are in."""
    return blocks.select("conv_id", "last", "formatted", "loss_mask", "loss_starts", "loss_ends").mapInArrow(_digest, DIGESTS)


def _digest(batches):
    turns = loss = None
    for batch in batches:
        rows = []
        for conv, last, text, mask, starts, ends in zip(*(batch.column(i) for i in range(6))):
            if turns is None:
                turns, loss, sums = hashlib.sha256(), hashlib.sha256(), [0] * 5
            text, at = text.as_py(), 0
            while at < len(text):
                turn = _TURN.match(text, at)
                turns.update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
                at, sums[0] = turn.end(), sums[0] + 1
            for piece in _joined(np.asarray(starts.values), np.asarray(ends.values)):
                under = unescape(text[piece[0]:piece[1]])
                loss.update(under.encode())
                sums[1] += len(under)
            sums[2:] = sums[2] + len(text), sums[3] + len(mask.values), sums[4] + (mask.values.true_count if len(mask.values) else 0)
            if last.as_py():
                rows.append((conv.as_py(), sums[0], turns.hexdigest(), sums[1], loss.hexdigest(), *sums[2:]))
                turns = None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = [f.split()[0] for f in DIGESTS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _joined(starts, ends):
    """Adjacent spans as one, so that an escape is never cut."""
    if not len(starts):
        return []
    first = np.concatenate([[True], starts[1:] != ends[:-1]])
    last = np.concatenate([first[1:], [True]])
    return zip(starts[first].tolist(), ends[last].tolist())
