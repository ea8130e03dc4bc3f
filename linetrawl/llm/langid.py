"""Multilingual language identification: language proportions by expectation-maximisation."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from linetrawl.llm import texts
from linetrawl.llm.common import without

#: Letter trigrams are counted in this many hash buckets.
BUCKETS = 1 << 16
#: What a model may weigh: languages x BUCKETS x 4 bytes stay below this.
MODEL_BYTES = 256 << 20
#: A document is a mixture of windows of this many trigrams, each in one language.
WINDOW = 48
_STEPS, _SPACE, _PRIME = 12, 32, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
PREDICTION = "lang_pred string, score double, languages array<struct<lang: string, share: double>>, known double"
UNDETERMINED = "und"


def train(docs: DataFrame) -> tuple[list[str], bytes]:
    """Languages and trigram log likelihoods from the ``text`` and non-null ``lang`` of documents.

    Each task adds up its own counts; one row per language, task and filled bucket is shuffled, and at most
    ``BUCKETS`` sums per language reach the driver. Raises if the languages are so many that the model
    would exceed ``MODEL_BYTES``. No labelled rows: a model without languages.
    """
    counted = (
        docs.filter("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
        .mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    langs = [r[0] for r in docs.filter("lang IS NOT NULL").select(F.col("lang").cast("string")).distinct().limit(MODEL_BYTES // (4 * BUCKETS) + 1).collect()]
    if len(langs) * BUCKETS * 4 > MODEL_BYTES:
        raise ValueError(f"more than {MODEL_BYTES // (4 * BUCKETS)} languages")
    langs.sort()
    counts = np.zeros((len(langs), BUCKETS))
    place = {x: i for i, x in enumerate(langs)}
    sums = counted.toPandas()
    counts[sums["lang"].map(place).to_numpy(int), sums["bucket"].to_numpy(int)] = sums["n"].to_numpy(float)
    likelihood = (counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * BUCKETS)
    out = io.BytesIO()
    np.save(out, np.log(likelihood).T.astype(np.float32))
    return langs, out.getvalue()


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for frame in frames:
        for lang, group in frame.groupby("lang", sort=False)["text"]:
            sums = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for chunk in texts.chunks(_pieces(group)):
                sums += np.bincount(trigrams(chunk)[0], minlength=BUCKETS)
    for lang, sums in counts.items():
        filled = np.flatnonzero(sums)
        yield pd.DataFrame({"lang": lang, "bucket": filled.astype(np.int32), "n": sums[filled]})


def _pieces(values, size: int = 1 << 20) -> Iterator[str]:
    """Texts with long ones cut; a cut counts as white space."""
    for text in values:
        text = text or ""
        for at in range(0, max(1, len(text)), size):
            yield text[at:at + size]


def trigrams(chunk: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the lower-case letter trigrams, and how many each text has.

    All but letters counts as one space, however long; a trigram has a letter in its middle.
    """
    joined = texts.lower(texts.points(" " + "  ".join(chunk) + " "))
    is_letter = texts.letters(joined)
    joined = np.where(is_letter, joined, _SPACE).astype(np.uint32)
    middle = is_letter[1:-1]
    a, b, c = (joined[i:len(joined) - 2 + i][middle] * np.uint32(p) for i, p in enumerate(_PRIME))
    mixed = a + b + c
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(_PRIME[1])
    sizes = np.fromiter(map(len, chunk), np.int64, len(chunk))
    ends = np.cumsum(sizes + 2)
    before = np.concatenate([[0], np.cumsum(is_letter)])
    per_text = np.diff(np.concatenate([[0], before[np.minimum(ends, len(joined))]]))
    return (mixed >> np.uint32(16)).astype(np.int64), per_text


def identify(docs: DataFrame, model: tuple[list[str], bytes]) -> DataFrame:
    """Add ``lang_pred, score, languages, known`` to documents, from their text alone.

    A text is cut into windows of ``WINDOW`` trigrams. Expectation-maximisation over their likelihoods gives the
    proportions of the languages and of an unknown one that finds all buckets equally likely. The
    least language is given up as long as the likelihood loses no more than half the logarithm of
    the number of windows. ``languages`` lists the rest by share (of the known part), ties by name; ``score`` is the share of the first,
    ``lang_pred``; ``known`` is the part that is not unknown.

    A text that is null or has no letter, and any without a trained language, is ``und`` with score 0 and no
    languages. Equal texts give equal results. Other columns are kept; those of the added names are replaced.
    """
    names = [f.split()[0] for f in ("lang_pred string", "score double", "languages x", "known double")]
    docs = without(docs, *names, "__language")
    langs, table = model

    @pandas_udf(PREDICTION)
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        likelihood = np.load(io.BytesIO(table))
        for part in parts:
            yield pd.DataFrame([row for chunk in texts.chunks(part) for row in _predict(chunk, langs, likelihood)], columns=names)

    found = docs.withColumn("__language", predict(F.col("text").cast("string")))
    return found.select(*[f"`{c}`" for c in docs.columns], *[F.col(f"__language.{n}").alias(n) for n in names])


def _predict(chunk: list[str], langs: list[str], table: np.ndarray) -> list[tuple]:
    scores, owner = [], []
    for first, text in enumerate(chunk):
        if len(text) > 1 << 21:  # a long text in pieces, so that no array outgrows the chunk
            for piece in _pieces([text]):
                scores.append(_windows([piece], table)[0])
                owner.append(np.full(len(scores[-1]), first))
            chunk[first] = ""
    likelihood, windows = _windows(chunk, table)
    scores.append(likelihood)
    owner.append(windows)
    scores, owner = np.concatenate(scores), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    scores, owner = scores[order], owner[order]
    shares = _mixture(scores, owner, len(chunk))
    totals = np.zeros((len(chunk), scores.shape[1]))
    np.add.at(totals, owner, scores)
    rows = []
    for share, total in zip(shares, totals):
        known = 1 - share[-1]
        if not langs or not share.any():
            rows.append((UNDETERMINED, 0.0, [], 0.0))
            continue
        kept = sorted(((langs[i], share[i] / known if known > 0 else 0.0) for i in range(len(langs)) if share[i] > 0), key=lambda x: (-x[1], x[0]))
        kept = kept or [(langs[int(total[:-1].argmax())], 0.0)]
        rows.append((kept[0][0], min(1.0, float(kept[0][1])), [{"lang": n, "share": float(s)} for n, s in kept], float(known)))
    return rows


def _windows(chunk, table):
    """Log likelihood of each window in each language, and the text it belongs to."""
    buckets, per_text = trigrams(chunk)
    count = -(-per_text // WINDOW)
    begins = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    owner = np.repeat(np.arange(len(chunk)), count)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    starts = begins[owner] + rank * WINDOW
    if not len(starts):
        return np.empty((0, table.shape[1] + 1)), owner
    sums = np.add.reduceat(table[buckets], starts, axis=0)
    sizes = np.diff(np.concatenate([starts, [len(buckets)]]))
    return np.column_stack([sums, -np.log(BUCKETS) * sizes]).astype(np.float64), owner


def _mixture(scores: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Proportions per text, the last for unknown; all zero for a text without windows."""
    width = scores.shape[1]
    count = np.bincount(owner, minlength=n)
    texts_, starts = np.flatnonzero(count), (np.cumsum(count) - count)[count > 0]
    shares = np.zeros((n, width))
    if not len(texts_):
        return shares
    place = np.repeat(np.arange(len(texts_)), count[texts_])
    top = scores.max(1, keepdims=True)
    likelihood = np.exp(np.maximum(scores - top, -60))

    def fit(start, steps):
        now = start
        for _ in range(steps):
            joint = likelihood * now[place]
            now = np.add.reduceat(joint / joint.sum(1, keepdims=True), starts, axis=0) / count[texts_][:, None]
        return now, np.add.reduceat(np.log((likelihood * now[place]).sum(1)), starts)

    now, fitted = fit(np.full((len(texts_), width), 1 / width), _STEPS)
    penalty = 0.5 * np.log(np.maximum(count[texts_], 2))
    trying = np.ones(len(texts_), bool)
    for _ in range(width - 1):
        positive = np.where(now > 0, now, np.inf)
        least = positive.argmin(1)
        several = (now > 0).sum(1) > 1
        trying &= several
        if not trying.any():
            break
        fewer = now.copy()
        fewer[np.arange(len(now)), np.where(trying, least, 0)] *= np.where(trying, 0, 1)
        fewer /= fewer.sum(1, keepdims=True)
        fewer, value = fit(fewer, 3)
        better = trying & (fitted - value <= penalty)
        now[better], fitted[better] = fewer[better], value[better]
        trying = better
    shares[texts_] = now
    return shares
