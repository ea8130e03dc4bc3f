"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated isotonically."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from linetrawl.llm import texts

STATISTICS = (
    "log_chars", "log_words", "word_length", "symbols", "capitals", "digits", "letters", "distinct_words", "distinct_pairs",
    "repeated_lines", "top_word", "word_again", "bare_marks", "stops", "log_line", "longest_word", "capital_words", "word_spread",
)
#: Random Fourier features, and the width of the Gaussian kernel in standard deviations of each statistic.
FEATURES, WIDTH, RIDGE, SEED = 192, 4.0, 1e-3, 7
#: Raw scores are counted in so many bins between these ends for the calibration.
BINS, LOW, HIGH = 2000, -0.5, 1.5


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` of every row: the numbers of ``STATISTICS`` for its text; a null text counts as empty."""
    @pandas_udf("array<double>")
    def stats(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([_statistics(t or "") for t in part])

    return docs.select("doc_id", stats(F.col("text").cast("string")).alias("stats"))


def _statistics(text: str) -> list[float]:
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    capitals = digits = letters = blanks = 0
    for at in range(0, len(text), 1 << 20):
        points = texts.points(text[at:at + (1 << 20)])
        is_letter = texts.letters(points)
        capitals += int((texts.lower(points) != points).sum())
        digits += int(((points >= 48) & (points <= 57)).sum())
        letters += int(is_letter.sum())
        blanks += int(texts.spaces(points).sum())
    counts = Counter(words)
    lines = text.split("\n")
    lengths = [len(w) for w in words] or [0]
    total = sum(lengths)
    mean = total / n
    return [
        np.log1p(len(text)), np.log1p(len(words)), mean, (len(text) - letters - digits - blanks) / chars, capitals / chars, digits / chars,
        letters / chars, len(counts) / n, len(set(zip(words, words[1:]))) / n, 1 - len(set(lines)) / len(lines),
        max(counts.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(k for w, k in counts.items() if not any(c.isalnum() for c in w)) / n, sum(k for w, k in counts.items() if w[-1] in ".!?") / n,
        np.log1p(len(text) / len(lines)), np.log1p(max(lengths)), sum(k for w, k in counts.items() if w[0].isupper()) / n,
        float(np.sqrt(max(0.0, sum(k * len(w) ** 2 for w, k in counts.items()) / n - mean * mean))),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    calibrated: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(SEED)
        slopes = draw.standard_normal((stats.shape[1], FEATURES)) / WIDTH
        phases = draw.uniform(0, 2 * np.pi, FEATURES)
        waves = np.sqrt(2 / FEATURES) * np.cos((stats - self.mean) / self.scale @ slopes + phases)
        return np.column_stack([waves, np.ones(len(stats))])

    def scores(self, stats: np.ndarray) -> np.ndarray:
        raw = np.clip(self.features(stats) @ self.weights, LOW, HIGH)
        steps = np.interp(raw, self.raw, self.calibrated)
        return np.clip((1 - 1e-6) * steps + 1e-6 * (raw - LOW) / (HIGH - LOW), 0, 1)  # keeps the order within a step


def fit(labelled: DataFrame) -> Model:
    """A model from rows of ``stats, label, calibrates``.

    Where ``calibrates`` is false, each task adds up its part of the normal equations of the ridge regression of
    ``label`` on the features; the parts are summed row by row of the matrix, and the driver solves for ``FEATURES`` + 1
    weights. The other rows give the calibration: their raw scores are counted by bin and label, and adjacent
    bins pooled until the share of label 1 rises. Without rows to learn from every score is
    0.5; without rows to calibrate on the raw score, cut to 0 and 1, is returned.
    """
    k = len(STATISTICS)
    moments = labelled.filter("NOT calibrates").agg(*[f(F.element_at("stats", i + 1)) for i in range(k) for f in (F.avg, F.stddev_pop)]).first()
    if moments[0] is None:
        return Model(np.zeros(k), np.ones(k), np.zeros(FEATURES + 1), np.array([LOW, HIGH]), np.array([0.5, 0.5]))
    scale = np.array([x if x > 1e-9 else 1.0 for x in moments[1::2]])
    model = Model(np.array(moments[0::2]), scale, np.zeros(FEATURES + 1), np.array([LOW, 0, 1, HIGH]), np.array([0, 0, 1, 1.0]))
    matrix, target = _normal_equations(labelled.filter("NOT calibrates"), model)
    matrix[np.diag_indices(FEATURES)] += RIDGE * matrix[-1, -1]
    model.weights = np.linalg.lstsq(matrix, target, rcond=None)[0]
    width = (HIGH - LOW) / BINS
    raw = _raw(model)
    counts = labelled.filter("calibrates").select(F.least(F.floor((raw("stats") - LOW) / width), F.lit(BINS - 1)).alias("bin"), "label") \
        .groupBy("bin").agg(F.sum("label"), F.count("*")).orderBy("bin").collect()
    if counts:
        model.raw, model.calibrated = _isotonic([(LOW + (b + 0.5) * width, ones, n) for b, ones, n in counts])
    return model


def _raw(model: Model):
    @pandas_udf("double")
    def raw(stats: pd.Series) -> pd.Series:
        return pd.Series(np.clip(model.features(np.stack(stats.to_numpy())) @ model.weights, LOW, HIGH) if len(stats) else [], dtype=float)

    return raw


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for frame in frames:
            if len(frame):
                x = model.features(np.stack(frame["stats"].to_numpy()))
                total += x.T @ np.column_stack([x, frame["label"].to_numpy(float)])
        if total.any():
            task = int(np.abs(total[0, 0] * 1e6)) % 64
            yield pd.DataFrame({"row": range(FEATURES + 1), "part": task, "sums": [r.tobytes() for r in total]})

    def join(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        whole = np.sum([np.frombuffer(b) for b in frame["sums"]], axis=0)
        return pd.DataFrame({"row": [key[0]], "part": [-1], "sums": [whole.tobytes()]})

    schema = "row int, part int, sums binary"
    parts = rows.select("stats", "label").mapInPandas(add, schema)
    for keys in (["row", "part"], ["row"]):
        parts = parts.groupBy(*keys).applyInPandas(join, schema)
    whole = np.stack([np.frombuffer(bytes(r["sums"])) for r in parts.orderBy("row").collect()])
    return whole[:, :-1].copy(), whole[:, -1]


def _isotonic(bins: list[tuple[float, float, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; each pool at its mean raw score."""
    pools: list[list[float]] = []
    for at, ones, n in bins:
        pools.append([at * n, ones, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def score(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``threshold`` on) to rows of ``stats``."""
    @pandas_udf("double")
    def scored(parts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(parts.to_numpy())) if len(parts) else [], dtype=float)

    return stats.withColumn("score", scored("stats")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def labelled(stats: DataFrame, labels: DataFrame, learns: Column, calibrates: Column) -> DataFrame:
    """Rows to fit on. Several labels of a document count as their mean; rows of a null id or label do not count."""
    means = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
    return stats.filter(learns).join(means, "doc_id").select("stats", "label", calibrates.alias("calibrates"))
