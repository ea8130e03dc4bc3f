"""Every stage of the pipeline, and all of them in a row, against plain Python on a small table."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linetrawl.llm import common, decontaminate, langid, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PRIMES, MASK = langid._PRIME, 2 ** 32 - 1


# ------------------------------------------------------------------------------------ plain versions
def trigrams(text):
    spaced = [c if c.isalpha() else " " for c in " " + (text or "") + " "]
    low = [c.lower() if len(c.lower()) == 1 else c for c in spaced]
    out = []
    for i in range(1, len(low) - 1):
        if spaced[i] != " ":
            mixed = sum(ord(low[i + j - 1]) * p for j, p in enumerate(PRIMES)) & MASK
            mixed ^= mixed >> 15
            out.append((mixed * PRIMES[1] & MASK) >> 16)
    return out


def plain_model(docs):
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang, *_ in docs:
        if lang is not None:
            counts[lang].update(trigrams(text))
    return {lang: (c, sum(c.values()) + 0.1 * langid.BUCKETS) for lang, c in counts.items()}


def plain_mixture(text, model):
    """Shares of the languages and of unknown, by expectation-maximisation and one language less as long as it is worth it."""
    grams, names = trigrams(text), [*sorted(model), None]
    if not grams:
        return None
    windows = []
    for at in range(0, len(grams), langid.WINDOW):
        some = grams[at:at + langid.WINDOW]
        logs = [sum(math.log((model[n][0][g] + 0.1) / model[n][1]) for g in some) for n in names[:-1]] + [-math.log(langid.BUCKETS) * len(some)]
        windows.append([math.exp(max(x - max(logs), -60)) for x in logs])

    def fit(now, steps):
        for _ in range(steps):
            sums = [0.0] * len(now)
            for w in windows:
                joint = [a * b for a, b in zip(w, now)]
                sums = [s + j / sum(joint) for s, j in zip(sums, joint)]
            now = [s / len(windows) for s in sums]
        return now, sum(math.log(sum(a * b for a, b in zip(w, now))) for w in windows)

    now, fitted = fit([1 / len(names)] * len(names), langid._STEPS)
    while sum(x > 0 for x in now) > 1:
        least = min((i for i in range(len(now)) if now[i] > 0), key=lambda i: now[i])
        fewer = [0.0 if i == least else x for i, x in enumerate(now)]
        fewer, value = fit([x / sum(fewer) for x in fewer], 3)
        if fitted - value > 0.5 * math.log(max(2, len(windows))):
            break
        now, fitted = fewer, value
    return dict(zip(names, now))


def plain_language(docs):
    model, out = plain_model(docs), []
    for row in docs:
        shares = plain_mixture(row[1], model)
        if shares and 1 - shares[None] >= 0.5:
            out.append(row)
    return out


def runs_of_words(text):
    words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def plain_deduplicate(docs):
    sets, root = [runs_of_words(r[1]) for r in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    best = {}
    for i, row in enumerate(docs):
        best.setdefault(find(i), []).append((row[0] is None, row[0] or 0, hashlib.md5((row[1] or "").encode()).digest(), i))
    return [docs[min(members)[3]] for members in best.values()]


def least_edits(item, text):
    """Least edit distance between the item and any part of the text: one column of the table as two numbers' bits."""
    masks, m = collections.defaultdict(int), len(item)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        score += bool(ph & high) - bool(mh & high)
        best = min(best, score)
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
    return best


def flat(text):
    points = decontaminate._normal(text or "")[0]
    return "".join(map(chr, points.tolist()))


def plain_decontaminate(docs, items):
    items = [flat(t).strip(" ") for t in items if t]
    return [r for r in docs if all(least_edits(i, flat(r[1])) > int(len(i) * 0.1) for i in items if i)]


def plain_mix(docs):
    sized = [(r, len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in docs]
    sizes = collections.Counter()
    for r, n in sized:
        sizes[r[3]] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 3 * sizes[s]}
        for s in full or free:
            target[s] = 3.0 * sizes[s] if full else level * weight[s]
        left -= sum(target[s] for s in full or free)
        free -= full or free
    out = []
    for source in order:
        rows = sorted(((hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest(), n, r) for r, n in sized if r[3] == source), key=lambda x: x[:2])
        start = 0
        for _, n, r in rows:
            for epoch in range(3):
                take = max(0, min(n, math.floor(target[source]) - (start + epoch * sizes[source])))
                out += [r] if take * 2 >= n and take > 0 else []
            start += n
    return out


# ------------------------------------------------------------------------------------ fixture
@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    table = [tuple(r) for r in common.table(spark, sf_dir, "documents").orderBy("doc_id").select("doc_id", "text", "lang", "source", "n_chars").limit(70).collect()]
    item = max((r.text for r in common.table(spark, sf_dir, "benchmark").collect()), key=len)
    prose = next(r for r in table if r[1] and 80 < len(r[1].split()) < 400 and r[2])
    near = " ".join(prose[1].split()[:-1] + ["zuletzt"])
    return table + [
        (1000, None, None, "s", 0), (1001, "", "en", "s", 0), (1002, "12345 !!! \x00", None, None, 9), (None, near + " eins", prose[2], "s", 1), (None, "", None, "s", 0),
        (1003, near, prose[2], None, 1), (1004, near, prose[2], "t", 1), (1004, near, prose[2], "t", 1), (1005, prose[1] + " " + item.upper().replace("e", "3", 2), prose[2], "s", 1),
        (1006, "漢字仮名交じり文 " * 60, None, "s", 1), (1007, "\t\n", None, "s", 1),
    ]


@pytest.fixture(scope="module")
def folder(spark, sf_dir, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    common.table(spark, sf_dir, "benchmark").unionByName(spark.createDataFrame([(9001, None), (9002, "")], "item_id long, text string")).write.parquet(f"{at}/benchmark.parquet")
    return at


def plain_stages(spark, folder, rows):
    items = [r.text for r in common.table(spark, folder, "benchmark").collect()]
    yield "language", plain_language
    yield "deduplicate", plain_deduplicate
    yield "decontaminate", lambda docs: plain_decontaminate(docs, items)
    yield "mix", plain_mix


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_every_stage_and_the_whole_run(spark, folder, rows):
    docs, stages = rows, dict(corpus_pipeline.STAGES)
    for name, plain in plain_stages(spark, folder, rows):
        want = plain(docs)
        frame = spark.createDataFrame(docs, DOCS)
        got = stages[name](spark, frame, folder)
        assert got.columns == frame.columns
        same(got.collect(), want)
        assert 0 < len(want) and (want != docs or name == "mix")
        docs = want
    sized = [(r[0], len((r[1] or "").encode()) + (r[1] is not None), zlib.crc32((r[1] or "").encode())) for r in docs]
    placed = corpus_pipeline.run(spark, folder).collect()
    assert sorted(((r.doc_id, r.text_crc32) for r in placed), key=str) == sorted(((d, c) for d, _, c in sized), key=str)
    slots = collections.defaultdict(list)
    for r in placed:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stages_take_empty_tables_and_extra_columns(spark, folder, rows):
    for docs in (spark.createDataFrame([], DOCS), spark.createDataFrame([(None, None, None, None, None)] * 3, DOCS)):
        docs = docs.withColumn("size", F.lit(1)).withColumn("root", F.lit("r"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns and out.count() <= 3


def test_language_equals_plain_expectation_maximisation(spark, sf_dir):
    """Shares, language and known part of every document of the table."""
    docs = [tuple(r) for r in common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = plain_model(docs)
    got = {r.doc_id: r for r in langid.identify(frame, langid.train(frame)).collect()}
    close = 0
    for doc, text, _ in docs:
        shares = plain_mixture(text, model)
        if shares is None:
            assert (got[doc].lang_pred, got[doc].score) == (langid.UNDETERMINED, 0)
            continue
        known = 1 - shares.pop(None)
        assert got[doc].known == pytest.approx(known, abs=2e-3)
        if known > 0:
            best = max(sorted(shares), key=lambda n: shares[n])
            close += got[doc].lang_pred == best and abs(got[doc].score - shares[best] / known) < 2e-3
    assert close >= len(docs) - sum(plain_mixture(t, model) is None for _, t, _ in docs) - 2  # a choice on the edge of the penalty may fall otherwise


def test_quality_weights_equal_a_direct_ridge_solve(spark, sf_dir):
    """The summed normal equations against one solve over all rows, and the calibration against plain pooling."""
    stats = common.stored(quality.statistics(common.table(spark, sf_dir, "documents")), "statistics")
    fold = common.crc(F.col("doc_id")) % 5
    learning = quality.labelled(stats, common.table(spark, sf_dir, "labels"), fold != 0, fold == 1)
    model = quality.fit(learning.repartition(7))
    rows = learning.collect()
    fitted = [r for r in rows if not r.calibrates]
    features = model.features(np.array([r.stats for r in fitted]))
    ridge = np.diag([quality.RIDGE * len(fitted)] * quality.FEATURES + [0.0])
    direct = np.linalg.solve(features.T @ features + ridge, features.T @ np.array([r.label for r in fitted]))
    probe = model.features(np.array([r.stats for r in rows]))
    assert np.abs(probe @ direct - probe @ model.weights).max() < 1e-6

    width = (quality.HIGH - quality.LOW) / quality.BINS
    raw = np.clip(model.features(np.array([r.stats for r in rows if r.calibrates])) @ model.weights, quality.LOW, quality.HIGH)
    pools = [[quality.LOW + (min(int((x - quality.LOW) // width), quality.BINS - 1) + 0.5) * width, r.label, 1] for x, r in sorted(
        zip(raw, (r for r in rows if r.calibrates)), key=lambda p: p[0])]
    pools = [[at, sum(p[1] for p in pools if p[0] == at), sum(1 for p in pools if p[0] == at)] for at in sorted({p[0] for p in pools})]
    means = [s / n for _, s, n in pools]
    # Least squares under the order: the largest over all beginnings of the smallest mean over all ends.
    isotonic = [max(min(sum(p[1] for p in pools[a:b + 1]) / sum(p[2] for p in pools[a:b + 1]) for b in range(i, len(pools))) for a in range(i + 1)) for i in range(len(pools))]
    assert len(means) > 3
    got = [model.calibrated[np.searchsorted(np.array(_pool_ends(pools, isotonic)), i)] for i in range(len(pools))]
    assert got == pytest.approx(isotonic, abs=1e-9)


def _pool_ends(pools, values):
    """The last bin of each run of equal values."""
    return [i for i in range(len(pools)) if i + 1 == len(pools) or abs(values[i] - values[i + 1]) > 1e-12]
