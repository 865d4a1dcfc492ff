from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from partweave.llm import language_id, toxicity as toxic
from partweave.llm.fitting import class_sample
from partweave.llm.language_id import identify_languages, with_language
from partweave.llm.quality_classifier import NAMES, Discriminant, discriminant, quality_scores, statistics
from partweave.llm.toxicity import GRADES, Ordinal, toxicity

M = (1 << 64) - 1
TEXTS = ["", "abc", "The the cat sat. On\n\nthe mat! 12 #tags\nthe mat! 12 #tags\n", "Ünï 中文 x " * 9, "one two three four five one two three four five", "a  b\tc\x0bd", "!!!", "Straße İstanbul 😀 don't"]


def fold(key, n):
    return zlib.crc32(str(key).encode()) % n


def test_language_on_held_out_rows(documents, messy, empty):
    got = {r.doc_id: r for r in identify_languages(documents).collect()}
    truth = {r.doc_id: r.lang for r in documents.collect()}
    assert all(r.held_out == (fold(i, 4) == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    odd = {r.doc_id: r for r in identify_languages(messy).collect()}
    assert all(odd[i].lang_pred == "und" for i in (4, 5, 6, 7)) and odd[8].lang_pred in ("en", "es")
    assert identify_languages(empty).count() == 0
    assert {r.lang_pred for r in identify_languages(documents.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert with_language(messy, None).columns == [*messy.columns, "lang_pred", "lang_score"]


def test_quality_on_held_out_rows(spark, documents, labels, messy, empty):
    got = {r.doc_id: r for r in quality_scores(documents, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in truth if i in got and got[i].held_out]
    assert all(r.held_out == (fold(i, 5) == 0) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.85
    odd = quality_scores(messy, labels).collect()
    assert len(odd) == messy.count() and all(0 <= r.score <= 1 for r in odd) and quality_scores(empty, labels).count() == 0
    assert {r.score for r in quality_scores(documents, labels.limit(0)).collect()} == {0.5}


def test_discriminant_against_plain_densities():
    r = np.random.default_rng(1)
    x = {0: r.normal(0, 1, (400, 3)), 1: r.normal(1, 2, (600, 3))}
    model = discriminant({c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()})
    assert isinstance(model, Discriminant) and discriminant({1: (5, np.zeros(3), np.eye(3))}) is None
    point = np.array([[0.2, -1.0, 2.0]])
    logs = [model.log_priors[c] - model.log_dets[c] - 0.5 * (np.linalg.solve(model.factors[c], point[0] - model.means[c]) ** 2).sum() for c in (0, 1)]
    assert np.isclose(model.scores(point)[0], 1 / (1 + np.exp((logs[0] - logs[1]) / 4)))


def test_statistics_are_finite_for_any_text():
    data = np.frombuffer("abc\n\nAbc abc !!\n".encode(), np.uint8)
    x = statistics(data, np.array([0, 0, 4, len(data), len(data)]))
    assert x.shape == (4, len(NAMES)) and np.isfinite(x).all()


def test_toxicity_on_planted_words(spark, messy, empty):
    r = np.random.default_rng(2)
    clean = [f"word{i}" for i in range(400)]
    bad = [f"awful{c}" for c in "abcdefgh"]
    rows = []
    for i in range(600):
        words = list(r.choice(clean, 60))
        y = int(i % 4 == 0)
        if y:
            words += list(r.choice(bad, 2 + i % 7))
        rows.append((i, " ".join(words), y))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {g.doc_id: g for g in toxicity(docs, labels).collect()}
    held = [(got[i], y) for i, _, y in rows if fold(i, 5) == 0]
    assert all(g.held_out for g, _ in held) and np.mean([g.toxic == bool(y) for g, y in held]) > 0.97
    assert all(0 <= g.severity <= GRADES - 1 for g in got.values())
    assert np.mean([g.severity for g, y in held if y]) > np.mean([g.severity for g, y in held if not y]) + 0.5
    assert toxicity(messy, labels.limit(0)).where("severity = 0 AND NOT toxic").count() == messy.count() and toxicity(empty, labels).count() == 0


def test_ordinal_is_cumulative():
    model = Ordinal(np.array([2.0, -1.0, 0.0]), np.array([1.0, 2.0, 4.0]))
    p = model.at_most(np.array([0]))
    assert (np.diff(p) > 0).all() and np.isclose(model.severity(np.array([0]))[0], (1 - p).sum())


def test_sample_is_bounded_and_repeatable(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "rare").otherwise("often").alias("y")).union(spark.sql("SELECT NULL, 'often'"))
    first, sizes = class_sample(df, "y", "k", 200)
    n = {r.y: r["count"] for r in first.groupBy("y").count().collect()}
    assert sizes == {"often": 4500, "rare": 500} and 120 < n["often"] < 280 and 120 < n["rare"] < 280
    assert sorted(first.collect()) == sorted(class_sample(df, "y", "k", 200)[0].collect())


def test_every_language_is_learnt(spark):
    """More languages than the sample has full shares for, of very different frequency; each has its own words."""
    r, rows = np.random.default_rng(7), []
    for k in range(80):
        own = ["".join(chr(0x4E00 + 40 * k + c) for c in r.integers(0, 40, 5)) for _ in range(12)]
        rows += [(1000 * k + i, " ".join(r.choice(own, 25)), f"l{k:02d}") for i in range(12 if k < 70 else 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {g.doc_id: g.lang_pred for g in identify_languages(df).collect()}
    assert {got[i] for i, _, _ in rows} == {y for _, _, y in rows} and np.mean([got[i] == y for i, _, y in rows]) > 0.95


def test_sample_has_every_class(spark):
    df = spark.range(30000).select(F.col("id").alias("k"), F.concat(F.lit("c"), (F.col("id") % 100).cast("string")).alias("y"))
    rows, sizes = class_sample(df, "y", "k", 200)
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    assert len(sizes) == len(n) == 100 and 80 < min(n.values()) and 0.7 * 64 * 200 < sum(n.values()) < 1.3 * 64 * 200


def plain_statistics(text):
    """The fifteen statistics of a text, one after the other."""
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    n, size = len(words), len(raw)
    lengths = [len(w) for w in words] or [0]
    mean = sum(lengths) / max(n, 1)
    spread = math.sqrt(max(sum(x * x for x in lengths) / max(n, 1) - mean**2, 0))
    of = lambda chars: sum(b in chars for b in raw)
    rate = lambda a, b: math.log((a + 0.5) / (b + 1.0))
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    shingles = len({tuple(low[i : i + 5]) for i in range(n - 4)}) if n >= 5 else min(n, 1)
    lines = [x for x in raw.split(b"\n") if x]
    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread), rate(of(b"#*$%&|<>@^~_=+\\/[]{}`"), size), rate(of(b"!?"), size), rate(upper, upper + lower), rate(sum(48 <= b <= 57 for b in raw), size),
        rate(of(b".,"), n), rate(of(b"'\"();:-"), n), rate(sum(a == b for a, b in zip(low, low[1:], strict=False)), n), rate(max(n - 4, min(n, 1)) - shingles, n),
        math.log1p(len(set(low))) - math.log1p(n), rate(len(lines) - len(set(lines)), len(lines)), rate(sum(b >= 192 for b in raw), size), rate(sum(65 <= w[0] <= 90 for w in words), n),
    ]


def test_statistics_against_plain_counting(documents):
    texts = TEXTS + [r.text or "" for r in documents.limit(60).collect()]
    raw = [t.encode() for t in texts]
    got = statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.allclose(got, [plain_statistics(t) for t in texts], atol=1e-9)


def test_quality_scores_against_plain_densities(documents, labels):
    """The whole query by inverses and determinants instead of Cholesky factors."""
    x = {r.doc_id: np.array(plain_statistics(r.text or "")) for r in documents.collect()}
    rows = {c: np.array([x[r.doc_id] for r in labels.collect() if r.quality == c and r.doc_id in x and fold(r.doc_id, 5) != 0]) for c in (0, 1)}
    means, covs = {c: v.mean(0) for c, v in rows.items()}, {c: np.cov(v.T, bias=True) for c, v in rows.items()}
    n = sum(map(len, rows.values()))
    pooled, logs = sum(len(rows[c]) / n * covs[c] for c in (0, 1)), {}
    for c in (0, 1):
        s = 0.9 * covs[c] + 0.1 * pooled
        s = 0.95 * s + 0.05 * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
        inverse, half = np.linalg.inv(s), np.linalg.slogdet(s)[1] / 2
        logs[c] = {i: math.log(len(rows[c]) / n) - half - 0.5 * (v - means[c]) @ inverse @ (v - means[c]) for i, v in x.items()}
    for r in quality_scores(documents, labels).collect():
        z = (logs[0][r.doc_id] - logs[1][r.doc_id]) / 4
        assert math.isclose(r.score, 1 / (1 + math.exp(min(z, 700))), abs_tol=1e-7)


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def lowered(text):
    return [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text]


def plain_ngrams(text):
    """Buckets of all runs of one to three characters, letters lower-cased and others as blanks."""
    value, counts = [plain_mix(ord(c) + 1) for c in lowered(text)], collections.Counter()
    for k in range(3):
        for i in range(len(value) - k):
            h = 0
            for v in value[i : i + k + 1]:
                h = (h * 0x9E3779B97F4A7C15 + v) & M
            counts[plain_mix((h + k) & M if k else h) >> 49] += 1
    return counts


def test_ngrams_against_plain_counting():
    raw = [t.encode() for t in TEXTS]
    got = language_id.ngram_rows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for text, (found, counts, letters) in zip(TEXTS, got, strict=True):
        assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == plain_ngrams(text) and letters == any(c.isalpha() for c in text)


def test_language_training_against_plain_ftrl(monkeypatch):
    """Weights coordinate by coordinate, and predictions by a plain softmax."""
    monkeypatch.setattr(language_id, "BUCKETS", 8)
    monkeypatch.setattr(language_id, "CALIBRATE", 0.0)
    r, idf = np.random.default_rng(3), np.linspace(1, 2, 8)
    rows = []
    for i in range(30):
        found = np.sort(r.choice(8, 3, replace=False))
        rows.append((found, r.integers(1, 5, 3), "abc"[i % 3]))
    # One row is kept for the temperature whatever its share.
    model = language_id.train(rows, list("abc"), idf)
    order = np.random.Generator(np.random.PCG64(3)).permutation(30)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(b, c):
        if abs(z[b, c]) <= 1e-3:
            return 0.0
        return -(z[b, c] - math.copysign(1e-3, z[b, c])) / ((1.0 + math.sqrt(n[b, c])) / 0.5 + 1e-4)

    def vector(i):
        v = [math.log1p(c) * idf[b] for b, c in zip(rows[i][0], rows[i][1], strict=True)]
        size = math.sqrt(sum(a * a for a in v))
        return [(int(b), a / size) for b, a in zip(rows[i][0], v, strict=True)] + [(8, 1.0)]

    for _ in range(3):
        for i in order[1:].tolist():
            w = {(b, c): weight(b, c) for b, _ in vector(i) for c in range(3)}
            s = [sum(a * w[b, c] for b, a in vector(i)) for c in range(3)]
            e = [math.exp(a - max(s)) for a in s]
            for b, a in vector(i):
                for c in range(3):
                    g = a * (e[c] / sum(e) - (c == "abc".index(rows[i][2])))
                    z[b, c] += g - (math.sqrt(n[b, c] + g * g) - math.sqrt(n[b, c])) / 0.5 * w[b, c]
                    n[b, c] += g * g
    want = [[weight(b, c) for c in range(3)] for b in range(9)]
    assert np.allclose(np.vstack([model.weights, model.bias]), want, atol=1e-9)
    s = [sum(a * want[b][c] for b, a in vector(0)) / model.temperature for c in range(3)]
    assert np.allclose(model.probabilities(*rows[0][:2]), np.exp(s) / np.exp(s).sum())


def plain_features(text):
    """Buckets of the words and of their beginnings of 4, 5 and 6 letters."""
    out = set()
    for word in re.findall(r"[^ ]+", "".join(lowered(text))):
        h = 0
        for k, c in enumerate(word, 1):
            h = (h * 0x9E3779B97F4A7C15 + plain_mix(ord(c) + 7)) & M
            if k in (4, 5, 6):
                out.add(plain_mix(h ^ k) >> 46)
        out.add(plain_mix(h ^ 1 << 20) >> 46)
    return out


def test_toxic_features_and_scores_against_plain_ones(spark):
    raw = [t.encode() for t in TEXTS]
    got = list(toxic.feature_rows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
    assert [set(g.tolist()) for g in got] == [plain_features(t) for t in TEXTS]
    rows = [(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(20)) + " vilest" * (i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    docs, marks = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxic.fit(docs, marks.where("doc_id % 5 <> 1"), "text", "toxic", "doc_id", 3000)
    # The labels are given twice and so are the documents: the sample has each once.
    again = toxic.fit(docs.union(docs), marks.union(marks).where("doc_id % 5 <> 1"), "text", "toxic", "doc_id", 3000)
    assert np.array_equal(model.weights, again.weights) and model.weights.any()
    for _, text, _ in rows[:40]:
        score = sum(model.weights[b] for b in plain_features(text))
        above = [1 - 1 / (1 + math.exp(score - t)) for t in model.thresholds]
        assert np.allclose(model.severity(np.array(sorted(plain_features(text)))), (sum(above), above[0]))


def test_sampled_labels_keep_their_meaning():
    """With one label sampled down, chances stay near the shares in the table."""
    r, rows = np.random.default_rng(4), []
    for i in range(4000):
        y = int(i % 10 == 0)
        words = {int(x) for x in r.integers(0, 50, 8)} | ({100 + int(r.integers(5))} if r.random() < (0.7 if y else 0.05) else set())
        rows.append((np.array(sorted(words)), y))
    some = [x for x in rows if x[1]] + [x for x in rows if not x[1]][:400]
    mean = lambda m: np.mean([m.severity(f)[1] for f, _ in rows])
    assert mean(toxic.train(some, {0: 3600, 1: 400})) == pytest.approx(0.1, abs=0.04) and mean(toxic.train(some)) > 0.2


@pytest.mark.parametrize("sizes", [None, {0: 500, 1: 30}])
def test_ordinal_training_against_a_plain_version(monkeypatch, sizes):
    """Grades, the features that are learnt, weights and thresholds, number by number."""
    monkeypatch.setattr(toxic, "BUCKETS", 24)
    r, rows = np.random.default_rng(11), []
    for i in range(160):
        y = int(i % 4 == 0)
        found = {int(b) for b in r.choice(12, 4, replace=False)} | ({int(b) for b in 12 + r.choice(12, int(r.integers(1, 11)), replace=False)} if y else {12 + int(r.integers(4))} if r.random() < 0.1 else set())
        rows.append((np.array(sorted(found)), y))
    model = toxic.train(rows, sizes)
    count = [collections.Counter(int(b) for f, y in rows if y == k for b in f) for k in (0, 1)]
    total = [sum(y == k for _, y in rows) for k in (0, 1)]
    mass = [sum(count[0][int(b)] == 0 and count[1][int(b)] >= 3 for b in f) if y else None for f, y in rows]
    cuts = [float(np.quantile([m for m in mass if m is not None], q)) for q in (1 / 3, 2 / 3)]
    grade = [0 if m is None else 1 + sum(m > c for c in cuts) for m in mass]

    def chi2(b):
        share = (count[0][b] + count[1][b]) / sum(total)
        return sum((count[k][b] - total[k] * share) ** 2 / max(total[k] * share * (1 - share), 1e-9) for k in (0, 1))

    kept = {b for b in range(24) if chi2(b) >= 12}
    share = [(sizes or dict(enumerate(total)))[k] / total[k] for k in (0, 1)]
    each_of = [s * len(rows) / sum(a * b for a, b in zip(share, total, strict=True)) for s in share]
    z, n, gaps, seen = [0.0] * 24, [0.0] * 24, [1.0] * 3, [1.0] * 3
    weight = lambda b: 0.0 if abs(z[b]) <= 1.0 else (math.copysign(1.0, z[b]) - z[b]) * 0.3 / (1 + math.sqrt(n[b]))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    order = np.random.Generator(np.random.PCG64(5)).permutation(len(rows))
    for _ in range(6):
        for i in order.tolist():
            found, y = [int(b) for b in rows[i][0] if int(b) in kept], grade[i]
            w, at = {b: weight(b) for b in found}, [sum(gaps[: k + 1]) for k in range(3)]
            score = sum(w.values())
            upper, lower = sigmoid(at[y] - score) if y < 3 else 1.0, sigmoid(at[y - 1] - score) if y else 0.0
            each, chance = each_of[rows[i][1]], max(upper - lower, 1e-12)
            slope = each * (1 - upper - lower)
            for b in found:
                z[b] += slope - (math.sqrt(n[b] + slope * slope) - math.sqrt(n[b])) / 0.3 * w[b]
                n[b] += slope * slope
            # The slope in each threshold goes to every gap that it is a sum of.
            at_slope = [-each * upper * (1 - upper) / chance * (k == y) + each * lower * (1 - lower) / chance * (k == y - 1) for k in range(3)]
            for k in range(3):
                push = sum(at_slope[k:])
                seen[k] += push * push
                gaps[k] -= 0.5 * push / math.sqrt(seen[k])
                if k:
                    gaps[k] = max(gaps[k], 1e-2)
    assert len(set(grade)) == 4 and 0 < len(kept) < 24 and model.weights.any()
    assert np.allclose(model.weights, [weight(b) for b in range(24)], atol=1e-9) and np.allclose(model.thresholds, np.cumsum(gaps), atol=1e-9)


def test_thousands_of_languages_stay_bounded(spark):
    """A dirty column of 1,500 labels: every one has a weight column, and weights and sample stay within their bounds."""
    r, rows = np.random.default_rng(8), []
    for k in range(1500):
        own = ["".join(chr(0x4E00 + (13 * k + c) % 20000) for c in r.integers(0, 13, 5)) for _ in range(6)]
        rows += [(10 * k + i, " ".join(r.choice(own, 8)), f"l{k:04d}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, "text", "lang", "doc_id", 1000)
    assert len(model.classes) == 1500 and model.weights.size <= language_id.MOST_WEIGHTS and model.weights.shape[0] == model.idf.size == (model.rows >= 0).sum()
    text = np.frombuffer("".join(t for _, t, _ in rows[:30]).encode(), np.uint8)
    langs, scores = language_id._predicted(model, text, np.array([0, len(text)]))
    assert langs[0].as_py() in model.classes and 0 < scores[0].as_py() <= 1
