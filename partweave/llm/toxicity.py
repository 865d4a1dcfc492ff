"""Toxicity: cumulative-link ordinal regression on sparse text features.

Features are hashed words and word beginnings, one for each whole text in which they occur. The labels
are 0 and 1; the training rows with label 1 are graded by how much of them is made of features that
occur in toxic training rows only, so that the severity has ordered grades: 0 none, then 1 to
``GRADES - 1``. One weight vector serves all thresholds: P(grade <= k) = logistic(threshold_k - w.x).
Weights come from adaptive proximal steps with an L1 penalty on a bounded sample; the result is the
expected severity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import fold, prepare
from partweave.llm.fitting import class_sample
from partweave.llm.kernels import U, mix, steps
from partweave.llm.language_id import _letter_table
from partweave.llm.pretokens import code_points

#: Feature buckets, lengths of word beginnings, grades, and training rows per label.
BUCKETS, BEGINNINGS, GRADES, PER_CLASS = 1 << 18, (4, 5, 6), 4, 3000
#: Step sizes of weights and thresholds, L1 penalty, passes.
RATE, THRESHOLD_RATE, L1, PASSES = 0.3, 0.5, 1.0, 6
#: Features that the sample ties to the label less than this are not learnt.
LEAST_CHI2 = 12.0
#: A document counts as toxic from this chance of a grade above 0.
CUTOFF = 0.5


def feature_rows(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each text the distinct buckets of its words (runs of letters, lower-cased) and word beginnings."""
    point, at = code_points(data)
    low = _letter_table()[point]
    bounds = np.searchsorted(at, offsets)
    letter = np.concatenate([[False], low != 32, [False]])
    border = np.zeros(len(low) + 1, bool)
    border[bounds] = True
    starts = np.flatnonzero(letter[1:] & (~letter[:-1] | border))
    ends = np.flatnonzero(letter[:-1] & (~letter[1:] | border))
    first = np.searchsorted(starts, bounds).tolist()
    value = mix(low.astype(U) + U(7))
    lengths = ends - starts
    found, owner = [], []
    running = np.zeros(len(starts), U)
    longest = int(lengths.max()) if len(lengths) else 0
    alive = np.arange(len(starts))
    for k in range(longest):
        alive = alive[lengths[alive] > k]
        running[alive] = running[alive] * U(0x9E3779B97F4A7C15) + value[starts[alive] + k]
        if k + 1 in BEGINNINGS:
            found.append(mix(running[alive] ^ U(k + 1)))
            owner.append(alive)
    found.append(mix(running ^ U(1 << 20)))
    owner.append(np.arange(len(starts)))
    buckets = (np.concatenate(found) >> U(64 - BUCKETS.bit_length() + 1)).astype(np.int32)
    word = np.concatenate(owner)
    order = np.argsort(word, kind="stable")
    buckets, place = buckets[order], np.searchsorted(word[order], np.array(first))
    for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True):
        yield np.unique(buckets[a:b])


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, found: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k below the top grade."""
        return 1 / (1 + np.exp(np.clip(self.weights[found].sum() - self.thresholds, -700, 700)))

    def severity(self, found: np.ndarray) -> tuple[float, float]:
        """Expected grade, and the chance of any grade above 0."""
        above = 1 - self.at_most(found)
        return float(above.sum()), float(above[0])


def associated(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Marks the features whose occurrence depends on the label, by the chi-squared statistic of the sample's counts."""
    by = np.zeros((2, BUCKETS))
    for found, y in rows:
        by[y][found] += 1
    sizes = np.bincount([y for _, y in rows], minlength=2)[:, None]
    share = by.sum(0) / sizes.sum()
    expected = np.maximum(sizes * share * (1 - share), 1e-9)
    return ((by - sizes * share) ** 2 / expected).sum(0) >= LEAST_CHI2


def grades(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """0 for label 0; label 1 by equal parts of the number of features that only toxic rows have."""
    clean, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for found, y in rows:
        (toxic if y else clean)[found] += 1
    marks = (clean == 0) & (toxic >= 3)
    mass = np.array([marks[found].sum() if y else -1 for found, y in rows])
    cuts = np.quantile(mass[mass >= 0], np.arange(1, GRADES - 1) / (GRADES - 1)) if (mass >= 0).any() else np.zeros(GRADES - 2)
    return np.where(mass < 0, 0, 1 + (mass[:, None] > cuts).sum(1))


def train(rows: list[tuple[np.ndarray, int]], sizes: dict[int, int] | None = None) -> Ordinal:
    """Follow-the-regularised-leader steps with an L1 penalty on the grades' negative log likelihood.

    With u and l the cumulative chances at the grade's own threshold and the one below, the slope in
    the shared score is 1 - u - l. Thresholds are sums of gaps, which stay positive. ``sizes``: how many
    rows of each label there are where ``rows`` is a sample; the steps weigh a label's rows by how many
    each stands for, so that chances mean the same however large the table is.
    """
    sampled = np.bincount([y for _, y in rows], minlength=2)
    share = np.array([(sizes or {0: sampled[0], 1: sampled[1]})[y] / max(sampled[y], 1) for y in (0, 1)])
    stands_for = share * len(rows) / max((share * sampled).sum(), 1e-12)
    grade, kept = grades(rows), associated(rows)
    rows = [(found[kept[found]], y) for found, y in rows]
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    gaps, seen = np.ones(GRADES - 1), np.ones(GRADES - 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        w = (np.sign(z[at]) * L1 - z[at]) * RATE / (1 + np.sqrt(n[at]))
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    order = np.random.Generator(np.random.PCG64(5)).permutation(len(rows))
    for _ in range(PASSES):
        for i in order:
            found, y = rows[i][0], grade[i]
            w, thresholds = weights(found), np.cumsum(gaps)
            score = w.sum()
            upper = sigmoid(thresholds[y] - score) if y < GRADES - 1 else 1.0
            lower = sigmoid(thresholds[y - 1] - score) if y > 0 else 0.0
            each, chance = stands_for[rows[i][1]], max(upper - lower, 1e-12)
            slope = each * (1 - upper - lower)
            z[found] += slope - (np.sqrt(n[found] + slope * slope) - np.sqrt(n[found])) / RATE * w
            n[found] += slope * slope
            own = np.zeros(GRADES - 1)
            if y < GRADES - 1:
                own[y] -= each * upper * (1 - upper) / chance
            if y > 0:
                own[y - 1] += each * lower * (1 - lower) / chance
            push = np.cumsum(own[::-1])[::-1]
            seen += push * push
            gaps -= THRESHOLD_RATE * push / np.sqrt(seen)
            gaps[1:] = np.maximum(gaps[1:], 1e-2)
    return Ordinal(weights(slice(None)), np.cumsum(gaps))


def fit(docs: DataFrame, labels: DataFrame, text: str, label: str, key: str, per_class: int) -> Ordinal | None:
    """The model of a bounded sample of the labelled documents; None unless both labels occur."""
    chosen, sizes = class_sample(labels.where(F.col(label).isin(0, 1)), label, key, per_class)
    if set(sizes) != {0, 1}:
        return None

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches, "text"):
            found = pa.array(list(feature_rows(data, offsets)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), found], names=["key", "label", "found"])

    # The sample is at most four times per_class rows of two numbers, so it may be broadcast.
    small = F.broadcast(chosen.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label")))
    joined = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(small, "_key")
    # One row for each key and label, however often tables repeat a key: what the driver gets stays within the sample's bound.
    one = joined.groupBy("_key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = one.select("text", F.col("_key").cast("string").alias("key"), "label").mapInArrow(features, "key string, label int, found array<int>").toArrow().sort_by([("key", "ascending"), ("label", "ascending")])
    rows = [(np.asarray(f.values), y) for f, y in zip(got["found"], got["label"].to_pylist(), strict=True)]
    return train(rows, sizes) if {y for _, y in rows} == {0, 1} else None


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", folds: int = 5, held: int = 0, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: ``key``, ``held_out``, ``severity`` (expected grade), ``score`` (chance of a grade above 0), ``toxic``.

    Learns from rows of ``labels`` outside fold ``held`` (crc32 of the key), about ``per_class`` of each
    label (a documented bound), weighted by how many rows each stands for; results depend on the text
    alone. Null and empty texts have no features and get what the thresholds alone give. Without training
    rows of both labels severity and score are 0. Rows with equal keys each get a row; of equal keys and
    labels one text (that with the smallest hash) is learnt from, and rows with a null key are not. A key
    must be a number, or text that reads as one. Labels other than 0 and 1 and other columns are ignored.
    An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    model = fit(docs, labels.where(fold(F.col(key), folds) != held), text, label, key, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches, "text"):
            got = np.array([(0.0, 0.0) if model is None else model.severity(f) for f in feature_rows(data, offsets)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(got[:, 0]), pa.array(got[:, 1])], names=[key, "severity", "score"])

    scored = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, f"{key} long, severity double, score double")
    return scored.select(key, (fold(F.col(key), folds) == held).alias("held_out"), "severity", "score", (F.col("score") >= CUTOFF).alias("toxic"))
