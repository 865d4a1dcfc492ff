"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Weights come from follow-the-regularised-leader with elastic-net penalties on a bounded sample of the
training rows; inverse document frequencies come from all training rows. A temperature fitted on a
part of the sample that training did not see turns scores into calibrated probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partweave.llm.common import fold, prepare
from partweave.llm.fitting import class_sample
from partweave.llm.kernels import U, give_back, mix, steps
from partweave.llm.pretokens import code_points

#: Feature buckets, longest n-gram, and training rows per language.
BUCKETS, ORDERS, PER_CLASS = 1 << 15, 3, 1000
#: FTRL: learning rate, its offset, L1 and L2 penalties, passes; share of the sample kept for the temperature.
RATE, OFFSET, L1, L2, PASSES, CALIBRATE = 0.5, 1.0, 1e-3, 1e-4, 3, 0.2
#: Weights of a model at most: with more than 64 languages only the most frequent buckets have weights.
MOST_WEIGHTS = BUCKETS * 64
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else a space."""
    if not _letters:
        table = np.full(0x110000, 32, np.int32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def ngram_rows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """For each text the buckets of its n-grams, their counts, and whether it has a letter."""
    point, at = code_points(data)
    low = _letter_table()[point]
    bounds = np.searchsorted(at, offsets).tolist()
    value = mix(low.astype(U) + U(1))
    grams, rolled, shift = [], value, U(64 - BUCKETS.bit_length() + 1)
    for k in range(ORDERS):
        if k:
            rolled = rolled[:-1] * U(0x9E3779B97F4A7C15) + value[k:]
        grams.append((mix(rolled + U(k)) >> shift).astype(np.int64))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = np.concatenate([g[a : max(a, b - k)] for k, g in enumerate(grams)])
        if len(own) > BUCKETS:
            # Most buckets have n-grams of a long text: counting them all is cheaper than sorting.
            counts = np.bincount(own, minlength=BUCKETS)
            found = np.flatnonzero(counts)
            counts = counts[found]
        else:
            found, counts = np.unique(own, return_counts=True)
        yield found, counts, bool((low[a:b] != 32).any())


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0
    #: The row of each bucket's weights, -1 for a bucket without; None where all have theirs.
    rows: np.ndarray | None = None

    def placed(self, found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that have weights, as rows, and their counts."""
        if self.rows is None:
            return found, counts
        at = self.rows[found]
        return at[at >= 0], counts[at >= 0]

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[found]
        return x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        found, counts = self.placed(found, counts)
        return self.vector(found, counts) @ self.weights[found] + self.bias

    def probabilities(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = self.logits(found, counts) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], classes: list[str], idf: np.ndarray, placed: np.ndarray | None = None) -> Model:
    """FTRL with elastic net over the rows in a fixed shuffled order, then the temperature on the rows kept for it.

    ``idf`` has an entry per row of weights; ``placed`` says which row a bucket has, if not all have one.
    """
    size, k, order = len(idf), len(classes), np.random.Generator(np.random.PCG64(3)).permutation(len(rows))
    held = max(1, int(len(rows) * CALIBRATE)) if len(rows) > 4 else 0
    # A class that has no other row gives none to the temperature.
    taught, moved = {rows[i][2] for i in order[held:]}, []
    for i in order[:held].tolist():
        if rows[i][2] not in taught:
            taught.add(rows[i][2])
            moved.append(i)
    order, held = np.array([i for i in order[:held].tolist() if i not in set(moved)] + moved + order[held:].tolist(), np.int64), held - len(moved)
    model = Model(classes, np.zeros((0, k)), np.zeros(k), idf, rows=placed)
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))
    number = {c: i for i, c in enumerate(classes)}

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((OFFSET + np.sqrt(n[at])) / RATE + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    for _ in range(PASSES):
        for i in order[held:]:
            # A row's vector is made when its turn comes: those of all rows take more than the sample itself.
            f, c = model.placed(*rows[i][:2])
            at, x, y = np.append(f, f.dtype.type(size)), np.append(model.vector(f, c), 1.0)[:, None], number[rows[i][2]]
            w = weights(at)
            s = (x * w).sum(0)
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / RATE * w
            n[at] += g * g
    final = weights(np.arange(size + 1))
    model.weights, model.bias = final[:-1], final[-1]
    if held:
        scores = np.array([model.logits(*rows[i][:2]) for i in order[:held]])
        truth = np.array([number[rows[i][2]] for i in order[:held]])
        loss = {}
        for t in np.geomspace(0.05, 20, 121):
            s = scores / t
            top = s.max(1)
            loss[t] = (np.log(np.exp(s - top[:, None]).sum(1)) + top - s[np.arange(held), truth]).mean()
        model.temperature = float(min(loss, key=loss.get))
    return model


def fit(training: DataFrame, text: str, label: str, key: str, per_class: int) -> Model | None:
    """The model of ``training``; None without labelled rows. What reaches the driver has fixed bounds: bucket counts and the sample's features."""
    sample, sizes = class_sample(training, label, key, per_class)
    if not sizes:
        return None

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for _, data, offsets in steps(batches, "text"):
            df[BUCKETS] += len(offsets) - 1
            for found, _, _ in ngram_rows(data, offsets):
                df[found] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["bucket", "n"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches, "text"):
            got = list(ngram_rows(data, offsets))
            yield pa.RecordBatch.from_arrays(
                [rows.column(1), rows.column(2), rows.column(3), pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1].astype(np.int32) for g in got], pa.list_(pa.int32()))],
                names=["key", "label", "place", "found", "counts"],
            )

    counts = training.select(F.col(text).alias("text")).mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(BUCKETS + 1)
    df[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    sample = sample.select(F.col(text).alias("text"), F.col(key).cast("string").alias("key"), F.col(label).alias("label"), F.xxhash64(text).alias("place"))
    got = sample.mapInArrow(features, "key string, label string, place long, found array<int>, counts array<int>")
    # One order on every run, for rows that share a key too.
    got = got.toArrow().sort_by([(c, "ascending") for c in ("key", "label", "place")])
    take = lambda c: [np.asarray(x.values) for x in got[c]]
    rows = list(zip(take("found"), take("counts"), got["label"].to_pylist(), strict=True))
    placed = None
    if len(sizes) * BUCKETS > MOST_WEIGHTS:
        chosen = np.sort(np.argsort(-df[:BUCKETS], kind="stable")[: max(1, MOST_WEIGHTS // len(sizes))])
        placed = np.full(BUCKETS, -1)
        placed[chosen] = np.arange(len(chosen))
        idf = idf[chosen]
    model = train(rows, sorted(sizes), idf, placed)
    # The driver goes on without the sample: what it took is the system's again.
    del rows, got, counts
    give_back()
    return model


def _predicted(model: Model | None, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    langs, scores = [], []
    for found, counts, letters in ngram_rows(data, offsets):
        if not letters or model is None:
            langs.append(UNKNOWN)
            scores.append(0.0)
        else:
            p = model.probabilities(found, counts)
            langs.append(model.classes[int(p.argmax())])
            scores.append(float(p.max()))
    return pa.array(langs, pa.string()), pa.array(scores, pa.float64())


def predict(docs: DataFrame, model: Model | None, text: str, key: str) -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column(0), *_predicted(model, data, offsets)], names=[key, "lang_pred", "score"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, f"{key} long, lang_pred string, score double")


def with_language(docs: DataFrame, model: Model | None, text: str = "text", language: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """All columns of ``docs`` as they are, and the prediction of each row beside them; no shuffle."""
    schema = T.StructType([*docs.schema.fields, T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches, text):
            langs, scores = _predicted(model, data, offsets)
            yield pa.RecordBatch.from_arrays([*rows.columns, langs, scores], names=[*rows.schema.names, language, score])

    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame, label: str, key: str, folds: int, held: int) -> DataFrame:
    return docs.where((fold(F.col(key), folds) != held) & F.col(label).isNotNull())


def identify_languages(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", folds: int = 4, held: int = 2, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: ``key``, ``held_out``, ``lang_pred``, ``score`` (0 to 1).

    Only text and non-null ``label`` of rows outside fold ``held`` (crc32 of the key) are learnt from; a
    prediction depends on the text alone. Every language there is learnt. The weights are fitted on about
    ``per_class`` rows per language, or fewer with more than 64 languages (documented bounds, see
    ``class_sample``), the document frequencies on all training rows. The model has a column per language
    and at most ``MOST_WEIGHTS`` weights: with more than 64 languages they go to the most frequent buckets.
    A null text, or one without a letter, is ``und`` with score 0, and so is every text when there is
    nothing to learn from. Ties go to the language that sorts first. Rows with equal keys each get a row
    and are learnt from each; rows with a null key are not learnt from. A key must be a number, or text
    that reads as one. Other columns are ignored. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key), F.col(text), F.col(label))
    found = predict(rows, fit(training_rows(rows, label, key, folds, held), text, label, key, per_class), text, key)
    return found.select(key, (fold(F.col(key), folds) == held).alias("held_out"), "lang_pred", "score")
