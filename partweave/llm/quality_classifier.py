"""Quality classifier: regularised quadratic discriminant analysis of transformed document statistics.

Each whole text becomes a short vector of statistics. Class means and covariances are sums over all
labelled training rows, made on the executors. A class covariance is shrunk towards the pooled one and
that towards its diagonal; its Cholesky factor is computed once and kept with the model. The score is
the logistic function of the difference of the classes' log densities, from Mahalanobis distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import cut, fold, prepare
from partweave.llm.kernels import shingle_sets, span_hashes, steps, word_hashes, words

#: Shrinkage of a class covariance to the pooled one, of the result to its diagonal, and the least variance.
TO_POOLED, TO_DIAGONAL, LEAST_VARIANCE = 0.1, 0.05, 1e-3
#: Score from which the prediction is 1.
CUTOFF = 0.3
#: A log-density difference is divided by this before the logistic function: the statistics are not quite normal.
SOFTEN = 4.0

_LOWER, _UPPER, _DIGIT, _STOP, _MARK, _PUNCT, _SYMBOL, _LEAD, _OTHER = range(9)
_KIND = np.full(256, _OTHER, np.int64)
_KIND[[*range(97, 123)]], _KIND[[*range(65, 91)]], _KIND[[*range(48, 58)]] = _LOWER, _UPPER, _DIGIT
for _kind, _chars in ((_STOP, b".,"), (_MARK, b"!?"), (_PUNCT, b"'\"();:-"), (_SYMBOL, b"#*$%&|<>@^~_=+\\/[]{}`")):
    _KIND[list(_chars)] = _kind
_KIND[192:] = _LEAD
NAMES = (
    "words", "word_length", "word_spread", "symbols", "marks", "upper", "digits", "stops", "punctuation",
    "adjacent_repeats", "repeated_shingles", "repeated_words", "repeated_lines", "beyond_ascii", "capital_words",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text, all finite, for empty texts too."""
    docs, sizes = len(offsets) - 1, np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(docs) * 9, sizes) + _KIND[data], minlength=docs * 9).reshape(docs, 9)
    starts, ends, first = words(data, offsets)
    counts, owner = np.diff(first), np.repeat(np.arange(docs), np.diff(first))
    lengths = (ends - starts).astype(float)
    total = lambda x: np.bincount(owner, x, docs)
    n = np.maximum(counts, 1)
    mean = total(lengths) / n
    spread = np.sqrt(np.maximum(total(lengths**2) / n - mean**2, 0))
    hashes = word_hashes(data, starts, ends)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    capital = total((data[starts] >= 65) & (data[starts] <= 90)) if len(starts) else np.zeros(docs)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
    shingles = np.array([len(s) for s in shingle_sets(data, offsets)])
    repeated = np.maximum(counts - 4, np.minimum(counts, 1)) - shingles
    lines, line_repeats = _lines(data, offsets)
    rate = lambda a, b: np.log((a + 0.5) / (b + 1.0))
    columns = [
        np.log1p(counts), np.log1p(mean), np.log1p(spread), rate(kinds[:, _SYMBOL], sizes), rate(kinds[:, _MARK], sizes),
        rate(kinds[:, _UPPER], kinds[:, _UPPER] + kinds[:, _LOWER]), rate(kinds[:, _DIGIT], sizes), rate(kinds[:, _STOP], counts), rate(kinds[:, _PUNCT], counts),
        rate(total(again), counts), rate(repeated, counts), np.log1p(distinct) - np.log1p(counts), rate(line_repeats, lines), rate(kinds[:, _LEAD], sizes), rate(capital, counts),
    ]
    return np.stack(columns, axis=1)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-empty lines of each text, and those of them that equal an earlier one."""
    docs = len(offsets) - 1
    edge = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10), np.flatnonzero(data == 10) + 1]))
    edge = edge[edge <= len(data)]
    a, b = edge[:-1], edge[1:]
    full = data[a] != 10 if len(a) else np.zeros(0, bool)
    a, b = a[full], b[full]
    owner = np.searchsorted(offsets, a, "right") - 1
    hashes = span_hashes(np.arange(1, 257, dtype=np.uint64)[data], a, b)
    order = np.lexsort((hashes, owner))
    same = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return np.bincount(owner, minlength=docs), np.bincount(owner[order][1:][same], minlength=docs)


def _substituted(factor: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The solutions y of factor y = column for a lower triangular factor, by forward substitution over all columns at once."""
    out = np.empty_like(columns)
    for i in range(len(factor)):
        out[i] = (columns[i] - factor[i, :i] @ out[:i]) / factor[i, i]
    return out


@dataclass
class Discriminant:
    """Per class: mean, Cholesky factor of the covariance, half its log determinant, log prior."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, factor, log_det, prior in zip(self.means, self.factors, self.log_dets, self.log_priors, strict=True):
            away = _substituted(factor, (x - mean).T)
            logs.append(prior - log_det - 0.5 * (away * away).sum(0))
        return 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) / SOFTEN, -700, 700)))


def discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant | None:
    """From (count, sums, sums of products) by class 0 and 1; None unless both classes have rows."""
    if any(c not in moments or moments[c][0] < 2 for c in (0, 1)):
        return None
    total = sum(moments[c][0] for c in (0, 1))
    means = [moments[c][1] / moments[c][0] for c in (0, 1)]
    own = [moments[c][2] / moments[c][0] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = sum(moments[c][0] / total * own[c] for c in (0, 1))
    factors, dets = [], []
    for c in (0, 1):
        s = (1 - TO_POOLED) * own[c] + TO_POOLED * pooled
        s = (1 - TO_DIAGONAL) * s + TO_DIAGONAL * np.diag(np.diag(s)) + LEAST_VARIANCE * np.eye(len(s))
        factor = np.linalg.cholesky(s)
        factors.append(factor)
        dets.append(np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(dets), np.log([moments[c][0] / total for c in (0, 1)]))


def fit(features: DataFrame, labels: DataFrame, key: str) -> Discriminant | None:
    """The model of the rows of ``features`` that ``labels`` (``key``, ``label``) names; the driver gets sums only."""
    size = len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((2, 1 + size + size * size))
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.asarray(batch.column(0).flatten()).reshape(-1, size)
            for c in (0, 1):
                mine = x[y == c]
                got[c] += np.concatenate([[len(mine)], mine.sum(0), (mine.T @ mine).ravel()])
        at = np.arange(got[0].size)
        for c in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c)), pa.array(at), pa.array(got[c])], names=["c", "at", "v"])

    joined = features.join(labels.where("label IN (0, 1)"), key).select("x", F.col("label").cast("int").alias("label"))
    moments = {c: np.zeros(1 + size + size * size) for c in (0, 1)}
    for r in joined.mapInArrow(sums, "c long, at long, v double").groupBy("c", "at").agg(F.sum("v").alias("v")).collect():
        moments[r["c"]][r["at"]] = r["v"]
    return discriminant({c: (m[0], m[1 : 1 + size], m[1 + size :].reshape(size, size)) for c, m in moments.items()})


def document_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``x``, the transformed statistics of the whole text; null is read as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches, "text"):
            x = statistics(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists], names=[key, "x"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, f"{key} long, x array<double>")


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", folds: int = 5, held: int = 0) -> DataFrame:
    """One row per document: ``key``, ``held_out``, ``score`` (0 to 1), ``predicted`` (score >= 0.3).

    Learns from the rows of ``labels`` outside fold ``held`` (crc32 of the key); scores depend on the
    text alone. Null and empty texts get the score of their statistics like any other. Where a class
    has fewer than two training rows every score is 0.5. Rows with equal keys each get a row, and a label
    counts once for each row that has its key and each time it is given; a null key has no label. A key
    must be a number, or text that reads as one. Labels other than 0 and 1 and labels of absent keys are
    ignored, and so are other columns. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    features = cut(document_statistics(docs, text, key))
    training = labels.select(F.col(key), F.col(label).alias("label")).where(fold(F.col(key), folds) != held)
    model = fit(features, training, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), 0.5) if model is None else model.scores(x))], names=[key, "score"])

    scored = features.mapInArrow(run, f"{key} long, score double")
    return scored.select(key, (fold(F.col(key), folds) == held).alias("held_out"), "score", F.when(F.col("score") >= CUTOFF, 1).otherwise(0).alias("predicted"))
