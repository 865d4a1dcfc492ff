"""Line deduplication across documents by winnowing over line hashes.

The lines of a document that have a word are hashed in order. A gram is ``GRAM_LINES`` lines in a row; of
each window of ``WINDOW`` grams the one with the smallest hash, and the rightmost of several, is a
fingerprint. So of each stretch of GRAM_LINES + WINDOW - 1 lines one gram is a fingerprint, and it is the same
wherever the stretch stands: that is the guarantee. Positions of fingerprints are joined, those that only
one place has are done with, and the match of the others is extended to both sides as far as their
window goes, before and after the gram. What is then equal to an earlier place (smaller key, then position)
is a repeated stretch; stretches that overlap or touch make up runs of any length, whichever earlier
documents have them. Grams that reach ``GRAM_WORDS`` words, and lines that do, are fingerprints always.

So a line goes exactly if it is in a run of GRAM_LINES + WINDOW - 1 lines or of ``GRAM_WORDS`` words that an
earlier place has. Extended fingerprints are joined with their first occurrence alone, so the work is linear
in the occurrences, however often a run repeats. Two of them are the same if two independent 64-bit hashes
of their lines are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import cut, prepare, release, whole_text
from partweave.llm.kernels import U, mix, span_hashes, steps, words

GRAM_LINES, GRAM_WORDS, WINDOW = 2, 50, 2

#: Byte values of the two hashes.
_RAW, _RAW2 = np.random.Generator(np.random.PCG64(20240305)).integers(1, 2**63, (2, 256), dtype=np.uint64)


def line_rows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text the numbers, both hashes and the word counts of its lines that have a word."""
    breaks = np.flatnonzero(data == 10)
    # A line begins at each text and after each break; it ends at the break or the text's end.
    begin = np.concatenate([offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    last = np.append(owner[1:] != owner[:-1], True)
    end = np.where(last, offsets[owner + 1], np.append(begin[1:], 0) - 1)
    starts, _, _ = words(data, offsets)
    count = np.searchsorted(starts, end) - np.searchsorted(starts, begin)
    hashes, checks = (span_hashes(raw[data], begin, end) if len(data) else np.zeros(len(begin), U) for raw in (_RAW, _RAW2))
    first = np.searchsorted(owner, np.arange(len(offsets)))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        has = np.flatnonzero(count[a:b] > 0)
        yield has, hashes[a:b][has], checks[a:b][has], count[a:b][has]


def _grams(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the lines of each stretch."""
    size = end - begin
    out, power = np.zeros(len(begin), U), U(1)
    for k in range(int(size.max(initial=0))):
        out += np.where(k < size, hashes[np.minimum(begin + k, len(hashes) - 1)] * power, U(0))
        power = U(int(power) * 0x9E3779B97F4A7C15 % 2**64)
    return mix(out + size.astype(U))


def winnowed(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each window's fingerprint, its first line, and the window's first line; lines of document d are those from ``offsets[d]`` on."""
    lines = GRAM_LINES + WINDOW - 1
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = np.flatnonzero(np.arange(len(hashes)) + lines <= offsets[owner + 1])
    if not len(whole):
        return np.zeros(0, U), whole, whole
    begin = np.arange(len(hashes) - GRAM_LINES + 1)
    gram = _grams(hashes, begin, begin + GRAM_LINES)
    view = np.lib.stride_tricks.sliding_window_view(gram, WINDOW)[whole]
    # The rightmost of equal minima, as winnowing has it.
    chosen = whole + WINDOW - 1 - view[:, ::-1].argmin(1)
    return gram[chosen], chosen, whole


def stretches(hashes: np.ndarray, checks: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Fingerprint, its first line, both hashes, document, first line and end of each stretch: a fingerprint extended to its window, or one of many words."""
    name, chosen, whole = winnowed(hashes, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    until = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    names, places, begins, ends = [name], [chosen], [whole], [whole + GRAM_LINES + WINDOW - 1]
    for size in range(1, GRAM_LINES + 1):
        begin = np.arange(max(len(hashes) - size + 1, 0))
        begin = begin[(begin + size <= offsets[owner[begin] + 1]) & (until[begin + size] - until[begin] >= GRAM_WORDS)]
        # Another hash than that of a gram of a window.
        names.append(mix(_grams(hashes, begin, begin + size) + U(size)))
        for held, more in ((places, begin), (begins, begin), (ends, begin + size)):
            held.append(more)
    name, place, begin, end = map(np.concatenate, (names, places, begins, ends))
    doc = owner[begin]
    # Words may make a stretch of a window's lines once more: both are the same stretch.
    return name, place, _grams(hashes, begin, end), _grams(checks, begin, end), doc, begin - offsets[doc], end - offsets[doc]


def repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc``, ``fp`` and ``deleted``, the numbers of the lines that go, of each document that loses any."""
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), F.xxhash64(whole_text(text)).alias("fp"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches, "text"):
            got = list(line_rows(data, offsets))
            arrays = [pa.array([g[k].view(np.int64) if a == pa.int64() else g[k].astype(np.int32) for g in got], pa.list_(a)) for k, a in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), *arrays], names=["doc", "fp", "number", "hash", "check", "words"])

    def select(extended: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))])
                hashes, checks = (batch.column(k).flatten().to_numpy().view(U) for k in (2, 3))
                name, place, gram, check, owner, begin, end = stretches(hashes, checks, batch.column(4).flatten().to_numpy(), offsets)
                if not extended:
                    # A gram that two windows choose is one fingerprint.
                    once = np.unique(np.stack([name, place.astype(U)], 1), axis=0)[:, 0]
                    yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64))], names=["name"])
                    continue
                take = pa.array(owner)
                numbers = (pa.array(x.view(np.int64)) for x in (name, gram, check))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *numbers, pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], names=["doc", "fp", "name", "gram", "check", "place", "stop"])

        return run

    rows = cut(texts.mapInArrow(lines, "doc long, fp long, number array<int>, hash array<long>, check array<long>, words array<int>").dropDuplicates(["doc", "fp"]))
    source, same = rows.select("doc", "fp", "hash", "check", "words"), ["gram", "check"]
    shared = cut(source.mapInArrow(select(False), "name long").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"))
    marks = cut(source.mapInArrow(select(True), "doc long, fp long, name long, gram long, check long, place int, stop int").join(shared, "name").drop("name"))
    place = F.struct("doc", "fp", "place")
    first = cut(marks.groupBy(*same).agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    later = marks.join(first, same).where(~place.eqNullSafe(F.col("f")))
    runs = later.select("doc", "fp", F.col("place").alias("a"), F.col("stop").alias("b"))
    # The places of one document come together here: at most its lines.
    places = runs.groupBy("doc", "fp").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("a", F.col("b") - 1)))).alias("places"))
    own = rows.select(F.col("doc").alias("_doc"), F.col("fp").alias("_fp"), "number")
    places = cut(places)
    release(shared, marks, first)
    named = places.join(own, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("fp") == F.col("_fp")))
    gone = cut(named.select("doc", "fp", F.sort_array(F.transform("places", lambda p: F.get("number", p))).alias("deleted")))
    release(places, rows)
    return gone


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, ``n_lines``, ``n_deleted``, ``deleted`` (line numbers from 0), ``text`` without them.

    Lines end at LF. Lines without a word are never matched or deleted and do not part a run. A null
    text is empty: one line, none deleted. Rows that repeat both key and text are one document,
    with a row of the result for each; rows with one key and different texts are different documents,
    in the order of a hash of the text. A
    null key comes first; a key must be a number, or text that reads as one. Repeats inside one document
    count too. Other columns are ignored. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    gone = repeated_lines(docs, text, key)
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(whole_text(text)).alias("fp"), whole_text(text).alias("t"))
    # Sorted on both sides at every size: a plan that changes with the size of ``gone`` would surprise on large inputs.
    joined = texts.alias("t").join(gone.hint("merge").alias("g"), F.col("t.doc").eqNullSafe(F.col("g.doc")) & (F.col("t.fp") == F.col("g.fp")), "left")
    deleted = F.coalesce(F.col("g.deleted"), F.array().cast("array<int>"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, texts = [], []
            for t, gone in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                lines = t.split("\n")
                counts.append(len(lines))
                if len(gone.values):
                    drop = set(gone.as_py())
                    t = "\n".join(line for i, line in enumerate(lines) if i not in drop)
                texts.append(t)
            lost = pa.array([len(g.values) for g in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), lost, batch.column(2), pa.array(texts, pa.string())], names=[key, "n_lines", "n_deleted", "deleted", "text"])

    out = joined.select(F.col("t.doc"), F.col("t.t"), deleted.alias("deleted"))
    return out.mapInArrow(remove, f"{key} long, n_lines long, n_deleted long, deleted array<int>, text string")
