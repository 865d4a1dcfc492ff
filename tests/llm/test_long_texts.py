"""One text of two megabytes beside short ones, through the operators that read whole texts in Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from partweave.llm.importance_resampling import importance_resample
from partweave.llm.language_id import identify_languages
from partweave.llm.line_dedup import dedup_lines
from partweave.llm.quality_classifier import quality_scores
from partweave.llm.source_divergence import divergence
from partweave.llm.suffix_dedup import remove_repeats
from partweave.llm.toxicity import toxicity

LINES = [" ".join(f"w{k}j{j}" for j in range(8)) for k in range(40_000)]


@pytest.fixture(scope="module")
def docs(spark):
    long = "\n".join(LINES)
    rows = [(0, long), (1, long[:600_000] + " end"), (2, "é" * 700_000)] + [(10 + k, " ".join(f"s{(k * j) % 37}" for j in range(30))) for k in range(60)]
    return spark.createDataFrame([(i, t, "en" if i % 2 else "de", f"s{i % 3}") for i, t in rows], "doc_id long, text string, lang string, source string").cache()


@pytest.fixture(scope="module")
def marks(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))


def test_scores(docs, marks):
    for got, column in ((quality_scores(docs, marks), "score"), (toxicity(docs, marks), "score"), (identify_languages(docs), "score")):
        rows = {r.doc_id: r[column] for r in got.collect()}
        assert len(rows) == 63 and all(0 <= v <= 1 for v in rows.values())


def test_lines(docs):
    got = {r.doc_id: r for r in dedup_lines(docs.where("doc_id < 10")).collect()}
    lines = docs.where("doc_id = 1").first().text.split("\n")
    # The last line is cut and ends in other words.
    assert got[0].n_deleted == 0 and got[0].n_lines == 40_000 and got[2].n_deleted == 0
    assert got[1].n_deleted == len(lines) - 1 and got[1].text == lines[-1]


def test_repeats(docs):
    got = {r.doc_id: r for r in remove_repeats(docs.where("doc_id < 10")).collect()}
    first, second, same = (docs.where(f"doc_id = {i}").first().text.encode() for i in (0, 1, 2))
    assert got[0].n_bytes == len(first) and got[0].spans == [] and bytes(got[1].kept) == b" end"
    # A run of one character: all but the first string's first byte is covered by a string that starts earlier too.
    assert got[2].n_bytes == len(same) and 0 < len(got[2].kept) <= 2
    both = {r.doc_id: bytes(r.kept) for r in remove_repeats(docs.where("doc_id < 10"), keep_first=False).collect()}
    assert both[2] == b"" and both[1] == b" end" and both[0] == first[len(second) - 4 :]


def test_counts(docs):
    assert divergence(docs, least_docs=2).where("part = 'pair'").count() == 12
    got = {r.doc_id: r for r in importance_resample(docs, docs.where("doc_id > 9")).collect()}
    assert got[0].n_features == 320_000 and got[2].n_features == 1 and len(got) == 63
