"""The stages against what their operators say, on small tables."""

from __future__ import annotations

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from partweave.llm.common import cut


def test_stages(spark, documents, sf_dir):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut(stage(spark, docs, sf_dir))
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == documents.columns
        if name == "exact_dedup":
            best = {}
            for r in before.collect():
                best[r.text] = max(best.get(r.text, -1), r.doc_id)
            assert {r.doc_id for r in docs.collect()} == set(best.values())
    mixed = collections.Counter(r.doc_id for r in seen["source_mixing"].collect())
    assert set(mixed) <= {r.doc_id for r in seen["jaccard_join"].collect()}
    assert collections.Counter(r.doc_id for r in docs.collect()) == mixed
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_odd_rows(spark, messy, empty, sf_dir):
    docs = messy
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    ids = {r.doc_id for r in docs.collect()}
    assert ids.isdisjoint({4, 5, 6, 7}) and 1 not in ids
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf_dir).count() == 0


def test_repeated_rows_stay_once(spark, messy, sf_dir):
    """A table with its rows loaded twice gives what it gives once."""
    ids = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    once, twice = (cut(corpus_pipeline.exact_dedup(spark, d, sf_dir)) for d in (messy, messy.union(messy)))
    assert ids(twice) == ids(once) and max(ids(twice).values()) == 1 and twice.columns == messy.columns
    near = [cut(corpus_pipeline.jaccard_join(spark, d, sf_dir)) for d in (once, twice)]
    assert ids(near[0]) == ids(near[1])
    assert ids(corpus_pipeline.source_mixing(spark, near[0], sf_dir)) == ids(corpus_pipeline.source_mixing(spark, near[1], sf_dir))


def test_repeated_keys_with_other_columns(spark, sf_dir):
    rows = [(1, "some text", "a"), (1, "some text", "b"), (1, "other", "a"), (None, "alone", "a"), (None, "alone", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [[tuple(r) for r in corpus_pipeline.exact_dedup(spark, d, sf_dir).collect()] for d in (df, df.orderBy(F.desc("source")).repartition(3))]
    assert {r[:2] for r in got[0]} == {r[:2] for r in rows} and len(got[0]) == 3 and sorted(got[0], key=str) == sorted(got[1], key=str)


def test_near_copies_go_by_key_and_text(spark, sf_dir):
    """Of two texts with one doc_id only the near copy goes, and two near copies with one doc_id are one."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c + " more"), (None, "short one"), (4, None), (4, "short two")]
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, rows long")
    got = corpus_pipeline.jaccard_join(spark, docs, sf_dir)
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert got.columns == docs.columns and [t for i, t in kept if i in (1, 2)].count(b) == 1
    assert (1, a) in kept and (2, a + " more") not in kept and len([t for i, t in kept if i == 3]) == 1 and len(kept) == 6


def test_language_without_anything_to_learn_from(spark, messy, sf_dir):
    """No model rejects nothing but texts without a letter."""
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, messy.withColumn("lang", F.lit(None).cast("string")), sf_dir).collect()}
    assert kept == {r.doc_id for r in messy.collect()} - {4, 5, 6, 7}


def test_mixing_does_not_multiply_repeated_rows(spark, sf_dir):
    """Every row is emitted equally often, give or take one pass, and no more rows come out than the mix emits."""
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, "d e f", "x"), (None, "g h", "y"), (None, "g h", "y"), (None, "i j", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.source_mixing(spark, docs, sf_dir)
    times = collections.Counter((r.doc_id, r.text) for r in got.collect())
    assert got.columns == docs.columns and sum(times.values()) <= len(rows) + 2
    assert times[1, "a b c"] >= 2 * times[2, "d e f"] - 2
