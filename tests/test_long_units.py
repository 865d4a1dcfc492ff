"""Rewriting inside very long units: the same rows as plain code, in seconds."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from partweave.functions.spans import first_where
from partweave.operators import rewrite

SPANS = "array<struct<start:int,end:int,final:string>>"


def plain_runs(texts, spans):
    at, out = 0, []
    for t in texts:
        text, pos, end = "", at, at + len(t)
        for a, z, f in spans:
            if at < z and end > a:
                text += t[pos - at : max(a - at, pos - at)] + (f if a >= at else "")
                pos = min(z, end)
        out.append(text + t[pos - at :])
        at = end
    return out


def unit(rng, n_runs, n_spans):
    texts = ["".join(rng.choice("ab é\n") for _ in range(rng.randrange(9))) for _ in range(n_runs)]
    size = sum(map(len, texts))
    cuts = sorted(rng.sample(range(size + 1), min(2 * n_spans, size + 1)))
    return texts, [(a, z, rng.choice(["", "X", "é;4022"])) for a, z in zip(cuts[::2], cuts[1::2], strict=False)]


def made(spark, units):
    rows = [(i, [(k, t) for k, t in enumerate(texts)], spans) for i, (texts, spans) in enumerate(units)]
    df = spark.createDataFrame(rows, f"id int, pieces array<struct<run_idx:int,text:string>>, spans {SPANS}")
    return df.select("id", rewrite.with_offsets(F.col("pieces")).alias("runs"), "spans")


def test_runs_against_plain_code(spark):
    rng = random.Random(2)
    units = [unit(rng, rng.randrange(1, 14), rng.randrange(9)) for _ in range(150)]
    rows = made(spark, units)
    got = {r.id: [x.text for x in r.out] for r in rows.select("id", rewrite.rewrite_runs(F.col("runs"), F.col("spans")).alias("out")).collect()}
    touched = rows.select("id", F.transform("spans", lambda s: F.transform(rewrite.overlapping(F.col("runs"), s["start"], s["end"]), lambda r: r["run_idx"])).alias("t"))
    for r in touched.collect():
        texts, spans = units[r.id]
        assert got[r.id] == plain_runs(texts, spans)
        ends = [0]
        for t in texts:
            ends.append(ends[-1] + len(t))
        assert r.t == [[k for k in range(len(texts)) if ends[k] < z and ends[k + 1] > a] for a, z, _ in spans]


@pytest.mark.parametrize("shape", [(20_000, 20_000), (3, 20_000), (20_000, 3)])
def test_twenty_thousand_runs_and_spans(spark, shape):
    texts, spans = unit(random.Random(3), *shape) if shape[0] > 3 else (["ab" * 20_000, "é" * 20_000, "x" * 20_000], [(5 * k, 5 * k + 3, "Y") for k in range(shape[1])])
    rows = made(spark, [(texts, spans)]).cache()
    rows.count()
    began = time.time()
    got = rows.select(rewrite.rewrite_runs(F.col("runs"), F.col("spans")).alias("out")).first().out
    pairs = rows.select(F.size(F.flatten(F.transform("spans", lambda s: rewrite.overlapping(F.col("runs"), s["start"], s["end"])))).alias("n")).first().n
    took = time.time() - began
    assert [x.text for x in got] == plain_runs(texts, spans) and pairs > 0
    assert took < 20, took


def test_line_breaks_before_many_places(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("ab\n中") for _ in range(60_000))
    places = sorted(rng.sample(range(len(text) + 1), 20_000))
    df = spark.createDataFrame([(text, places), ("", [0]), (None, None), ("\n\n", [0, 1, 2])], "t string, p array<int>").cache()
    df.count()
    began = time.time()
    got = [r.o for r in df.select(rewrite.newline_adjusted(F.col("t"), F.col("p")).alias("o")).collect()]
    assert time.time() - began < 20
    before = [0]
    for c in text:
        before.append(before[-1] + (c == "\n"))
    assert got == [[p - before[p] for p in places], [0], None, [0, 0, 0]]


def test_results_that_stand_in_the_text_already(spark):
    """As searching the whole text for each has it, also where parts hold the separator, and for 20,000 of them."""
    texts = ["a1;R b2 c3;Rx;y", "a1;R;Q a1", ";;a1;", "no separator a1", "a1a1;Ra1;R", "é1;Ré"]
    finds = [("a1", "R"), ("b2", "R"), ("c3", "Rx;y"), ("a1", "R;Q"), ("é1", "Ré"), ("a1", None), ("3;Rx", "y")]
    units = spark.createDataFrame(list(enumerate(texts)), "unit_id int, text string")
    found = spark.createDataFrame([(i, k, k, m, r) for i in range(len(texts)) for k, (m, r) in enumerate(finds)], "unit_id int, start_pos int, end_pos int, matched_text string, replacement string")
    got = {r.unit_id: {(s.matched_text, s.replacement): s.applied for s in r.spans} for r in rewrite.with_spans(units, found, "append", ";").collect()}
    for i, t in enumerate(texts):
        assert got[i] == {(m, r): r is not None and f"{m};{r}" not in t for m, r in finds}
    n = 20_000
    long = " ".join(f"p{k:05d};q{k:05d}" if k % 2 else f"p{k:05d}" for k in range(n))
    units = spark.createDataFrame([(0, long)], "unit_id int, text string")
    found = spark.range(n).selectExpr("0 AS unit_id", "CAST(id AS INT) AS start_pos", "CAST(id AS INT) AS end_pos", "format_string('p%05d', id) AS matched_text", "format_string('q%05d', id) AS replacement")
    began = time.time()
    rows = rewrite.with_spans(units, found, "append", ";").select("spans").first().spans
    assert time.time() - began < 40 and [s.applied for s in rows] == [k % 2 == 0 for k in range(n)]


def test_first_where(spark):
    got = spark.range(12).select(first_where(F.sequence(F.lit(0), F.lit(9)), lambda x: x >= F.col("id")).alias("k"), first_where(F.array().cast("array<int>"), lambda x: x > 0).alias("none")).collect()
    assert [r.k for r in got] == [*range(11), 10] and {r.none for r in got} == {0}
