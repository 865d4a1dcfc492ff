"""Settings, processors, parsers and sinks: what has no table of its own."""

from __future__ import annotations

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from partweave import processors
from partweave.functions import spans
from partweave.operators import boxes, fonts, report
from partweave.processors import processor, with_fallbacks
from partweave.profiles import CANONICAL, CLASSIC, PatternSet, load_profile
from partweave.sources import docx, sinks


def test_settings_from_file_and_environment(tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"separator": " ", "min_confidence": 0.6, "tiers": ["exact", "lower"]}))
    made, warnings = load_profile(CANONICAL, str(path), {"DOC_PROCESSING_MIN_CONFIDENCE": "1.5", "DOC_PROCESSING_ALL_HEADERS": "true", "OTHER": "x"})
    assert (made.separator, made.min_confidence, made.all_headers, made.tiers) == (" ", 1.5, True, ("exact", "lower"))
    assert len(warnings) == 1 and "min_confidence" in warnings[0] and load_profile()[1] == []
    for bad in ({"DOC_PROCESSING_NOTHING": "1"}, {"DOC_PROCESSING_ALL_HEADERS": "perhaps"}, {"DOC_PROCESSING_MIN_CONFIDENCE": "high"}):
        with pytest.raises(ValueError):
            load_profile(environment=bad)


def test_patterns_that_do_not_compile(spark):
    kept, wrong = spans.compiled(spark, PatternSet.of({"good": "77-[0-9]+", "bad": "77-(", "_note": "x"}))
    assert [n for n, _ in kept.patterns] == ["good"] and kept.patterns[0][1] != "77-[0-9]+" and len(wrong) == 2


def test_processors_by_name(spark):
    assert {"text", "graphics", "image"} <= set(processors.names())
    with pytest.raises(ValueError, match="there are"):
        processor("none", CANONICAL)

    @processors.register("mine")
    def mine(profile, patterns):
        return processors.Processor("mine", lambda rows, mapping: rows)

    assert processor("mine", CLASSIC).name == "mine"
    mapping = spark.createDataFrame([(0, "77-123-abcdef-01", "4022")], "ord int, key string, value string")
    units = spark.createDataFrame([(0, "x 77-123-ABCDEF-01"), (1, "77-123-zzzzzz-01"), (2, None)], "unit_id int, text string")
    got = {(r.unit_id, r.final) for r in processor("graphics", CANONICAL).run(units, mapping).collect()}
    assert got == {(0, "77-123-ABCDEF-01;4022-NA"), (1, "77-123-zzzzzz-01;4022-NA")}
    assert [r.final for r in processor("text", CLASSIC).run(units, mapping).collect()] == ["77-123-ABCDEF-01 4022"]


def test_fallbacks_in_order():
    tries = []

    def fails(x):
        tries.append("a")
        raise ValueError("no")

    def works(x):
        return x + 1

    assert with_fallbacks(fails, (works,), attempts=3)(1) == (2, 4, "works") and len(tries) == 3
    with pytest.raises(ValueError):
        with_fallbacks(fails)(1)


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def test_archives_with_forbidden_characters_and_many_headers(spark):
    space = f'xmlns:w="{docx.W[1:-1]}" xmlns:a="{docx.A[1:-1]}"'
    text = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    shape = f'<w:p><w:r><w:pict><s><sp><a:xfrm><a:ext cx="1270000" cy="635000"/></a:xfrm></sp><w:txbxContent>{text("in")}</w:txbxContent></s></w:pict></w:r></w:p>'
    parts = {"word/document.xml": f"<w:document {space}><w:body>{text('a&#1;b')}{shape}</w:body></w:document>"} | {f"word/header{i}.xml": f"<w:hdr {space}>{text(f'h{i}')}</w:hdr>" for i in (1, 2)}
    docs = spark.createDataFrame([("x", archive(parts)), ("y", b"no archive"), ("z", archive({"word/document.xml": "<a><b></a>"}))], "path string, content binary")
    runs = docx.text_runs(docs).collect()
    assert [(r.location, r.text) for r in runs if r.path == "x" and r.text] == [("paragraph_0", "a b"), ("header1_paragraph_0", "h1"), ("header2_paragraph_0", "h2")]
    assert all(r.error for r in runs if r.path in "yz") and len([r for r in docx.text_runs(docs, CANONICAL).collect() if r.path == "x" and r.text]) == 2
    assert {r.path: r.parser for r in docx.parsers(docs).collect()} == {"x": "lenient", "y": None, "z": None}
    assert [(r.text, r.width, r.height) for r in docx.text_boxes(docs).collect() if r.path == "x"] == [("in", 100.0, 50.0)]


def test_sinks_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("in/a.docx", True, 3, [1, 2]), ("in/b.docx", False, 0, None)], "path string, success boolean, matches int, places array<int>")
    totals, results = sinks.processing_log(rows, str(tmp_path / "log"))
    assert spark.read.json(totals).select("total_processed", "successful", "failed", "total_matches").first() == (2, 1, 1, 3) and spark.read.json(results).count() == 2
    assert [r.moved_to for r in sinks.completed(rows.select("path"), rows, "out/").collect()] == ["out/a.docx"]
    assert spark.read.option("header", "true").csv(sinks.write_csv(rows, str(tmp_path / "csv"))).where("path = 'in/a.docx'").first().places == "1 2"
    page = report.html(rows.select("path"), "t", most=1)
    assert "first 1 rows" in page and "a.docx" in page and "first" not in report.html(rows.select("path"), "t")


def test_token_runs_and_fonts(spark):
    tokens = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(x).alias("x"), F.lit(0).alias("y"), F.lit(9).alias("w"), F.lit(5).alias("h")) for t, x in (("a", 0), ("77-1", 10), ("b", 20), ("c", 30))))
    find = lambda target, glue: spark.range(1).select(F.explode(F.array(boxes.token_rectangle(tokens, F.lit(target), glue))).alias("r")).first().r
    assert find("77-1", "")[:] == (10, 0, 9, 5, 20) and find("77-1 b", "") is None and find("77-1 b", " ")[:] == (10, 0, 19, 5, 30) and find("zz", "") is None
    runs = spark.createDataFrame([([("a" * 30, None, None), ("b", "Arial", 12.0), ("c", "Verdana", 12.0), ("d", "Other", 9.0), ("e", "More", 9.0), ("f", None, None)],), ([],)], "runs array<struct<text:string,family:string,size:double>>")
    got = runs.select(fonts.best_run(F.col("runs"))["text"], fonts.baseline(F.col("runs")), fonts.described(F.col("runs"))).collect()
    assert got[0][:2] == ("d", 9.0) and got[0][2].startswith("Distinct sizes: 9.0pt, 12.0pt | Seg1: aaaaaaaaaaaaaaaaaaaa... (9.0pt Unknown) | Seg2: b (12.0pt Arial)") and got[0][2].endswith(" | ... and 1 more segments")
    assert tuple(got[1]) == (None, 12.0, "12.0pt")
