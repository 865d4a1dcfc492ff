from __future__ import annotations

import datetime
import json
import os
import shutil
import tracemalloc
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from partweave import processors
from partweave.sources import docx, sized
from partweave.streaming import incremental, intake


def test_intake_survives_restarts(spark, tmp_path):
    """Nothing is processed or moved twice: on a restart, after a lost commit, or without the checkpoint."""
    top, seen = tmp_path, []
    (top / "in").mkdir()
    add = lambda *names: [(top / "in" / n).write_bytes(n.encode()) for n in names]

    def process(rows):
        found = [r.path for r in rows.select("path").collect()]
        seen.extend(Path(p).name for p in found)
        return rows.select("path", (~F.col("path").contains("bad")).alias("success")).where("path NOT LIKE '%silent%'")

    def run():
        files = intake.arriving(spark, str(top / "in"), str(top / "done"), "*.docx", 2)
        intake.take_in(files, process, str(top / "log"), str(top / "state")).awaitTermination()

    add("a.docx", "bad.docx", "silent.docx", "note.txt")
    run()
    add("b.docx", "c.docx")
    run()
    moved = {p.name for p in (top / "done").rglob("*.docx")}
    left = {p.name for p in (top / "in").glob("*.docx")}
    assert {"a.docx", "bad.docx"} <= moved and not moved & left and moved | left == {"a.docx", "bad.docx", "silent.docx", "b.docx", "c.docx"}
    # The last batch ran but its commit was lost.
    last = max(int(p.name) for p in (top / "state" / "commits").iterdir() if p.name.isdigit())
    for p in (top / "state" / "commits").glob(f"*{last}*"):
        p.unlink()
    run()
    log = {Path(r.path).name: r.success for r in intake.logged(spark, str(top / "log")).collect()}
    assert log == {"a.docx": True, "bad.docx": False, "silent.docx": False, "b.docx": True, "c.docx": True}
    assert intake.logged(spark, str(top / "log")).count() == 5
    before = [n for n in seen if n in ("a.docx", "bad.docx")]
    shutil.rmtree(top / "state")
    run()
    assert [n for n in seen if n in ("a.docx", "bad.docx")] == before and intake.logged(spark, str(top / "log")).where("path LIKE '%a.docx'").count() == 1
    assert (top / "in" / "note.txt").exists()


def test_a_lost_checkpoint_keeps_the_log(spark, tmp_path):
    """A new stream counts its batches from 0 again; the log of the old batch 0 stays, and its files are not processed twice."""
    (tmp_path / "in").mkdir()
    seen = []

    def process(rows):
        seen.extend(Path(r.path).name for r in rows.select("path").collect())
        return rows.select("path", F.lit(True).alias("success"))

    for name, kept in (("a", True), ("b", False), ("c", False)):
        (tmp_path / "in" / f"{name}.docx").write_bytes(b"x")
        if not kept:
            shutil.rmtree(tmp_path / "state")
        files = intake.arriving(spark, str(tmp_path / "in"), str(tmp_path / "done"), "*.docx")
        intake.take_in(files, process, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    assert sorted(seen) == ["a.docx", "b.docx", "c.docx"]
    assert sorted((Path(r.path).name, r.success, r.batch) for r in intake.logged(spark, str(tmp_path / "log")).collect()) == [("a.docx", True, 0), ("b.docx", True, 0), ("c.docx", True, 0)]


def test_fresh_drops_repeats_across_batches(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    schema = "id int, at timestamp"
    (tmp_path / "in").mkdir()
    names = spark.createDataFrame([(1, "one")], "id int, name string")
    for k, rows in enumerate([[(1, at(0)), (1, at(1)), (2, at(2))], [(1, at(5)), (3, at(6)), (3, at(6))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = incremental.with_names(incremental.fresh(stream, "id", "at"), names, "id").select("id", "name")
        incremental.write_reports(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select("id").toPandas().id) == [1, 2, 3]
    assert {r.id: r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "one", 2: None, 3: None}


def archive(path, body, rows=0):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("word/document.xml", "w", force_zip64=True) as f:
        f.write(f'<w:document xmlns:w="{docx.W[1:-1]}"><w:body>'.encode())
        f.write(body)
        for k in range(rows):
            f.write(b"<w:p><w:r><w:t>%d %s</w:t></w:r></w:p>" % (k, b"x" * 2000))
        f.write(b"</w:body></w:document>")


TABLE = b"<w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p><w:r><w:t>d</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"


def test_parsers_agree_and_hand_on(spark, tmp_path):
    text = lambda t: b"<w:p><w:r><w:t>%s</w:t></w:r></w:p>" % t
    archive(tmp_path / "good.docx", text(b"a") + TABLE + text(b"b") + TABLE)
    archive(tmp_path / "forbidden.docx", text(b"a") + text(b"one\x01two &#x1;") + text(b"z"))
    archive(tmp_path / "open.docx", text(b"a") + b"<w:p>")
    (tmp_path / "none.docx").write_bytes(b"PK")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.docx")).select("path", "length", "content")
    got = {}
    for limits in ((100, 200), (0, 200), (0, 0)):
        rows = sized.body_runs(files, *limits).collect()
        for name in ("good", "forbidden", "open", "none"):
            own = [r for r in rows if r.path.endswith(f"{name}.docx")]
            got[limits, name] = own[-1].parser, own[-1].tries, sorted((r.location, r.run_idx, r.text, r.row_idx, r.merged) for r in own if r.text is not None), own[-1].error
    assert {k: (p, t) for (k, n), (p, t, _, _) in got.items() if n == "good"} == {(100, 200): ("standard", 1), (0, 200): ("enhanced", 1), (0, 0): ("custom", 1)}
    assert len({str(x[2]) for (_, n), x in got.items() if n == "good"}) == 1 and len(got[(0, 0), "good"][2]) == 6
    assert all(x[0] == "custom" and [r[2] for r in x[2]] == ["a", "one two  ", "z"] for (_, n), x in got.items() if n == "forbidden")
    assert got[(100, 200), "open"][1] == 3 and got[(100, 200), "open"][3].startswith("ParseError") and "BadZipFile" in got[(0, 0), "none"][3]
    (large,) = sized.body_runs(files.where("path LIKE '%good%'"), most=0).collect()
    assert (large.size_class, large.parser, large.error, large.tries) == ("unsupported_size", None, "unsupported size", 0)


def test_a_document_larger_than_a_steps_memory(spark, tmp_path):
    """120 MB of XML are pulled in a few MB, opened by path, with no bytes in a column."""
    path = tmp_path / "big one.docx"
    archive(path, TABLE, 60_000)
    assert zipfile.ZipFile(path).getinfo("word/document.xml").file_size > 120_000_000
    tracemalloc.start()
    with zipfile.ZipFile(path) as z:
        n = sum(1 for _ in sized.pulled_runs(z, clean=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_002 and peak < 8 << 20, peak
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.docx")).select("path", "length", "content")
    runs = sized.body_runs(files, 0, 200)
    assert runs.groupBy("size_class", "parser").count().collect() == [("enhanced", "enhanced", 60_002)]
    missing = files.withColumn("path", F.lit(f"file:{tmp_path}/gone.docx"))
    assert "FileNotFoundError" in sized.body_runs(missing, 0, 200).first().error


def test_references_across_reads():
    raw = b"<a>" + b"x" * 9 + b"&#x0001;y&amp;&#12;\x02</a>"
    for size in range(1, 40):
        class Base:
            def __init__(self):
                self.at = 0

            def read(self, n):
                self.at += size
                return raw[self.at - size : self.at]

        clean, out = sized._Clean(Base()), b""
        while chunk := clean.read(size):
            out += chunk
        assert out == docx._FORBIDDEN.sub(b" ", raw), size


def test_routing_by_priority(spark):
    files = spark.createDataFrame([("a", ".DOCX"), ("b", ".pdf"), ("c", ".PNG"), ("d", ".exe"), ("e", None)], "f string, ext string")
    assert {r.f: r.p for r in files.select("f", processors.by_extension(F.col("ext")).alias("p")).collect()} == {"a": "text", "b": "graphics", "c": "image", "d": None, "e": None}

    @processors.register("urgent", (".PDF",), 0)
    def urgent(profile, patterns):
        return processors.Processor("urgent", lambda rows, mapping: rows)

    try:
        got = processors.routed(files, {"urgent": lambda r: r.select("f"), "graphics": lambda r: r.select("f"), "image": lambda r: r.select("f")})
        assert {r.f: r.processor for r in got.collect()} == {"b": "urgent", "c": "image"}
    finally:
        processors.unregister("urgent")


def test_guarded_chains():
    calls = []

    def action(x):
        calls.append(x)
        if x < 3 or len(calls) % 2:
            raise ValueError(f"no {x}")
        return x

    def half(x):
        if x == 0:
            raise KeyError(x)
        return x / 2

    run = processors.guarded("ocr_page", action, {"ocr": (half, lambda x: "skipped"), "processing": ()}, 2)
    first = run(4)
    assert (first.value, first.tries, first.strategy, first.fallback_used, first.error) == (4, 2, "primary", False, "no 4")
    assert run(2) == processors.Outcome(1.0, 3, "half", True, "ValueError", "no 2") and run(0).value == "skipped" and run(0).tries == 4
    none = processors.guarded("count", action, {"ocr": (half,)}, 1)(1)
    assert none == processors.Outcome(None, 1, "none", False, "ValueError", "no 1")
    assert [processors.operation_category(x) for x in ("Convert_x", "load_doc", "parse_archive", "image_scan", "other")] == ["conversion", "conversion", "loading", "ocr", "processing"]
