"""What must not grow with the input: Arrow batches, the share of one task, how often a table is read."""

from __future__ import annotations

import io
import tracemalloc
import zipfile
from xml.etree import ElementTree as ET

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from partweave.operators import report
from partweave.plans import catalog
from partweave.session import BATCH_BYTES, spread
from partweave.sources import docx, sized


def test_archives_go_on_by_bytes(spark):
    """F1, F4 to F12: no batch of archives is much larger than the bound, however many rows a task has."""
    texts = spark.range(0, 600, 1, 1).select(F.col("id").cast("string").alias("path"), F.repeat(F.lit("word "), 1000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"n": batch.num_rows, "size": batch.nbytes}])

    made = docx.packed(texts)
    found = made.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 600 and sum(r.size for r in found) > 4 * BATCH_BYTES
    assert max(r.size for r in found) < 2 * BATCH_BYTES


@pytest.mark.parametrize(("name", "step"), [("docx_parsers", "parsers"), ("docx_shapes", "text_boxes")])
def test_what_queries_parse_is_bounded(spark, tmp_path, monkeypatch, name, step):
    """however many rows a task has, the query's archives reach their parser in bounded batches, all of them."""
    n, seen, whole = 4000, [], getattr(docx, step)
    spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 200).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(docx, step, lambda docs: (seen.append(docs), whole(docs))[1])
    catalog.QUERIES[name](spark, str(tmp_path))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"n": batch.num_rows, "size": batch.nbytes}])

    found = seen[0].mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == n and sum(r.size for r in found) > 8 * BATCH_BYTES
    assert max(r.size for r in found) < 2 * BATCH_BYTES


def test_a_long_text_is_packed_in_little_memory():
    """F5 to F11: making an archive takes a few times its size, not an element for each word; it holds the same runs."""
    text = "\n".join(" ".join(f"word{i * j % 977}" for i in range(20)) for j in range(1000))
    tracemalloc.start()
    try:
        made = docx.archive_of(text)
        assert tracemalloc.get_traced_memory()[1] < 5 * len(made)
    finally:
        tracemalloc.stop()
    for odd in (text, "", " ", "a  b \n\n <c> &amp; \"d\" \n", "é\n😀 x\t]]>"):
        for rich in (False, True):
            with zipfile.ZipFile(io.BytesIO(docx.archive_of(odd, rich))) as archive:
                runs = [(r["location"], r["run_idx"], r["text"]) for r in docx._read_runs(archive) if r["location"].startswith("paragraph")]
            words = [[x if k == 0 else f" {x}" for k, x in enumerate(line.split(" "))] if not rich else [line] for line in odd.split("\n")]
            # A rich one ends with the paragraph that anchors the text box.
            assert runs == [(f"paragraph_{i}", k, x) for i, line in enumerate(words) for k, x in enumerate(line)] + [(f"paragraph_{len(words)}", 0, "")] * rich


def test_one_row_group_is_dealt(spark, tmp_path):
    """a file with as many splits as cores but all rows in one row group is no work for one task."""
    cores = spark.sparkContext.defaultParallelism
    pq.write_table(pa.table({"path": [f"{i:08d}" for i in range(40000)], "text": [f"{i * 7919:0200d}" for i in range(40000)]}), tmp_path / "t.parquet", compression="none", use_dictionary=False)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str((tmp_path / "t.parquet").stat().st_size // (2 * cores)))
    try:
        scan = spark.read.parquet(str(tmp_path / "t.parquet"))
        assert scan.rdd.getNumPartitions() >= cores
        shares = [r["count"] for r in spread(scan, "path").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sum(shares) == 40000 and max(shares) < 3 * 40000 / cores
    # Well dealt rows are left where they are.
    even = spark.read.parquet(str(tmp_path / "t.parquet")).repartition(2 * cores)
    assert spread(even).rdd.getNumPartitions() == 2 * cores and spread(even) is even


def test_errors_are_read_once(spark):
    """making and parsing archives for the error report is not repeated for each column of it."""
    rows = [("b", 1, "x", "high", True), ("b", 2, "y", "low", False), ("b", 3, "y", "high", False), ("b", 4, "x", "low", False), ("c", 5, None, "low", True)]
    errors = spark.createDataFrame(rows, "batch string, ord int, category string, severity string, fallback_used boolean")
    found = report.error_summary(errors, ["batch"])
    assert sorted(map(tuple, found.collect())) == [("b", 4, 25.0, "x", "high"), ("c", 1, 100.0, None, "low")]
    plan = catalog.QUERIES["fallback_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


def test_boxes_are_not_broadcast(spark):
    """boxes that a small file becomes do not go through the driver."""
    plan = catalog.QUERIES["band_shrink"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_units_are_dealt_by_number(spark):
    """partitions of units follow their number, and the joins by unit keep them."""
    from partweave.session import TASK_ROWS, dealt

    assert dealt(spark.range(10), 10, "id").rdd.getNumPartitions() == 4
    many = dealt(spark.range(10), 7 * TASK_ROWS + 1, "id")
    assert many.rdd.getNumPartitions() == 8 and many.join(spark.range(10).hint("merge"), "id").rdd.getNumPartitions() == 8


def test_matches_of_reports_are_found_once(spark, monkeypatch):
    """reports of one run are written from one table of matches, so texts are not searched again for each."""
    read, write = [], catalog.sinks.write_report
    monkeypatch.setattr(catalog.sinks, "write_report", lambda rows, folder: (read.append(rows.inputFiles()), write(rows, folder))[1])
    catalog.QUERIES["reports_by_document"](spark, "/root/testdata/sf0.001")
    assert len(read) == 2 and all(files and not any("orders" in f for f in files) for files in read)


def test_runs_by_size_are_made_once_and_not_sorted(spark):
    """each archive is made once and parsed once, and its runs are counted in a hash table, not sorted for an aggregate of texts."""
    plan = catalog.QUERIES["docx_by_size"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("MapInArrow") == 2
    steps = [line.strip(" +-:*()0123456789").split("(")[0].split(" ")[0] for line in plan.sparkPlan().toString().splitlines()]
    above = [step for step in steps[: steps.index("MapInArrow")] if "Aggregate" in step]
    assert above[-2:] == ["HashAggregate", "HashAggregate"]


def test_computed_files_give_the_same_runs_in_one_pass(spark):
    """files that are not listed are taken in one pass, each by the same parser and with the same rows."""
    rows = [(str(k), size << 20, bytearray(docx.archive_of(text))) for k, (size, text) in enumerate((s, t) for s in (1, 150, 300, 600) for t in ("", "a b\nc", "one \x01\n two", "w " * 12_000))]
    files = spark.createDataFrame(rows, "path string, length long, content binary")
    found = [sorted(map(repr, sized.body_runs(files, listed=listed).collect())) for listed in (True, False)]
    assert found[0] == found[1] and len(found[0]) == 3 * (1 + 3 + 4 + 12_001) + 4
    # Paths of files are opened there, and their bytes are in no column.
    gone = files.where("path = '4'").withColumn("path", F.lit("file:/nowhere/gone.docx"))
    assert "FileNotFoundError" in sized.body_runs(gone, listed=False).first().error


def test_what_was_complete_is_given_before_a_failure():
    """wherever a part is cut, the runs of the blocks that had ended are given first, as by a parser that stops at each end."""
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = f"<w:tr><w:tc>{p('c')}</w:tc><w:tc>{p('d')}</w:tc></w:tr>"
    part = f'<w:document xmlns:w="{docx.W[1:-1]}"><w:body>{p("a")}<w:tbl><w:tblPr/>{row}{row}</w:tbl>{p("b")}<w:sectPr/></w:body></w:document>'
    for cut in range(len(part) + 1):
        for rest in ("", "</w:q>", "<w:p/>"):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("word/document.xml", part[:cut] + rest)
            got = []
            try:
                with zipfile.ZipFile(out) as archive:
                    for r in sized.pulled_runs(archive):
                        got.append(r["text"])
            except ET.ParseError:
                pass
            ended = part[: cut + len(rest)] if part[:cut] + rest == part[: cut + len(rest)] else part[:cut]
            top = ended.split("<w:tbl>")
            want = ["a"] * top[0].count("</w:p>")
            if len(top) > 1:
                want += ["c", "d"] * top[1].count("</w:tr>") + ["b"] * top[1].partition("</w:tbl>")[2].count("</w:p>")
            assert got == want, (cut, rest)
