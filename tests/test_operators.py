"""Operators on hand-made rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from partweave.functions import spans
from partweave.operators import boxes, capacity, dedupe, report, rewrite
from partweave.operators.detect import detections, mapped_detections
from partweave.operators.lookup import lookup, with_default
from partweave.operators.wrapping import broken, optimal_size, wrap
from partweave.profiles import CLASSIC, PART_PATTERNS, PROFILES, PatternSet, load_json
from partweave.sources import docx, files
from partweave.streaming import incremental

#: Texts and the part numbers expected in them.
CASES = [
    (":77-531-116BLK-245", ["77-531-116BLK-245"]), ("(77-525-551WH1-000)", ["77-525-551WH1-000"]), ("[77-234-120616-000]", ["77-234-120616-000"]), ("{77-245-000406-000}", ["77-245-000406-000"]),
    ("@77-110-810096-000", ["77-110-810096-000"]), ("#77-130-120541-001", ["77-130-120541-001"]), ("%77-151-0301701-00", ["77-151-0301701-00"]), ("&77-160-810105-000", ["77-160-810105-000"]),
    (" 77-232-0403040-00 ", ["77-232-0403040-00"]), ("Part 77-234-120616-000 needed", ["77-234-120616-000"]), ("177-234-120616-000", []), ("77-234-120616-0001", ["77-234-120616-000"]),
    ("中77-531-116BLK-245", ["77-531-116BLK-245"]), ("ñ77-525-551WH1-000", ["77-525-551WH1-000"]), ("ü77-234-120616-000", ["77-234-120616-000"]), ("α77-245-000406-000", ["77-245-000406-000"]),
    ("Use :77-531-116BLK-245 and (77-525-551WH1-000)", ["77-531-116BLK-245", "77-525-551WH1-000"]), ("77-110-810096-000", ["77-110-810096-000"]), ("Part: 77-130-120541-001", ["77-130-120541-001"]),
    ("Heat Shrink Heat:77-531-116BLK-245", ["77-531-116BLK-245"]), ("22 AWG(77-525-551WH1-000)", ["77-525-551WH1-000"]),
]


def mapping_of(spark, pairs):
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(pairs)], "ord int, key string, value string")


def test_pattern_corpus(spark):
    keys = sorted({k for _, ks in CASES for k in ks})
    units = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "unit_id int, text string")
    got = mapped_detections(units, mapping_of(spark, [(k, "4022") for k in keys])).orderBy("unit_id", "start_pos").collect()
    assert [[r.matched_text for r in got if r.unit_id == i] for i in range(len(CASES))] == [k for _, k in CASES]
    for r in got:
        assert CASES[r.unit_id][0][r.start_pos : r.end_pos] == r.matched_text


def test_positions_count_code_points_and_guard_counts_digits(spark):
    units = spark.createDataFrame([(0, "😀 77-123-abcdef-01"), (1, "1177-123-abcdef-01"), (2, None), (3, "  "), (4, "77-123-ABCDEF-01 77-123-xy")], "unit_id int, text string")
    got = {(r.unit_id, r.start_pos, r.end_pos) for r in detections(units).collect()}
    assert got == {(0, 2, 18), (1, 2, 18), (4, 0, 16), (4, 17, 26)}
    assert spans.hardened(r"(?<!\w)77-x(?!\w)") == r"(?<![0-9])77-x(?![0-9])"


def test_very_many_matches_in_one_text(spark):
    """Work is about linear in the matches, and offsets hold across blocks."""
    text = " ".join(f"77-{i % 1000:03d}-ab{i:04d}-00 é" for i in range(20_000))
    units = spark.createDataFrame([(0, text)], "unit_id int, text string")
    got = detections(units).orderBy("start_pos").collect()
    assert len(got) == 20_000 and all(text[r.start_pos : r.end_pos] == r.matched_text for r in got)
    done = rewrite.rewrite(units, detections(units).withColumn("replacement", F.lit("x")), "append", ";").first().final_text
    assert done == " ".join(f"77-{i % 1000:03d}-ab{i:04d}-00;x é" for i in range(20_000))


def test_prefilter_is_necessary_for_a_match():
    assert [spans.literal_head(p) for p in ("77-[0-9]", "77?-x", "7*", "77{2}", "(77)-", "77-a|88-b", "77-+x", "")] == ["77-", "7", "", "7", "", "", "77-", ""]


def test_overlap_resolution_is_greedy_from_the_left(spark):
    patterns = PatternSet.of({"_meta": "x", "b": "cde", "a": "abcd", "c": "ef"})
    units = spark.createDataFrame([(0, "abcdef")], "unit_id int, text string")
    assert [(r.pattern_name, r.start_pos) for r in detections(units, patterns, False).orderBy("start_pos").collect()] == [("a", 0), ("c", 4)]


def test_lookup_tiers_and_file_order(spark):
    m = mapping_of(spark, [("AB-1", "first"), ("ab-1", "second"), ("c d2", "third"), ("CD-2", "fourth")])
    rows = spark.createDataFrame([("ab-1",), ("AB-1",), ("Ab-1",), ("A B1",), ("cd 2",), ("zz",), (None,)], "t string")
    got = {r.t: (r.replacement, r.tier) for r in lookup(rows, "t", m).collect()}
    assert got == {"ab-1": ("second", "exact"), "AB-1": ("first", "exact"), "Ab-1": ("first", "lower"), "A B1": ("first", "normalized"), "cd 2": ("third", "normalized"), "zz": (None, None), None: (None, None)}
    assert with_default(lookup(rows, "t", m), "append", "NA").where("is_default").count() == 2
    assert with_default(lookup(rows, "t", m), "replace", "NA").count() == 5
    assert PROFILES["classic"] is CLASSIC


def test_apply_spans_and_runs(spark):
    df = spark.createDataFrame([("abcdef", [(1, 2, "XX"), (4, 6, "")]), ("abc", []), ("abc", None)], "t string, s array<struct<start:int,end:int,final:string>>")
    assert [r[0] for r in df.select(rewrite.apply_spans(F.col("t"), F.col("s"))).collect()] == ["aXXcd", "abc", "abc"]
    runs = spark.createDataFrame([([(0, "ab"), (1, "cd"), (2, "ef")],)], "runs array<struct<run_idx:int,text:string>>").select(rewrite.with_offsets(F.col("runs")).alias("r"))
    got = runs.select(rewrite.rewrite_runs(F.col("r"), F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end"), F.lit("<>").alias("final")), F.struct(F.lit(3).alias("start"), F.lit(5).alias("end"), F.lit("!").alias("final")))).alias("o")).first().o
    assert [x.text for x in got] == ["a<>", "!", "f"]


def test_append_is_idempotent(spark):
    units = spark.createDataFrame([(0, "x 77-1;4022 y"), (1, "x 77-1 y")], "unit_id int, text string")
    hits = spark.createDataFrame([(0, "77-1", "4022", 2, 6), (1, "77-1", "4022", 2, 6)], "unit_id int, matched_text string, replacement string, start_pos int, end_pos int")
    got = {r.unit_id: r.final_text for r in rewrite.rewrite(units, hits, "append", ";").collect()}
    assert got == {0: "x 77-1;4022 y", 1: "x 77-1;4022 y"}


def test_size_check_rows(spark):
    df = spark.createDataFrame([(8.0,), (6.0,), (7.0,)], "s double")
    c = capacity.size_check(F.lit(112.0), F.lit(34.5), F.lit("Verdana"), F.col("s"), F.lit(41))
    got = [tuple(r[0]) for r in df.select(c).collect()]
    assert got == [(3, 22, 66, "Y"), (4, 30, 120, "Y"), (3, 25, 75, "Y")]
    assert tuple(df.select(capacity.capacity(F.lit(0.0), F.lit(9.0), F.lit("x"), F.col("s"))).first()[0])[:3] == (0, 0, 0)


def test_wrapping():
    assert wrap("aa bb cc", 5) == ["aa bb", "cc"]
    assert wrap("abcdefghijk", 10) == ["abcdefghijk"]
    assert broken("77-123-abcdef", 6) == ["77-123", "-abcde", "f"]
    assert broken("ab_cdef_g", 5) == ["ab", "_cdef", "_g"] and broken("abcdefg", 3) == ["abc", "def", "g"]
    assert wrap("a\n\nb", 5) == ["a", "", "b"]


def test_optimal_size(spark):
    rows = [(1, "short", 100.0, 20.0, 10.0, True), (2, "x" * 120, 100.0, 20.0, 10.0, False), (3, "word " * 60, 60.0, 20.0, 10.0, True)]
    got = {r.box_id: r.optimal_size for r in optimal_size(spark.createDataFrame(rows, "box_id int, text string, width double, height double, size double, has_dimensions boolean")).collect()}
    assert got == {1: 10.0, 2: 9.0, 3: 6.0}


def test_geometry(spark):
    one = spark.range(1).select(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1.9, 2.2), (11.5, 2.0), (11.0, 8.7)))).alias("p"))
    assert tuple(one.select(boxes.from_polygon(F.col("p"))).first()[0]) == (1, 2, 9, 6)
    angles = spark.createDataFrame([(44,), (46,), (359,), (225,), (-90,)], "a int")
    assert [r[0] for r in angles.select(boxes.quarter_turn(F.col("a"))).collect()] == [0, 90, 0, 180, 270]
    rows = [(1, "easyocr", 1, 0, 0, 10, 10, 0.5, "a"), (1, "easyocr", 2, 1, 0, 10, 10, 0.9, "b"), (1, "tesseract", 1, 0, 0, 10, 10, 0.5, "c"), (1, "tesseract", 2, 50, 50, 5, 5, 0.1, "d")]
    df = spark.createDataFrame(rows, "image_id int, engine string, ord int, x int, y int, w int, h int, confidence double, text string")
    # The second box overlaps only a partner that the first has claimed, so it is in neither part.
    assert {(r.text, r.reason) for r in boxes.hybrid(df).collect()} == {("a", "highest_confidence"), ("d", "unique_tesseract_detection")}


def test_dedupe_prefers_mapped_then_confidence(spark):
    rows = [(1, 0, "a-b", 0.9, False), (1, 1, "AB", 0.2, True), (1, 2, "ab", 0.2, True), (1, 3, "x", 0.1, False)]
    got = dedupe.image_best(spark.createDataFrame(rows, "image_id int, ord int, text string, confidence double, is_mapped boolean")).collect()
    assert {(r.key, r.text, r.first_ord, r.kept_ord) for r in got} == {("AB", "AB", 0, 1), ("X", "x", 3, 3)}


def test_reports(spark):
    df = spark.createDataFrame([(0,), (1023,), (1536,), (3 * 1024**4,)], "n long")
    assert [r[0] for r in df.select(report.size_text(F.col("n"))).collect()] == ["0 B", "1023.0 B", "1.5 KB", "3.0 TB"]
    assert "<td>&lt;b&gt;</td>" in report.html(spark.createDataFrame([("<b>",)], "x string"), "t")


def test_config(tmp_path):
    (tmp_path / "p.json").write_text('{"b": "x", "a": "y", "_m": 1}')
    assert PatternSet.load(str(tmp_path / "p.json")).patterns == (("b", "x"), ("a", "y"))
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(json.JSONDecodeError):
        load_json(str(tmp_path / "bad.json"))
    assert len(PART_PATTERNS.patterns) == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx.archive_of("hello"))
    (tmp_path / "a.doc").write_bytes(b"x")
    (tmp_path / "~b.docx").write_bytes(b"x")
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "d_12NC_processed.docx").write_bytes(docx.archive_of("x"))
    listing = files.listing(spark, str(tmp_path))
    reasons = {r.stem + r.ext: r.reason for r in listing.select("stem", "ext", files.skip_reason().alias("reason")).collect()}
    assert reasons == {"a.docx": None, "a.doc": None, "~b.docx": "not alphanumeric start", "c.docx": "not a valid document", "d_12NC_processed.docx": "already processed"}
    assert [(r.stem, r.ext) for r in files.discover(listing).collect()] == [("a", ".doc")]


def rich_archive() -> bytes:
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
    run = "<w:r><w:t>{}</w:t></w:r>"
    box = "<w:txbxContent><w:p>" + run.format("in box") + "</w:p><w:p><w:r><w:t>two</w:t><w:br/><w:t>three</w:t></w:r></w:p></w:txbxContent>"
    cell = "<w:tc><w:tcPr>{}</w:tcPr><w:p>" + run.format("cell") + "</w:p></w:tc>"
    body = (
        "<w:p><w:r><w:rPr><w:rFonts w:ascii='Arial'/><w:sz w:val='21'/><w:b/></w:rPr><w:t>77-1</w:t></w:r><w:r><w:t>23</w:t></w:r></w:p>"
        f"<w:p><w:r><mc:AlternateContent><mc:Choice><w:drawing><wp:inline><wp:extent cx='914400' cy='457200'/>{box}</wp:inline></w:drawing></mc:Choice><mc:Fallback><w:pict>{box}</w:pict></mc:Fallback></mc:AlternateContent></w:r></w:p>"
        f"<w:tbl><w:tr>{cell.format('')}</w:tr><w:tr>{cell.format('<w:vMerge/>')}</w:tr><w:tr>{cell.format('<w:vMerge w:val=' + chr(39) + 'restart' + chr(39) + '/>')}</w:tr></w:tbl>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}><w:p>{run.format('head')}</w:p></w:hdr>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x/image" Target="media/i.png"/><Relationship Id="r2" Type="x/image" Target="media/gone.png"/></Relationships>')
        z.writestr("word/media/i.png", b"1234")
        z.writestr("docProps/app.xml", "<Properties><Pages>23</Pages><Words>487</Words></Properties>")
    return out.getvalue()


def test_docx(spark):
    docs = spark.createDataFrame([("a", bytearray(rich_archive())), ("broken", bytearray(b"zzz"))], "path string, content binary")
    runs = docx.text_runs(docs).where("error IS NULL").collect()
    assert [(r.location, r.text) for r in runs if r.location == "paragraph_0"] == [("paragraph_0", "77-1"), ("paragraph_0", "23")]
    assert (runs[0].family, runs[0].size, runs[0].bold) == ("Arial", 10.5, True)
    assert [r.text for r in runs if r.location.startswith("header")] == ["head"]
    assert docx.unmerged(docx.text_runs(docs)).where("text = 'cell'").count() == 2
    box = docx.text_boxes(docs).where("error IS NULL").collect()
    assert [(b.text, b.width, b.height, b.estimated) for b in box] == [("in box\ntwo\nthree", 72.0, 36.0, False)]
    assert {(r.name, r.length, r.error) for r in docx.images(docs).where("path = 'a'").collect()} == {("media/i.png", 4, None), ("media/gone.png", None, "missing part")}
    p = docx.properties(docs).where("path = 'a'").first()
    assert (p.pages, p.words) == (23, 487)
    assert docx.text_runs(docs).where("path = 'broken' AND error IS NOT NULL").count() == 1


def test_stream(spark, tmp_path):
    units = spark.createDataFrame([(i, f"see 77-12{i}-abcdef-01") for i in range(5)], "unit_id int, text string")
    units.write.parquet(str(tmp_path / "in"))
    stream = incremental.detect_stream(spark.readStream.schema(units.schema).parquet(str(tmp_path / "in")))
    incremental.write_reports(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
