from __future__ import annotations

import datetime
import json

from pyspark.sql import functions as F

from partweave.operators import metadata
from partweave.sources import sinks


def test_latest_report_comes_back_whole(spark, tmp_path):
    """All part files of the newest write, and of each document the newest report that has it."""
    folder, rows = str(tmp_path / "r"), spark.range(40).selectExpr("id", "id * 2 AS v")
    sinks.write_report(rows.withColumn("v", F.lit(0).cast("long")).repartition(4), folder)
    sinks.write_report(rows.where("id < 10").repartition(4), folder)
    assert sorted(tuple(r) for r in sinks.latest_report(spark, folder, "id long, v long").collect()) == [(i, 2 * i) for i in range(10)]
    got = sinks.latest_reports(spark, folder, "id long, v long", ["id"])
    assert sorted((r.id, r.v) for r in got.collect()) == [(i, 2 * i if i < 10 else 0) for i in range(40)] and got.select("written").distinct().count() == 2


def test_reports_with_odd_rows(spark, tmp_path):
    """Broken lines are left out, a document without a key is one, several rows of a document stay together."""
    first, second = tmp_path / "written=a", tmp_path / "written=b"
    first.mkdir(), second.mkdir()
    (first / "x.json").write_text('{"id":1,"v":"old"}\n{"id":null,"v":"n"}\n{"id":2,"v":"kept"}\n')
    (first / "y.json").write_text('{"id":2,"v":"kept too"}\n')
    (second / "x.json").write_text('{"id":1,"v":{"deep":[1]}}\nbroken\n')
    (second / "y.json").write_text('{"id":1,"v":null}\n')
    got = sinks.latest_reports(spark, str(tmp_path), "id long, v variant", ["id"]).select("id", F.to_json("v").alias("v"), "written")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(None, '"n"', "a"), (2, '"kept"', "a"), (2, '"kept too"', "a"), (1, '{"deep":[1]}', "b"), (1, "null", "b")]))
    assert sinks.latest_report(spark, str(tmp_path), "id long").count() == 2


def test_metadata_of_any_depth(spark, tmp_path):
    rows = [(1, None, [1, 2], {"a": {"b": [None, "x"]}}, datetime.date(2024, 1, 2)), (2, "q\"{[", [], {}, None)]
    df = spark.createDataFrame(rows, "id int, note string, list array<int>, nested map<string,map<string,array<string>>>, day date")
    made = metadata.serialized(df, ["id"])
    back = spark.read.schema("id int, metadata variant").json(sinks.write_json(made, str(tmp_path / "j")))
    objects = {r.id: json.loads(r.j) for r in back.select("id", F.to_json("metadata").alias("j")).collect()}
    assert objects == {1: {"note": None, "list": [1, 2], "nested": {"a": {"b": [None, "x"]}}, "day": "2024-01-02"}, 2: {"note": 'q"{[', "list": [], "nested": {}, "day": None}}
    got = sorted(tuple(r) for r in metadata.leaves(back, ["id"]).where("id = 1").select("path", "kind", F.coalesce("value", F.lit("-"))).collect())
    assert got == [("$.day", "text", "2024-01-02"), ("$.list[0]", "number", "1"), ("$.list[1]", "number", "2"), ("$.nested.a.b[0]", "null", "-"), ("$.nested.a.b[1]", "text", "x"), ("$.note", "null", "-")]
    assert {r.path for r in metadata.leaves(back, ["id"]).where("id = 2").collect()} == {"$.note", "$.list", "$.nested", "$.day"}
    assert [r.d for r in back.select(metadata.depth(F.col("metadata")).alias("d")).orderBy("d").collect()] == [2, 4]
    assert metadata.leaves(back.where("id > 5"), ["id"]).count() == 0


def test_nested_rows(spark):
    df = spark.createDataFrame([(1, '{"m":{"list":[{"a":1,"b":"x"},{"a":"no"},3]}}'), (2, '{"m":{"list":{}}}'), (3, "{}"), (4, None)], "id int, j string").select("id", F.parse_json("j").alias("metadata"))
    got = sorted(tuple(r) for r in metadata.nested_rows(df, ["id"], "$.m.list", "a int, b string").collect())
    assert [r[:2] for r in got] == [(1, 0), (1, 1), (1, 2)] and got[0] == (1, 0, 1, "x") and got[1][2] is None and got[2][2:] == (None, None)
