"""Where results go, and how the latest report is read back. Every sink writes its partitions in parallel."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_json(rows: DataFrame, folder: str) -> str:
    """A JSON object per row: document and batch reports, match dumps."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)
    return folder


def write_csv(rows: DataFrame, folder: str) -> str:
    """Rows with a header, as the size check has them; lists are written joined by blanks."""
    flat = [F.array_join(F.transform(f.name, lambda x: x.cast("string")), " ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in rows.schema.fields]
    rows.select(flat).write.mode("overwrite").option("header", "true").csv(folder)
    return folder


def processing_log(results: DataFrame, folder: str) -> tuple[str, str]:
    """The log of a batch in two folders: its totals in one row, and a row per result."""
    good = F.count_if("success")
    totals = results.agg(F.count(F.lit(1)).alias("total_processed"), good.alias("successful"), (F.count(F.lit(1)) - good).alias("failed"), F.coalesce(F.sum("matches"), F.lit(0)).alias("total_matches"))
    return write_json(totals.withColumn("timestamp", F.current_timestamp()), f"{folder}/totals"), write_json(results, f"{folder}/results")


def completed(files: DataFrame, results: DataFrame, target: str) -> DataFrame:
    """Files whose result is a success, with the path they belong to afterwards: ``path``, ``moved_to``."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.join(results.where("success").select("path").distinct(), "path", "left_semi").select("path", F.concat(F.lit(f"{target.rstrip('/')}/"), name).alias("moved_to"))


def write_report(rows: DataFrame, folder: str, written: str | None = None) -> str:
    """A report of its own below ``folder``, in as many part files as ``rows`` has partitions; earlier ones stay.

    Its folder is named by the time of writing (UTC, to the microsecond), so names sort as times do.
    """
    return write_json(rows, f"{folder.rstrip('/')}/written={written or datetime.now(UTC).strftime('%Y%m%dT%H%M%S%fZ')}")


def latest_reports(spark: SparkSession, folder: str, schema: str, keys: list[str]) -> DataFrame:
    """Of each document, told by ``keys``, all rows of the newest report that has it; ``written`` says which that is.

    A report is all part files of one write. Where a schema column is VARIANT it takes JSON of any depth.
    Broken lines are left out. The newest report of a document is an aggregate, combined before it is
    shuffled; without reports there are no rows.
    """
    layout = T.StructType.fromDDL(schema)
    reader = spark.read.option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json")
    rows = reader.schema(layout.add("written", "string")).json(folder)
    newest = rows.groupBy(*keys).agg(F.max("written").alias("_w"))
    # Documents without a key are documents too.
    same = reduce(lambda a, b: a & b, (F.col(f"r.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    return rows.alias("r").join(newest.alias("n"), same & (F.col("r.written") == F.col("n._w")), "left_semi")


def latest_report(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows of the newest report below a folder, every part file of it; broken lines are left out."""
    rows = spark.read.option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").schema(T.StructType.fromDDL(schema).add("written", "string")).json(folder)
    # One row on the other side.
    return rows.join(F.broadcast(rows.agg(F.max("written").alias("_w"))), F.col("written") == F.col("_w"), "left_semi").drop("written")
