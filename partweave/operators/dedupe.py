"""Deduplication rules: which of equal detections stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.operators.lookup import first_by


def cells(rows: DataFrame) -> DataFrame:
    """Merged-cell rule: in tables one of (table, matched, replacement), elsewhere one of (location, matched, replacement); the first in scan order ``ord``."""
    table = F.regexp_extract("location", r"^(.*?table_\d+)", 1)
    keyed = rows.withColumn("_key", F.concat_ws(":", F.when(table != "", table).otherwise(F.col("location")), F.concat("matched_text", F.lit("->"), "replacement")))
    return first_by(keyed, ["doc_id", "_key"], [F.col("ord")]).drop("_key")


def textbox(rows: DataFrame, id: str = "unit_id") -> DataFrame:
    """Inside a textbox one of (matched, replacement): the last position."""
    return first_by(rows, [id, "matched_text", "replacement"], [F.col("start_pos").desc()])


def recognised(rows: DataFrame, grid: int = 10) -> DataFrame:
    """Recognised text: one of (image, lower-case trimmed text, grid cell), the first."""
    keyed = rows.withColumn("_t", F.lower(F.trim("text"))).withColumn("_gx", F.floor(F.col("x") / grid)).withColumn("_gy", F.floor(F.col("y") / grid))
    return first_by(keyed, ["image_id", "_t", "_gx", "_gy"], [F.col("ord"), F.col("engine")]).drop("_t", "_gx", "_gy")


def image_best(rows: DataFrame) -> DataFrame:
    """Image matches: of equal alphanumeric upper-case keys the mapped one, then the most confident, then the first; at the place of the first.

    Two aggregates over one grouping, combined before the shuffle: no window over a key's rows.
    """
    key = F.upper(F.regexp_replace("text", "[^A-Za-z0-9]", ""))
    best = F.struct(F.col("is_mapped").cast("int").alias("m"), "confidence", (-F.col("ord")).alias("o"))
    kept = F.struct("text", "confidence", "is_mapped", F.col("ord").alias("kept_ord"))
    return rows.groupBy("image_id", key.alias("key")).agg(F.max_by(kept, best).alias("k"), F.min("ord").alias("first_ord")).select("image_id", "key", "k.*", "first_ord")


def stems(files: DataFrame) -> DataFrame:
    """One file for each stem, .doc before .docx, then the first."""
    return first_by(files, ["stem"], [(F.col("ext") != ".doc").cast("int"), F.col("file_id")])


def variants(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Variants with equal content once, compared by a 256-bit digest."""
    digest = F.sha2(F.concat_ws("\x1f", *(F.col(c).cast("string") for c in columns)), 256)
    return rows.withColumn("_d", digest).dropDuplicates(["_d"]).drop("_d")
