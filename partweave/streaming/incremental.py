"""The same transforms over a stream of files: detection is stateless, the counts have a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from partweave.operators.detect import detections
from partweave.profiles import PART_PATTERNS, PatternSet


def detect_stream(units: DataFrame, patterns: PatternSet = PART_PATTERNS, id: str = "unit_id", text: str = "text") -> DataFrame:
    """Detections of a stream of text units; one stateless map."""
    return detections(units, patterns, True, id, text)


def fresh(units: DataFrame, id: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Each unit once within the lateness that the watermark allows."""
    return units.withWatermark(at, late).dropDuplicatesWithinWatermark([id])


def with_names(events: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """A stream joined with a table that does not change: each row looks its key up, and keeps its place without one."""
    return events.join(static, key, "left")


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and key; later ones than the watermark are dropped."""
    counts = events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), key, "n")


def write_reports(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's rows as parquet files, each once, for all that is there now."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
