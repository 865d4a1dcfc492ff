"""Registered queries of the density table and of the font searches that use it. SQL for them is in ``oracles_sizing``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.operators import density
from partweave.plans import inputs
from partweave.session import spread

C = F.col

#: Text boxes of which every fifth has just the size of a box that the rules name.
KNOWN_BOXES = f"""
    SELECT box_id, family, size, has_dimensions, text, CASE box_id % 20 WHEN 0 THEN CAST(116.4 AS DOUBLE) WHEN 4 THEN CAST(180.6 AS DOUBLE) WHEN 8 THEN CAST(119.5 AS DOUBLE) WHEN 16 THEN CAST(155.3 AS DOUBLE) ELSE width END AS width,
           CASE box_id % 20 WHEN 0 THEN CAST(31.2 AS DOUBLE) WHEN 4 THEN CAST(35.6 AS DOUBLE) WHEN 8 THEN CAST(31.2 AS DOUBLE) WHEN 16 THEN CAST(21.8 AS DOUBLE) ELSE height END AS height
    FROM ({inputs.TEXTBOXES}) AS b"""


def known_boxes(s: SparkSession, d: str) -> DataFrame:
    return density.with_rules(spread(inputs.spark(s, d, KNOWN_BOXES)), density.box_rules(s))


def density_table(s: SparkSession, d: str) -> DataFrame:
    """Characters per square centimetre of every box at every size that its rules or the computation give."""
    rows = known_boxes(s, d).select("box_id", F.explode(density.density_table()).alias("e"))
    return rows.select("box_id", C("e.size").alias("font_size"), F.round("e.per_cm2", 6).alias("per_cm2"), "e.source")


def own_size_fit(s: SparkSession, d: str) -> DataFrame:
    """The search over a box's own sizes and whole points; a third of the boxes have no sizes of their own."""
    own = F.when(C("box_id") % 3 == 1, F.array(C("size"), F.lit(12.0), F.lit(9.0))).when(C("box_id") % 3 == 2, F.array(F.lit(7.0), F.floor("size").cast("double")))
    fit = density.own_size_fit(density.density_table(), own, C("text"), C("size"))
    return known_boxes(s, d).select("box_id", fit.alias("fit_size"))


def reconstruction_fit(s: SparkSession, d: str) -> DataFrame:
    """The search for rewritten texts of which some have line breaks."""
    original = F.when(C("box_id") % 2 == 0, F.replace("text", F.lit(" "), F.lit("\n"))).otherwise(C("text"))
    rows = known_boxes(s, d).withColumn("before", original).withColumn("after", F.concat("before", F.lit(";4022-NA")))
    return rows.select("box_id", density.reconstruction_fit(C("after"), C("before"), C("size")).alias("fit_size"))


QUERIES = {"density_table": density_table, "own_size_fit": own_size_fit, "reconstruction_fit": reconstruction_fit}
