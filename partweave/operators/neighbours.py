"""Boxes near a region of an image, by grid cells, and what they leave of the room beside and around a box.

An image's boxes never come together in one row or task: boxes and regions are dealt to the cells of a
grid that they cover, and a pair is taken in one cell only, the one that holds the corner where their
common part begins. Touching counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of a cell in pixels, about the width of a line of text in a box.
CELL = 128
#: Fixed value: pixels that stay free between a band and a neighbour.
FREE = 2


def _cells(low: Column, high: Column, cell: int) -> Column:
    return F.sequence(F.floor(low / cell).cast("int"), F.floor(high / cell).cast("int"))


def touching(regions: DataFrame, boxes: DataFrame, cell: int = CELL) -> DataFrame:
    """``regions`` (``image_id``, ``x0``, ``y0``, ``x1``, ``y1`` and others) with each box that touches them as struct ``n``, a row per pair.

    ``n`` has ord, engine, x, y, w, h of ``boxes``. Regions with x1 < x0 or y1 < y0 touch nothing.
    """
    sides = {"x": ("x0", "x1"), "y": ("y0", "y1")}
    able = regions.where((F.col("x1") >= F.col("x0")) & (F.col("y1") >= F.col("y0")))
    dealt = able.withColumn("_cx", F.explode(_cells(F.col("x0"), F.col("x1"), cell))).withColumn("_cy", F.explode(_cells(F.col("y0"), F.col("y1"), cell)))
    own = boxes.select("image_id", F.struct("ord", "engine", "x", "y", "w", "h").alias("n"))
    own = own.withColumn("_cx", F.explode(_cells(F.col("n.x"), F.col("n.x") + F.col("n.w"), cell))).withColumn("_cy", F.explode(_cells(F.col("n.y"), F.col("n.y") + F.col("n.h"), cell)))
    # A table's bytes on disk tell little of the boxes that it becomes: neither side goes to the driver to be broadcast.
    pairs = dealt.join(own.hint("merge"), ["image_id", "_cx", "_cy"])
    for side, (low, high) in sides.items():
        begin, end = F.col(f"n.{side}"), F.col(f"n.{side}") + F.col(f"n.{'w' if side == 'x' else 'h'}")
        pairs = pairs.where((begin <= F.col(high)) & (end >= F.col(low)) & (F.floor(F.greatest(begin, F.col(low)) / cell) == F.col(f"_c{side}")))
    return pairs.drop("_cx", "_cy")


def right_widths(anchors: DataFrame, boxes: DataFrame, image_w: Column, keys: list[str]) -> DataFrame:
    """``keys`` and ``safe_width``: the room from ``start_x`` to the right inside a box that no neighbour takes.

    ``anchors``: ``keys``, ``image_id`` among them, with ``x``, ``y``, ``w``, ``h``, ``start_x``. A neighbour that touches the box's
    rows and begins at ``start_x`` or later ends the room two pixels before it; so do the box's right side and
    the image's. Never below 0.
    """
    end = F.least(image_w, F.col("x") + F.col("w"))
    rows = anchors.select(*keys, "start_x", end.alias("_end"), F.col("start_x").alias("x0"), F.col("y").alias("y0"), (end + FREE).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    found = touching(rows, boxes).where(F.col("n.x") >= F.col("start_x")).select(*keys, "start_x", "_end", F.col("n.x").alias("_x"))
    both = rows.select(*keys, "start_x", "_end", F.lit(None).cast("int").alias("_x")).unionByName(found)
    # Neighbours are reduced to the nearest before they are shuffled.
    nearest = both.groupBy(*keys, "start_x", "_end").agg(F.min("_x").alias("_x"))
    return nearest.select(*keys, F.greatest(F.lit(0), F.least("_end", F.col("_x") - FREE) - F.col("start_x")).cast("int").alias("safe_width"))


def vertical_bands(anchors: DataFrame, boxes: DataFrame, image_h: Column, keys: list[str]) -> DataFrame:
    """``keys``, ``safe_top`` and ``safe_height`` of a band above and below a box that keeps clear of neighbours.

    ``anchors``: ``keys``, ``image_id`` among them, with ``y`` (of the box) and the band ``band_x``, ``band_top``, ``band_w``, ``band_h``.
    Neighbours are taken in order; one that touches the band as it is then and begins above the box pushes
    the top below itself, any other pulls the bottom above itself.
    """
    bottom = F.least(image_h - 1, F.col("band_top") + F.col("band_h"))
    rows = anchors.select(*keys, "y", F.col("band_x").alias("x0"), F.col("band_top").alias("y0"), (F.col("band_x") + F.col("band_w")).alias("x1"), bottom.alias("y1"))
    pairs = touching(rows, boxes)
    none = rows.withColumn("n", F.lit(None).cast(pairs.schema["n"].dataType))
    # What touches one band comes together: as many boxes as have room there.
    lists = none.unionByName(pairs.select(none.columns)).groupBy(*keys, "y", "y0", "y1").agg(F.sort_array(F.collect_list("n")).alias("_all"))
    band = F.struct(F.col("y0").cast("int").alias("top"), F.col("y1").cast("int").alias("bottom"))

    def pushed(b: Column, n: Column) -> Column:
        meets, above = (n["y"] <= b["bottom"]) & (n["y"] + n["h"] >= b["top"]), n["y"] < F.col("y")
        top = F.when(meets & above, F.greatest(b["top"], n["y"] + n["h"] + FREE)).otherwise(b["top"])
        low = F.when(meets & ~above, F.least(b["bottom"], n["y"] - FREE)).otherwise(b["bottom"])
        return F.struct(top.cast("int").alias("top"), low.cast("int").alias("bottom"))

    done = lists.select(*keys, F.aggregate("_all", band, pushed).alias("b"))
    return done.select(*keys, F.col("b.top").alias("safe_top"), F.greatest(F.lit(0), F.col("b.bottom") - F.col("b.top")).alias("safe_height"))
