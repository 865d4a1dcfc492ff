from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from partweave.operators import neighbours

BOX = "image_id int, ord int, engine string, x int, y int, w int, h int"


def test_right_width_of_touching_boxes(spark):
    """A neighbour that only touches the box's rows counts; one that begins before the start does not."""
    boxes = spark.createDataFrame([(1, 0, "e", 0, 0, 100, 20), (1, 1, "e", 60, 20, 40, 10), (1, 2, "e", 80, 5, 40, 10), (1, 3, "e", 55, 21, 9, 9), (2, 4, "e", 300, 0, 400, 20), (2, 5, "e", 310, 5, 20, 5)], BOX)
    start = F.when(F.col("ord") == 0, 10).when(F.col("ord") == 4, 320).otherwise(F.col("x") + 1)
    got = {r.ord: r.safe_width for r in neighbours.right_widths(boxes.withColumn("start_x", start), boxes, F.lit(500), ["image_id", "ord"]).collect()}
    assert got[0] == 58 - 10 and got[4] == 500 - 320 and len(got) == 6
    assert got[1] == 100 - 61, "the box above ends before it"


def test_bands_follow_the_order_of_neighbours(spark):
    boxes = spark.createDataFrame([(1, 0, "e", 0, 100, 50, 20), (1, 1, "e", 0, 60, 50, 10), (1, 2, "e", 40, 150, 5, 5), (1, 3, "e", 51, 90, 9, 9), (1, 4, "e", 10, 30, 10, 20)], BOX)
    band = boxes.where("ord = 0").withColumns({"band_x": F.lit(0), "band_top": F.lit(40), "band_w": F.lit(50), "band_h": F.lit(140)})
    (r,) = neighbours.vertical_bands(band, boxes.where("ord > 0"), F.lit(1000), ["image_id", "ord"]).collect()
    assert (r.safe_top, r.safe_height) == (72, 148 - 72)
    (r,) = neighbours.vertical_bands(band, boxes.where("ord < 0"), F.lit(150), ["image_id", "ord"]).collect()
    assert (r.safe_top, r.safe_height) == (40, 149 - 40), "the image's edge"


def test_a_hundred_thousand_boxes_in_one_image(spark):
    """Every pair that touches is met exactly once, and none comes together with the whole image."""
    n = 100_000
    k = F.col("id")
    boxes = spark.range(n).select(F.lit(1).alias("image_id"), k.cast("int").alias("ord"), F.lit("e").alias("engine"), (k * 7919 % 20011).cast("int").alias("x"), (k * 104729 % 9973).cast("int").alias("y"), (k % 90 + 5).cast("int").alias("w"), (k % 17 + 4).cast("int").alias("h"))
    some = boxes.where("ord % 500 = 0")
    got = {r.ord: r.safe_width for r in neighbours.right_widths(some.withColumn("start_x", F.col("x") + 3), boxes, F.lit(20_100), ["image_id", "ord"]).collect()}
    o = np.arange(n, dtype=np.int64)
    x, y, w, h = o * 7919 % 20011, o * 104729 % 9973, o % 90 + 5, o % 17 + 4
    for i in range(0, n, 500):
        near = x[(y + h >= y[i]) & (y <= y[i] + h[i]) & (x >= x[i] + 3)]
        assert got[i] == max(0, min(20_100, x[i] + w[i], near.min(initial=10**9) - 2) - (x[i] + 3))
    regions = some.selectExpr("image_id", "ord AS o", "x AS x0", "y AS y0", "x + 300 AS x1", "y + 200 AS y1")
    pairs = neighbours.touching(regions, boxes).groupBy("o").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("n.ord").alias("m")).collect()
    for r in pairs:
        i = r.o
        assert r.n == r.m == ((x <= x[i] + 300) & (x + w >= x[i]) & (y <= y[i] + 200) & (y + h >= y[i])).sum()
    assert len(pairs) == n // 500
