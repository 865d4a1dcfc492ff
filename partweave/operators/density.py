"""Font sizes by how many characters fit a square centimetre, and the searches that start from a box's own sizes.

The rules for known boxes are a small file. They become one row a family, which every box is joined with
once; all that follows is decided inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.functions.spans import bound
from partweave.operators.capacity import CM_PER_POINT, capacity, font_metric, wrapped_lines

#: Width and line-height multipliers, safety margin and headroom of each family in this search.
DENSE_FONTS = {
    "Arial": (0.58, 1.18, 0.12, 0.96),
    "Times New Roman": (0.53, 1.25, 0.12, 0.96),
    "Calibri": (0.58, 1.25, 0.12, 0.96),
    "Verdana": (0.62, 1.25, 0.12, 0.96),
    "PMingLiU": (0.58, 1.10, 0.18, 0.92),
    "SimSun": (0.60, 1.10, 0.18, 0.92),
    "Microsoft YaHei": (0.60, 1.14, 0.18, 0.92),
    "ACADEMY ENGRAVED LET PLAIN": (0.7, 1.25, 0.15, 0.96),
}
#: Sizes of the table, smallest sizes, ratio of areas below which another box's rules are scaled, room added, area of an unknown box, margin at the baseline.
TABLE_SIZES = (12.0, 11.0, 10.0, 9.0, 8.0, 7.0, 6.0)
LEAST_POINT, LEAST_HALF, NEAR_AREA, EXTRA, UNKNOWN_AREA, BASE_MARGIN = 6, 5.0, 2.0, 1.2, 4.0, 0.2
#: For boxes of a width and height, in points, what each range of sizes takes: lines and characters of a line.
BOX_RULES = {
    "Arial": {
        "116.4x31.2": ((7.5, 11.0, 2, 20), (7.0, 7.0, 3, 22), (11.5, 14.0, 1, 16)),
        "180.6x35.6": ((9.0, 9.0, 2, 34), (8.5, 8.5, 3, 36), (8.0, 8.0, 3, 40)),
        "119.5x31.2": ((8.0, 8.0, 2, 22),),
        "155.3x21.8": ((6.0, 6.0, 2, 45), (5.0, 5.0, 3, 50)),
    }
}


def box_rules(spark: SparkSession, found: dict | None = None) -> DataFrame:
    """A row per family: ``_family`` in lower case and ``_boxes``, an array of struct ord, width, height, rules in the file's order."""
    rows = [
        (family.lower(), [(i, *map(float, name.split("x")), [tuple(r) for r in rules]) for i, (name, rules) in enumerate(boxes.items())])
        for family, boxes in (BOX_RULES if found is None else found).items()
    ]
    return spark.createDataFrame(rows, "_family string, _boxes array<struct<ord:int,width:double,height:double,rules:array<struct<low:double,high:double,lines:int,cpl:int>>>>")


def with_rules(boxes: DataFrame, rules: DataFrame) -> DataFrame:
    """``boxes`` with ``_boxes`` of their family, null where it has none. The file's rows go to every task; their number does not grow with the data."""
    return boxes.join(F.broadcast(rules), F.lower("family") == F.col("_family"), "left").drop("_family")


def _same(b: Column) -> Column:
    return (b["width"] == F.round(F.col("width"), 1)) & (b["height"] == F.round(F.col("height"), 1))


def _area(width: Column, height: Column) -> Column:
    return width * CM_PER_POINT * (height * CM_PER_POINT)


def density_table() -> Column:
    """Array of struct size, per_cm2, source of a row with ``width``, ``height``, ``family`` and ``_boxes``.

    ``source`` is exact where rules name the box to one decimal, scaled where the box with the nearest area
    (the first of equals, below twice or half of it) has rules, else computed. Of several rules for a
    size the last counts.
    """
    w, h = F.col("width"), F.col("height")
    area = _area(w, h)

    def of(box: Column, x: Column, y: Column, source: str) -> Column:
        good = F.filter(box["rules"], lambda r: (r["lines"] > 0) & (r["cpl"] > 0))
        single = F.transform(F.filter(good, lambda r: r["low"] == r["high"]), lambda r: r["low"])
        whole = F.array(*(F.lit(s) for s in TABLE_SIZES))
        last = lambda size: F.filter(good, lambda r: size.between(r["low"], r["high"]) & ((r["low"] == r["high"]) | F.array_contains(whole, size)))
        part = lambda n, k: F.greatest(F.lit(1), (n * k).cast("int"))
        entries = F.transform(F.array_distinct(F.concat(single, whole)), lambda size: F.struct(size.alias("size"), F.try_element_at(last(size), F.lit(-1)).alias("r")))
        known = F.filter(entries, lambda e: e["r"].isNotNull())
        return F.transform(known, lambda e: F.struct(e["size"].alias("size"), (part(e["r"]["lines"], y) * part(e["r"]["cpl"], x) / area).alias("per_cm2"), F.lit(source).alias("source")))

    exact = F.get(F.filter("_boxes", _same), 0)
    ratio = lambda b: F.greatest(w * h / (b["width"] * b["height"]), b["width"] * b["height"] / (w * h))
    nearest = F.array_min(F.transform("_boxes", lambda b: F.struct(ratio(b).alias("ratio"), b["ord"].alias("ord"), b.alias("b"))))
    scaled = bound(nearest, lambda n: F.when(n["ratio"] < NEAR_AREA, of(n["b"], w / n["b"]["width"], h / n["b"]["height"], "scaled")))
    fit = lambda room, size, which: (room * CM_PER_POINT / (size * font_metric(F.col("family"), which, DENSE_FONTS) * CM_PER_POINT)).cast("int")
    computed = F.array(*(F.struct(F.lit(s).alias("size"), (fit(w, F.lit(s), 0) * fit(h, F.lit(s), 1) / area).alias("per_cm2"), F.lit("computed").alias("source")) for s in TABLE_SIZES))
    some = lambda a: F.when(F.size(a) > 0, a)
    return F.when((w > 0) & (h > 0), F.coalesce(some(bound(exact, lambda b: of(b, F.lit(1), F.lit(1), "exact"))), some(scaled), computed)).otherwise(F.array().cast("array<struct<size:double,per_cm2:double,source:string>>"))


def own_size_fit(table: Column, detected: Column, text: Column, base: Column) -> Column:
    """The first size at which a text takes no more than its box's area: the box's own sizes from the largest, then whole points to 6.

    A text takes its characters over the table's density, and a fifth more. Sizes that the table lacks are
    not taken. Whole points begin at the smallest own size, or at ``base`` where a box has none. An
    unknown box counts as 4 square centimetres. If nothing fits: 6.
    """
    room = F.when(F.col("has_dimensions"), _area(F.col("width"), F.col("height"))).otherwise(UNKNOWN_AREA)
    own = F.sort_array(F.coalesce(detected, F.array().cast("array<double>")), asc=False)
    begin = F.coalesce(F.array_min(own), base).cast("int")
    points = F.when(begin >= LEAST_POINT, F.sequence(begin, F.lit(LEAST_POINT), F.lit(-1))).otherwise(F.array().cast("array<int>"))

    def first(entries: Column) -> Column:
        density = lambda size: F.get(F.filter(entries, lambda e: e["size"] == size), 0)["per_cm2"]
        fits = lambda size: F.coalesce((density(size) > 0) & (F.char_length(text) / density(size) * EXTRA <= room), F.lit(False))
        return F.coalesce(F.get(F.filter(F.concat(own, F.transform(points, lambda p: p.cast("double"))), fits), 0), F.lit(float(LEAST_POINT)))

    return bound(table, first)


def reconstruction_fit(text: Column, original: Column, base: Column) -> Column:
    """The largest half point from ``base`` to 5 at which a rewritten text fits, of a row with ``_boxes``.

    Fits: wrapped lines stay within the lines, which rules of just this box and size set before the
    capacity does; the longest line within the rules' characters; all characters within the capacity's
    headroom. Where the text needs more lines than the original did and the box had none to spare at
    ``base``, one line must stay free. Both the text as it is and with blanks for line breaks are tried,
    and the smaller of their sizes is taken. Nothing fits: 5. Without dimensions: ``base``.
    """
    w, h, family = F.col("width"), F.col("height"), F.col("family")
    halves = F.when(base >= LEAST_HALF, F.transform(F.sequence((base * 2).cast("int"), F.lit(int(LEAST_HALF * 2)), F.lit(-1)), lambda k: k / 2)).otherwise(F.array().cast("array<double>"))
    start = capacity(w, h, family, base, F.lit(BASE_MARGIN), DENSE_FONTS)
    spare = F.when(start["cpl"] > 0, start["lines"] - wrapped_lines(original, F.greatest(start["cpl"], F.lit(1))) >= 1).otherwise(False)
    rules = F.get(F.filter("_boxes", _same), 0)["rules"]

    def largest(t: Column, spare: Column, rules: Column) -> Column:
        longest = F.array_max(F.transform(F.split(t, "\n", -1), F.char_length))
        chars = F.char_length(F.replace(t, F.lit("\n"), F.lit("")))

        def fits(size: Column) -> Column:
            rule = F.get(F.filter(rules, lambda r: size.between(r["low"], r["high"])), 0)
            room = capacity(w, h, family, size, None, DENSE_FONTS)
            both = F.struct(F.coalesce(rule["lines"], room["lines"]).alias("lines"), F.coalesce(rule["cpl"], room["cpl"]).alias("cpl"), rule["lines"].alias("most_lines"), rule["cpl"].alias("most_cpl"), room["total"].alias("total"))

            def judged(c: Column) -> Column:
                cpl = F.greatest(c["cpl"], F.lit(1))
                need, before = wrapped_lines(t, cpl), wrapped_lines(original, cpl)
                strict = (need > before) & ~spare & (c["lines"] > 1)
                kept = ~F.coalesce((longest > c["most_cpl"]) | (need > c["most_lines"]), F.lit(False))
                return (c["cpl"] > 0) & (c["lines"] > 0) & F.when(strict, need < c["lines"]).otherwise(need <= c["lines"]) & (chars <= (c["total"] * font_metric(family, 3, DENSE_FONTS)).cast("int")) & kept

            return bound(both, judged)

        return F.get(F.filter(halves, fits), 0)

    def found(x: Column) -> Column:
        flat = F.when(F.contains(text, F.lit("\n")), largest(F.replace(text, F.lit("\n"), F.lit(" ")), x["spare"], x["rules"]))
        return F.least(largest(text, x["spare"], x["rules"]), flat)

    fit = bound(F.struct(F.coalesce(spare, F.lit(False)).alias("spare"), rules.alias("rules")), found)
    return F.when(F.col("has_dimensions"), F.coalesce(fit, F.lit(LEAST_HALF))).otherwise(base)
