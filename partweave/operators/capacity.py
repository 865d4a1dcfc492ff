"""How much text fits: line and character capacity of text boxes, guidelines, and the font size search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points in an inch, centimetres in an inch and in a point.
POINTS, CM, CM_PER_POINT = 72.0, 2.54, 0.0352778
#: Width and line-height multipliers, safety margin and headroom of each family, and the defaults.
FONTS = {
    "Arial": (0.597, 1.494, 0.113, 0.96),
    "Times New Roman": (0.554, 1.494, 0.12, 0.96),
    "PMingLiU": (0.651, 1.757, 0.18, 0.92),
}
DEFAULT_FONT = (0.6, 1.25, 0.15, 0.96)
#: The size check's width multipliers.
CHECK_WIDTHS = {"Arial": 0.6, "Times New Roman": 0.55, "Calibri": 0.58, "PMingLiU": 0.65, "SimSun": 0.65, "Microsoft YaHei": 0.62, "Verdana": 0.62, "ACADEMY ENGRAVED LET PLAIN": 0.7}
#: Sizes that the line map lists; smallest size.
LINE_MAP_SIZES = (14.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.0, 6.0, 5.5, 5.0)
LEAST_SIZE = 6.0


def font_metric(family: Column, which: int, fonts: dict[str, tuple[float, ...]] | None = None) -> Column:
    """A metric of a family, whatever its case, or the default: 0 width, 1 line height, 2 safety, 3 headroom."""
    out = F.lit(DEFAULT_FONT[which])
    for name, values in (FONTS if fonts is None else fonts).items():
        out = F.when(F.lower(family) == name.lower(), values[which]).otherwise(out)
    return out


def check_width(family: Column) -> Column:
    out = F.lit(0.6)
    for name, value in CHECK_WIDTHS.items():
        out = F.when(F.lower(family) == name.lower(), value).otherwise(out)
    return out


def _quotient(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b)).cast("int")


def capacity(width: Column, height: Column, family: Column, size: Column, safety: Column | None = None, fonts: dict[str, tuple[float, ...]] | None = None) -> Column:
    """Struct of lines, cpl, total, per_sq_in, area_in2; zeros where a measure is not positive."""
    good = (width > 0) & (height > 0) & (size > 0)
    keep = 1.0 - (font_metric(family, 2, fonts) if safety is None else safety)
    area = width / POINTS * (height / POINTS)
    cpl = F.when(good, _quotient(width / POINTS * keep, size * font_metric(family, 0, fonts) / POINTS)).otherwise(0)
    lines = F.when(good, _quotient(height / POINTS * keep, size * font_metric(family, 1, fonts) / POINTS)).otherwise(0)
    total = F.greatest(cpl * lines, F.lit(0))
    dense = F.coalesce(F.when(good, F.try_divide(total, area)), F.lit(0.0))
    return F.struct(lines.alias("lines"), cpl.alias("cpl"), total.alias("total"), dense.alias("per_sq_in"), F.when(good, area).otherwise(0.0).alias("area_in2"))


def size_check(width: Column, height: Column, family: Column, size: Column, length: Column) -> Column:
    """The size check: struct of lines, cpl, total and whether ``length`` characters fit, Y or N."""
    good = (width > 0) & (height > 0) & (size > 0)
    lines = F.when(good, _quotient(height / POINTS, size * 1.3 / POINTS)).otherwise(0)
    cpl = F.when(good, _quotient(width / POINTS, size * check_width(family) / POINTS)).otherwise(0)
    total = F.greatest(lines * cpl, F.lit(0))
    return F.struct(lines.alias("lines"), cpl.alias("cpl"), total.alias("total"), F.when(total >= length, "Y").otherwise("N").alias("fits"))


def classic_capacity(width: Column, height: Column, size: Column, has_dimensions: Column) -> Column:
    """Struct of max_lines and max_cpl: 94 % of the box, 0.6 and 1.25 of the size; floors of 1 line and 8 characters."""
    lines = F.when(has_dimensions, F.greatest(F.lit(1), (height * 0.94 / (size * 1.25)).cast("int"))).otherwise(F.greatest(F.lit(1), (F.lit(20) / size).cast("int")))
    cpl = F.when(has_dimensions, F.greatest(F.lit(8), (width * 0.94 / (size * 0.6)).cast("int"))).otherwise(F.greatest(F.lit(10), (F.lit(600) / size).cast("int")))
    return F.struct(lines.alias("max_lines"), cpl.alias("max_cpl"))


def line_map(width: Column, height: Column, has_dimensions: Column) -> Column:
    """Map of font size to the lines that fit."""
    entries = [x for s in LINE_MAP_SIZES for x in (F.lit(s), classic_capacity(width, height, F.lit(s), has_dimensions)["max_lines"])]
    return F.create_map(*entries)


def size_for_lines(width: Column, height: Column, target: Column, has_dimensions: Column, most: float = 14.0, least: float = 5.0) -> Column:
    """Largest size in quarter points at which ``target`` lines fit; without dimensions by the number of lines."""
    quarters = F.array(*(F.lit(q) for q in range(int(most * 4), int(least * 4) - 1, -1)))
    fits = F.filter(quarters, lambda q: classic_capacity(width, height, q / 4, F.lit(True))["max_lines"] >= target)
    free = F.when(target <= 1, most).when(target <= 2, max(least, most * 0.8)).otherwise(max(least, most * 0.6))
    return F.when(has_dimensions, F.coalesce(F.get(fits, 0) / 4, F.lit(least))).otherwise(free)


def extents(text: Column, size: Column) -> tuple[Column, Column]:
    """Estimated width and height of a text: 0.4 of the size for each character of the longest line, 1.2 for each line."""
    lines = F.split(text, "\n", -1)
    return F.array_max(F.transform(lines, F.char_length)) * (size * 0.4), F.size(lines) * (size * 1.2)


def scale(text: Column, size: Column, width: Column, height: Column, has_dimensions: Column) -> tuple[Column, Column]:
    """Whether a text overflows 95 % of its box, and the factor, at most 1, that makes it fit."""
    w, h = extents(text, size)
    room_w, room_h = width - width * 0.05, height - height * 0.05
    factor = F.least(F.coalesce(F.try_divide(room_w, w), F.lit(1.0)), F.coalesce(F.try_divide(room_h, h), F.lit(1.0)), F.lit(1.0))
    return has_dimensions & ((w > room_w) | (h > room_h)), F.when(has_dimensions, factor).otherwise(1.0)


def source_lines(text: Column) -> Column:
    """Lines that are not blank."""
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != ""))


def guidelines(spark: SparkSession, found: dict) -> DataFrame:
    """Tall form of a guideline file's object: family, axis (height or width), dim, size, limit; a row per entry."""
    rows = [
        (family, axis, float(dim), float(size), int(limit))
        for family, block in (found.get("fonts") or {}).items()
        for axis, name in (("height", "lines_by_height"), ("width", "cpl_by_width"))
        for dim, sizes in (block.get(name) or {}).items()
        for size, limit in sizes.items()
        if limit is not None
    ]
    return spark.createDataFrame(rows, "family string, axis string, dim double, size double, limit int")


def with_guideline(boxes: DataFrame, tall: DataFrame, axis: str, dim: str, column: str, how: str = "interpolated") -> DataFrame:
    """``boxes`` with the guideline limit of their ``dim`` at their family and size, null where there is none.

    ``exact`` takes the entry whose dimension is the same to one decimal; ``nearest`` the one with the
    nearest dimension, the smaller of two; ``interpolated`` the exact
    entry, else the smaller of the neighbours' limits (a conservative interpolation never exceeds it),
    and the end's limit outside. The entries of a family and size travel as one array, so each box is
    joined with one row: the guideline file is small, whatever the boxes are.
    """
    lists = tall.where(F.col("axis") == axis).groupBy(F.lower("family").alias("_f"), F.round("size", 1).alias("_s")).agg(F.sort_array(F.collect_list(F.struct("dim", "limit"))).alias("_g"))
    joined = boxes.join(F.broadcast(lists), (F.lower("family") == F.col("_f")) & (F.round("size", 1) == F.col("_s")), "left")
    entries, at = F.col("_g"), F.col(dim)
    if how == "exact":
        found = F.get(F.filter(entries, lambda e: F.round(e["dim"], 1) == F.round(at, 1)), 0)["limit"]
    elif how == "nearest":
        found = F.array_min(F.transform(entries, lambda e: F.struct(F.abs(e["dim"] - at).alias("d"), e["dim"].alias("dim"), e["limit"].alias("limit"))))["limit"]
    else:
        below, above = F.filter(entries, lambda e: e["dim"] <= at), F.filter(entries, lambda e: e["dim"] >= at)
        found = F.least(F.get(below, F.size(below) - 1)["limit"], F.get(above, 0)["limit"])
    return joined.withColumn(column, found).drop("_f", "_s", "_g")


def _limit(entries: Column, at: Column) -> tuple[Column, Column]:
    """The limit of the entry with a dimension, to one decimal, else the smaller of its neighbours'; and which of the two it is."""
    same = F.get(F.filter(entries, lambda e: F.round(e["dim"], 1) == F.round(at, 1)), 0)["limit"]
    below, above = F.filter(entries, lambda e: e["dim"] <= at), F.filter(entries, lambda e: e["dim"] >= at)
    between = F.least(F.get(below, F.size(below) - 1)["limit"], F.get(above, 0)["limit"])
    return F.coalesce(same, between), F.when(same.isNotNull(), "exact match").otherwise("interpolated")


def guideline_limits(boxes: DataFrame, tall: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """``boxes`` with ``guide_lines``, ``guide_cpl`` and ``guide_details``: the limits of both axes, exact where an entry has the dimension.

    Sizes and dimensions are compared rounded to one decimal; else the limit is interpolated as in
    ``with_guideline``. A family and size is one row with both arrays, so there is one join.
    """
    entry = lambda axis: F.sort_array(F.collect_list(F.when(F.col("axis") == axis, F.struct("dim", "limit"))))
    lists = tall.groupBy(F.lower("family").alias("_f"), F.round("size", 1).alias("_s")).agg(entry("height").alias("_h"), entry("width").alias("_w"))
    families = tall.select(F.lower("family").alias("_known")).distinct()
    joined = boxes.join(F.broadcast(lists), (F.lower("family") == F.col("_f")) & (F.round("size", 1) == F.col("_s")), "left").join(F.broadcast(families), F.lower("family") == F.col("_known"), "left")

    (lines, how_h), (cpl, how_w) = _limit(F.col("_h"), F.col(height)), _limit(F.col("_w"), F.col(width))
    details = F.when(F.col("_known").isNull(), "No font guidelines available").otherwise(F.concat(F.lit("Height: "), how_h, F.lit("; Width: "), how_w))
    return joined.withColumns({"guide_lines": lines, "guide_cpl": cpl, "guide_details": details}).drop("_f", "_s", "_h", "_w", "_known")


def effective(computed: Column, guide: Column, mode: str = "minimum") -> Column:
    """Computed capacity and guideline as one limit: the smaller, or with ``replace`` the guideline where there is one."""
    return F.coalesce(guide, computed) if mode == "replace" else F.least(computed, guide)


def band(boxes: DataFrame, rules: list[tuple[float, float, int, int]]) -> DataFrame:
    """Boxes with the first of the rules (low, high, max_lines, max_cpl) whose size range holds their size: ``rule_ord``, ``max_lines``, ``max_cpl``."""
    hit = F.lit(None).cast("struct<rule_ord:int,max_lines:int,max_cpl:int>")
    for i, (low, high, lines, cpl) in reversed(list(enumerate(rules))):
        hit = F.when(F.col("size").between(low, high), F.struct(F.lit(i).alias("rule_ord"), F.lit(lines).alias("max_lines"), F.lit(cpl).alias("max_cpl"))).otherwise(hit)
    return boxes.withColumn("_h", hit).select(*boxes.columns, "_h.*")


def wrapped_lines(text: Column, cpl: Column) -> Column:
    """Lines that the segments of a text take at ``cpl`` characters, at least one each."""
    return F.aggregate(F.split(text, "\n", -1), F.lit(0), lambda a, s: a + F.greatest(F.lit(1), F.ceil(F.char_length(s) / cpl).cast("int")))


def font_fit(boxes: DataFrame, baseline: str = "size") -> DataFrame:
    """``boxes`` with ``fit_size``: the largest half-point size from the baseline to 6 at which the text fits.

    Fits: wrapped lines and characters stay within the capacity and its headroom. Nothing fits: 6.
    Without dimensions the baseline shrinks by the text's length. One array of sizes per row, no join.
    """
    text, base = F.col("text"), F.col(baseline)
    halves = F.when(base >= LEAST_SIZE, F.sequence((base * 2).cast("int"), F.lit(int(LEAST_SIZE * 2)), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    chars = F.char_length(F.replace(text, F.lit("\n"), F.lit("")))

    def fits(half: Column) -> Column:
        c = capacity(F.col("width"), F.col("height"), F.col("family"), half / 2)
        return (c["cpl"] > 0) & (c["lines"] > 0) & (wrapped_lines(text, F.greatest(c["cpl"], F.lit(1))) <= c["lines"]) & (chars <= (c["total"] * font_metric(F.col("family"), 3)).cast("int"))

    n = F.char_length(text)
    free = F.greatest(base * F.when(n > 100, 0.8).when(n > 50, 0.85).otherwise(0.9), F.lit(LEAST_SIZE))
    return boxes.withColumn("fit_size", F.when(F.col("has_dimensions"), F.coalesce(F.get(F.filter(halves, fits), 0) / 2, F.lit(LEAST_SIZE))).otherwise(free))


#: Sizes that a guideline prefers, in the order in which they are tried.
PREFERRED = (12.0, 10.0, 9.5, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5, 6.0)


def guided_fit(boxes: DataFrame, tall: DataFrame, id: str = "box_id") -> DataFrame:
    """``id`` and ``fit_size``: the largest half-point size from the baseline to 6 at which the text fits the guideline.

    Fits: wrapped lines and characters stay within its lines and lines times characters. If nothing does,
    the first preferred size whose lines take what the text needs at the baseline, if its lines fit there;
    then the first search again without line breaks; then 6. Without dimensions the baseline shrinks by the
    text's length. A family is one row with the limits of all its sizes: one join, and the search is in the row.
    """
    text, base = F.col("text"), F.col("size")
    halves = F.when(base >= LEAST_SIZE, F.transform(F.sequence((base * 2).cast("int"), F.lit(int(LEAST_SIZE * 2)), F.lit(-1)), lambda h: h / 2)).otherwise(F.array().cast("array<double>"))
    tried = F.sort_array(F.array_distinct(F.concat(halves, F.array(*(F.lit(p) for p in PREFERRED)), F.array(base))), asc=False)
    of_axis = lambda axis: F.sort_array(F.collect_list(F.when(F.col("axis") == axis, F.struct("dim", "limit"))))
    by_size = tall.groupBy(F.lower("family").alias("_f"), F.round("size", 1).alias("_s")).agg(of_axis("height").alias("h"), of_axis("width").alias("w"))
    families = by_size.groupBy("_f").agg(F.map_from_entries(F.collect_list(F.struct("_s", F.struct("h", "w")))).alias("_g"))
    rows = boxes.join(F.broadcast(families), F.lower("family") == F.col("_f"), "left")

    def entry(size: Column) -> Column:
        room = capacity(F.col("width"), F.col("height"), F.col("family"), size)
        limits = F.try_element_at("_g", F.round(size, 1))
        (lines, _), (cpl, _) = _limit(limits["h"], F.col("height")), _limit(limits["w"], F.col("width"))
        return F.struct(size.alias("size"), lines.alias("lines"), cpl.alias("cpl"), ((room["lines"] > 0) & (room["cpl"] > 0)).alias("room"))

    # A Generate between the entries and what searches them, so that they are made once.
    rows = rows.select("*", F.explode(F.array(F.transform(tried, entry))).alias("_e"))
    at = lambda size: F.get(F.filter("_e", lambda e: e["size"] == size), 0)
    needed = lambda t, cpl: F.when(cpl > 0, wrapped_lines(t, F.greatest(cpl, F.lit(1)))).otherwise(F.size(F.split(t, "\n", -1)))

    def largest(t: Column) -> Column:
        chars = F.char_length(F.replace(t, F.lit("\n"), F.lit("")))
        fits = lambda e: F.array_contains(halves, e["size"]) & (needed(t, e["cpl"]) <= e["lines"]) & (chars <= e["lines"] * e["cpl"])
        return F.get(F.filter("_e", lambda e: F.coalesce(fits(e), F.lit(False))), 0)["size"]

    lines = needed(text, F.coalesce(at(base)["cpl"], F.lit(0)))
    likes = F.filter(F.array(*(F.struct(F.lit(p).alias("p"), at(F.lit(p)).alias("e")) for p in PREFERRED)), lambda x: F.coalesce(x["e"]["lines"] >= lines, F.lit(False)))
    first = F.get(likes, 0)
    preferred = F.when((first["e"]["cpl"] > 0) & first["e"]["room"] & (needed(text, first["e"]["cpl"]) <= first["e"]["lines"]), first["p"])
    flat = F.when(F.contains(text, F.lit("\n")), largest(F.replace(text, F.lit("\n"), F.lit(" "))))
    n = F.char_length(text)
    free = F.greatest(base * F.when(n > 100, 0.8).when(n > 50, 0.85).otherwise(0.9), F.lit(LEAST_SIZE))
    return rows.select(id, F.when(F.col("has_dimensions"), F.coalesce(largest(text), preferred, flat, F.lit(LEAST_SIZE))).otherwise(free).alias("fit_size"))
