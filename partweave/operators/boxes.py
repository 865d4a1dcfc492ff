"""Geometry of recognised boxes: overlap, merging of two engines, line merging and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partweave.functions.spans import bound
from partweave.profiles import Profile

OVERLAP = 0.5


def from_polygon(points: Column) -> Column:
    """Struct x, y, w, h of an array of points (x, y), truncated to whole pixels."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    low_x, low_y = F.array_min(xs).cast("int"), F.array_min(ys).cast("int")
    return F.struct(low_x.alias("x"), low_y.alias("y"), (F.array_max(xs) - F.array_min(xs)).cast("int").alias("w"), (F.array_max(ys) - F.array_min(ys)).cast("int").alias("h"))


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Struct x, y, w, h of two opposite corners in any order, truncated to whole pixels."""
    part = lambda v: v.cast("int")
    return F.struct(part(F.least(x1, x2)).alias("x"), part(F.least(y1, y2)).alias("y"), part(F.abs(x2 - x1)).alias("w"), part(F.abs(y2 - y1)).alias("h"))


def from_numbers(numbers: Column) -> Column:
    """Struct x, y, w, h of an array of four numbers (two corners) or of eight and more (points one after another); null of any other."""
    n = F.size(numbers)
    at = lambda k: F.get(numbers, F.lit(k))
    points = F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1), lambda k: F.struct(F.get(numbers, 2 * k).alias("x"), F.get(numbers, 2 * k + 1).alias("y")))
    return F.when(n == 4, from_corners(at(0), at(1), at(2), at(3))).when((n >= 8) & (n % 2 == 0), bound(points, from_polygon))


def iou(a: str, b: str) -> Column:
    """Intersection over union of two aliased boxes; 0 where they only touch."""
    c = lambda t, n: F.col(f"{t}.{n}")
    span = lambda p, s: F.least(c(a, p) + c(a, s), c(b, p) + c(b, s)) - F.greatest(c(a, p), c(b, p))
    common = F.greatest(span("x", "w"), F.lit(0)) * F.greatest(span("y", "h"), F.lit(0))
    return F.coalesce(F.try_divide(common, c(a, "w") * c(a, "h") + c(b, "w") * c(b, "h") - common), F.lit(0.0))


def intersects(a: str, b: str) -> Column:
    """Whether two boxes share an area; touching does not count."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "x") < c(b, "x") + c(b, "w")) & (c(b, "x") < c(a, "x") + c(a, "w")) & (c(a, "y") < c(b, "y") + c(b, "h")) & (c(b, "y") < c(a, "y") + c(a, "h"))


def overlaps(boxes: DataFrame, threshold: float = OVERLAP) -> DataFrame:
    """Pairs of one box of each engine of an image above the threshold: ``image_id``, ``easy_ord``, ``tess_ord``, ``iou``.

    An equi-join on the image with the rectangle test inside; an image has a screenful of boxes.
    """
    e, t = boxes.where("engine = 'easyocr'").alias("e"), boxes.where("engine = 'tesseract'").alias("t")
    on = (F.col("e.image_id") == F.col("t.image_id")) & intersects("e", "t") & (iou("e", "t") > threshold)
    return e.join(t, on).select("e.image_id", F.col("e.ord").alias("easy_ord"), F.col("t.ord").alias("tess_ord"), iou("e", "t").alias("iou"))


def unique_boxes(boxes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Boxes without a partner in the other engine (an anti-join)."""
    used = pairs.select("image_id", F.lit("easyocr").alias("engine"), F.col("easy_ord").alias("ord")).union(pairs.select("image_id", F.lit("tesseract"), "tess_ord"))
    return boxes.join(used.distinct(), ["image_id", "engine", "ord"], "left_anti")


def hybrid(boxes: DataFrame, threshold: float = OVERLAP) -> DataFrame:
    """Both engines' boxes merged: those without partner, and of each group the most confident.

    A second engine's box belongs to the first box of the first engine that it overlaps; a box of the
    first engine whose partners all belong to earlier ones is in neither part. Of equally confident
    boxes the first engine's wins, then the earlier.
    """
    pairs = overlaps(boxes, threshold)
    owner = pairs.groupBy("image_id", "tess_ord").agg(F.min("easy_ord").alias("group"))
    members = owner.select("image_id", "group", F.lit("tesseract").alias("engine"), F.col("tess_ord").alias("ord"))
    members = members.union(owner.select("image_id", "group", F.lit("easyocr"), F.col("group").alias("ord")).distinct())
    full = members.join(boxes, ["image_id", "engine", "ord"])
    best = F.struct("confidence", (F.col("engine") == "easyocr").cast("int").alias("e"), (-F.col("ord")).alias("o"))
    won = full.groupBy("image_id", "group").agg(F.max_by(F.struct("engine", "ord", "x", "y", "w", "h", "confidence", "text"), best).alias("b")).select("image_id", "b.*")
    columns = ["image_id", "engine", "ord", "x", "y", "w", "h", "confidence", "text"]
    alone = unique_boxes(boxes, pairs).select(columns)
    return alone.withColumn("reason", F.concat(F.lit("unique_"), "engine", F.lit("_detection"))).unionByName(won.select(columns).withColumn("reason", F.lit("highest_confidence")))


def merged_lines(boxes: DataFrame) -> DataFrame:
    """Neighbouring boxes of one line as one: ``image_id``, ``group``, ``text``, ``x``, ``y``, ``w``, ``h``, ``confidence``, ``n``.

    In order of (y, x) a box joins the one before it if their centres are less than half the mean height
    apart and the gap between them is less than three mean heights. Windows are per image.
    """
    order = Window.partitionBy("image_id").orderBy("y", "x", "ord")
    before = lambda c: F.lag(c).over(order)
    mean = (F.col("h") + before("h")) / 2
    apart = F.abs((F.col("y") + F.col("h") / 2) - (before("y") + before("h") / 2))
    gap = F.greatest(F.col("x") - (before("x") + before("w")), before("x") - (F.col("x") + F.col("w")), F.lit(0))
    joins = F.coalesce((apart < mean * 0.5) & (gap < mean * 3), F.lit(False))
    rows = boxes.withColumn("_new", (~joins).cast("int"))
    rows = rows.withColumn("group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    words = F.array_sort(F.collect_list(F.struct("x", "y", "ord", F.trim("text").alias("t"))))
    return rows.groupBy("image_id", "group").agg(
        F.array_join(F.filter(F.transform(words, lambda w: w["t"]), lambda t: t != ""), " ").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"),
    )


def sub_box(text: Column, start: Column, end: Column) -> Column:
    """Struct x, w of the part of a box that a stretch of its text takes, in proportion to characters."""
    n, begin = F.char_length(text), F.greatest(start, F.lit(0))
    x = F.col("x") + F.coalesce((F.try_divide(begin, n) * F.col("w")).cast("int"), F.lit(0))
    w = F.when(n > 0, F.greatest(F.lit(1), (F.greatest(end - begin, F.lit(0)) / F.greatest(n, F.lit(1)) * F.col("w")).cast("int"))).otherwise(F.col("w"))
    return F.struct(x.alias("x"), w.alias("w"))


#: Fixed values of clearing: least and share of the padding by width and height, room below, gap to a neighbour, distance at which one counts, least side.
PAD_X, PAD_Y, BELOW, GAP, NEAR, LEAST_SIDE = (5, 0.15), (8, 0.6), 20, 3, 10, 10
#: Fixed values where the pattern's own place is not known: share and additions of width and height, padding, and how far it may stand out.
FREE_W, FREE_H, FREE_PAD, FREE_OUT, PATTERN_OUT = (0.8, 20), (1.2, 15), 5, 10, 15
#: Pixels around a rectangle within which neighbours are looked for first.
AROUND = 40


def clear_rects(boxes: DataFrame, image_w: Column, image_h: Column) -> DataFrame:
    """``image_id``, ``engine``, ``ord`` and the rectangle ``cx``, ``cy``, ``cw``, ``ch`` to clear around the pattern in each box.

    ``boxes`` has ``start`` and ``end``, the characters that the pattern takes in ``text``, and ``pattern``
    (struct x, y, w, h of its own place, or null) and ``next_left`` (where the next token begins, or null).
    With a place the rectangle is that, padded by a share of its size, within the box and short of the next
    token; without one it is estimated from characters. Then the boxes of the image are taken in order, and
    each near one that the rectangle still reaches into pushes an edge back: a fold over those that touch its
    surroundings. A rectangle that leaves them (kept at its least side, it may move on) is folded over all.
    """
    c = F.col
    share = lambda at: F.least(F.greatest(at / F.greatest(F.char_length("text"), F.lit(1)), F.lit(0.0)), F.lit(1.0))
    left, right = (c("x") + (share(c(k)) * c("w")).cast("int") for k in ("start", "end"))
    free_x, free_y = F.greatest(c("x"), left - FREE_PAD), F.greatest(F.lit(0), c("y") - FREE_PAD)
    free = F.struct(
        free_x.alias("x"), free_y.alias("y"),
        F.least(F.greatest((c("w") * FREE_W[0]).cast("int"), right - left + FREE_W[1]), c("x") + c("w") - free_x + FREE_OUT).alias("w"),
        F.least(F.greatest((c("h") * FREE_H[0]).cast("int"), c("h") + FREE_H[1]), image_h - free_y).alias("h"),
    )
    p = c("pattern")
    pad_x, pad_y = (F.greatest(F.lit(least), (p[k] * part).cast("int")) for k, (least, part) in (("w", PAD_X), ("h", PAD_Y)))
    low_x, low_y = F.greatest(c("x"), p["x"] - pad_x), F.greatest(F.lit(0), p["y"] - pad_y)
    high_x = F.least(c("x") + c("w") + PATTERN_OUT, p["x"] + p["w"] + pad_x, c("next_left") - GAP)
    high_y = F.least(image_h, p["y"] + p["h"] + pad_y + BELOW)
    side = lambda n: F.greatest(F.lit(LEAST_SIDE), n)
    known = F.struct(low_x.alias("x"), low_y.alias("y"), side(high_x - low_x).alias("w"), side(high_y - low_y).alias("h"))
    # An image has a screenful of boxes: they travel as one array.
    others = boxes.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("ord", "engine", "x", "y", "w", "h"))).alias("_all"))
    rows = boxes.withColumn("_r", F.when(p.isNotNull(), known).otherwise(free)).join(others, "image_id")

    def pushed(r: Column, o: Column) -> Column:
        own = (o["x"] == c("x")) & (o["y"] == c("y")) & (o["w"] == c("w")) & (o["h"] == c("h"))
        meet = (o["x"] < r["x"] + r["w"]) & (r["x"] < o["x"] + o["w"]) & (o["y"] < r["y"] + r["h"]) & (r["y"] < o["y"] + o["h"])
        apart = lambda k, n: F.least(F.abs(o[k] - (r[k] + r[n])), F.abs(o[k] + o[n] - r[k]))
        touched = ~own & meet & ((apart("x", "w") < NEAR) | (apart("y", "h") < NEAR))

        def edge(k: str, n: str) -> tuple[Column, Column]:
            beyond, before = o[k] > r[k] + r[n] / 2, o[k] + o[n] < r[k] + r[n] / 2
            at = F.when(touched & ~beyond & before, o[k] + o[n] + GAP).otherwise(r[k])
            return at, F.when(touched & beyond, side(o[k] - GAP - r[k])).when(touched & before, side(r[k] + r[n] - (o[k] + o[n] + GAP))).otherwise(r[n])

        (x, w), (y, h) = edge("x", "w"), edge("y", "h")
        return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))

    def inside(r: Column) -> Column:
        spans = ((r[k] >= c("_r")[k] - AROUND) & (r[k] + r[n] <= c("_r")[k] + c("_r")[n] + AROUND) for k, n in (("x", "w"), ("y", "h")))
        return next(spans) & next(spans)

    typed = F.struct(*(F.col("_r")[k].cast("int").alias(k) for k in ("x", "y", "w", "h")))
    near = F.filter("_all", lambda o: (o["x"] <= c("_r.x") + c("_r.w") + AROUND) & (c("_r.x") - AROUND <= o["x"] + o["w"]) & (o["y"] <= c("_r.y") + c("_r.h") + AROUND) & (c("_r.y") - AROUND <= o["y"] + o["h"]))
    watched = F.struct(typed.alias("r"), F.lit(True).alias("in"))
    # Each step is computed once and then looked at.
    followed = F.aggregate(near, watched, lambda s, o: bound(pushed(s["r"], o), lambda r: F.struct(r.alias("r"), (s["in"] & inside(r)).alias("in"))))
    rows = rows.withColumn("_r", bound(followed, lambda s: F.when(s["in"], s["r"]).otherwise(F.aggregate("_all", typed, pushed))))
    x, y = (F.greatest(F.lit(0), F.least(c("_r")[k], size - LEAST_SIDE)) for k, size in (("x", image_w), ("y", image_h)))
    rows = rows.withColumn("cx", x).withColumn("cy", y)
    return rows.select("image_id", "engine", "ord", "cx", "cy", side(F.least(c("_r.w"), image_w - c("cx"))).alias("cw"), side(F.least(c("_r.h"), image_h - c("cy"))).alias("ch"))


def token_rectangle(tokens: Column, target: Column, glue: str = "") -> Column:
    """Struct x, y, w, h of the run of tokens (struct text, x, y, w, h, in order) that spells ``target``, and ``next_left``; null without one.

    A token continues the run while the target begins with the run, ``glue`` and the token; the run is
    kept with blanks between tokens, and it is found once it is the target. With the default glue only
    targets of one token are found, as programs that compare so find them; a blank finds longer ones.
    """
    run = "struct<spelt:string,first:int,last:int>"

    def step(a: Column, i: Column) -> Column:
        token = F.get(tokens, i)["text"]
        spelt = F.concat(a["spelt"], F.when(a["spelt"] == "", "").otherwise(glue), token)
        goes = a["last"].isNull() & F.startswith(target, F.trim(spelt))
        longer = F.trim(F.concat_ws(" ", a["spelt"], token))
        return F.when(
            F.coalesce(goes, F.lit(False)),
            F.struct(longer.alias("spelt"), F.coalesce(a["first"], i).alias("first"), F.when(longer == target, i).alias("last")),
        ).otherwise(a)

    zero = F.struct(F.lit("").alias("spelt"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")).cast(run)
    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))

    def rectangle(f: Column) -> Column:
        a, z = F.get(tokens, f["first"]), F.get(tokens, f["last"])
        box = F.struct(a["x"].alias("x"), F.least(a["y"], z["y"]).alias("y"), (z["x"] + z["w"] - a["x"]).alias("w"), F.greatest(a["h"], z["h"]).alias("h"), F.get(tokens, f["last"] + 1)["x"].alias("next_left"))
        return F.when(f["last"].isNotNull(), box)

    return bound(F.aggregate(places, zero, step), rectangle)


def confident(boxes: DataFrame, profile: Profile) -> DataFrame:
    """Recognised boxes that the profile takes: of its engines, at least as confident as it asks, and with some text."""
    engine = F.lit(True) if profile.ocr_engine == "hybrid" else F.col("engine") == profile.ocr_engine
    return boxes.where(engine & (F.col("confidence") >= profile.min_confidence) & (F.trim("text") != ""))


#: Fixed value: pixels below which an image is too small for its orientation to be told.
LEAST_AREA = 200_000


def large_enough(width: Column, height: Column) -> Column:
    return width * height >= LEAST_AREA


#: Orientations that raise the confidence of an analysis.
STANDARD_ANGLES = (0.0, 90.0, 180.0, 270.0)


def analysis_confidence(area: Column, angle: Column, contrast: Column) -> Column:
    """Confidence of a text analysis: 0.5, and more for a large region, a standard angle and high contrast; 1 at most."""
    more = lambda test, by: F.when(test, by).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + more(area > 1000, 0.2) + more(angle.isin(*STANDARD_ANGLES), 0.2) + more(contrast > 50, 0.1))


def recommendations(rotated: Column, size: Column, confidence: Column) -> Column:
    """What an analysis asks for, in order; ``standard`` if nothing."""
    asked = F.array_compact(F.array(F.when(rotated, "rotation_correction"), F.when(size < 10, "upscaling"), F.when(confidence < 0.7, "preprocessing_enhancement")))
    return F.when(F.size(asked) > 0, asked).otherwise(F.array(F.lit("standard")))


def best_variant(rows: DataFrame) -> DataFrame:
    """Of each image's preprocessing variants the one with the highest mean confidence, the first of equals."""
    means = rows.groupBy("image_id", "variant").agg(F.avg("confidence").alias("mean_confidence"), F.count(F.lit(1)).alias("n"))
    return means.groupBy("image_id").agg(F.max_by(F.struct("variant", "mean_confidence", "n"), F.struct("mean_confidence", (-F.col("variant")).alias("v"))).alias("b")).select("image_id", "b.*")


def orientation_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Score of an orientation: 10 a region, 50 times the mean confidence, up to 20 for length, 5 for each sure and -2 for each doubtful region."""
    sure, doubtful = F.count_if(F.col("confidence") > 0.8), F.count_if(F.col("confidence") < 0.3)
    length = F.least(F.sum(F.char_length("text")) * 0.1, F.lit(20.0))
    score = F.count(F.lit(1)) * 10 + F.avg("confidence") * 50 + length + sure * 5 - doubtful * 2
    return rows.groupBy(*keys).agg(F.greatest(score, F.lit(0.0)).alias("score"))


def orientation_vote(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent quarter turn, the smallest of equals."""
    counts = rows.groupBy(*keys, quarter_turn(F.col("angle")).alias("turn")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by("turn", F.struct("n", (-F.col("turn")).alias("t"))).alias("turn"))


def quarter_turn(angle: Column) -> Column:
    """The nearest of 0, 90, 180 and 270 degrees on the circle, the smaller of equals."""
    turned = F.pmod(angle, F.lit(360))
    options = F.array(*(F.struct(F.least(F.abs(turned - a), 360 - F.abs(turned - a)).alias("d"), F.lit(a).alias("a")) for a in (0, 90, 180, 270)))
    return F.array_min(options)["a"]


def table_score(parts: Column, sevens: Column, artifacts: Column, table: Column) -> Column:
    return parts * 100 + sevens * 50 + artifacts * 10 + table * 1000


def reconstruction(height: Column, length: Column, width: Column) -> Column:
    """Struct font_size, num_lines and dimensions by the height and text length bands."""
    size = F.when(height < 20, 12).when(height < 40, 16).otherwise(20)
    lines = F.when(length <= 30, 1).otherwise(2)
    return F.struct(size.alias("font_size"), lines.alias("num_lines"), F.greatest(width + 20, F.lit(100)).alias("width"), (height * lines + 20).alias("height"))


#: Preprocessing strategies in order, and when each suits an image.
STRATEGIES = (
    ("contrast", lambda: F.col("contrast") < 0.3), ("denoise", lambda: F.col("noise") > 200), ("sharpen", lambda: F.col("sharpness") < 30), ("rotate", lambda: F.lit(True)),
    ("brighten", lambda: F.col("brightness") < 80), ("darken", lambda: F.col("brightness") > 200), ("standard", lambda: F.lit(True)),
)


def strategies() -> Column:
    """Names of the strategies that suit an image's quality measures."""
    return F.array_compact(F.array(*(F.when(test(), name) for name, test in STRATEGIES)))


#: Findings from quality measures, in order.
BANDS = (
    ("Too dark", lambda: F.col("brightness") < 50), ("Too bright", lambda: F.col("brightness") > 200), ("Low contrast", lambda: F.col("contrast") < 30),
    ("Blurry/Low sharpness", lambda: F.col("sharpness") < 100), ("Very few edges (may not contain text)", lambda: F.col("edge_density") < 0.01),
)


def quality_bands() -> Column:
    """What is wrong with an image for recognition, as one text."""
    issues = F.array_compact(F.array(*(F.when(test(), name) for name, test in BANDS)))
    return F.when(F.size(issues) > 0, F.concat(F.lit("Issues: "), F.array_join(issues, ", "))).otherwise("Good quality for OCR")


#: Degrees from upright within which text is level; share of dark pixels from which it is bold.
LEVEL, BOLD = 45, 0.3


def level(angle: Column) -> Column:
    """Whether text at an angle lies level: within 45 degrees of 0 or of 180."""
    return (F.abs(angle) < LEVEL) | (F.abs(angle - 180) < LEVEL)


def estimated_size(height: Column, width: Column | None = None, angle: Column | None = None, dark: Column | None = None) -> Column:
    """Struct font_size (8 to 72), baseline, line height and bold from a box.

    Level text is as high as its box, turned text as its box is wide, and its baseline is the middle of the
    box. Bold from a share of dark pixels, false without one.
    """
    flat = F.lit(True) if angle is None else level(angle)
    tall = height if width is None else F.when(flat, height).otherwise(width)
    baseline = F.when(flat, height * 0.8).otherwise(F.floor(height / 2))
    return F.struct(
        F.least(F.greatest(tall, F.lit(8)), F.lit(72)).alias("font_size"), baseline.alias("baseline"), (tall * 1.2).alias("line_height"), (F.lit(False) if dark is None else F.coalesce(dark > BOLD, F.lit(False))).alias("bold")
    )


def formatted(style: str) -> Column:
    """A box as text: ``named``, ``corners`` or ``plain``."""
    x2, y2 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    pattern, values = {"named": ("x=%d, y=%d, w=%d, h=%d", ["x", "y", "w", "h"]), "corners": ("(%d,%d)-(%d,%d)", ["x", "y", x2, y2]), "plain": ("%d,%d,%d,%d", ["x", "y", x2, y2])}[style]
    return F.format_string(pattern, *values)


