"""Registered queries over the driver's tables. SQL for them is in ``oracles``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.functions import spans
from partweave.operators import boxes as geometry
from partweave.operators import capacity as cap
from partweave.operators import dedupe, fonts, metadata, neighbours, report, rewrite
from partweave.operators import wrapping
from partweave.operators.detect import detections, mapped_detections, resolved_detections, self_test
from partweave.operators.lookup import debug_counts, lookup, mapped, with_default
from partweave.plans import inputs, oracles_sizing, sizing
from partweave.plans.oracles import ORACLES as ORACLES
from partweave.processors import Registration, processor, routed
from partweave.profiles import CANONICAL, CLASSIC, PART_PATTERNS, PROFILES, PatternSet
from partweave.session import dealt, spread, work_folder
from partweave.sources import docx, files, sinks, sized
from partweave.streaming import incremental, intake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
C = F.col


def query(f: Query) -> Query:
    QUERIES[f.__name__.removeprefix("q_")] = f
    return f


def corpus(s: SparkSession, d: str) -> DataFrame:
    return spread(inputs.spark(s, d, inputs.CORPUS))


def corpus_by_unit(s: SparkSession, d: str) -> DataFrame:
    """The corpus for joins by unit; the footers tell how many units there are."""
    return dealt(inputs.spark(s, d, inputs.CORPUS), s.read.parquet(f"{d}/orders.parquet").count(), "unit_id")


def mapping(s: SparkSession, d: str) -> DataFrame:
    return inputs.spark(s, d, inputs.MAPPING)


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Detection, lookup by all tiers, default, and the rewritten text, in one plan."""
    profile = CANONICAL.__class__("flagship")
    units = corpus(s, d)
    rows = rewrite.with_spans(units, resolved_detections(units, mapping(s, d), profile), profile.text_mode, profile.separator)
    hits = rows.select("unit_id", F.explode("spans").alias("m"), "final_text")
    return hits.select("unit_id", "m.pattern_name", "m.matched_text", "m.start_pos", "m.end_pos", "m.replacement", "m.is_default", "final_text")


# Detection


@query
def q_detect_all(s: SparkSession, d: str) -> DataFrame:
    return detections(corpus(s, d))


@query
def q_detect_plain(s: SparkSession, d: str) -> DataFrame:
    """The raw patterns, as the profile without hardening has them."""
    return detections(corpus(s, d), enhanced=False)


@query
def q_detect_compiled(s: SparkSession, d: str) -> DataFrame:
    """A pattern file with one that does not compile: the others are used as they compile, hardened where they do."""
    given = PatternSet((("broken", "77-([0-9"), *PART_PATTERNS.patterns, ("_note", "77-[")))
    kept, _ = spans.compiled(s, given)
    return detections(corpus(s, d), kept, enhanced=False)


@query
def q_detect_mapped(s: SparkSession, d: str) -> DataFrame:
    return mapped_detections(corpus(s, d), mapping(s, d))


@query
def q_match_context(s: SparkSession, d: str) -> DataFrame:
    rows = detections(corpus(s, d), width=5)
    return rows.select("unit_id", "start_pos", "preceding_context", "following_context")


@query
def q_pattern_part(s: SparkSession, d: str) -> DataFrame:
    units = corpus(s, d)
    return units.select("unit_id", spans.part_of(C("text")).alias("part"), spans.token_of(C("text")).alias("token"))


@query
def q_char_profile(s: SparkSession, d: str) -> DataFrame:
    """Counts of characters by class; classes are counted in the row, characters are not shuffled."""
    text = spread(s.read.parquet(f"{d}/documents.parquet").select(F.coalesce("text", F.lit("")).alias("t")))
    rest = lambda cls: F.char_length(F.regexp_replace("t", f"[{cls}]", ""))
    n = F.char_length("t")
    sums = {"digit": n - rest("0-9"), "ascii_letter": n - rest("A-Za-z"), "space": n - rest(r" \t\n\r"), "punctuation": n - rest(r"!-/:-@\[-`{-~"), "unicode": n - F.char_length(F.regexp_replace("t", r"[^\x00-\x7F]", ""))}
    totals = text.agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    return totals.select(F.explode(F.array(*(F.struct(F.lit(k).alias("class"), C(k).alias("n")) for k in sums))).alias("x")).select("x.*")


@query
def q_top_characters(s: SparkSession, d: str) -> DataFrame:
    """How often each character stands in the documents."""
    return report.characters(spread(s.read.parquet(f"{d}/documents.parquet")).select("text"))


@query
def q_character_classes(s: SparkSession, d: str) -> DataFrame:
    """Every character of the documents with its class; classes are told of distinct characters, not of each one."""
    return q_top_characters(s, d).select("ch", spans.character_class(C("ch")).alias("class"), "n")


@query
def q_paragraph_scan(s: SparkSession, d: str) -> DataFrame:
    """Non-blank paragraphs of documents with their place, length and whether an address stands in them."""
    docs = spread(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("paragraph", "t")).where(F.trim("t") != "")
    return rows.select("doc_id", "paragraph", F.char_length("t").alias("n_chars"), C("t").rlike(r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z]+").alias("has_address"))


# Lookup


@query
def q_lookup_exact(s: SparkSession, d: str) -> DataFrame:
    return lookup(detections(corpus(s, d)), "matched_text", mapping(s, d), ("exact",)).select("unit_id", "start_pos", "matched_text", "replacement")


@query
def q_lookup_tiered(s: SparkSession, d: str) -> DataFrame:
    return lookup(detections(corpus(s, d)), "matched_text", mapping(s, d)).select("unit_id", "start_pos", "matched_text", "replacement", "tier")


@query
def q_mapped_only(s: SparkSession, d: str) -> DataFrame:
    return mapped(detections(corpus(s, d)), "matched_text", mapping(s, d)).select("unit_id", "start_pos", "matched_text")


@query
def q_unmapped_default(s: SparkSession, d: str) -> DataFrame:
    rows = with_default(lookup(detections(corpus(s, d)), "matched_text", mapping(s, d), ("exact",)), "append", "4022-NA")
    return rows.groupBy("is_default", "pattern_name").agg(F.count(F.lit(1)).alias("n"))


@query
def q_match_debug(s: SparkSession, d: str) -> DataFrame:
    units = corpus(s, d)
    rows = lookup(detections(units), "matched_text", mapping(s, d), ("exact",)).select("unit_id", C("matched_text").alias("text"), "replacement")
    return debug_counts(corpus_by_unit(s, d).select("unit_id").join(rows, "unit_id", "left"))


# Rewriting


@query
def q_rewrite_append(s: SparkSession, d: str) -> DataFrame:
    units = corpus(s, d)
    rows = with_default(lookup(detections(units), "matched_text", mapping(s, d)), "append", "4022-NA")
    return rewrite.rewrite(units, rows, "append", ";").select("unit_id", "final_text")


@query
def q_rewrite_replace(s: SparkSession, d: str) -> DataFrame:
    units = corpus(s, d)
    rows = with_default(lookup(detections(units), "matched_text", mapping(s, d)), "replace", None)
    return rewrite.rewrite(units, rows, "replace", "").select("unit_id", "final_text")


def runs(s: SparkSession, d: str) -> DataFrame:
    """Text units with detections, cut into runs of seven characters; ``hits`` has all their detections."""
    units = corpus(s, d).where(spans.may_match(C("text"), PART_PATTERNS))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / 7).cast("int")), lambda i: F.struct(i.alias("run_idx"), F.substring(C("text"), i * 7 + 1, F.lit(7)).alias("text")))
    # A Generate between detection and what uses it: a filter on the detections would have them made twice.
    rows = units.select("unit_id", "text", F.explode(F.array(spans.resolved(spans.found_all(C("text"), PART_PATTERNS)))).alias("hits")).where(F.size("hits") > 0)
    return rows.select("unit_id", rewrite.with_offsets(pieces).alias("runs"), "hits")


@query
def q_run_spans(s: SparkSession, d: str) -> DataFrame:
    """The runs that each detection touches."""
    touched = lambda m: F.transform(rewrite.overlapping(C("runs"), m["start"], m["end"]), lambda r: F.struct(m["start"].alias("start_pos"), r["run_idx"].alias("run_idx"), r["start"].alias("start"), r["end"].alias("end")))
    return runs(s, d).select("unit_id", F.inline(F.flatten(F.transform("hits", touched))))


@query
def q_run_rewrite(s: SparkSession, d: str) -> DataFrame:
    """All runs of units with detections, after each detection has its default appended."""
    finals = F.transform("hits", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.concat(m["text"], F.lit(";4022-NA")).alias("final")))
    return runs(s, d).select("unit_id", F.explode(rewrite.rewrite_runs(C("runs"), finals)).alias("r")).select("unit_id", "r.run_idx", "r.text")


@query
def q_dedupe_spans(s: SparkSession, d: str) -> DataFrame:
    """Replacements that the hardened and the plain patterns list; what both list stays once."""
    listed = lambda enhanced: F.transform(spans.resolved(spans.found_all(C("text"), PART_PATTERNS, enhanced)), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("final")))
    units = corpus(s, d).where(spans.may_match(C("text"), PART_PATTERNS)).select("unit_id", F.explode(F.array(F.concat(listed(True), listed(False)))).alias("all"))
    return units.select("unit_id", F.size("all").alias("listed"), F.size(rewrite.distinct_spans(C("all"))).alias("kept"))


@query
def q_newline_offsets(s: SparkSession, d: str) -> DataFrame:
    """Detections in texts whose blanks are line breaks, with their place among the joined pieces."""
    units = corpus(s, d).withColumn("text", F.replace("text", F.lit(" "), F.lit("\n")))
    some = units.where(spans.may_match(C("text"), PART_PATTERNS)).select("unit_id", "text", F.explode(F.array(spans.resolved(spans.found_all(C("text"), PART_PATTERNS)))).alias("hits"))
    starts = F.transform("hits", lambda m: m["start"])
    return some.select("unit_id", F.inline(F.arrays_zip(starts.alias("start_pos"), rewrite.newline_adjusted(C("text"), starts).alias("adjusted"))))


@query
def q_self_test(s: SparkSession, d: str) -> DataFrame:
    """Whether the distinct matches of a unit are the tags it was made with."""
    k = inputs._K
    tags = s.read.parquet(f"{d}/orders.parquet").select(
        C("o_orderkey").alias("unit_id"),
        F.expr(f"array_compact(array(CASE WHEN o_orderkey % 5 = 0 THEN {inputs.tag2(k)} ELSE {inputs.tag(k)} END, CASE WHEN o_orderkey % 3 = 0 THEN {inputs.tag('(o_orderkey * 3) % 2000 + 1')} END))").alias("expected"),
    )
    return self_test(corpus_by_unit(s, d).join(tags, "unit_id")).select("unit_id", F.array_join("detected", ",").alias("detected"), "passed")


@query
def q_split_around(s: SparkSession, d: str) -> DataFrame:
    before, after = rewrite.around(C("text"), C("part"))
    rows = corpus(s, d).withColumn("part", spans.part_of(C("text"))).where("part IS NOT NULL")
    return rows.select("unit_id", before.alias("before"), after.alias("after"), rewrite.replace_first(C("text"), C("part"), F.lit("X")).alias("replaced"))


# Deduplication


@query
def q_dedupe_cells(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/orders.parquet").select(
        (C("o_orderkey") % 97).alias("doc_id"), C("o_orderkey").alias("ord"), (C("o_custkey") % 40).cast("string").alias("matched_text"), F.lit("4022").alias("replacement"),
        F.when(C("o_orderkey") % 2 == 0, F.concat(F.lit("section_0_table_"), (C("o_orderkey") % 3).cast("string"), F.lit("_row_"), (C("o_orderkey") % 11).cast("string"), F.lit("_cell_1")))
        .otherwise(F.concat(F.lit("paragraph_"), (C("o_orderkey") % 5).cast("string"))).alias("location"),
    )
    return dedupe.cells(rows).select("doc_id", "ord", "location", "matched_text")


@query
def q_dedupe_textbox(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/orders.parquet").select((C("o_orderkey") % 500).alias("unit_id"), C("o_orderkey").alias("start_pos"), (C("o_custkey") % 9).cast("string").alias("matched_text"), C("o_orderstatus").alias("replacement"))
    return dedupe.textbox(rows)


def recognised(s: SparkSession, d: str) -> DataFrame:
    return inputs.spark(s, d, inputs.BOXES)


@query
def q_dedupe_ocr(s: SparkSession, d: str) -> DataFrame:
    return dedupe.recognised(recognised(s, d)).select("image_id", "engine", "ord", "x", "y")


@query
def q_dedupe_image_best(s: SparkSession, d: str) -> DataFrame:
    rows = recognised(s, d).withColumn("is_mapped", C("ord") % 3 == 0).withColumn("text", F.substring("text", 1, 3)).withColumn("ord", C("ord") * 2 + (C("engine") == "easyocr").cast("int"))
    return dedupe.image_best(rows)


@query
def q_dedupe_variants(s: SparkSession, d: str) -> DataFrame:
    return dedupe.variants(recognised(s, d).select("w", "h", "engine"), ["w", "h", "engine"]).groupBy("engine").agg(F.count(F.lit(1)).alias("n"))


# Files


def file_rows(s: SparkSession, d: str) -> DataFrame:
    return inputs.spark(s, d, inputs.FILES)


@query
def q_file_filter_reason(s: SparkSession, d: str) -> DataFrame:
    reason = F.coalesce(files.skip_reason(CANONICAL, C("magic") == "PK34"), F.lit("accepted"))
    return file_rows(s, d).select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query
def q_listed_files(s: SparkSession, d: str) -> DataFrame:
    """A folder that is listed: files that orders are written to, by status, with what their extension and content say."""
    folder = work_folder(s)
    s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus").repartition("o_orderstatus").write.partitionBy("o_orderstatus").json(folder)
    rows = files.listing(s, f"{folder}/*", "*.json").withColumn("status", F.element_at(F.split("parent", "="), -1))
    lines = F.size(F.filter(F.split(C("content").cast("string"), "\n"), lambda x: x != ""))
    reason = F.coalesce(files.skip_reason(CANONICAL), F.lit("accepted"))
    return rows.groupBy("status", "ext", reason.alias("reason")).agg(F.sum(lines).alias("n_lines"), F.min(C("length") > 0).alias("filled"))


@query
def q_stem_dedupe(s: SparkSession, d: str) -> DataFrame:
    return files.discover(file_rows(s, d), CANONICAL, C("magic") == "PK34").select("stem", "ext", "file_id")


@query
def q_output_names(s: SparkSession, d: str) -> DataFrame:
    rows = file_rows(s, d)
    return rows.select("file_id", files.output_stem(C("stem"), CANONICAL).alias("output_stem"), files.safe_name(C("stem")).alias("safe_name"), report.size_text(C("length")).alias("size_text"))


@query
def q_classic_files(s: SparkSession, d: str) -> DataFrame:
    return files.classic_filter(file_rows(s, d), CLASSIC).select("file_id", files.output_stem(C("stem"), CLASSIC).alias("output_stem"))


@query
def q_file_union(s: SparkSession, d: str) -> DataFrame:
    """Files that either of two listings has, each once."""
    name = ["parent", "stem", "ext"]
    rows = file_rows(s, d)
    return rows.where(C("ext").isin(".doc", ".docx")).select(name).union(rows.where(C("length") > 0).select(name)).distinct()


# Capacity


def text_boxes(s: SparkSession, d: str) -> DataFrame:
    return inputs.spark(s, d, inputs.TEXTBOXES)


@query
def q_capacity(s: SparkSession, d: str) -> DataFrame:
    c = cap.capacity(C("width"), C("height"), C("family"), C("size"))
    return text_boxes(s, d).select("box_id", c.alias("c")).select("box_id", "c.lines", "c.cpl", "c.total", F.round("c.per_sq_in", 4).alias("per_sq_in"))


@query
def q_capacity_root(s: SparkSession, d: str) -> DataFrame:
    c = cap.classic_capacity(C("width"), C("height"), C("size"), C("has_dimensions"))
    return text_boxes(s, d).select("box_id", c.alias("c")).select("box_id", "c.max_lines", "c.max_cpl")


@query
def q_line_map(s: SparkSession, d: str) -> DataFrame:
    m = cap.line_map(C("width"), C("height"), C("has_dimensions"))
    return text_boxes(s, d).select("box_id", F.explode(m).alias("font_size", "max_lines"))


@query
def q_size_for_lines(s: SparkSession, d: str) -> DataFrame:
    target = (C("box_id") % 6 + 1).cast("int")
    return text_boxes(s, d).select("box_id", F.round(cap.size_for_lines(C("width"), C("height"), target, C("has_dimensions")), 4).alias("font_size"))


@query
def q_size_grid(s: SparkSession, d: str) -> DataFrame:
    """Every box at every size of the grid: the size check."""
    rows = text_boxes(s, d).withColumn("grid_size", F.explode(F.array(*(F.lit(float(x)) for x in (6, 7, 8, 9, 10, 12)))))
    c = cap.size_check(C("width"), C("height"), C("family"), C("grid_size"), F.char_length("text"))
    return rows.select("box_id", "grid_size", c.alias("c")).select("box_id", "grid_size", "c.lines", "c.cpl", "c.total", "c.fits")


#: A small guideline table for the queries: limit = floor of a dimension over the size.
GUIDE = {"fonts": {f: {"lines_by_height": {str(h): {str(s / 2): int(h * 2 // (s * 3 / 2)) for s in range(12, 25)} for h in (15, 25, 40, 60)}, "cpl_by_width": {str(w): {str(s / 2): int(w * 4 // s) for s in range(12, 25)} for w in (80, 130, 200)}} for f in ("Arial", "Times New Roman")}}
RULES = [(0.0, 6.5, 5, 40), (6.0, 8.0, 4, 30), (8.5, 12.0, 2, 20)]


@query
def q_guideline_nearest(s: SparkSession, d: str) -> DataFrame:
    rows = cap.with_guideline(text_boxes(s, d), cap.guidelines(s, GUIDE), "height", "height", "max_lines", "nearest")
    return rows.select("box_id", F.coalesce("max_lines", F.lit(-1)).alias("max_lines"))


@query
def q_guideline_exact(s: SparkSession, d: str) -> DataFrame:
    """Guideline entries of just the box's whole width and height."""
    boxes = text_boxes(s, d).withColumn("width", F.floor("width").cast("double")).withColumn("height", F.floor("height").cast("double"))
    rows = cap.with_guideline(cap.with_guideline(boxes, cap.guidelines(s, GUIDE), "height", "height", "max_lines", "exact"), cap.guidelines(s, GUIDE), "width", "width", "max_cpl", "exact")
    return rows.where("max_lines IS NOT NULL OR max_cpl IS NOT NULL").select("box_id", F.coalesce("max_lines", F.lit(-1)).alias("max_lines"), F.coalesce("max_cpl", F.lit(-1)).alias("max_cpl"))


@query
def q_guideline_fallback(s: SparkSession, d: str) -> DataFrame:
    """The nearest entry, and the computed capacity where a family has none."""
    rows = cap.with_guideline(text_boxes(s, d), cap.guidelines(s, GUIDE), "height", "height", "near", "nearest")
    return rows.select("box_id", F.coalesce("near", cap.capacity(C("width"), C("height"), C("family"), C("size"))["lines"]).alias("max_lines"))


@query
def q_guideline_interp(s: SparkSession, d: str) -> DataFrame:
    rows = cap.with_guideline(text_boxes(s, d), cap.guidelines(s, GUIDE), "width", "width", "max_cpl")
    return rows.select("box_id", F.coalesce("max_cpl", F.lit(-1)).alias("max_cpl"))


@query
def q_band_lookup(s: SparkSession, d: str) -> DataFrame:
    return cap.band(text_boxes(s, d), RULES).select("box_id", "rule_ord", "max_lines", "max_cpl")


@query
def q_font_fit(s: SparkSession, d: str) -> DataFrame:
    return cap.font_fit(text_boxes(s, d)).select("box_id", F.round("fit_size", 4).alias("fit_size"))


@query
def q_guided_fit(s: SparkSession, d: str) -> DataFrame:
    return cap.guided_fit(spread(text_boxes(s, d)), cap.guidelines(s, GUIDE)).select("box_id", F.round("fit_size", 4).alias("fit_size"))


@query
def q_overflow_scale(s: SparkSession, d: str) -> DataFrame:
    over, factor = cap.scale(C("text"), C("size"), C("width"), C("height"), C("has_dimensions"))
    return text_boxes(s, d).select("box_id", over.alias("overflow"), F.round(factor, 9).alias("factor"))


@query
def q_source_lines(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", cap.source_lines(C("text")).alias("n_lines"))


@query
def q_wrap_lines(s: SparkSession, d: str) -> DataFrame:
    rows = wrapping.wrap_lines(spread(text_boxes(s, d)), cap.classic_capacity(C("width"), C("height"), C("size"), C("has_dimensions"))["max_cpl"])
    return rows.select("box_id", "required_lines", "max_line_length", F.array_join("lines", "\n").alias("wrapped"))


@query
def q_optimal_size(s: SparkSession, d: str) -> DataFrame:
    return wrapping.optimal_size(spread(text_boxes(s, d))).select("box_id", F.round("optimal_size", 4).alias("optimal_size"))


@query
def q_overflow_handler(s: SparkSession, d: str) -> DataFrame:
    return wrapping.overflow_size(spread(text_boxes(s, d))).select("box_id", F.round("new_size", 4).alias("new_size"), "adjusted")


@query
def q_guided_capacity(s: SparkSession, d: str) -> DataFrame:
    """Guideline limits and the capacity that they leave, as the smaller of both and as the guideline alone."""
    boxes = text_boxes(s, d).withColumn("width", F.floor("width").cast("double")).withColumn("height", F.floor("height").cast("double"))
    rows = cap.guideline_limits(boxes, cap.guidelines(s, GUIDE)).withColumn("c", cap.capacity(C("width"), C("height"), C("family"), C("size")))
    pairs = {f"{n}_{m}": cap.effective(C(f"c.{c}"), C(f"guide_{n}"), m) for n, c in (("lines", "lines"), ("cpl", "cpl")) for m in ("minimum", "replace")}
    none = lambda c: F.coalesce(c, F.lit(-1))
    return rows.select("box_id", none(C("guide_lines")).alias("guide_lines"), none(C("guide_cpl")).alias("guide_cpl"), "guide_details", *(v.alias(k) for k, v in pairs.items()))


@query
def q_size_reasoning(s: SparkSession, d: str) -> DataFrame:
    """Why the size is a tenth less, in half points, after the default was appended."""
    rows = cap.guideline_limits(text_boxes(s, d), cap.guidelines(s, GUIDE)).withColumn("new", F.concat("text", F.lit(";4022-NA"))).withColumn("half", F.floor(C("size") * 2 * 0.9) / 2)
    rows = rows.withColumn("c", cap.capacity(C("width"), C("height"), C("family"), C("half")))
    lines = F.when(C("has_dimensions") & (C("c.cpl") > 0), cap.wrapped_lines(C("new"), C("c.cpl"))).otherwise(F.size(F.split("new", "\n", -1)))
    return rows.select("box_id", fonts.reasoning(C("text"), C("new"), C("size"), C("half"), lines, C("c.total"), C("has_dimensions"), C("guide_details")).alias("r")).select("box_id", "r.*")


# Fonts


def styled(s: SparkSession, d: str) -> DataFrame:
    """Text units with their runs; a unit's runs come together, as in the document."""
    one = F.struct("run_idx", "text", "family", "size")
    return inputs.spark(s, d, inputs.RUNS).groupBy("unit_id").agg(F.sort_array(F.collect_list(one)).alias("runs"))


@query
def q_best_font(s: SparkSession, d: str) -> DataFrame:
    rows = styled(s, d).select("unit_id", fonts.best_run(C("runs")).alias("b"), fonts.baseline(C("runs")).alias("baseline"), fonts.described(C("runs")).alias("description"))
    return rows.select("unit_id", C("b.run_idx").alias("run_idx"), F.coalesce("b.family", F.lit("-")).alias("family"), F.coalesce("b.size", F.lit(-1.0)).alias("size"), "baseline", "description")


@query
def q_normalize_fonts(s: SparkSession, d: str) -> DataFrame:
    """Every run in its unit's best family and smallest size."""
    family = F.coalesce(fonts.best_run(C("runs"))["family"], F.lit(fonts.DEFAULT_FAMILY))
    return styled(s, d).select("unit_id", F.explode(fonts.normalized(C("runs"), family, fonts.baseline(C("runs")))).alias("r")).select("unit_id", "r.*")


# Boxes


@query
def q_iou_pairs(s: SparkSession, d: str) -> DataFrame:
    return geometry.overlaps(recognised(s, d)).withColumn("iou", F.round("iou", 5))


@query
def q_unique_boxes(s: SparkSession, d: str) -> DataFrame:
    rows = recognised(s, d)
    return geometry.unique_boxes(rows, geometry.overlaps(rows)).select("image_id", "engine", "ord")


@query
def q_hybrid_merge(s: SparkSession, d: str) -> DataFrame:
    return geometry.hybrid(recognised(s, d)).select("image_id", "engine", "ord", "confidence", "reason")


@query
def q_region_merge(s: SparkSession, d: str) -> DataFrame:
    rows = geometry.merged_lines(recognised(s, d).where("engine = 'easyocr'"))
    return rows.select("image_id", "group", "text", "x", "y", "w", "h", "n", F.round("confidence", 5).alias("confidence"))


@query
def q_sub_box(s: SparkSession, d: str) -> DataFrame:
    rows = recognised(s, d).withColumn("b", geometry.sub_box(C("text"), F.lit(2), F.lit(7)))
    return rows.select("engine", "ord", "b.x", "b.w")


@query
def q_clear_rect(s: SparkSession, d: str) -> DataFrame:
    """Half of the boxes know where the pattern itself stands, a quarter also the next token."""
    place = F.struct((C("x") + 5).alias("x"), (C("y") + 1).alias("y"), F.floor(C("w") / 2).cast("int").alias("w"), (C("h") - 2).alias("h"))
    rows = spread(recognised(s, d), "image_id").withColumn("start", F.lit(2)).withColumn("end", F.lit(7)).withColumn("pattern", F.when(C("ord") % 2 == 0, place))
    rows = rows.withColumn("next_left", F.when(C("ord") % 4 == 0, C("x") + F.floor(C("w") / 2).cast("int") + 9))
    return geometry.clear_rects(rows, F.lit(500), F.lit(150))


@query
def q_token_rectangle(s: SparkSession, d: str) -> DataFrame:
    """In each line of an image the rectangle of its third token's text."""
    token = F.struct("ord", F.element_at(F.split("text", " "), 1).alias("text"), "x", "y", "w", "h")
    lines = recognised(s, d).where("engine = 'easyocr'").groupBy("image_id", F.floor(C("y") / 40).cast("int").alias("line")).agg(F.sort_array(F.collect_list(token)).alias("tokens"))
    rows = lines.withColumn("target", F.get("tokens", 2)["text"])
    found = rows.select("image_id", "line", F.explode(F.array(geometry.token_rectangle(C("tokens"), C("target")))).alias("r")).where("r IS NOT NULL")
    return found.select("image_id", "line", "r.x", "r.y", "r.w", "r.h", F.coalesce("r.next_left", F.lit(-1)).alias("next_left"))


@query
def q_polygon_boxes(s: SparkSession, d: str) -> DataFrame:
    corner = lambda x, y: F.struct((C("x") + x).alias("x"), (C("y") + y).alias("y"))
    points = F.array(corner(0.7, 0.2), corner(C("w") + 0.3, -0.4), corner(C("w") + 0.0, C("h") + 0.9), corner(-0.6, C("h") + 0.0))
    return recognised(s, d).select("engine", "ord", F.explode(F.array(geometry.from_polygon(points))).alias("b")).select("engine", "ord", "b.*")


@query
def q_estimated_sizes(s: SparkSession, d: str) -> DataFrame:
    """Sizes from boxes of level and of turned text, some of it dark."""
    e = geometry.estimated_size(C("h"), C("w"), (C("ord") % 8 * 45).cast("double"), C("confidence"))
    rows = recognised(s, d).select("engine", "ord", e.alias("e"))
    return rows.select("engine", "ord", "e.font_size", F.round("e.baseline", 4).alias("baseline"), F.round("e.line_height", 4).alias("line_height"), "e.bold")


@query
def q_corner_boxes(s: SparkSession, d: str) -> DataFrame:
    """Boxes from two corners in any order, from eight numbers, and none from three."""
    right, low = C("x") + C("w") + 0.6, C("y") + C("h") + 0.3
    two = F.when(C("ord") % 2 == 0, F.array(C("x") + 0.4, C("y") + 0.2, right, low)).otherwise(F.array(right, low, C("x") + 0.4, C("y") + 0.2))
    four = F.array(C("x") + 0.4, C("y") + 0.2, right, C("y") + 0.0, right, low, C("x") + 0.0, low)
    numbers = F.when(C("ord") % 3 == 0, four).when(C("ord") % 10 == 1, F.slice(two, 1, 3)).otherwise(two)
    rows = recognised(s, d).select("engine", "ord", F.explode(F.array(geometry.from_numbers(numbers))).alias("b"))
    return rows.where("b IS NOT NULL").select("engine", "ord", "b.*")


@query
def q_confident_boxes(s: SparkSession, d: str) -> DataFrame:
    """The boxes that each profile takes."""
    rows = [geometry.confident(recognised(s, d), p).select(F.lit(p.name).alias("profile"), "image_id", "engine", "ord") for p in PROFILES.values()]
    return reduce(DataFrame.unionByName, rows)


@query
def q_image_matches(s: SparkSession, d: str) -> DataFrame:
    """Part numbers in recognised text, by each profile's engines, confidence, tiers and image mode."""
    boxes = recognised(s, d).withColumn("text", F.concat("text", F.lit(" "), F.expr(inputs.tag("ord"))))
    rows = [processor("image", p).run(boxes, mapping(s, d)).select(F.lit(p.name).alias("profile"), "engine", "ord", "matched_text", "is_default", "final") for p in PROFILES.values()]
    return reduce(DataFrame.unionByName, rows)


@query
def q_analysis_score(s: SparkSession, d: str) -> DataFrame:
    k = C("p_partkey")
    rows = s.read.parquet(f"{d}/part.parquet").select("p_partkey", (k % 2000).alias("area"), (k * 45 % 360).cast("double").alias("angle"), (k % 100).alias("contrast"), (k % 10 + 6).alias("size"), geometry.large_enough(k % 700, k % 600).alias("oriented"))
    rows = rows.withColumn("confidence", geometry.analysis_confidence(C("area"), C("angle"), C("contrast")))
    advice = geometry.recommendations(C("angle") != 0, C("size"), C("confidence"))
    return rows.select("p_partkey", "oriented", F.round("confidence", 4).alias("confidence"), F.array_join(advice, ",").alias("recommended"))


@query
def q_band_shrink(s: SparkSession, d: str) -> DataFrame:
    """The room right of a pattern in each box, and what is left of a band above and below it, by the neighbours."""
    rows, keys = recognised(s, d), ["image_id", "engine", "ord"]
    rows = rows.withColumn("start_x", C("x") + F.floor(C("w") / 2).cast("int") + 10)
    rows = rows.withColumns({"band_x": C("x") + 5, "band_top": C("y") - 2 * C("h"), "band_w": F.greatest(F.lit(10), F.floor(C("w") / 2).cast("int")), "band_h": 5 * C("h")})
    right = neighbours.right_widths(rows, rows, F.lit(500), keys)
    return right.join(neighbours.vertical_bands(rows, rows, F.lit(150), keys).hint("merge"), keys)


@query
def q_variant_pick(s: SparkSession, d: str) -> DataFrame:
    rows = recognised(s, d).withColumn("variant", (C("ord") % 3).cast("int"))
    return geometry.best_variant(rows).select("image_id", "variant", F.round("mean_confidence", 5).alias("mean_confidence"), "n")


@query
def q_orientation_score(s: SparkSession, d: str) -> DataFrame:
    rows = recognised(s, d).withColumn("angle", ((C("ord") % 4) * 90).cast("int"))
    return geometry.orientation_scores(rows, ["image_id", "angle"]).withColumn("score", F.round("score", 4))


@query
def q_orientation_vote(s: SparkSession, d: str) -> DataFrame:
    return geometry.orientation_vote(recognised(s, d).withColumn("angle", (C("ord") * 47) % 360), ["image_id"])


@query
def q_strategy_select(s: SparkSession, d: str) -> DataFrame:
    k = C("p_partkey")
    rows = s.read.parquet(f"{d}/part.parquet").select("p_partkey", (k % 10 / 10).alias("contrast"), (k * 7 % 300).alias("noise"), (k * 3 % 90).alias("sharpness"), (k * 11 % 255).alias("brightness"))
    return rows.select("p_partkey", F.array_join(geometry.strategies(), ",").alias("strategies"))


@query
def q_quality_bands(s: SparkSession, d: str) -> DataFrame:
    k = C("p_partkey")
    rows = s.read.parquet(f"{d}/part.parquet").select("p_partkey", (k * 11 % 255).alias("brightness"), (k * 7 % 90).alias("contrast"), (k * 3 % 300).alias("sharpness"), (k % 40 / 1000).alias("edge_density"))
    return rows.select("p_partkey", geometry.quality_bands().alias("quality"))


@query
def q_box_format(s: SparkSession, d: str) -> DataFrame:
    return recognised(s, d).select("engine", "ord", *(geometry.formatted(k).alias(k) for k in ("named", "corners", "plain")))


@query
def q_reconstruction(s: SparkSession, d: str) -> DataFrame:
    r = geometry.reconstruction(C("h"), F.char_length("text"), C("w"))
    return recognised(s, d).select("engine", "ord", r.alias("r")).select("engine", "ord", "r.*")


@query
def q_top_images(s: SparkSession, d: str) -> DataFrame:
    """The ten best images by table score."""
    rows = recognised(s, d).groupBy("image_id").agg(F.count_if(C("w") > 80).alias("parts"), F.count_if(C("h") > 16).alias("sevens"), F.count_if(C("x") < 50).alias("artifacts"), F.max("confidence").alias("table"))
    scored = rows.select("image_id", F.round(geometry.table_score(C("parts"), C("sevens"), C("artifacts"), C("table")), 4).alias("score"))
    return scored.orderBy(F.desc("score"), "image_id").limit(10)


# Reports


def results(s: SparkSession, d: str) -> DataFrame:
    return inputs.spark(s, d, inputs.RESULTS)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else C(c) for c, t in df.dtypes))


@query
def q_doc_stats(s: SparkSession, d: str) -> DataFrame:
    return rounded(report.statistics(results(s, d), ["doc_type"]))


@query
def q_batch_report(s: SparkSession, d: str) -> DataFrame:
    return rounded(report.batch_report(results(s, d), ["batch"]))


@query
def q_activity_shares(s: SparkSession, d: str) -> DataFrame:
    """Matches of each kind of event by batch, their mean over all documents and their share."""
    return rounded(report.activity_shares(results(s, d), ["batch"], ("click", "view", "purchase")))


@query
def q_activity_by_type(s: SparkSession, d: str) -> DataFrame:
    return rounded(report.activity(results(s, d))).select(F.coalesce("doc_type", F.lit("all")).alias("doc_type"), F.coalesce("processor", F.lit("all")).alias("processor"), "documents", "matches", "share")


@query
def q_review_files(s: SparkSession, d: str) -> DataFrame:
    return report.review_files(results(s, d))


def error_rows(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("ValueError", "OSError", "MemoryError", "ImportError", "KeyError", "PermissionError")))
    messages = F.array(*(F.lit(x) for x in ("could not parse", "conversion failed", "out of memory", "bad value", "connection lost", "invalid mapping", "denied")))
    rows = s.read.parquet(f"{d}/events.parquet").withColumn("t", F.get(names, (C("event_id") % 6).cast("int"))).withColumn("m", F.get(messages, (C("event_id") % 7).cast("int")))
    return rows.select(C("event_id").alias("ord"), (C("user_id") % 20).alias("batch"), report.category(C("t"), C("m")).alias("category"), report.severity(C("t")).alias("severity"), (C("event_id") % 4 == 0).alias("fallback_used"))


@query
def q_error_summary(s: SparkSession, d: str) -> DataFrame:
    return rounded(report.error_summary(error_rows(s, d), ["batch"]))


@query
def q_sr_no(s: SparkSession, d: str) -> DataFrame:
    return report.serial_numbers(results(s, d), "batch", ["processor", "event_id"]).select("batch", "event_id", "sr_no")


@query
def q_perf_indicators(s: SparkSession, d: str) -> DataFrame:
    return rounded(report.indicators(results(s, d), ["batch"]))


@query
def q_recent_samples(s: SparkSession, d: str) -> DataFrame:
    return report.recent(results(s, d), ["batch"], 5).select("batch", "event_id")


@query
def q_progress_ticks(s: SparkSession, d: str) -> DataFrame:
    return report.every_nth(results(s, d), ["batch"], ["event_id"], 60).select("batch", "event_id")


@query
def q_worker_stats(s: SparkSession, d: str) -> DataFrame:
    status = F.when(C("event_id") % 5 == 0, "waiting").when(C("success"), "done").otherwise("failed")
    return rounded(report.worker_statistics(results(s, d).withColumn("status", status), ["batch"]))


@query
def q_processor_stats(s: SparkSession, d: str) -> DataFrame:
    return rounded(report.processor_statistics(results(s, d).withColumn("init_millis", F.when(C("event_id") % 3 == 0, C("millis")))))


@query
def q_processor_matches(s: SparkSession, d: str) -> DataFrame:
    """Detections of texts, text boxes and images that the mapping has or lacks; every fourth box's number is one that it lacks."""
    known = mapping(s, d)
    text = detections(corpus(s, d)).select(F.lit("Text").alias("processor"), C("unit_id").alias("doc_id"), "matched_text")
    number = lambda k: F.when(C(k) % 4 == 0, F.concat(F.lit("77-000-Z"), F.lpad(C(k).cast("string"), 6, "0"), F.lit("-00"))).otherwise(F.expr(inputs.tag(k)))
    boxed = text_boxes(s, d).select(F.lit("Graphics").alias("processor"), C("box_id").alias("doc_id"), number("box_id").alias("matched_text"))
    image = recognised(s, d).select(F.lit("Image").alias("processor"), C("image_id").cast("long").alias("doc_id"), number("ord").alias("matched_text"))
    return report.match_counts(lookup(text.unionByName(boxed).unionByName(image), "matched_text", known))


@query
def q_detection_status(s: SparkSession, d: str) -> DataFrame:
    """Details of customers, against detections and reconstructions of orders."""
    orders = s.read.parquet(f"{d}/orders.parquet")
    place = lambda k: F.concat(F.lit("paragraph_"), (k % 11).cast("string"))
    found = orders.select(
        (C("o_orderkey") % 97).alias("doc_id"), C("o_orderkey").alias("ord"), place(C("o_orderkey")).alias("location"), (C("o_custkey") % 53).cast("string").alias("matched_text"),
        (C("o_orderkey") % 1000).cast("int").alias("start_pos"), (C("o_orderkey") % 1000 + 18).cast("int").alias("end_pos"),
    )
    keys = ["doc_id", "location", "matched_text", "start_pos", "end_pos"]
    done = found.groupBy(*keys).agg((F.max("ord") % 3 == 0).alias("ok"))
    details = s.read.parquet(f"{d}/customer.parquet").select(C("c_custkey").alias("detail_id"), (C("c_custkey") % 97).alias("doc_id"), place(C("c_custkey")).alias("location"), (C("c_custkey") * 7 % 53).cast("string").alias("src_text"))
    return report.with_reconstruction(details, found, done).select("detail_id", "reconstructed")


@query
def q_report_round_trip(s: SparkSession, d: str) -> DataFrame:
    """The batch report written as JSON after an older one, in as many files as it has partitions, and the newest read back whole."""
    report_rows, folder = rounded(report.batch_report(results(s, d), ["batch"])), work_folder(s)
    sinks.write_report(report_rows.withColumn("documents", -C("documents")).repartition(2), folder)
    sinks.write_report(report_rows.repartition(3), folder)
    return sinks.latest_report(s, folder, ", ".join(f"{n} {t}" for n, t in report_rows.dtypes))


@query
def q_reports_by_document(s: SparkSession, d: str) -> DataFrame:
    """The matches that the latest report of each text has: all texts are reported once, every second one again with its defaults."""
    # Finding and resolving is the heavy part: both reports take it from one written table.
    texts, folder, found = corpus(s, d), work_folder(s), work_folder(s)
    hits = lookup(detections(texts), "matched_text", mapping(s, d)).withColumn("resolved", C("replacement"))
    hits = with_default(hits, "append", "4022-NA").select("unit_id", F.struct("start_pos", "matched_text", "resolved", "replacement").alias("match"))
    lists = texts.select("unit_id").join(hits.groupBy("unit_id").agg(F.sort_array(F.collect_list("match")).alias("matches")), "unit_id", "left")
    lists.write.parquet(found)
    lists = s.read.schema(lists.schema).parquet(found)

    def reported(rows: DataFrame, run: str, replacement: str) -> str:
        matches = F.transform("matches", lambda m: F.struct(m["start_pos"].alias("start_pos"), m["matched_text"].alias("matched_text"), m[replacement].alias("replacement"))).alias("matches")
        text = rows.select("unit_id", F.struct(F.lit(run).alias("run"), F.struct(F.struct(matches).alias("metadata")).alias("text")).alias("processor_results"))
        return sinks.write_report(metadata.serialized(text, ["unit_id"], "detailed_results"), folder)

    reported(lists, "first", "resolved")
    reported(lists.where("unit_id % 2 = 0"), "second", "replacement")
    latest = sinks.latest_reports(s, folder, "unit_id long, detailed_results variant", ["unit_id"])
    rows = latest.select("unit_id", F.variant_get("detailed_results", "$.processor_results.run", "string").alias("run"), "detailed_results")
    fields = "start_pos int, matched_text string, replacement string"
    return metadata.nested_rows(rows, ["unit_id", "run"], "$.processor_results.text.metadata.matches", fields, "detailed_results")


@query
def q_metadata_leaves(s: SparkSession, d: str) -> DataFrame:
    """Every plain value of the events' metadata, written as JSON and read back as objects of unknown depth."""
    made = inputs.spark(s, d, inputs.METADATA).select("event_id", F.parse_json("metadata").alias("metadata"))
    back = s.read.schema("event_id long, metadata variant").json(sinks.write_json(made, work_folder(s)))
    return metadata.leaves(back, ["event_id"])


@query
def q_size_check_csv(s: SparkSession, d: str) -> DataFrame:
    """The size check written as CSV and read back."""
    rows = q_size_grid(s, d)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return s.read.schema(schema).option("header", "true").csv(sinks.write_csv(rows, work_folder(s)))


@query
def q_processing_log(s: SparkSession, d: str) -> DataFrame:
    """Totals of the log of all results."""
    totals, _ = sinks.processing_log(results(s, d), work_folder(s))
    return s.read.schema("total_processed long, successful long, failed long, total_matches long").json(totals)


@query
def q_union_matches(s: SparkSession, d: str) -> DataFrame:
    """Text and image matches in one shape, counted by kind."""
    text = detections(corpus(s, d)).select(F.lit("text").alias("kind"), C("matched_text").alias("value"))
    image = recognised(s, d).select(C("engine").alias("kind"), C("text").alias("value"))
    both = text.unionByName(image)
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("distinct_values"))


@query
def q_detection_rows(s: SparkSession, d: str) -> DataFrame:
    """Detections of texts, text boxes and images in their common shape; -1 for a number that a kind does not have."""
    text = lookup(detections(corpus(s, d)), "matched_text", mapping(s, d))
    text = report.common_shape(text, "Text", doc_id=C("unit_id"), location=F.lit("paragraph_0"), **{c: C(c) for c in ("matched_text", "replacement", "start_pos", "end_pos")})
    boxed = lookup(text_boxes(s, d).withColumn("matched_text", F.expr(inputs.tag("box_id"))), "matched_text", mapping(s, d))
    boxed = report.common_shape(boxed, "Graphics", doc_id=C("box_id"), location=F.concat(F.lit("textbox_"), "box_id"), matched_text=C("matched_text"), replacement=C("replacement"), font_family=C("family"), font_size=C("size"))
    image = recognised(s, d).withColumn("matched_text", F.expr(inputs.tag("ord")))
    place = {"location": F.concat(F.lit("image_"), "image_id"), **{c: C(c) for c in ("confidence", "x", "y", "w", "h", "matched_text", "replacement")}}
    image = report.common_shape(lookup(image, "matched_text", mapping(s, d)), "Image", doc_id=C("image_id"), **place)
    rows = text.unionByName(boxed).unionByName(image)
    return rows.select(*(F.coalesce(c, F.lit(-1).cast(kind)).alias(c) if kind != "string" else C(c) for c, kind in rows.dtypes))


@query
def q_debug_dump(s: SparkSession, d: str) -> DataFrame:
    """What the debugger finds of each text, written as JSON with the self-test's verdict and read back."""
    counts, checked = q_match_debug(s, d), q_self_test(s, d)
    dump = counts.join(checked, "unit_id").select("unit_id", F.struct("raw", "mapped", "reason").alias("debug_info"), F.struct("detected", "passed").alias("test_results"))
    schema = "unit_id long, debug_info struct<raw:long,mapped:long,reason:string>, test_results struct<detected:string,passed:boolean>"
    back = s.read.schema(schema).json(sinks.write_json(dump, work_folder(s)))
    return back.select("unit_id", "debug_info.*", "test_results.*")


@query
def q_json_report(s: SparkSession, d: str) -> DataFrame:
    return report.json_rows(results(s, d).select("event_id", "doc_type", "matches", "success"), "event_id")


# Archives


def archives(s: SparkSession, d: str, rich: bool = True) -> DataFrame:
    """An archive made of each document; making and parsing them is spread over all cores, whatever the files' row groups."""
    return docx.packed(spread(inputs.spark(s, d, inputs.ARCHIVED.format(b="\\\\", g="")), "path"), rich)


@query
def q_docx_scan(s: SparkSession, d: str) -> DataFrame:
    """Archives made of the documents, parsed back to runs."""
    return docx.text_runs(archives(s, d, False)).select("path", "location", "run_idx", "text")


@query
def q_docx_tables(s: SparkSession, d: str) -> DataFrame:
    """Cells of all tables, with those that go on in the row below."""
    cells = docx.text_runs(archives(s, d)).where("row_idx IS NOT NULL").groupBy("path", "row_idx", "cell_idx", "merged")
    return cells.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_idx", "text"))), lambda r: r["text"]), "").alias("text"))


@query
def q_docx_headers(s: SparkSession, d: str) -> DataFrame:
    rows = docx.text_runs(archives(s, d)).where("location LIKE 'header%'").groupBy("path", "location")
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_idx", "text"))), lambda r: r["text"]), "").alias("text"))


@query
def q_docx_textboxes(s: SparkSession, d: str) -> DataFrame:
    return docx.text_boxes(archives(s, d)).select("path", "location", "text", "width", "height", "has_dimensions", "estimated")


@query
def q_docx_shapes(s: SparkSession, d: str) -> DataFrame:
    """Text boxes of archives with fallback copies, links, and sizes from shapes, styles or nothing."""
    texts = spread(inputs.spark(s, d, inputs.ARCHIVED.format(b="\\\\", g="")), "path")
    return docx.text_boxes(docx.packed(texts, build=docx.archive_of_shapes)).select("path", "location", "text", F.round("width", 4).alias("width"), F.round("height", 4).alias("height"), "has_dimensions", "estimated")


@query
def q_docx_images(s: SparkSession, d: str) -> DataFrame:
    rows = docx.images(archives(s, d))
    return rows.select("path", "location", "name", "extension", F.coalesce("length", F.lit(-1)).cast("long").alias("length"), F.coalesce("error", F.lit("")).alias("problem"))


@query
def q_docx_properties(s: SparkSession, d: str) -> DataFrame:
    return docx.properties(archives(s, d)).select("path", "pages", "words", "application")


def marked_texts(s: SparkSession, d: str) -> DataFrame:
    """Documents of which every tenth has a character that the format forbids; dealt to all cores, since an archive is made of each."""
    forbidden = F.when(C("doc_id") % 10 == 0, "\x01").otherwise("")
    texts = inputs.spark(s, d, inputs.ARCHIVED.format(b="\\\\", g="")).withColumn("doc_id", C("path").cast("long")).select("path", "doc_id", F.concat("text", forbidden).alias("text"))
    return spread(texts, "path")


@query
def q_docx_parsers(s: SparkSession, d: str) -> DataFrame:
    """Which parser reads archives of which some have a character that the format forbids."""
    marked = s.read.parquet(f"{d}/documents.parquet").select(C("doc_id").cast("string").alias("path"), F.concat(F.coalesce("text", F.lit("")), F.when(C("doc_id") % 10 == 0, "\x01").otherwise("")).alias("text"))
    return docx.parsers(docx.packed(spread(marked, "path"))).select("path", "parser")


@query
def q_docx_by_size(s: SparkSession, d: str) -> DataFrame:
    """The parser that each archive's size asks for, the one that reads it, and its runs. Sizes are made from the document's number."""
    files = docx.packed(marked_texts(s, d)).withColumn("length", C("path").cast("long") * 37 % 600 * sized.MB)
    # Counts alone go through a hash table; texts as results of an aggregate would have all runs sorted first.
    counts = sized.body_runs(files, listed=False).groupBy("path", "size_class", "parser", "tries", "error").agg(F.count("run_idx").alias("n"))
    return counts.groupBy("path", "size_class").agg(F.max_by("parser", "tries").alias("parser"), F.coalesce(F.max("error"), F.lit("")).alias("problem"), F.sum("n").alias("n_runs"))


@query
def q_docx_fallbacks(s: SparkSession, d: str) -> DataFrame:
    """Texts of archives of which some are cut short or lack the document part: tries, strategy and error of each, as the error report takes them."""
    content = F.when(C("path").cast("long") % 7 == 0, F.substring("content", 1, 40)).otherwise(C("content"))
    return docx.guarded_texts(docx.packed(marked_texts(s, d)).withColumn("content", content)).select("path", "tries", "strategy", "fallback_used", F.coalesce("error_type", F.lit("")).alias("error_type"), F.char_length("text").alias("n_chars"))


@query
def q_fallback_summary(s: SparkSession, d: str) -> DataFrame:
    """The error report of those archives, by the last digit of their number."""
    content = F.when(C("path").cast("long") % 7 == 0, F.substring("content", 1, 40)).otherwise(C("content"))
    rows = docx.guarded_texts(docx.packed(marked_texts(s, d)).withColumn("content", content)).where("error_type IS NOT NULL")
    rows = rows.select(C("path").cast("long").alias("ord"), (C("path").cast("long") % 10).alias("batch"), report.category(C("error_type"), C("error")).alias("category"), report.severity(C("error_type")).alias("severity"), "fallback_used")
    return rounded(report.error_summary(rows, ["batch"]))


@query
def q_routed_files(s: SparkSession, d: str) -> DataFrame:
    """One listing dealt to processors by extension: two take .docx, the more urgent one gets it; one is switched off; nobody takes the rest."""
    made = (Registration("word", lambda p, x: None, (".docx",), 1), Registration("any", lambda p, x: None, (".docx", ".doc"), 2), Registration("off", lambda p, x: None, (".doc",), 0, False))
    rules = {r.name: r for r in made}
    whole = lambda rows: rows.select("file_id", "stem", F.lit(0).alias("n"))
    short = lambda rows: rows.select("file_id", F.upper("stem").alias("stem"), F.char_length("stem").alias("n"))
    return routed(file_rows(s, d).withColumn("ext", F.when(C("file_id") % 2 == 0, F.upper("ext")).otherwise(C("ext"))), {"word": whole, "any": short}, rules)


# Streams


def streamed(s: SparkSession, d: str, name: str) -> DataFrame:
    """A table's file as a stream of its folder."""
    file = f"{name}.parquet"
    return s.readStream.schema(s.read.parquet(f"{d}/{file}").schema).option("pathGlobFilter", file).parquet(d)


@query
def q_stream_detect(s: SparkSession, d: str) -> DataFrame:
    """Detections of a stream over the orders' texts, all that is there now."""
    view = f"stream_{uuid.uuid4().hex}"
    streamed(s, d, "orders").createOrReplaceTempView(view)
    units, folder = s.sql(inputs.CORPUS.replace("{orders}", view)), work_folder(s)
    incremental.write_reports(incremental.detect_stream(units), f"{folder}/rows", f"{folder}/state").awaitTermination()
    s.catalog.dropTempView(view)
    return s.read.schema("unit_id long, pattern_name string, matched_text string, start_pos int, end_pos int").parquet(f"{folder}/rows")


@query
def q_stream_windows(s: SparkSession, d: str) -> DataFrame:
    """Events by five minutes and type, as far as the watermark has closed them."""
    folder, events = work_folder(s), streamed(s, d, "events").withColumn("ts", C("ts").cast("timestamp"))
    incremental.write_reports(incremental.windowed_counts(events, "ts", "event_type"), f"{folder}/rows", f"{folder}/state").awaitTermination()
    rows = s.read.schema("window_start timestamp, event_type string, n long").parquet(f"{folder}/rows")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


@query
def q_stream_fresh(s: SparkSession, d: str) -> DataFrame:
    """Events that arrive twice, a minute apart, each once within the watermark, with the name of their customer."""
    folder, again = work_folder(s), F.explode(F.array(C("ts").cast("timestamp"), C("ts").cast("timestamp") + F.expr("INTERVAL 1 MINUTE")))
    events = streamed(s, d, "events").select("event_id", (C("user_id") % 3000).alias("c_custkey"), again.alias("ts"))
    names = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name")
    fresh = incremental.with_names(incremental.fresh(events, "event_id", "ts"), names, "c_custkey").select("event_id", "c_name")
    incremental.write_reports(fresh, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return s.read.schema("event_id long, c_name string").parquet(f"{folder}/rows")


@query
def q_stream_intake(s: SparkSession, d: str) -> DataFrame:
    """Files of orders, one or more a status, taken in batch by batch and logged; the stream is started again and finds nothing new."""
    folder = work_folder(s)
    orders = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus")
    orders.repartition("o_orderstatus").write.partitionBy("o_orderstatus").json(f"{folder}/in")

    def process(rows: DataFrame) -> DataFrame:
        lines = F.size(F.filter(F.split(C("content").cast("string"), "\n"), lambda x: x != ""))
        rows.select("path", lines.alias("n")).write.mode("append").parquet(f"{folder}/made")
        return rows.select("path", (lines > 0).alias("success"))

    for _ in range(2):
        files = intake.arriving(s, f"{folder}/in/*", f"{folder}/done", "*.json", 2)
        intake.take_in(files, process, f"{folder}/log", f"{folder}/state").awaitTermination()
    made = s.read.schema("path string, n int").parquet(f"{folder}/made").join(intake.logged(s, f"{folder}/log").where("success"), "path")
    return made.groupBy(F.regexp_extract("path", "o_orderstatus=([^/]*)", 1).alias("status")).agg(F.sum("n").alias("n_orders"))


QUERIES |= sizing.QUERIES
ORACLES |= oracles_sizing.ORACLES
