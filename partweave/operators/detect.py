"""Detection: part numbers of text units with positions, context and replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.functions.spans import context, found_all, may_match, resolved
from partweave.operators.lookup import lookup, with_default
from partweave.profiles import PART_PATTERNS, PatternSet, Profile


def detections(units: DataFrame, patterns: PatternSet = PART_PATTERNS, enhanced: bool = True, id: str = "unit_id", text: str = "text", width: int | None = None) -> DataFrame:
    """One row per match that stays after overlap resolution: ``id``, ``pattern_name``, ``matched_text``, ``start_pos``, ``end_pos``.

    With a ``width`` also ``preceding_context`` and ``following_context``, the characters around it.
    """
    some = units.where((F.trim(text) != "") & may_match(F.col(text), patterns))
    hits = some.select(id, text, F.explode(resolved(found_all(F.col(text), patterns, enhanced))).alias("m"))
    out = [id, F.col("m.name").alias("pattern_name"), F.col("m.text").alias("matched_text"), F.col("m.start").alias("start_pos"), F.col("m.end").alias("end_pos")]
    if width is not None:
        before, after = context(F.col(text), F.col("m.start"), F.col("m.end"), width)
        out += [before.alias("preceding_context"), after.alias("following_context")]
    return hits.select(out)


def raw_detections(units: DataFrame, patterns: PatternSet = PART_PATTERNS, enhanced: bool = True, id: str = "unit_id", text: str = "text") -> DataFrame:
    """One row per match of any pattern, overlapping ones too, with the pattern's priority ``ord``."""
    hits = units.where(may_match(F.col(text), patterns)).select(id, F.explode(found_all(F.col(text), patterns, enhanced)).alias("m"))
    return hits.select(id, F.col("m.ord").alias("ord"), F.col("m.name").alias("pattern_name"), F.col("m.text").alias("matched_text"), F.col("m.start").alias("start_pos"), F.col("m.end").alias("end_pos"))


def mapped_detections(units: DataFrame, mapping: DataFrame, patterns: PatternSet = PART_PATTERNS, enhanced: bool = True, id: str = "unit_id", text: str = "text", tiers: tuple[str, ...] = ("exact", "lower", "normalized")) -> DataFrame:
    """Matches with a mapping, overlaps resolved among those: an unmapped match does not hide a mapped one."""
    hits = lookup(raw_detections(units, patterns, enhanced, id, text), "matched_text", mapping, tiers).where("replacement IS NOT NULL")
    one = F.struct("ord", F.col("pattern_name").alias("name"), F.col("matched_text").alias("text"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    # A unit's matches come together here; they are bounded by the unit's own text.
    values = hits.groupBy(id).agg(F.collect_list(one).alias("m"), F.map_from_entries(F.collect_set(F.struct("matched_text", "replacement"))).alias("r"))
    rows = values.select(id, F.explode(resolved(F.col("m"))).alias("m"), "r")
    return rows.select(id, F.col("m.name").alias("pattern_name"), F.col("m.text").alias("matched_text"), F.col("m.start").alias("start_pos"), F.col("m.end").alias("end_pos"), F.element_at("r", F.col("m.text")).alias("replacement"))


def resolved_detections(units: DataFrame, mapping: DataFrame, profile: Profile, patterns: PatternSet = PART_PATTERNS, id: str = "unit_id", text: str = "text") -> DataFrame:
    """Detections with replacement by the profile's tiers, mode and default."""
    rows = lookup(detections(units, patterns, profile.enhanced, id, text), "matched_text", mapping, profile.tiers)
    return with_default(rows, profile.text_mode, profile.default_value)


def self_test(cases: DataFrame, patterns: PatternSet = PART_PATTERNS, enhanced: bool = True, id: str = "unit_id", text: str = "text") -> DataFrame:
    """``id``, ``detected`` and ``passed``: whether a case's distinct matches are just those that ``expected`` (an array) lists."""
    hits = F.array_distinct(F.transform(resolved(found_all(F.col(text), patterns, enhanced)), lambda m: m["text"]))
    rows = cases.select(id, F.explode(F.array(F.sort_array(hits))).alias("detected"), "expected")
    return rows.select(id, "detected", (F.col("detected") == F.sort_array(F.array_distinct("expected"))).alias("passed"))
