"""Rewriting text units: compose, replace spans, and carry spans over to styled runs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.functions.spans import BLOCK, bound, first_where, scan


#: Two lengths of texts in one number.
LENGTHS = 1 << 31


def composed(original: Column, replacement: Column, mode: str, separator: str) -> Column:
    """Append keeps the original before the separator; replace does not."""
    return F.concat(original, F.lit(separator), replacement) if mode == "append" else replacement


def apply_spans(text: Column, spans: Column) -> Column:
    """``text`` with every span (struct start, end, final) replaced, from right to left so that offsets stay true.

    Spans must not overlap. Offsets count code points. No spans leave the text as it is. A block of spans
    works on the stretch of text from the block before to its last span, so a long text with many spans
    is not copied once for each.
    """
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["final"].alias("final"))))

    def stretch(all: Column, i: Column) -> Column:
        low = F.coalesce(F.get(all, i * BLOCK - 1)["end"], F.lit(0))
        some = F.slice(all, i * BLOCK + 1, F.lit(BLOCK))
        region = F.substring(text, low + 1, F.get(some, F.size(some) - 1)["end"] - low)
        return F.aggregate(F.reverse(some), region, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"] - low), s["final"], F.substring(t, s["end"] - low + 1, F.char_length(t))))

    def all_of(spans: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), lambda i: stretch(spans, i))
        return F.concat(F.array_join(blocks, ""), F.substring(text, F.get(spans, F.size(spans) - 1)["end"] + 1, F.char_length(text)))

    return bound(ordered, lambda x: F.when(F.size(x) > 0, all_of(x)).otherwise(text))


def _standing(text: Column, spans: Column, separator: str) -> Column:
    """The results of spans that stand in a text already, sorted, from one pass over its pieces between separators.

    A result stands where a piece ends in an original and the next one begins with its replacement; each pair
    of lengths that the spans have is cut from every place once. Results with a further separator are left out.
    """
    pieces = F.split(text, re.escape(separator), -1)
    n = F.size(pieces) - 1
    meetings = F.zip_with(F.slice(pieces, F.lit(1), n), F.slice(pieces, F.lit(2), n), lambda left, right: F.struct(left.alias("left"), right.alias("right")))
    lengths = F.array_distinct(F.array_compact(F.transform(spans, lambda s: F.char_length(s["matched_text"]).cast("long") * LENGTHS + F.char_length(s["replacement"]))))
    of = lambda x, k: F.concat(F.right(x["left"], F.floor(k / LENGTHS).cast("int")), F.lit(separator), F.left(x["right"], (k % LENGTHS).cast("int")))
    seen = bound(meetings, lambda m: F.flatten(F.transform(lengths, lambda k: F.transform(m, lambda x: of(x, k)))))
    return F.sort_array(F.array_intersect(F.transform(spans, lambda s: s["final"]), seen))


def _stands(text: Column, span: Column, standing: Column, separator: str) -> Column:
    """Whether a span's result stands in the text, null without a result; only one with a further separator has to be searched for."""
    further = F.contains(F.concat(span["matched_text"], span["replacement"]), F.lit(separator))
    known = F.coalesce(F.get(standing, first_where(standing, lambda x: x >= span["final"])) == span["final"], F.lit(False))
    return F.when(further, F.contains(text, span["final"])).when(span["final"].isNotNull(), known)


def with_spans(units: DataFrame, detected: DataFrame, mode: str, separator: str, id: str = "unit_id", text: str = "text") -> DataFrame:
    """``id``, ``text``, ``spans`` and ``final_text`` of every unit; units without detections have null spans and keep their text.

    A span has the columns of ``detected``, ``start``, ``end`` and ``final``. Where a unit's text already
    holds ``original + separator + replacement`` it is not appended again, and the span's ``applied`` is
    false. Only the detections are grouped; texts are joined with them once.
    """
    final = composed(F.col("matched_text"), F.col("replacement"), mode, separator)
    own = [F.col(c) for c in detected.columns if c != id]
    one = F.struct(F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), final.alias("final"), *own)
    # A unit's spans come together here; they are bounded by its own text.
    spans = detected.groupBy(id).agg(F.sort_array(F.collect_list(one)).alias("spans"))
    joined = units.select(id, text).join(spans, id, "left")
    marked = lambda test: F.transform("spans", lambda s: s.withField("applied", test(s)))
    everything = marked(lambda s: s["final"].isNotNull())
    if mode == "append":
        # Most texts have no separator: then none of the results stands in them, and no span has to be searched for.
        new = bound(_standing(F.col(text), F.col("spans"), separator), lambda there: marked(lambda s: F.coalesce(~_stands(F.col(text), s, there, separator), F.lit(False))))
        everything = F.when(F.contains(F.col(text), F.lit(separator)), new).otherwise(everything)
    joined = joined.withColumn("spans", everything)
    return joined.withColumn("final_text", apply_spans(F.col(text), F.filter("spans", lambda s: s["applied"])))


def rewrite(units: DataFrame, detected: DataFrame, mode: str, separator: str, id: str = "unit_id", text: str = "text") -> DataFrame:
    """``id``, ``text`` and ``final_text`` of every unit, as ``with_spans`` has them."""
    return with_spans(units, detected, mode, separator, id, text).select(id, text, "final_text")


RUN = "struct<run_idx:int,text:string,start:int,end:int>"


def with_offsets(runs: Column) -> Column:
    """Runs (struct run_idx, text) with the code point range each covers: a prefix sum inside the row."""

    def one(at: Column, r: Column) -> Column:
        return F.array(F.struct(r["run_idx"].alias("run_idx"), r["text"].alias("text"), at.alias("start"), (at + F.char_length(r["text"])).alias("end")))

    return scan(runs, F.lit(0), lambda at, r: at + F.char_length(r["text"]), one, RUN)


def overlapping(runs: Column, start: Column, end: Column) -> Column:
    """The runs (in order, with offsets) that a span touches: an interval join inside the row, by two binary searches."""
    low, high = first_where(runs, lambda r: r["end"] > start), first_where(runs, lambda r: r["start"] >= end)
    return bound(F.struct(low.alias("low"), high.alias("high")), lambda x: F.slice(runs, x["low"] + 1, F.greatest(x["high"] - x["low"], F.lit(0))))


def rewrite_runs(runs: Column, spans: Column) -> Column:
    """Runs (in order, with offsets) after replacing spans (struct start, end, final) that do not overlap.

    The first run that a span touches gets the final text, later ones lose their covered part. Each run
    finds its own spans among the sorted ones by binary search and is rewritten once.
    """

    def of_run(r: Column, all: Column) -> Column:
        low, high = first_where(all, lambda s: s["end"] > r["start"]), first_where(all, lambda s: s["start"] >= r["end"])

        def local(s: Column) -> Column:
            start, end = F.greatest(s["start"] - r["start"], F.lit(0)), F.least(s["end"], r["end"]) - r["start"]
            return F.struct(start.alias("start"), end.alias("end"), F.when(s["start"] >= r["start"], s["final"]).otherwise("").alias("final"))

        some = lambda x: r.withField("text", apply_spans(r["text"], F.transform(F.slice(all, x["low"] + 1, x["high"] - x["low"]), local)))
        return bound(F.struct(low.alias("low"), high.alias("high")), lambda x: F.when(x["low"] < x["high"], some(x)).otherwise(r))

    return bound(F.sort_array(spans), lambda all: F.transform(runs, lambda r: of_run(r, all)))


def located(haystack: Column, needle: Column, from_position: Column) -> Column:
    """Offset of the first occurrence at or after a position; -1 if there is none."""
    return F.call_function("locate", needle, haystack, from_position + 1) - 1


def around(text: Column, part: Column) -> tuple[Column, Column]:
    """What stands before and after the first occurrence of a part; the whole text and nothing if it is absent."""
    at = located(text, part, F.lit(0))
    return F.when(at < 0, text).otherwise(F.substring(text, F.lit(1), at)), F.when(at < 0, "").otherwise(F.substring(text, at + 1 + F.char_length(part), F.char_length(text)))


def replace_first(text: Column, part: Column, final: Column) -> Column:
    """One part of a recognised string replaced, the first time it occurs."""
    before, after = around(text, part)
    return F.when(located(text, part, F.lit(0)) < 0, text).otherwise(F.concat(before, final, after))


def distinct_spans(spans: Column) -> Column:
    """Replacements (struct start, end, final) once each, in order: sorted, so that equal ones stand side by side."""
    return bound(F.sort_array(spans), lambda all: F.filter(all, lambda s, i: (i == 0) | ~s.eqNullSafe(F.get(all, i - 1))))


def newline_adjusted(text: Column, positions: Column) -> Column:
    """Positions where the text's pieces are joined without the line breaks before each.

    The places of all breaks are summed up once; each position finds how many are before it by binary search.
    """
    breaks = scan(F.split(text, "\n", -1), F.lit(0), lambda at, piece: at + F.char_length(piece) + 1, lambda at, piece: F.array(at + F.char_length(piece)), "int")
    return bound(breaks, lambda all: F.transform(positions, lambda p: p - first_where(all, lambda b: b >= p)))
