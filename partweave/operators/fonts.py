"""Fonts of the runs of a text unit: which one stands for all, what is written of them, and why a size was chosen.

``runs`` is an array of structs with ``text``, ``family`` and ``size``, in order; everything stays in the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a run has that says nothing; segments that a description lists, and characters of each.
DEFAULT_FAMILY, DEFAULT_SIZE = "Arial", 12.0
SEGMENTS, PREVIEW = 5, 20


def score(run: Column) -> Column:
    """2 for a family and 2 for a size other than the default."""
    other = lambda value, default: F.when(value != default, 2).otherwise(0)
    return other(run["family"], DEFAULT_FAMILY) + other(run["size"], DEFAULT_SIZE)


def best_run(runs: Column) -> Column:
    """The run with the highest score, the first of equals; null without runs."""
    ranked = F.transform(runs, lambda r, i: F.struct(score(r).alias("score"), (-i).alias("place")))
    return F.get(runs, -F.array_max(ranked)["place"])


def baseline(runs: Column) -> Column:
    """The smallest size that a run has, the default if none has one."""
    return F.coalesce(F.array_min(F.transform(runs, lambda r: r["size"])), F.lit(DEFAULT_SIZE))


def normalized(runs: Column, family: Column, size: Column) -> Column:
    """The runs in one font."""
    return F.transform(runs, lambda r: r.withField("family", family).withField("size", size))


def _points(size: Column) -> Column:
    return F.format_string("%.1fpt", size)


def described(runs: Column) -> Column:
    """The distinct sizes, and the first runs with their size and family: ``Distinct sizes: 8.0pt, 9.0pt | Seg1: text (8.0pt Arial)``."""
    sizes = F.array_sort(F.array_distinct(F.array_compact(F.transform(runs, lambda r: r["size"]))))
    only = F.get(sizes, 0)

    def segment(r: Column, i: Column) -> Column:
        text = F.when(F.char_length(r["text"]) > PREVIEW, F.concat(F.substring(r["text"], F.lit(1), F.lit(PREVIEW)), F.lit("..."))).otherwise(r["text"])
        return F.concat(F.lit("Seg"), (i + 1).cast("string"), F.lit(": "), text, F.lit(" ("), _points(F.coalesce(r["size"], only)), F.lit(" "), F.coalesce(r["family"], F.lit("Unknown")), F.lit(")"))

    first = F.array_join(F.transform(F.slice(runs, 1, SEGMENTS), segment), " | ")
    more = F.when(F.size(runs) > SEGMENTS, F.concat(F.lit(" | ... and "), (F.size(runs) - SEGMENTS).cast("string"), F.lit(" more segments"))).otherwise("")
    head = F.when(F.size(sizes) == 1, _points(only)).otherwise(F.concat(F.lit("Distinct sizes: "), F.array_join(F.transform(sizes, _points), ", ")))
    return F.when(F.size(sizes) > 0, F.concat(head, F.lit(" | "), first, more)).otherwise(_points(F.lit(DEFAULT_SIZE)))


def reasoning(original: Column, new: Column, baseline_size: Column, size: Column, lines: Column, total: Column, has_dimensions: Column, guideline: Column) -> Column:
    """Why a size was chosen, as a struct of counts and texts. ``lines``: those the new text takes; ``total``: characters that fit at ``size``."""
    chars = lambda t: F.char_length(F.replace(t, F.lit("\n"), F.lit("")))
    whole = lambda x: F.format_string("%.0f", F.bround(x))
    fit = F.try_divide(chars(new), total) * 100
    fits = F.when(~has_dimensions, "No Dimensions").when(total <= 0, "Unknown").otherwise(F.concat(whole(fit), F.when(fit > 100, "% Over").otherwise("% Fit")))
    reduction = F.when(baseline_size > 0, F.concat(whole((baseline_size - size) / baseline_size * 100), F.lit("% Font Reduction"))).otherwise("0% Font Reduction")
    return F.struct(
        chars(original).alias("orig_total_char"), F.size(F.filter(F.split(original, "\n", -1), lambda x: F.trim(x) != "")).alias("orig_total_lines"),
        chars(new).alias("new_total_char"), lines.alias("new_total_lines"), fits.alias("new_size_fit_percent"), reduction.alias("reduction_percent"),
        F.format_string("%.1f -> %.1f", baseline_size, size).alias("new_size_change"), guideline.alias("interpolation_details"),
    )
