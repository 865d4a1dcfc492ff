"""Aggregates of processing results: document, batch, review, error and performance reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Review limits.
MANY_MATCHES, SIZE_CHANGE = 50, 20.0


def percent(part: Column, whole: Column) -> Column:
    """Percentage, 0 of nothing."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def statistics(results: DataFrame, keys: list[str]) -> DataFrame:
    """Documents, successes, matches, success rate and mean time by ``keys``."""
    good, n = F.count_if("success"), F.count(F.lit(1))
    return results.groupBy(*keys).agg(
        n.alias("documents"), good.alias("successful"), (n - good).alias("failed"), F.sum("matches").alias("total_matches"),
        percent(good, n).alias("success_rate"), F.coalesce(F.avg(F.when(F.col("success"), F.col("millis"))), F.lit(0.0)).alias("mean_millis"),
    )


def batch_report(results: DataFrame, keys: list[str]) -> DataFrame:
    """Sums, peaks, sizes and their change, shares of successes and of documents that want a look, throughput (documents a second, 0 without time)."""
    seconds, n, mb = F.sum("millis") / 1000, F.count(F.lit(1)), 1024 * 1024
    before, after = F.coalesce(F.sum("size_before"), F.lit(0)), F.coalesce(F.sum("size_after"), F.lit(0))
    looks = F.count_if(F.size(review_reasons()) > 0)
    return results.groupBy(*keys).agg(
        n.alias("documents"), F.sum("matches").alias("total_matches"), F.max("memory_mb").alias("peak_memory_mb"), F.max("cpu").alias("peak_cpu"), F.max("millis").alias("longest_millis"),
        (F.avg("size_before") / mb).alias("mean_mb"), F.coalesce(F.try_divide(n, seconds), F.lit(0.0)).alias("throughput"),
        percent(F.count_if("success"), n).alias("success_rate"), (before / mb).alias("input_mb"), (after / mb).alias("output_mb"), (F.avg("size_after") / mb).alias("mean_output_mb"),
        percent(after - before, before).alias("size_change_percent"), looks.alias("review_documents"), percent(looks, n).alias("review_percent"), F.avg("matches").alias("mean_matches"),
    )


def activity_shares(results: DataFrame, keys: list[str], kinds: tuple[str, ...], kind: str = "processor") -> DataFrame:
    """For each kind of processing its matches, their mean over all documents, and their percentage of all matches; a column each, in one aggregate."""
    n, total = F.count(F.lit(1)), F.sum("matches")
    own = {k: F.coalesce(F.sum(F.when(F.col(kind) == k, F.col("matches"))), F.lit(0)) for k in kinds}
    columns = [c for k, v in own.items() for c in (v.alias(f"{k}_matches"), (v / n).alias(f"{k}_mean"), percent(v, total).alias(f"{k}_percent"))]
    return results.groupBy(*keys).agg(*columns)


def activity(results: DataFrame) -> DataFrame:
    """Per document type and processor and their totals (grouping sets): documents, matches, share of all documents."""
    out = results.rollup("doc_type", "processor").agg(F.count(F.lit(1)).alias("documents"), F.sum("matches").alias("matches"), F.grouping_id().alias("level"))
    total = F.max(F.when(F.col("level") == 3, F.col("documents"))).over(Window.partitionBy())
    return out.withColumn("share", percent(F.col("documents"), total))


def review_reasons() -> Column:
    """Why a document wants a look: many matches, failure, size changed by more than a fifth; in this order."""
    change = F.abs(F.try_divide((F.col("size_after") - F.col("size_before")) * 100.0, F.col("size_before")))
    tests = ((F.col("matches") > MANY_MATCHES, "high_matches"), (~F.col("success"), "failed"), (change > SIZE_CHANGE, "size_change"))
    return F.array_compact(F.array(*(F.when(test, name) for test, name in tests)))


def review_files(results: DataFrame, id: str = "event_id") -> DataFrame:
    return results.select(id, F.array_join(review_reasons(), ",").alias("reasons")).where(F.col("reasons") != "")


#: Severity by error type; category by the first word found in the message.
SEVERITIES = {"MemoryError": "critical", "OSError": "critical", "PermissionError": "critical", "ValueError": "high", "TypeError": "high", "AttributeError": "high", "FileNotFoundError": "medium", "ImportError": "medium", "ConnectionError": "medium"}
CATEGORIES = (("conversion", ("conversion", "convert")), ("loading", ("load", "parse", "open")), ("memory", ("memory",)), ("permission", ("permission",)), ("network", ("network", "connection")), ("validation", ("validation", "invalid")))
CATEGORY_TYPES = {"memory": "MemoryError", "permission": "PermissionError"}


def severity(error_type: Column) -> Column:
    out = F.lit("low")
    for name, level in SEVERITIES.items():
        out = F.when(error_type == name, level).otherwise(out)
    return out


def category(error_type: Column, message: Column) -> Column:
    text, out = F.lower(message), F.lit("processing")
    for name, words in reversed(CATEGORIES):
        test = error_type == CATEGORY_TYPES[name] if name in CATEGORY_TYPES else F.lit(False)
        for word in words:
            test = test | F.contains(text, F.lit(word))
        out = F.when(test, name).otherwise(out)
    return out


def error_summary(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Errors, share with fallback, and the most frequent category and severity; of equals the one that came first.

    ``errors`` is read once: what follows works on a count for each pair of category and severity.
    """
    one = F.struct("category", "severity", F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    counts = errors.groupBy(*keys, "category", "severity").agg(one.alias("_one"), F.count_if("fallback_used").alias("_fallbacks"))
    lists = counts.groupBy(*keys).agg(F.sum("_one.n").alias("total_errors"), percent(F.sum("_fallbacks"), F.sum("_one.n")).alias("fallback_percent"), F.collect_list("_one").alias("_all"))

    def top(column: str) -> Column:
        def scored(value: Column) -> Column:
            own = F.filter("_all", lambda x: x[column].eqNullSafe(value))
            n = F.aggregate(F.transform(own, lambda x: x["n"]), F.lit(0).cast("long"), lambda a, k: a + k)
            return F.struct(n.alias("n"), (-F.array_min(F.transform(own, lambda x: x["first"]))).alias("f"), value.alias("value"))

        return F.array_max(F.transform(F.array_distinct(F.transform("_all", lambda x: x[column])), scored))["value"].alias(f"most_common_{column}")

    return lists.select(*keys, "total_errors", "fallback_percent", top("category"), top("severity"))


def serial_numbers(rows: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """Continuous numbers of a document's rows in report order."""
    return rows.withColumn("sr_no", F.row_number().over(Window.partitionBy(doc).orderBy(*order)))


def indicators(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Performance indicators; ``blended_memory_mb`` is 0.7 of the peak and 0.3 of the last sample, ``mean_memory_mb`` a true mean."""
    seconds, n = F.sum("millis") / 1000, F.count(F.lit(1))
    last = F.max_by("memory_mb", "event_id")
    return samples.groupBy(*keys).agg(
        F.max("memory_mb").alias("peak_memory_mb"), F.avg("memory_mb").alias("mean_memory_mb"), (F.max("memory_mb") * 0.7 + last * 0.3).alias("blended_memory_mb"),
        F.max("cpu").alias("peak_cpu"), percent(F.count_if("success"), n).alias("success_rate"), F.coalesce(F.try_divide(n, seconds), F.lit(0.0)).alias("files_per_second"),
        F.coalesce(F.try_divide(F.sum(F.col("size_before") + F.col("size_after")), n), F.lit(0.0)).alias("bytes_per_file"),
    )


def recent(samples: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """The last samples of each key, as a bounded buffer keeps them."""
    w = Window.partitionBy(*keys).orderBy(F.col("event_id").desc())
    return samples.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def every_nth(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Every ``n``-th row of each key in order: what a progress display shows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") % n == 0).drop("_n")


def worker_statistics(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Progress of tasks by ``status`` (done, failed, waiting): counts, percentage, elapsed and estimated remaining seconds."""
    count = lambda s: F.count_if(F.col("status") == s)
    total, done, failed = F.count(F.lit(1)), count("done"), count("failed")
    seconds = F.coalesce(F.sum(F.when(F.col("status") != "waiting", F.col("millis"))), F.lit(0)) / 1000
    remaining = F.coalesce(F.try_divide(seconds, done + failed), F.lit(0.0)) * (total - done - failed)
    return tasks.groupBy(*keys).agg(
        total.alias("total_files"), done.alias("completed_files"), failed.alias("failed_files"), (done + failed).alias("processed_files"),
        percent(done + failed, total).alias("progress_percentage"), seconds.alias("elapsed_seconds"), remaining.alias("remaining_seconds"),
    )


def processor_statistics(usage: DataFrame) -> DataFrame:
    """One row for all processors, from a row per use (``processor``, ``success``, ``init_millis``): what was initialised, used and failed."""
    per = usage.groupBy("processor").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("errors"), F.min("init_millis").alias("init"))
    total, ready, used, errors = F.count(F.lit(1)), F.count("init"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("errors"), F.lit(0))
    return per.agg(
        total.alias("total_processors"), ready.alias("initialized_processors"), percent(ready, total).alias("initialization_rate"), used.alias("total_usage_count"),
        errors.alias("total_error_count"), (errors * 100.0 / F.greatest(used, F.lit(1))).alias("error_rate"), (F.coalesce(F.sum("init"), F.lit(0)) / 1000 / F.greatest(ready, F.lit(1))).alias("average_initialization_time"),
    )


#: Fixed value: the processor whose detections without a mapping are not counted as such.
UNCOUNTED = "Text"


def match_counts(found: DataFrame) -> DataFrame:
    """Per processor, from a row per detection (``processor``, ``doc_id``, ``replacement``): documents, detections, and those with and without a replacement.

    The text processor leaves detections that nothing maps uncounted: its ``no_match`` is 0.
    """
    mapped = F.col("replacement").isNotNull()
    none = F.when(F.col("processor") == UNCOUNTED, 0).otherwise(F.count_if(~mapped))
    return found.groupBy("processor").agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("detections"), F.count_if(mapped).alias("matches"), none.alias("no_match"))


def characters(texts: DataFrame, text: str = "text") -> DataFrame:
    """``ch`` and ``n``: how often each character occurs.

    Words between blanks are counted first, as sums of each task, and then taken apart once each with their
    count; blanks are what parts the words. So there is a row per word and none per character.
    """
    words = texts.where(F.col(text).isNotNull()).select(F.explode(F.split(text, " ", -1)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    each = words.select(F.explode(F.filter(F.split("word", ""), lambda c: c != "")).alias("ch"), "n").groupBy("ch").agg(F.sum("n").alias("n"))
    blanks = texts.agg(F.sum(F.size(F.split(text, " ", -1)) - 1).alias("n")).where("n > 0").select(F.lit(" ").alias("ch"), "n")
    return each.unionByName(blanks)


#: What all processors' detections have in common.
DETECTION = ("processor", "doc_id", "location", "matched_text", "replacement", "start_pos", "end_pos", "font_family", "font_size", "confidence", "x", "y", "w", "h")
_TYPES = {"doc_id": "long", "start_pos": "int", "end_pos": "int", "font_size": "double", "confidence": "double", "x": "int", "y": "int", "w": "int", "h": "int"}


def common_shape(rows: DataFrame, processor: str, **columns: Column) -> DataFrame:
    """Detections of one processor in the shape of all; what it has no value for is null.

    A confidence is a column of its own and no font size, and an image's place is its location and box and no
    start position, so that rows of several processors can be sorted and summed together.
    """
    given = {"processor": F.lit(processor), **columns}
    none = lambda c: F.lit(None)
    return rows.select(*(given.get(c, none(c)).cast(_TYPES.get(c, "string")).alias(c) for c in DETECTION))


def with_reconstruction(details: DataFrame, detected: DataFrame, done: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``details`` (``doc``, ``location``, ``src_text``) with ``reconstructed``: whether the first detection of that text there was written back.

    ``detected``: ``doc``, ``ord``, ``location``, ``matched_text``, ``start_pos``, ``end_pos``; ``done``: ``doc``, ``location``,
    ``matched_text``, ``start_pos``, ``end_pos``, ``ok``, one row for each. The first detection is an aggregate, so
    equal ones combine before they are shuffled. Details without a detection, or whose detection has no result, are false.
    """
    place = F.struct("start_pos", "end_pos")
    first = detected.groupBy(doc, "location", F.col("matched_text").alias("src_text")).agg(F.min_by(place, "ord").alias("_p"))
    result = done.select(doc, "location", F.col("matched_text").alias("src_text"), place.alias("_p"), F.col("ok").alias("_ok"))
    rows = details.join(first, [doc, "location", "src_text"], "left").join(result, [doc, "location", "src_text", "_p"], "left")
    return rows.withColumn("reconstructed", F.coalesce("_ok", F.lit(False))).drop("_p", "_ok")


def size_text(size: Column) -> Column:
    """Bytes as ``0 B`` or with one decimal in the largest unit up to TB."""
    out = F.concat(F.call_function("format_number", size / float(1024**4), F.lit("0.0")), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < 1024 ** (power + 1), F.concat(F.call_function("format_number", size / float(1024**power), F.lit("0.0")), F.lit(f" {unit}"))).otherwise(out)
    return F.when(size == 0, "0 B").otherwise(out)


def json_rows(rows: DataFrame, id: str) -> DataFrame:
    """``id`` and a JSON object of each row."""
    return rows.select(id, F.to_json(F.struct(*rows.columns)).alias("report"))


def html(rows: DataFrame, title: str, most: int = 200) -> str:
    """A small report as an HTML page; at most ``most`` rows, as a page has room for, and a line that says so if there are more."""
    from html import escape

    found = rows.limit(most + 1).collect()
    shown, more = found[:most], f"<p>The first {most} rows.</p>" if len(found) > most else ""
    head = "".join(f"<th>{escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in row) + "</tr>" for row in shown)
    return f"<!doctype html><title>{escape(title)}</title><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table>{more}"
