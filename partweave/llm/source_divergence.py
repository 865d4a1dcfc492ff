"""How far the sources of a language differ in their terms, by wide term vectors.

Occurrences and documents are counted for each language, source and term: a task sums whole texts in
array steps, so a frequent term of a hot source leaves it as one row, and Spark adds the tasks' sums. Each
kept term is then one row with an array of shares by source of its language. Higher-order functions emit
the contribution of each pair of sources and the gain of each source over its language from that array;
sums are taken on the map side again, the best terms by a limited window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partweave.llm.common import cut, prepare, release
from partweave.llm.kernels import steps

LEAST_DOCS = 10
TOP_TERMS = 10
#: Shares are whole billionths.
SCALE = 1_000_000_000
#: Bytes of text of one counting step, and sums that a task holds before it adds them up or passes them on.
STEP_BYTES, MOST_SUMS = 2 << 20, 400_000

#: Bytes of terms (ASCII letters and all of UTF-8 beyond ASCII), and bytes with A-Z as a-z.
_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def share(count: str, total: str, kept: str) -> str:
    """SQL of the smoothed share of a count: exact, since products go through decimals of 38 digits."""
    return f"CAST(1 + (CAST({SCALE} AS DECIMAL(10)) * CAST({count} + 2 AS DECIMAL(20))) DIV CAST({total} + 2 * {kept} AS DECIMAL(20)) AS BIGINT)"


def _counts(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.Table:
    """``lang``, ``source``, ``term``, ``n``, ``docs`` of the texts of one step."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TERM[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | border))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | border))
    # Terms side by side are a string column as they are.
    letters = _LOWER[data[inside[1:-1]]]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(letters.tobytes())).dictionary_encode()
    ids, size = np.asarray(words.indices).astype(np.int64), max(len(words.dictionary), 1)
    owner = np.repeat(np.arange(rows.num_rows), np.diff(np.searchsorted(starts, offsets)))
    (langs, lang), (sources, source) = ((a.dictionary, np.asarray(a.indices).astype(np.int64)) for a in (rows.column(k).dictionary_encode() for k in (0, 1)))
    one, n = np.unique(owner * size + ids, return_counts=True)
    group = (lang * len(sources) + source)[one // size]
    both, inverse = np.unique(group * size + one % size, return_inverse=True)
    total = np.bincount(inverse, n, len(both)).astype(np.int64)
    group = both // size
    columns = langs.take(pa.array(group // len(sources))), sources.take(pa.array(group % len(sources))), words.dictionary.take(pa.array(both % size))
    return pa.table([*columns, pa.array(total), pa.array(np.bincount(inverse, minlength=len(both)).astype(np.int64))], names=["lang", "source", "term", "n", "docs"])


def _added(tables: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return total.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for rows, data, offsets in steps(batches, "text", STEP_BYTES):
        held.append(_counts(rows, data, offsets))
        size += held[-1].num_rows
        if size > MOST_SUMS:
            held = [_added(held)]
            size = held[0].num_rows
            if size > MOST_SUMS // 2:
                yield from held[0].combine_chunks().to_batches(64 << 10)
                held, size = [], 0
    if held:
        yield from _added(held).combine_chunks().to_batches(64 << 10)


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences), ``docs`` (documents that have it)."""
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    sums = named.mapInArrow(_count_texts, "lang string, source string, term string, n long, docs long")
    return sums.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` long, ``rank`` int.

    Part ``pair``: each other source of the language and the divergence from it, over all terms that at
    least ``least_docs`` documents of the language have. Part ``term``: the ``top`` terms by which the
    source exceeds its language. Shares are in billionths, counts smoothed by two.

    Null text, language and source are empty texts. A group without terms has pairs like any other; a
    language without kept terms has pairs of value 0. Ties go by the item's bytes. Repeated rows count
    each. An empty table gives no rows; other columns are ignored. Pairs are as many as the squares of
    the sources of each language, which is the size of the answer.
    """
    prepare(docs.sparkSession)
    counts = cut(term_counts(docs, text, lang, source))
    groups = cut(docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct())
    entry = F.struct("source", "n")
    vectors = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(entry).alias("sparse")).where(F.col("docs") >= least_docs)
    vectors = cut(vectors.select("lang", "term", "n", F.map_from_entries("sparse").alias("by_source")))
    release(counts)
    # Totals over kept terms: by group, and by language with the number of terms.
    by_group = vectors.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = vectors.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    full = groups.join(by_group, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    index = full.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("sources"))
    index = cut(index.join(by_lang, "lang", "left").select("lang", "sources", F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.coalesce("kept", F.lit(0)).alias("kept")))
    # The planner sends the index around only where its measured size allows; else both sides are sorted and hot languages split.
    wide = vectors.join(index, "lang").select(
        "lang", "term", "sources",
        F.expr(share("n", "lang_total", "kept")).alias("q"),
        F.expr(f"transform(sources, s -> {share('coalesce(by_source[s.source], 0L)', 's.total', 'kept')})").alias("p"),
        F.expr("transform(sources, s -> by_source[s.source])").alias("counts"),
    )

    pair = "transform(sequence(i + 1, size(sources) - 1), j -> struct(i AS a, j AS b, {value} AS value))"
    every = "flatten(transform(sequence(0, size(sources) - 2), i -> " + pair + "))"
    several = "size(sources) > 1"
    sums = wide.where(several).select("lang", F.expr("inline(" + every.format(value="((p[i] - p[j]) * (p[i] - p[j])) div (p[i] + p[j])") + ")"))
    none = index.where(several).select("lang", F.expr("inline(" + every.format(value="0L") + ")"))
    # A language's pairs are numbered by position; names are put back once the sums are small.
    pairs = sums.unionByName(none).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    named = pairs.join(index.select("lang", "sources"), "lang").select("lang", F.expr("sources[a].source").alias("a"), F.expr("sources[b].source").alias("b"), "value")
    both = named.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    part_pair = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(order))

    above = "filter(transform(sources, (s, i) -> struct(s.source AS source, counts[i] AS n, p[i] AS p)), x -> x.n IS NOT NULL AND x.p > q)"
    terms = wide.select("lang", F.col("term").alias("item"), "q", F.expr(f"inline({above})"))
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    part_term = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return part_pair.unionByName(part_term)
