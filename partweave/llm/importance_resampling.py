"""Importance resampling of documents towards a target distribution, scored without exploding any document.

A document's words become an array of hash buckets in the row. The corpus and the target are counted by
bucket, which is the only thing that shuffles: at most ``BUCKETS`` totals of each task. The gain of each
bucket is then a literal array of the plan, and a document's weight folds over its own buckets.

The draw takes the highest scores, a weight plus noise of the Gumbel distribution that depends on the key
alone. Scores are whole thousandths: gains are logarithms of counts and the noise of 32 bits, so they take
fewer than 2^17 values whatever the size. A table of documents by score, with running sums, gives each
score its first rank; documents of one score are numbered by key among themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partweave.llm.common import cut, release
from partweave.llm.terms import lower_ascii, word_array

#: What parts words: ASCII that is neither a digit nor a letter.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10


def buckets(text: Column, size: int = BUCKETS) -> Column:
    """The bucket of every word of a text in order, repeats included."""
    return F.transform(word_array(text, APART), lambda w: (F.crc32(lower_ascii(w).cast("binary")) % F.lit(size)).cast("short"))


def bucket_counts(arrays: DataFrame, size: int = BUCKETS) -> list[int]:
    """Features of each bucket over all rows of ``buckets``. ``size`` sums reach the driver."""
    counted = arrays.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    out = [0] * size
    for bucket, n in counted.collect():
        out[bucket] = n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the logarithm by which the target prefers each bucket, counts smoothed by one."""
    size, total, wanted = len(corpus), sum(corpus), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (total + size) / ((s + 1) * (wanted + size)))) for s, t in zip(corpus, target, strict=True)]


def noise(key: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate from the key's digest; a null key reads as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scored(arrays: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """``doc``, ``n_features``, ``weight`` (floored mean gain, 0 without features) and ``score`` of each row of ``doc``, ``buckets``."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")  # folded to one literal by the optimizer
    n = F.size("buckets").cast("long")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b.cast("int") + 1))
    rows = arrays.select("doc", n.alias("n_features"), total.alias("_total"))
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(_total - pmod(_total, n_features)) div n_features"))
    return rows.select("doc", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc"), seed))


def ranked(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``rows`` (a written table with ``doc``, ``n_features``, ``score``) with ``rank``: the draw's order, null for what is not drawn."""
    able = F.col("n_features") >= least_words
    by_score = rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # Fewer than 2^17 rows meet in this window, one for each score.
    upto = by_score.select("score", "n", F.sum("n").over(Window.orderBy(F.desc("score"))).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    taken = upto.select("score", (F.col("upto") - F.col("n")).alias("before"), F.expr(f"all * {percent} div 100").alias("most")).where("before < most")
    taken = cut(taken)
    own = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_first("doc")))
    drawn = rows.where(able).join(F.broadcast(taken), "score")
    place = F.col("before") + F.col("own")
    drawn = drawn.withColumn("own", own).withColumn("rank", F.when(place <= F.col("most"), place))
    rest = rows.where(able).join(F.broadcast(taken), "score", "left_anti").unionByName(rows.where(~able)).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*rest.columns).unionByName(rest)


def importance_resample(
    docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text", seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT, size: int = BUCKETS
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_features``, ``weight``, ``score``, ``rank`` (1 is best; null where not drawn), all long.

    A null text has no words. Documents with fewer than ``least_words`` words are scored and never drawn.
    Ties go to the smaller key, a null key before all; rows that share a key are ranked next to each other
    in no given order. An empty target prefers nothing: gains then only follow how often a bucket is used.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    arrays = cut(docs.select(F.col(key).cast("long").alias("doc"), buckets(F.col(text), size).alias("buckets")))
    wanted = bucket_counts(target.select(buckets(F.col(target_text), size).alias("buckets")), size)
    rows = cut(scored(arrays, gains(bucket_counts(arrays, size), wanted), seed))
    release(arrays)
    return ranked(rows, least_words, percent).select(F.col("doc").alias(key), "n_features", "weight", "score", "rank")
