"""Resolving matched text against the mapping: equi-joins by tier, the first entry in file order winning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partweave.functions.spans import normalized

#: A mapping whose plan is not larger than this is broadcast; a larger one joins as Spark sees fit.
BROADCAST_BYTES = 64 << 20


def tiers(mapping: DataFrame) -> DataFrame:
    """``key``, ``value``, ``ord`` with the lower-case and normalized forms."""
    return mapping.select("ord", "key", "value", F.lower("key").alias("key_lower"), normalized(F.col("key")).alias("key_norm"))


def _first(mapping: DataFrame, column: str) -> DataFrame:
    """One entry for each form: the first in file order. An aggregate, so it combines before its shuffle."""
    return mapping.groupBy(F.col(column).alias("_k")).agg(F.min_by("value", "ord").alias("_v"))


def _forms(column: Column) -> dict[str, Column]:
    return {"exact": column, "lower": F.lower(column), "normalized": normalized(column)}


_COLUMNS = {"exact": "key", "lower": "key_lower", "normalized": "key_norm"}


def _small(mapping: DataFrame) -> bool:
    """Whether the planner bounds the mapping's size; no job runs for it. A size that is not known counts as large."""
    return int(str(mapping._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES


def lookup(rows: DataFrame, column: str, mapping: DataFrame, use: tuple[str, ...] = ("exact", "lower", "normalized")) -> DataFrame:
    """``rows`` with ``replacement`` and ``tier`` (the first that has an entry; null without one).

    ``mapping``: ``ord``, ``key``, ``value``. Every row stays, once.
    """
    forms, small = tiers(mapping), _small(mapping)
    out, values = rows, []
    for i, tier in enumerate(use):
        side = _first(forms, _COLUMNS[tier]).select(F.col("_k").alias(f"_k{i}"), F.col("_v").alias(f"_v{i}"))
        out = out.join(F.broadcast(side) if small else side, _forms(F.col(column))[tier] == F.col(f"_k{i}"), "left")
        values.append((tier, F.col(f"_v{i}")))
    tier = F.coalesce(*(F.when(v.isNotNull(), t) for t, v in values))
    kept = [c for c in rows.columns]
    return out.select(*kept, F.coalesce(*(v for _, v in values)).alias("replacement"), tier.alias("tier"))


def mapped(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """The rows whose text is a key, exactly (a semi-join)."""
    keys = mapping.select(F.col("key").alias("_k")).distinct()
    return rows.join(F.broadcast(keys) if _small(mapping) else keys, F.col(column) == F.col("_k"), "left_semi")


def with_default(rows: DataFrame, mode: str, default: str | None) -> DataFrame:
    """Mode predicate: replace, and append without a default, drop unmapped rows; append fills the default in."""
    if mode == "append" and default is not None:
        return rows.withColumn("is_default", F.col("replacement").isNull()).withColumn("replacement", F.coalesce("replacement", F.lit(default)))
    return rows.where(F.col("replacement").isNotNull()).withColumn("is_default", F.lit(False))


def debug_counts(rows: DataFrame, id: str = "unit_id") -> DataFrame:
    """Per unit: raw and mapped match counts, and why there is no mapped match."""
    counts = rows.groupBy(id).agg(F.count("text").alias("raw"), F.count("replacement").alias("mapped"))
    reason = F.when(F.col("raw") == 0, "no_pattern_match").when(F.col("mapped") == 0, "no_mapping").otherwise("ok")
    return counts.withColumn("reason", reason)


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
