"""Metadata objects of unknown depth as VARIANT columns: made of rows, written as JSON, taken apart into leaves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ``schema_of_variant`` calls a value, and the kind it is of.
_KINDS = (("OBJECT", "object"), ("ARRAY", "array"), ("VOID", "null"), ("STRING", "text"), ("BOOLEAN", "boolean"), ("BIGINT", "number"), ("DOUBLE", "number"), ("FLOAT", "number"), ("DECIMAL", "number"))


def kind(value: Column) -> Column:
    """object, array, null, text, boolean or number; other is what JSON has no value for (dates, times, bytes)."""
    name, out = F.schema_of_variant(value), F.lit("other")
    for prefix, this in reversed(_KINDS):
        out = F.when(name.startswith(prefix), this).otherwise(out)
    return out


def serialized(rows: DataFrame, id: list[str], column: str = "metadata") -> DataFrame:
    """``id`` and all other columns as one VARIANT object, whatever they nest; nulls stay as nulls."""
    others = [F.col(f"`{c}`") for c in rows.columns if c not in id]
    return rows.select(*id, F.to_variant_object(F.struct(*others)).alias(column))


def depth(value: Column) -> Column:
    """How deep a JSON value nests: 0 for a plain one. From its text without strings, so brackets inside those do not count."""
    brackets = F.regexp_replace(F.regexp_replace(F.to_json(value), r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    steps = F.transform(F.filter(F.split(brackets, ""), lambda c: c != ""), lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda a, x: F.struct((a["now"] + x).alias("now"), F.greatest(a["most"], a["now"] + x).alias("most"))
    return F.aggregate(steps, zero, step, lambda a: a["most"])


def leaves(rows: DataFrame, id: list[str], column: str = "metadata", levels: int | None = None) -> DataFrame:
    """``id``, ``path``, ``kind`` and ``value`` (text; null for a null) of each plain value and each empty object or list.

    ``levels`` is how deep objects nest at most; without it the deepest is measured first, by one aggregate.
    Each level is a Generate on the one before it: nothing is shuffled. Paths are written as ``$.a[0].b``,
    with keys that are no plain names in quotes. A null object has no leaves.
    """
    if levels is None:
        levels = rows.agg(F.max(depth(F.col(column)))).first()[0] or 0
    now = rows.where(F.col(column).isNotNull()).select(*id, F.lit("$").alias("path"), F.col(column).alias("_v"))
    out = []
    for level in range(levels + 1):
        told = now.withColumn("kind", kind(F.col("_v")))
        empty = F.to_json("_v").isin("{}", "[]")
        out.append(told.where(~F.col("kind").isin("object", "array") | empty).select(*id, "path", "kind", F.when(F.col("kind") != "null", F.when(F.col("kind") == "text", F.variant_get("_v", "$", "string")).otherwise(F.to_json("_v"))).alias("value")))
        if level < levels:
            below = told.where(F.col("kind").isin("object", "array")).lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()))
            key = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos"), F.lit("]"))).when(F.col("key").rlike("^[A-Za-z0-9_]+$"), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit('."'), "key", F.lit('"')))
            now = below.select(*id, F.concat("path", key).alias("path"), F.col("value").alias("_v"))
    return reduce(DataFrame.unionByName, out)


def nested_rows(rows: DataFrame, id: list[str], path: str, schema: str, column: str = "metadata") -> DataFrame:
    """``id``, ``pos`` and the fields of each object in the list at a path (``$.a.b``); values that do not fit their type are null, as is what is absent."""
    at = rows.select(*id, F.try_variant_get(column, path, "variant").alias("_v")).where(F.schema_of_variant("_v").startswith("ARRAY"))
    one = at.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    fields = [c.strip().split(" ", 1) for c in schema.split(",")]
    return one.select(*id, "pos", *(F.try_variant_get("value", f"$.{name}", of).alias(name) for name, of in fields))
