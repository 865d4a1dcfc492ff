"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of a fixed number of bytes. The distinct blocks are sorted and numbered, so
that equal blocks have one integer name; then adjacent names are paired and the distinct pairs are
sorted and numbered in turn, until each document has one name. Two documents share block count and
name exactly when their texts are equal.

Only the naming step moves block contents, and it combines equal blocks before the shuffle. The
occurrences of a block find its name by a 64-bit router value; router values that two different
contents share are found by comparing the contents, and those few go by content instead. So no hash
ever decides that two texts are equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import cut, free_name, release, whole_text

#: Bytes of a block. Most documents are one or two blocks; a longer one takes log2(blocks) pairings.
BLOCK_BYTES = 4096
#: Stands for the missing right neighbour of an odd last block; no block has this name.
NO_NAME = -(2**63)
#: Repeats of one row that are written out in one stretch.
STRETCH = 4096


def _names(contents: DataFrame, on: list[str]) -> DataFrame:
    """A row per distinct content with its integer ``name``: its place in the sorted order of its partition.

    The sort makes the number a function of the partition's contents, so a task that runs again
    gives the same names.
    """
    return contents.distinct().sortWithinPartitions(*on).withColumn("name", F.monotonically_increasing_id())


def _name_occurrences(occurrences: DataFrame, content: list[str], keep: list[str], router: Callable[..., Column]) -> DataFrame:
    """``keep`` and ``name`` of every occurrence; equal ``content`` has equal ``name``, other content another."""
    routed = occurrences.withColumn("router", router(*content))
    names = _names(routed.select("router", *content), ["router", *content])
    table = cut(names.select("router", "name"))
    clashes = cut(table.groupBy("router").count().where("count > 1").select("router"))
    named = routed.select(*keep, "router").join(table, "router").select(*keep, "name")
    if clashes.isEmpty():
        return named
    alike = routed.join(clashes, "router", "left_semi")
    by_content = _names(alike.select("router", *content), ["router", *content]).withColumn("name", -1 - F.col("name"))
    clear = routed.select(*keep, "router").join(table.join(clashes, "router", "left_anti"), "router").select(*keep, "name")
    return clear.unionByName(alike.join(by_content, ["router", *content]).select(*keep, "name"))


def block_identities(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES, router: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """``doc``, ``sha`` (binary), ``blocks``, ``name``, ``times``: documents agree in the third and fourth exactly when their texts do.

    Rows that repeat key and text are one document here, and ``times`` says how many they are.
    """
    whole = docs.select(F.col(key).alias("doc"), whole_text(text).cast("binary").alias("whole"))
    blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("whole") / F.lit(block_bytes)).cast("int"))
    one = whole.select("doc", F.unhex(F.sha2("whole", 256)).alias("sha"), blocks.alias("blocks"), "whole")
    pieces = one.select(
        "doc", "sha", "blocks",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.substring(F.col("whole"), i * block_bytes + 1, F.lit(block_bytes)))).alias("pos", "block"),
    )
    keep = ["doc", "sha", "blocks", "pos"]
    level = cut(_name_occurrences(pieces, ["block"], keep, router).groupBy(*keep, "name").agg(F.count(F.lit(1)).alias("times")))
    done, width = [level.where("blocks = 1")], 1
    most = level.agg(F.max("blocks")).first()[0] or 1
    while width < most:
        # Position p of this level covers blocks p * width to (p + 1) * width - 1; its neighbour at p + 1 makes the pair.
        left, right = (F.max(F.when(F.col("pos") % 2 == side, F.col("name"))) for side in (0, 1))
        pairs = level.where(F.col("blocks") > width).groupBy("doc", "sha", "blocks", F.expr("pos div 2").cast("int").alias("pos"), "times")
        pairs = cut(pairs.agg(left.alias("left"), F.coalesce(right, F.lit(NO_NAME)).alias("right")))
        level = cut(_name_occurrences(pairs, ["left", "right"], [*keep, "times"], lambda a, b: router(a, b)))
        release(pairs)
        width *= 2
        done.append(level.where((F.col("blocks") <= width) & (F.col("blocks") > width // 2)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc", "sha", "blocks", "name", "times")


def _repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as its ``times`` says; ``turn`` counts from 0. A hot row is dealt out in stretches to all tasks."""
    ends = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {STRETCH}"))).alias("stretch")
    parts = rows.select("*", ends).withColumn("_n", F.least(F.lit(STRETCH), F.col("times") - F.col("stretch") * STRETCH))
    if not rows.where(F.col("times") > STRETCH).isEmpty():
        parts = parts.repartition("doc", "sha", "stretch")
    turns = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_t")
    return parts.select("*", turns).withColumn("turn", F.col("stretch") * STRETCH + F.col("_t")).drop("stretch", "_n", "_t")


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES, router: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of rows with equal texts the one with the largest key stays; where several rows have that key, one
    of them does. ``group_size`` counts all rows of the text. A null text counts as empty and all empty
    texts are one group. Rows with one key and different texts are different documents. A null key is
    smaller than any other and stays only where its group has no other key. Other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    rows = cut(block_identities(docs, text, key, block_bytes, router))
    groups = cut(rows.groupBy("blocks", "name").agg(F.max("doc").alias("keep"), F.sum("times").alias("n")).where("n > 1"))
    joined = rows.join(groups, ["blocks", "name"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc")).otherwise(F.col("keep"))
    marked = joined.select("doc", "sha", keep.alias("keep"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), "times")
    if not rows.where("times > 1").isEmpty():
        marked = _repeated(marked)
    else:
        marked = marked.withColumn("turn", F.lit(0))
    return marked.select(
        F.col("doc").alias(key), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("doc").eqNullSafe(F.col("keep")) & (F.col("turn") == 0)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose text is the one that stays of its group; columns and texts as they were.

    Rows that repeat key and text stay once; where they differ in other columns, the one whose JSON has
    the smallest hash. The join is on the key and the digest of the row's text.
    """
    own, other, sha = free_name(docs, "sha_own"), free_name(docs, "kept_key"), free_name(docs, "kept_sha")
    kept = exact_duplicates(docs, text, key).where("kept").select(F.col(key).alias(other), F.col("text_sha256").alias(sha))
    marked = docs.withColumn(own, F.sha2(whole_text(text).cast("binary"), 256))
    same = F.col(key).eqNullSafe(F.col(other)) & (F.col(own) == F.col(sha))
    rows = marked.join(kept.hint("merge"), same, "left_semi")
    # Digests alone are counted here; texts are moved once more only if some rows repeat.
    times = free_name(marked, "times")
    again = marked.groupBy(key, own).agg(F.count(F.lit(1)).alias(times)).where(F.col(times) > 1)
    again = cut(again.select(F.col(key).alias(other), F.col(own).alias(sha)))
    if again.isEmpty():
        return rows.drop(own)
    whole, columns = free_name(docs, "whole"), [F.col(f"`{c}`") for c in docs.columns]
    rest = F.xxhash64(F.to_json(F.struct(*(c for c, n in zip(columns, docs.columns, strict=True) if n != text))))
    one = rows.join(again, same, "left_semi").groupBy(key, own).agg(F.min_by(F.struct(*columns), rest).alias(whole))
    return rows.join(again, same, "left_anti").drop(own).unionByName(one.select(f"{whole}.*"))
