"""Connected components of an edge list, by repeated contraction to smaller labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import cut, release


def _moved(rows: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """``rows`` with the labels of ``column`` replaced as ``moves`` (``old``, ``new``) says."""
    found = rows.join(moves.select(F.col("old").alias(column), "new"), column, "left")
    return found.withColumn(column, F.coalesce("new", column)).drop("new")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``comp`` for every node of ``edges`` (``a``, ``b``); nodes have one ``comp`` exactly when a path links them.

    In each round every label takes the smallest label next to it, then the one that that label took;
    edges inside a label go. The rounds are about the logarithm of the longest path. No node's
    neighbours are gathered: all steps are minimum aggregates, which combine before their shuffle.
    """
    rest = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = cut(rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct().withColumn("comp", F.col("node")))
    while not rest.isEmpty():
        near = rest.union(rest.select("b", "a")).groupBy(F.col("a").alias("old")).agg(F.min("b").alias("b"))
        first = cut(near.select("old", F.least("old", "b").alias("new")))
        jumps = first.select(F.col("old").alias("new"), F.col("new").alias("newer"))
        moves = cut(first.join(jumps, "new", "left").select("old", F.coalesce("newer", "new").alias("new")).where("old <> new"))
        moved = cut(_moved(labels, "comp", moves))
        left = _moved(_moved(rest, "a", moves), "b", moves).where("a <> b")
        left = cut(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        release(first, moves, labels, rest)
        labels, rest = moved, left
    release(rest)
    return labels
