"""Mixing sources to target weights: temperature mixing, realised by budgeted block permutations.

Source shares are raised to an exponent and normalised; bisection finds the exponent, the largest in
[0, 1] that meets a target entropy (a share of the greatest possible) and, as far as that allows,
keeps every source within a repetition limit. A source's token budget is its weight times the total.
Its documents are dealt to blocks by a hash and ordered by a hash inside; whole passes over the source
come first, each with its own hash, then whole blocks of the next pass while the budget lasts, then
documents of the next block. Only the documents of that one block are put in order one by one, so no
task ever holds a source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partweave.llm.common import SPACE_CLASS, cut, whole_text

#: Target entropy as a share of log(sources), most passes over a source, and documents of a block on average.
ENTROPY_SHARE, MOST_REPEATS, BLOCK_DOCS = 0.98, 4.0, 256
#: Sources that the driver solves for, a row each, and blocks whose sums one window adds up.
MOST_SOURCES, SUPER_BLOCKS = 100_000, 4096
SEED = 20240306


def weights(tokens: dict[str, float], exponent: float) -> dict[str, float]:
    """Normalised shares to the power ``exponent``; sources without tokens have weight 0."""
    logs = {s: exponent * math.log(n) for s, n in tokens.items() if n > 0}
    top = max(logs.values(), default=0.0)
    total = math.fsum(math.exp(x - top) for x in logs.values())
    return {s: math.exp(logs[s] - top) / total if s in logs else 0.0 for s in tokens}


def entropy(w: dict[str, float]) -> float:
    return -math.fsum(x * math.log(x) for x in w.values() if x > 0)


@dataclass(frozen=True)
class Mix:
    exponent: float
    weights: dict[str, float]
    #: Tokens that each source may emit.
    budgets: dict[str, float]


def solve(tokens: dict[str, float], budget: float | None = None, entropy_share: float = ENTROPY_SHARE, most_repeats: float = MOST_REPEATS, steps: int = 60) -> Mix:
    """The exponent by bisection. Entropy falls and the largest repetition falls as it grows, so each limit is a half line.

    The target entropy wants a small exponent, the repetition limit a large one; where they conflict
    the repetition limit holds.
    """
    total = float(sum(tokens.values())) if budget is None else float(budget)
    live = sum(n > 0 for n in tokens.values())

    def flat_enough(x: float) -> bool:
        return entropy(weights(tokens, x)) >= entropy_share * math.log(max(live, 1)) - 1e-12

    def few_repeats(x: float) -> bool:
        return all(w * total <= most_repeats * tokens[s] * (1 + 1e-12) for s, w in weights(tokens, x).items() if tokens[s] > 0)

    def bisect(good: object, low: float, high: float) -> float:
        """The border of ``good``, which holds at ``low``."""
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)  # type: ignore[operator]
        return low

    exponent = 1.0 if flat_enough(1.0) else bisect(flat_enough, 0.0, 1.0)
    if not few_repeats(exponent):
        exponent = 1.0 if not few_repeats(1.0) else 1.0 - bisect(lambda d: few_repeats(1.0 - d), 0.0, 1.0 - exponent)
    w = weights(tokens, exponent)
    return Mix(exponent, w, {s: x * total for s, x in w.items()})


def white_space_tokens(text: str = "text") -> Column:
    """The default token measure: white-space words."""
    return F.size(F.filter(F.split(whole_text(text), SPACE_CLASS + "+", -1), lambda w: w != "")).cast("long")


def _place(row: list[Column], turn: Column, salt: int) -> Column:
    return F.xxhash64(*row, turn, F.lit(SEED + salt))


def _with_before(sums: DataFrame) -> DataFrame:
    """``sums`` (``source``, ``block``, ``t``) with ``before``, the sum over a source's smaller blocks, in two levels.

    Stretches of SUPER_BLOCKS blocks are summed first, so a window holds that many rows, or a row for
    each such stretch of a source: a task has about the square root of what a single window would.
    """
    up_to = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("super", F.expr(f"block div {SUPER_BLOCKS}"))
    supers = sums.groupBy("source", "super").agg(F.sum("t").alias("s"))
    supers = supers.select("source", "super", F.coalesce(F.sum("s").over(up_to("source").orderBy("super")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("t").over(up_to("source", "super").orderBy("block")), F.lit(0))
    return sums.withColumn("inside", inside).join(supers, ["source", "super"]).withColumn("before", F.col("base") + F.col("inside")).drop("super", "base", "inside")


def mix_sources(
    docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", budget: float | None = None, entropy_share: float = ENTROPY_SHARE, most_repeats: float = MOST_REPEATS, block_docs: int = BLOCK_DOCS, tokens: Column | None = None
) -> tuple[DataFrame, Mix]:
    """The rows that the mix emits and the mix: ``key``, ``source``, ``n_tokens``, ``fp``, ``turn``, ``block``, ``place``.

    A document has one row for each time it is emitted; ``turn`` counts the passes over its source from
    0, and (``turn``, ``block``, ``place``) is its order there. A source emits the documents that begin
    within its budget of tokens, so it oversteps it by less than one document. Documents without tokens
    come with the pass or block that they fall in. ``budget`` is the total, by default the tokens of the
    input. A null source is a source of its own, written as an empty string. Rows that repeat key and
    text are emitted each. Other columns are ignored. An empty table gives no rows.

    ``tokens`` is the number of tokens of a row of ``docs``, by default its white-space words (a null
    counts as 0). The driver has a row per source; more than MOST_SOURCES raise.
    """
    count = white_space_tokens(text) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    rows = docs.select(F.col(key), F.coalesce(F.col(source), F.lit("")).alias("source"), count.alias("n_tokens"), F.xxhash64(whole_text(text)).alias("fp"))
    rows = cut(rows)
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: give a coarser column")
    sums = {r["source"]: (r["t"], r["n"]) for r in totals}
    mixed = solve({s: t for s, (t, _) in sums.items()}, budget, entropy_share, most_repeats)
    if not sums:
        return rows.select(key, "source", "n_tokens", "fp", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("place")), mixed
    plan = [(s, int(mixed.budgets[s] // t) if t else 1, float(mixed.budgets[s] - (mixed.budgets[s] // t) * t) if t else 0.0, max(1, n // block_docs)) for s, (t, n) in sums.items()]
    plan = docs.sparkSession.createDataFrame(plan, "source string, passes int, rest double, blocks long")
    # A row per source: small by the condition above.
    rows = rows.join(F.broadcast(plan), "source")
    own = [F.col(key), F.col("fp")]
    block = lambda turn: F.pmod(_place(own, turn, 0), F.col("blocks"))
    columns = [key, "source", "n_tokens", "fp", "turn", "block", "place"]
    whole = rows.where("passes > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("turn"))
    whole = whole.withColumn("block", block(F.col("turn"))).withColumn("place", _place(own, F.col("turn"), 1)).select(columns)
    last = rows.where("rest > 0").withColumn("turn", F.col("passes"))
    last = last.withColumn("block", block(F.col("turn"))).withColumn("place", _place(own, F.col("turn"), 1))
    # Running sums over blocks: a row per block, not per document.
    blocks = cut(last.groupBy("source", "rest", "block").agg(F.sum("n_tokens").alias("t")))
    blocks = cut(_with_before(blocks).where("before < rest"))
    full = last.join(blocks.where("before + t <= rest").select("source", "block"), ["source", "block"], "left_semi").select(columns)
    edge = last.join(blocks.where("before + t > rest").select("source", "block", "before"), ["source", "block"])
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("place", key, "fp").rowsBetween(Window.unboundedPreceding, -1))
    part = edge.withColumn("inside", F.coalesce(inside, F.lit(0))).where("before + inside < rest").select(columns)
    return whole.unionByName(full).unionByName(part), mixed
