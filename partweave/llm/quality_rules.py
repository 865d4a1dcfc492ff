"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Base measures come from each whole text by array and string functions inside the row. For each rule
and each stratum of document length a cutoff is chosen from a fixed list, lenient to strict: a cutoff
is accepted while an exact binomial test on the labelled holdout shows that at most ``alpha`` of the
good documents of the stratum would be rejected. Going down the list stops at the first cutoff that
is not proven (fixed-sequence testing, so one chain costs one test); the confidence is shared among
all chains of rules and strata (Bonferroni). A chain without a proven cutoff rejects nothing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import SPACE_CLASS, cut, whole_text

#: Words of a window, symbols counted, least words, largest percentage of repeated words.
WINDOW, SYMBOLS, LEAST_WORDS, MOST_REPEATED = 5, "#*$%&|<>", 10, 20
#: Lower ends of the strata, in words.
STRATA = (0, 100, 400, 1600)
#: Rules (a document is rejected above the cutoff) and their cutoffs from lenient to strict.
RULES = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3),
    "repeat_share": (0.19, 0.18, 0.17, 0.16, 0.15, 0.14, 0.13, 0.12, 0.11, 0.1),
}
#: Largest share of good documents that one rule may reject in a stratum, and the chance that any promise fails.
ALPHA, DELTA = 0.01, 0.05


def base_measures(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``n_lines``.

    A null text has no words. Windows are compared by a 64-bit hash of their five words within one
    document. Lines are those with a word; a line counts as repeated if it equals an earlier one.
    """
    rows = docs.select(F.col(key).alias(key), whole_text(text).alias("t"))
    rows = rows.select(
        key,
        F.char_length(F.translate("t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", SPACE_CLASS + "+", -1), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n", -1), lambda x: F.translate(x, " \t\x0b\f\r", "") != "").alias("lines"),
    )
    rows = rows.select(
        key, "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*(F.get("words", i + j) for j in range(WINDOW)))),
        ).alias("hashes"),
    )
    # Only texts with a repeated window pay for the sort that finds where.
    rows = rows.withColumn(
        "ordered",
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    same = lambda x, k: F.coalesce(F.get("ordered", k)["h"] == x["h"], F.lit(False))
    rows = rows.withColumn("places", F.sort_array(F.transform(F.filter("ordered", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    covered = F.aggregate(
        "places", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"],
    )
    return rows.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def stratum() -> Column:
    return reduce(lambda a, n: a + F.when(F.col("n_words") >= n, 1).otherwise(0), STRATA[1:], F.lit(0))


def rule_values() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words")}


def _stirling_rest(n: int) -> float:
    """log n! less Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _deviance(x: int, mean: float) -> float:
    """x * log(x / mean) + mean - x, without cancellation."""
    e = (mean - x) / x
    return x * (e - math.log1p(e)) if abs(e) > 1e-3 else x * e * e * (1 / 2 - e * (1 / 3 - e * (1 / 4 - e / 5)))


def _log_chance(n: int, k: int, p: float) -> float:
    """log of the probability of exactly ``k`` successes in ``n`` trials of chance ``p``, 0 <= k < n, by the saddle-point expansion."""
    if k == 0:
        return n * math.log1p(-p)
    rests = _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k)
    return rests - _deviance(k, n * p) - _deviance(n - k, n * (1 - p)) - 0.5 * math.log(2 * math.pi * k * (n - k) / n)


def tail(n: int, k: int, p: float) -> float:
    """Probability of at most ``k`` successes in ``n`` trials of chance ``p``; 1 where ``k`` is not below ``n * p``.

    The exact binomial sum at every ``n``: its terms are taken from ``k`` downwards, where they shrink,
    until they no longer change it; that is some multiple of the standard deviation at most.
    """
    if k >= n * p:
        return 1.0
    term, total = 1.0, 1.0
    for j in range(k, 0, -1):
        term *= j * (1 - p) / ((n - j + 1) * p)
        total += term
        if term < total * 1e-18:
            break
    return math.exp(_log_chance(n, k, p) + math.log(total))


def cutoffs(measures: DataFrame, good: DataFrame, key: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[int, str], float]:
    """Proven cutoffs by (stratum, rule). ``good``: the keys of the labelled good documents.

    The counts are sums over all labelled rows; what comes to the driver is a row of counts per stratum,
    and the tests are arithmetic on those.
    """
    held = measures.join(good.select(key), key).where(~base_failed()).withColumn("stratum", stratum())
    counts = [F.count_if(value > c).alias(f"{rule}_{i}") for rule, value in rule_values().items() for i, c in enumerate(RULES[rule])]
    level, chosen = delta / (len(STRATA) * len(RULES)), {}
    for row in held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts).collect():
        for rule, steps in RULES.items():
            for i, cutoff in enumerate(steps):
                if tail(row["n"], row[f"{rule}_{i}"], alpha) > level:
                    break
                chosen[row["stratum"], rule] = cutoff
    return chosen


def verdict(chosen: dict[tuple[int, str], float]) -> Column:
    """Whether a document passes every proven cutoff of its stratum."""
    values, at = rule_values(), stratum()
    return reduce(lambda a, x: a & ~((at == x[0][0]) & (values[x[0][1]] > x[1])), sorted(chosen.items()), F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, the five base measures, ``base_failed``, ``kept``.

    ``labels`` has ``key`` and ``quality``; rows with quality 1 are the good holdout (nothing else is
    learnt, and the lists of cutoffs are fixed, so all of them can serve). Without labels, or with too
    few to prove anything, ``kept`` is ``not base_failed``. Null and empty texts fail the base rules.
    Rows with equal keys each get their own result; a label counts once for each row that has its key
    and each time it is given, and a null key has no label. Columns other than these are ignored. An empty
    table gives no rows.
    """
    measures = cut(base_measures(docs, text, key))
    good = labels.where("quality = 1").select(key)
    failed = base_failed()
    passed = verdict(cutoffs(measures, good, key))
    return measures.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & passed).alias("kept"))
