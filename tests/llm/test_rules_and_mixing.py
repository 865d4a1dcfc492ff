from __future__ import annotations

import collections
import math
import re
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from partweave.llm.mixing import SEED, _with_before, entropy, mix_sources, solve, weights
from partweave.llm.quality_rules import ALPHA, base_measures, cutoffs, quality_rules, tail

SPACE = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(SPACE, text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_measures(messy, documents, empty):
    for df in (messy.where("doc_id IS NOT NULL"), documents):
        texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
        for r in base_measures(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
    assert base_measures(empty).count() == 0


def exact_tail(n, k, p):
    """The sum of the binomial terms from 0 to k, in decimal arithmetic."""
    getcontext().prec = 40
    p = Decimal(str(p))
    term = total = (1 - p) ** n
    for j in range(1, k + 1):
        term = term * (n - j + 1) / j * p / (1 - p)
        total += term
    return float(total)


def test_tail_is_the_binomial_distribution_at_every_size():
    sizes = [(n, k) for n in (1, 10, 500, 3000) for k in (0, 1, 4, 20) if k < n * ALPHA]
    # Around 20,000 expected rejections, and far beyond.
    for n, k in [*sizes, (1_999_900, 19_800), (2_000_100, 19_800), (2_500_000, 24_700)]:
        assert math.isclose(tail(n, k, ALPHA), exact_tail(n, k, ALPHA), rel_tol=1e-11)
    assert tail(10_000_000, 1000, ALPHA) < 1e-300 and tail(100, 50, ALPHA) == 1.0 and 0.01 < tail(10**11, 10**9 - 70_000, ALPHA) < 0.02


def test_cutoffs_hold_the_promise_on_their_holdout(spark):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(20)) + ("#" if i % 400 == 0 else "")) for i in range(4000)]
    junk = [(10_000 + i, " ".join(f"##w{i}x{k}" for k in range(20))) for i in range(50)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules(docs, labels).collect()}
    assert sum(not kept[i] for i, _ in good) <= ALPHA * len(good) and not any(kept[i] for i, _ in junk)
    few = cutoffs(base_measures(docs), labels.limit(100).select("doc_id"))
    assert few == {}, "too few rows prove nothing"


def test_rules_edges(messy, empty, labels):
    got = {r.doc_id: r for r in quality_rules(messy, labels).collect()}
    assert got[4].base_failed and got[5].n_words == 0 and not got[4].kept and len(got) == messy.count()
    assert quality_rules(empty, labels).count() == 0


def test_temperature_meets_the_entropy_or_the_repetition_limit():
    tokens = {"a": 1_000_000.0, "b": 100_000.0, "c": 10_000.0, "d": 0.0}
    mix = solve(tokens, entropy_share=0.7, most_repeats=1e9)
    assert math.isclose(entropy(mix.weights), 0.7 * math.log(3), rel_tol=1e-6) and mix.weights["d"] == 0
    tight = solve(tokens, entropy_share=0.99, most_repeats=3.0)
    assert math.isclose(max(tight.budgets[s] / tokens[s] for s in "abc"), 3.0, rel_tol=1e-6)
    assert solve(tokens, entropy_share=0.0).exponent == 1.0 and math.isclose(sum(weights(tokens, 0.3).values()), 1.0)
    assert solve({}).budgets == {}


@pytest.mark.parametrize("block_docs", [1, 3, 1000])
def test_budgets_are_met_by_less_than_a_document(spark, block_docs):
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", "w " * (1 + i * 37 % 50)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out, mix = mix_sources(docs, entropy_share=0.95, block_docs=block_docs)
    got = out.collect()
    spent, biggest = collections.Counter(), max(r.n_tokens for r in got)
    for r in got:
        spent[r.source] += r.n_tokens
    assert all(b <= spent[s] + 1e-6 and spent[s] < b + biggest for s, b in mix.budgets.items())
    times = collections.Counter(r.doc_id for r in got)
    for s in mix.budgets:
        own = [times[i] for i, x, _ in rows if x == s]
        assert max(own) - min(own) <= 1, "no document comes again before the others"
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_sources(docs, entropy_share=0.95, block_docs=block_docs)[0].collect()))


def test_mix_against_a_plain_running_sum(spark):
    """Each source's documents in the order of pass, block and place: whole blocks while they fit, then documents that begin within the budget."""
    rows = [(i % 700, "hot" if i % 3 else f"s{i % 5}", "w " * (i * 31 % 40), i % 7) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, given long")
    for given in (None, F.col("given")):
        got, mix = mix_sources(docs, entropy_share=0.97, block_docs=5, tokens=given)
        count = F.expr("size(filter(split(text, ' '), w -> w != ''))") if given is None else given
        per = collections.Counter(r[1] for r in rows)
        marked = docs.select("doc_id", "source", count.alias("n"), F.xxhash64("text").alias("fp")).collect()
        total = collections.Counter()
        for r in marked:
            total[r.source] += r.n
        turns = max(int(mix.budgets[s] // total[s]) for s in total) + 1
        hashed = spark.createDataFrame([(*r, t) for r in marked for t in range(turns)], "doc_id long, source string, n long, fp long, turn int")
        place = lambda salt: F.xxhash64("doc_id", "fp", "turn", F.lit(SEED + salt))
        hashed, want = hashed.select("*", place(0).alias("b"), place(1).alias("place")).collect(), []
        for s in total:
            passes, blocks = int(mix.budgets[s] // total[s]), max(1, per[s] // 5)
            own = [(r.turn, r.b % blocks, r.place, r.doc_id, r.fp, r.n) for r in hashed if r.source == s]
            want += [(s, *r[:5]) for r in own if r[0] < passes]
            spent, rest = 0, mix.budgets[s] - passes * total[s]
            for block in sorted({r[1] for r in own}):
                mine = sorted(r for r in own if r[0] == passes and r[1] == block)
                fits, inside = spent + sum(r[5] for r in mine) <= rest, spent
                for r in mine:
                    if rest > 0 and spent < rest and (fits or inside < rest):
                        want.append((s, *r[:5]))
                    inside += r[5]
                spent = inside
        assert sorted(want) == sorted((r.source, r.turn, r.block, r.place, r.doc_id, r.fp) for r in got.collect())


def test_running_sums_in_two_levels(spark):
    sums = spark.range(20_000).select((F.col("id") % 2).cast("string").alias("source"), (F.col("id") * 7).alias("block"), (F.col("id") % 11).alias("t"))
    running = {"0": 0, "1": 0}
    got = {(r.source, r.block): r.before for r in _with_before(sums).collect()}
    for i in range(20_000):
        assert got[str(i % 2), i * 7] == running[str(i % 2)]
        running[str(i % 2)] += i % 11


def test_mixing_edges(messy, empty):
    assert mix_sources(messy)[0].count() >= 1 and mix_sources(empty)[0].count() == 0
