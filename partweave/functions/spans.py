"""Regular expression matches with positions, as column expressions.

A match is a struct (ord, name, text, start, end): the pattern's priority and name, and code point
offsets. Everything stays in the row: no explode, no shuffle, no Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from partweave.profiles import PatternSet

#: Case-insensitive in all scripts.
FLAGS = "(?iu)"
_FIRST_DIGIT_GUARD = r"(?<!(?<!\d)\d)"
#: A match, and how many items ``scan`` gathers at once.
MATCH, BLOCK = "struct<ord:int,name:string,text:string,start:int,end:int>", 128


def hardened(pattern: str) -> str:
    """The pattern with word guards turned into digit guards; one that starts with 77 and has no guard gets one.

    That guard rejects a start after a run of exactly one digit: ``177-`` no, ``1177-`` yes.
    """
    out = pattern.replace(r"(?<!\w)", r"(?<![0-9])").replace(r"(?!\w)", r"(?![0-9])")
    return _FIRST_DIGIT_GUARD + out if out.startswith("77") and "(?<!" not in out else out


def literal_head(pattern: str) -> str:
    """Digits and hyphens that every match of the pattern begins with, as far as they can be told; else empty."""
    if "|" in pattern:
        return ""
    head = re.match(r"[0-9-]*", pattern)[0]
    return head[:-1] if pattern[len(head) : len(head) + 1] in ("?", "*", "{") else head


def may_match(text: Column, patterns: PatternSet) -> Column:
    """A cheap necessary condition for a match of any pattern: it reaches the scan, and spares most texts the expressions below."""
    heads = [literal_head(p) for _, p in patterns.patterns]
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(h)) for h in sorted(set(heads)))) if heads and all(heads) else F.lit(True)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def scan(items: Column, zero: Column, turn: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], of: str) -> Column:
    """What ``emit`` gives for each item and the state before it, all in one array of ``of``; ``turn`` is the next state.

    Arrays grow by copying, so results are gathered in blocks: the work is about linear in the items.
    """
    none = lambda t: F.array().cast(f"array<{t}>")

    def block(acc: Column, some: Column) -> Column:
        step = lambda a, x: F.struct(turn(a["s"], x).alias("s"), F.concat(a["out"], emit(a["s"], x)).alias("out"))
        done = F.aggregate(some, F.struct(acc["s"].alias("s"), none(of).alias("out")), step)
        return bound(done, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def blocks(x: Column) -> Column:
        return F.aggregate(in_blocks(x), F.struct(zero.alias("s"), none(f"array<{of}>").alias("out")), block, lambda a: F.flatten(a["out"]))

    return bound(items, blocks)


def first_where(items: Column, test: Callable[[Column], Column]) -> Column:
    """Index of the first item for which a test holds that holds for all items after it too; the size if there is none. A binary search."""

    def step(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        half = lambda m: F.when(a["low"] >= a["high"], a).when(test(F.get(items, m)), F.struct(a["low"].alias("low"), m.alias("high"))).otherwise(F.struct((m + 1).alias("low"), a["high"].alias("high")))
        return bound(middle, half)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(items) + 1)).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(items).alias("high")), step, lambda a: a["low"])


def in_blocks(items: Column) -> Column:
    """An array cut into arrays of BLOCK items."""
    ends = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    return F.when(F.size(items) > 0, F.transform(ends, lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array())


def found(text: Column, pattern: str, name: str = "", ord: int = 0) -> Column:
    """All matches of one pattern, left to right. Null text gives no matches.

    The text between matches comes from splitting at the same pattern, so a start is the length of
    all gaps so far and all matches before. The text is matched twice in all, whatever it holds.
    """
    whole = F.coalesce(text, F.lit(""))
    matches, gaps = F.regexp_extract_all(whole, F.lit(FLAGS + pattern), F.lit(0)), F.split(whole, FLAGS + pattern, -1)
    # There is one gap more than matches.
    pieces = F.zip_with(gaps, matches, lambda g, m: F.struct(F.char_length(g).alias("gap"), m.alias("m"), F.char_length(m).alias("n")))

    def one(at: Column, p: Column) -> Column:
        start = at + p["gap"]
        return F.array(F.struct(F.lit(ord).alias("ord"), F.lit(name).alias("name"), p["m"].alias("text"), start.alias("start"), (start + p["n"]).alias("end")))

    return scan(F.filter(pieces, lambda p: p["m"].isNotNull()), F.lit(0), lambda at, p: at + p["gap"] + p["n"], one, MATCH)


def compiled(session: SparkSession, patterns: PatternSet, enhanced: bool = True) -> tuple[PatternSet, list[str]]:
    """The patterns as they will be used, and what was wrong with any: one that does not compile hardened is used as it is, or left out."""
    java, kept, wrong = session._jvm.java.util.regex.Pattern, [], []
    for name, given in patterns.patterns:
        for pattern in [hardened(given), given] if enhanced else [given]:
            try:
                java.compile(FLAGS + pattern)
                kept.append((name, pattern))
                break
            except Exception as e:
                wrong.append(f"{name}: {str(e).splitlines()[0]}")
    return PatternSet(tuple(kept)), wrong


def found_all(text: Column, patterns: PatternSet, enhanced: bool = True) -> Column:
    """Matches of all patterns, by priority; they may overlap."""
    lists = [found(text, hardened(p) if enhanced else p, name, i) for i, (name, p) in enumerate(patterns.patterns)]
    return F.concat(*lists)


def resolved(matches: Column) -> Column:
    """The matches that stay when, from left to right and by priority at equal starts, one is taken if it overlaps none taken."""
    fields = ("start", "ord", "end", "name", "text")
    ordered = F.sort_array(F.transform(matches, lambda m: F.struct(*(m[k].alias(k) for k in fields))))
    # Taken spans are disjoint and in order: only the last one can overlap the next.
    keep = lambda last, m: F.when(m["start"] >= last, F.array(F.struct(*(m[k].alias(k) for k in ("ord", "name", "text", "start", "end"))))).otherwise(F.array().cast(f"array<{MATCH}>"))
    return scan(ordered, F.lit(0), lambda last, m: F.when(m["start"] >= last, m["end"]).otherwise(last), keep, MATCH)


def context(text: Column, start: Column, end: Column, width: int = 5) -> tuple[Column, Column]:
    """Up to ``width`` characters before ``start`` and after ``end``."""
    low = F.greatest(start - width, F.lit(0))
    return F.substring(text, low + 1, start - low), F.substring(text, end + 1, F.lit(width))


#: The part inside a longer string, and the two kinds of token in recognised text.
PART = r"77-[0-9]{3}-[A-Za-z0-9]+(?:-[0-9]{2,3})?"
TOKEN = r"(?:77|4022)-[0-9A-Za-z]+(?:-[0-9A-Za-z]+)*"


def part_of(text: Column) -> Column:
    """The first part number of a string, or null."""
    return F.nullif(F.regexp_extract(text, PART, 0), F.lit(""))


def token_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, TOKEN, 0), F.lit(""))


def normalized(text: Column) -> Column:
    """Lower case without white space of any script and without hyphens."""
    return F.lower(F.regexp_replace(text, r"(?U)[\s-]", ""))


def character_class(c: Column) -> Column:
    """digit, letter, space, punctuation (ASCII) or unicode, by the first rule that holds."""
    return (
        F.when(c.rlike(r"^(?U)\p{Nd}$"), "digit").when(c.rlike(r"^(?U)\p{IsAlphabetic}$"), "letter").when(c.rlike(r"^(?U)\s$"), "space")
        .when(c.rlike(r"^[\x21-\x7E]$"), "punctuation").otherwise("unicode")
    )


