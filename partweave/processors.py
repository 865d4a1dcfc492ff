"""Processors by name: what each detects and in which mode, made for a profile; new ones register themselves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.functions.spans import part_of
from partweave.operators.boxes import confident
from partweave.operators.detect import detections
from partweave.operators.lookup import lookup, with_default
from partweave.operators.rewrite import composed
from partweave.profiles import PART_PATTERNS, PatternSet, Profile


@dataclass(frozen=True)
class Processor:
    """From the rows of its kind and the mapping to matches with replacements: a plan, nothing runs here."""

    name: str
    run: Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Registration:
    """A factory with the extensions it takes; of several that take one, that with the lowest ``priority`` gets the file."""

    name: str
    factory: Callable[[Profile, PatternSet], Processor]
    extensions: tuple[str, ...] = ()
    priority: int = 100
    enabled: bool = True


_REGISTERED: dict[str, Registration] = {}


def register(name: str, extensions: tuple[str, ...] = (), priority: int = 100, enabled: bool = True) -> Callable:
    """Adds a factory under a name; a later one with the same name takes its place."""

    def add(factory: Callable[[Profile, PatternSet], Processor]) -> Callable[[Profile, PatternSet], Processor]:
        _REGISTERED[name] = Registration(name, factory, tuple(e.lower() for e in extensions), priority, enabled)
        return factory

    return add


def unregister(name: str) -> None:
    _REGISTERED.pop(name, None)


def by_extension(ext: Column, registered: dict[str, Registration] | None = None) -> Column:
    """Name of the processor of a file: the first by priority, then name, that is enabled and takes its extension, whatever the case; else null."""
    out = F.lit(None).cast("string")
    for r in sorted((_REGISTERED if registered is None else registered).values(), key=lambda r: (r.priority, r.name), reverse=True):
        if r.enabled and r.extensions:
            out = F.when(F.lower(ext).isin(*r.extensions), r.name).otherwise(out)
    return out


def routed(files: DataFrame, branches: dict[str, Callable[[DataFrame], DataFrame]], registered: dict[str, Registration] | None = None, ext: str = "ext") -> DataFrame:
    """One listing split by the rules into a plan per processor, and the plans' rows united, with ``processor``.

    Each branch is the listing under its own filter, which the scan takes over; branches must return the same
    columns. Files that no processor takes, or whose processor has no branch, have no rows.
    """
    name, out = by_extension(F.col(ext), registered), []
    for processor_name, run in branches.items():
        out.append(run(files.where(name == processor_name)).withColumn("processor", F.lit(processor_name)))
    return reduce(DataFrame.unionByName, out)


def names() -> list[str]:
    return sorted(_REGISTERED)


def processor(name: str, profile: Profile, patterns: PatternSet = PART_PATTERNS) -> Processor:
    """The processor of that name for a profile; an unknown name raises and says which there are."""
    if name not in _REGISTERED:
        raise ValueError(f"no processor {name!r}; there are {', '.join(names())}")
    return _REGISTERED[name].factory(profile, patterns)


def _text_matches(profile: Profile, patterns: PatternSet) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def run(units: DataFrame, mapping: DataFrame) -> DataFrame:
        rows = lookup(detections(units, patterns, profile.enhanced), "matched_text", mapping, profile.tiers)
        rows = with_default(rows, profile.text_mode, profile.default_value)
        return rows.withColumn("final", composed(F.col("matched_text"), F.col("replacement"), profile.text_mode, profile.separator))

    return run


@register("text", (".docx",), 1)
def text(profile: Profile, patterns: PatternSet) -> Processor:
    """Paragraphs, cells and headers."""
    return Processor("text", _text_matches(profile, patterns))


@register("graphics", (".svg", ".pdf"), 2)
def graphics(profile: Profile, patterns: PatternSet) -> Processor:
    """Text boxes: the same matches; sizes are computed from what they become."""
    return Processor("graphics", _text_matches(profile, patterns))


@register("image", (".png", ".jpg", ".jpeg", ".tiff", ".bmp"), 3)
def image(profile: Profile, patterns: PatternSet) -> Processor:
    """Recognised boxes that the profile takes, with the first part number of each, in its image mode."""

    def run(boxes: DataFrame, mapping: DataFrame) -> DataFrame:
        rows = confident(boxes, profile).withColumn("matched_text", part_of(F.col("text"))).where("matched_text IS NOT NULL")
        rows = with_default(lookup(rows, "matched_text", mapping, profile.tiers), profile.image_mode, profile.default_value)
        return rows.withColumn("final", composed(F.col("matched_text"), F.col("replacement"), profile.image_mode, profile.separator))

    return Processor("image", run)


def with_fallbacks(action: Callable, fallbacks: tuple[Callable, ...] = (), attempts: int = 1) -> Callable:
    """A function that tries ``action`` so often, then each fallback once; it returns the result, the number of tries and who gave it.

    For use inside row functions, such as archive parsers: a row that fails everywhere raises the last
    error, and the caller makes it an error row.
    """

    def run(*args: object) -> tuple[object, int, str]:
        error, tries = None, 0
        for one in [action] * attempts + list(fallbacks):
            tries += 1
            try:
                return one(*args), tries, getattr(one, "__name__", "action")
            except Exception as e:  # the next one may do
                error = e
        raise error

    return run


#: The category of an operation by the words in its name, in order.
OPERATIONS = (("conversion", ("convert", "doc")), ("loading", ("load", "parse")), ("ocr", ("ocr", "image")))


def operation_category(operation: str) -> str:
    """conversion, loading, ocr or processing, by an operation's name."""
    return next((name for name, words in OPERATIONS if any(w in operation.lower() for w in words)), "processing")


@dataclass(frozen=True)
class Outcome:
    """What came of one row: the value, or null with the first error; ``tries`` counts all calls, ``strategy`` says whose the value is."""

    value: object
    tries: int
    strategy: str
    fallback_used: bool
    error_type: str | None
    error: str | None


def guarded(operation: str, action: Callable, strategies: dict[str, tuple[Callable, ...]], attempts: int = 1) -> Callable[..., Outcome]:
    """A row function that never raises: ``action`` so often, then in turn the strategies of its operation's category.

    A strategy gets the same arguments. The error that is told is the last one of ``action``, also where a
    strategy helped. For use inside Arrow row functions, whose rows then carry tries, strategy and error as columns.
    """
    chain = strategies.get(operation_category(operation), ())

    def run(*args: object) -> Outcome:
        failed: Exception | None = None
        for k in range(attempts):
            try:
                return Outcome(action(*args), k + 1, "primary", False, type(failed).__name__ if failed else None, str(failed)[:500] if failed else None)
            except Exception as e:  # the next one may do
                failed = e
        told = type(failed).__name__, str(failed)[:500]
        for k, one in enumerate(chain):
            try:
                return Outcome(one(*args), attempts + k + 1, one.__name__.strip("_"), True, *told)
            except Exception:  # noqa: S112  the first error is the one to tell
                continue
        return Outcome(None, attempts + len(chain), "none", False, *told)

    return run
