"""Settings of the two processing profiles, and what a pattern set and a mapping are."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

APPEND, REPLACE = "append", "replace"


@dataclass(frozen=True)
class Profile:
    """One program variant. ``default_value`` None means that unmapped text is left alone in append mode too."""

    name: str
    text_mode: str = APPEND
    separator: str = ";"
    default_value: str | None = "4022-NA"
    image_mode: str = APPEND
    ocr_engine: str = "hybrid"
    min_confidence: float = 0.4
    min_file_mb: float = 0.0
    max_file_mb: float = 300.0
    suffix: str = "_12NC_processed"
    enhanced: bool = True
    tiers: tuple[str, ...] = ("exact", "lower", "normalized")
    all_headers: bool = False


CANONICAL = Profile("canonical", tiers=("exact",))
CLASSIC = Profile("classic", separator=" ", default_value=None, image_mode=REPLACE, ocr_engine="easyocr", min_confidence=0.7, max_file_mb=100.0, suffix="_processed", all_headers=True)
PROFILES = {p.name: p for p in (CANONICAL, CLASSIC)}


@dataclass(frozen=True)
class PatternSet:
    """Named regular expressions; their order is their priority."""

    patterns: tuple[tuple[str, str], ...] = field(default_factory=tuple)

    @staticmethod
    def of(patterns: dict[str, str]) -> PatternSet:
        """Names that begin with an underscore are metadata."""
        return PatternSet(tuple((k, v) for k, v in patterns.items() if not k.startswith("_")))

    @staticmethod
    def load(path: str) -> PatternSet:
        return PatternSet.of(load_json(path))


#: The two part number patterns, three dashes before two.
PART_PATTERNS = PatternSet.of(
    {
        "pattern_77_enforced_structure": "77-[0-9]{3}-[A-Za-z0-9]{6,7}-[0-9]{2,3}",
        "pattern_77_two_dash_structure": "77-[0-9]{3}-[A-Za-z0-9]+",
    }
)


def load_json(path: str) -> dict:
    """A JSON object in file order. A missing or broken file raises: it must not look like an empty one."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no JSON object")
    return found


#: Fixed value: what environment variables that override a setting begin with.
ENVIRONMENT = "DOC_PROCESSING_"


def load_profile(base: Profile = CANONICAL, path: str | None = None, environment: Mapping[str, str] | None = None) -> tuple[Profile, list[str]]:
    """A profile with the settings of a JSON or YAML file, then of the environment, and warnings about values out of range.

    Variables are named DOC_PROCESSING_ and the setting in capitals. Unknown settings and values that do
    not read as the setting's type raise.
    """
    settings: dict = {}
    if path is not None and path.endswith((".yml", ".yaml")):
        import yaml  # only where such a file is used

        settings = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    elif path is not None:
        settings = load_json(path)
    settings |= {k.removeprefix(ENVIRONMENT).lower(): v for k, v in (environment or {}).items() if k.startswith(ENVIRONMENT)}
    types = {f.name: type(getattr(base, f.name)) for f in dataclasses.fields(base)}
    if unknown := sorted(set(settings) - set(types)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")

    def read(name: str, value: object) -> object:
        if types[name] is bool and isinstance(value, str):
            if value.lower() not in ("true", "false", "1", "0", "yes", "no"):
                raise ValueError(f"{name}: {value!r} is no truth value")
            return value.lower() in ("true", "1", "yes")
        if types[name] is tuple:
            return tuple(value.split(",")) if isinstance(value, str) else tuple(value)
        return types[name](value) if types[name] in (bool, float, int) else value

    made = dataclasses.replace(base, **{k: read(k, v) for k, v in settings.items()})
    warnings = [
        text
        for bad, text in (
            (made.text_mode not in (APPEND, REPLACE), f"text_mode is {made.text_mode!r}"),
            (made.image_mode not in (APPEND, REPLACE), f"image_mode is {made.image_mode!r}"),
            (made.ocr_engine not in ("hybrid", "easyocr", "tesseract"), f"ocr_engine is {made.ocr_engine!r}"),
            (not 0 <= made.min_confidence <= 1, f"min_confidence is {made.min_confidence}, not between 0 and 1"),
            (made.min_file_mb < 0 or made.max_file_mb <= made.min_file_mb, f"file sizes from {made.min_file_mb} to {made.max_file_mb} MB"),
        )
        if bad
    ]
    return made, warnings
