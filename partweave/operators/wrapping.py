"""Word wrapping for part numbers: a vectorised function, since breaking a word depends on what came before it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partweave.operators.capacity import LEAST_SIZE, classic_capacity
from partweave.session import ship

#: A single line may be this much longer than the target.
TOLERANCE = 1.1


def chopped(piece: str, width: int) -> list[str]:
    return [piece[i : i + width] for i in range(0, len(piece), width)] or [""]


def broken(word: str, width: int) -> list[str]:
    """A long word in pieces of at most ``width``: at hyphens, else at underscores, else anywhere."""
    mark = "-" if "-" in word else "_" if "_" in word else None
    if mark is None:
        return chopped(word, width)
    head, *tail = word.split(mark)
    done, open_piece = [], ""
    for part in [head, *(mark + t for t in tail)]:
        if len(open_piece) + len(part) <= width:
            open_piece += part
            continue
        done += [open_piece] if open_piece else []
        *full, open_piece = chopped(part, width)
        done += full
    return [*done, open_piece]


def wrap(text: str, width: int) -> list[str]:
    """Lines of a text at ``width`` characters; line breaks stay, a slightly longer line is left whole."""
    lines: list[str] = []
    for line in text.split("\n"):
        if len(line) <= width * TOLERANCE:
            lines.append(line)
            continue
        current = ""
        for word in line.split(" "):
            longer = f"{current} {word}" if current else word
            if len(longer) <= width:
                current = longer
                continue
            if current:
                lines.append(current)
            *full, current = broken(word, width) if len(word) > width else [word]
            lines += full
        if current:
            lines.append(current)
    return lines


@F.pandas_udf(T.ArrayType(T.StringType()))
def wrapped(texts: pd.Series, widths: pd.Series) -> pd.Series:
    """``wrap`` over Arrow batches; null text gives null."""
    return pd.Series([None if t is None else wrap(t, max(1, int(w))) for t, w in zip(texts, widths, strict=True)])


def wrap_lines(boxes: DataFrame, width: Column, text: str = "text") -> DataFrame:
    """``boxes`` with ``lines``, ``required_lines`` and ``max_line_length``."""
    ship(boxes.sparkSession)
    out = boxes.withColumn("lines", wrapped(F.col(text), width))
    return out.withColumn("required_lines", F.size("lines")).withColumn("max_line_length", F.coalesce(F.array_max(F.transform("lines", F.char_length)), F.lit(0)))


def optimal_size(boxes: DataFrame, least: float | Column = LEAST_SIZE) -> DataFrame:
    """``boxes`` with ``optimal_size``: the largest size in quarter points from the original down to 75 % of it at which the wrapped text fits, else ``least``."""
    schema = T.StructType([*boxes.schema.fields, T.StructField("optimal_size", T.DoubleType())])
    ship(boxes.sparkSession)
    sized = boxes.withColumn("_l", (least if isinstance(least, Column) else F.lit(least)).cast("double"))
    sized = sized.withColumn("_q", F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("size") - F.greatest(F.col("_l"), F.col("size") * 0.75)) * 4).cast("int"))), lambda k: F.col("size") - k / 4))
    sized = sized.withColumn("_c", F.transform("_q", lambda q: classic_capacity(F.col("width"), F.col("height"), q, F.lit(True))))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for text, size, whole, least, sizes, rooms in zip(*(pdf[c] for c in ("text", "size", "has_dimensions", "_l", "_q", "_c")), strict=True):
                if not whole:
                    n = len(text or "")
                    factor = 0.85 if n > 150 else 0.9 if n > 100 else 0.95 if n > 70 else None
                    found.append(size if factor is None else max(least, size * factor))
                    continue
                best = least
                for q, room in zip(sizes, rooms, strict=True):
                    lines = wrap(text or "", room["max_cpl"])
                    if q >= max(least, size * 0.75) and len(lines) <= room["max_lines"] and max(map(len, lines), default=0) <= room["max_cpl"]:
                        best = q
                        break
                found.append(best)
            yield pdf.drop(columns=["_l", "_q", "_c"]).assign(optimal_size=found)

    return sized.mapInPandas(search, schema)


#: The least size after an overflow, as points and as a share of the original, and the change below which a size stays.
OVERFLOW_LEAST, OVERFLOW_SHARE, UNCHANGED = 8.0, 0.7, 0.1


def overflow_size(boxes: DataFrame) -> DataFrame:
    """``boxes`` with ``new_size``, the optimal size with a higher least one, and ``adjusted``, whether it differs enough to be applied."""
    found = optimal_size(boxes, F.greatest(F.lit(OVERFLOW_LEAST), F.col("size") * OVERFLOW_SHARE))
    change = F.abs(F.col("optimal_size") - F.col("size")) > UNCHANGED
    return found.withColumn("adjusted", change).withColumn("new_size", F.when(change, F.col("optimal_size")).otherwise(F.col("size"))).drop("optimal_size")
