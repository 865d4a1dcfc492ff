"""Bounded, repeatable samples of labelled rows for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many classes have the full number of rows in a sample. With more, the sample stays as large
#: and each class has fewer rows, but never fewer than the least number.
FULL_CLASSES, LEAST_ROWS = 64, 10


def class_sample(rows: DataFrame, label: str, key: str, per_class: int) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each class, chosen by a hash of the key, and the row count of each class.

    Every class is in it. A row's choice depends on its key, its class's count and the number of classes
    alone, so it is the same on every run. Never more than twice the bound in all; null labels and null
    keys are left out.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return rows.limit(0), sizes
    if len(sizes) > FULL_CLASSES:
        per_class = max(min(per_class, LEAST_ROWS), per_class * FULL_CLASSES // len(sizes))
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_class / n))))
    place = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(place < F.coalesce(F.try_element_at(share, F.col(label)), F.lit(0.0))).limit(2 * per_class * len(sizes)), sizes
