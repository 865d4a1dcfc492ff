"""Words of whole texts as arrays in the row, by built-in functions, for operators that count terms in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_ascii(word: Column) -> Column:
    """The word with A-Z alone in lower case.

    ``lower`` also changes letters beyond ASCII, but a word that it leaves alone has no A-Z; so the slow
    ``translate`` runs only for words with a capital.
    """
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def word_array(text: Column, apart: str) -> Column:
    """The words of a text in order, as they stand: what stretches of ``apart`` part; none where it is null or empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), apart), lambda w: w != "")
