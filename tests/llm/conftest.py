from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, token long, node long, doc long, fp long, sha string, name string, count long, n long, `_key` string, `_gone` long"
P1 = "the quick brown fox jumps over the lazy dog while seventeen green turtles walk along the sandy river bank and sing about the old mill near the town "
P2 = "una casa grande con jardín verde donde viven muchos gatos negros y perros blancos que juegan todos los días bajo el sol de la mañana clara "


def rows():
    long_text = " ".join(f"w{i * 7919 % 100003}" for i in range(30_000))
    texts = [
        (1, P1 * 2, "en"), (2, P1 * 2, "en"), (3, P1 * 2 + "extra", "en"), (4, None, None), (5, "", None), (6, "   \n\t ", "en"), (7, "123 456 !!", None), (8, P2, "es"), (9, P2, "es"), (10, P2 + "hoy", "es"),
        (11, "a b c", "en"), (12, "A b C", "en"), (13, "one\ntwo\n\ntwo\nthree", "en"), (14, long_text, "en"), (15, long_text + " tail", "en"), (16, "😀 中文 don't 'll <|endoftext|> x", None), (None, P1 * 2, "en"), (17, "\n".join(["same line here"] * 40), "en"),
    ]
    return [(i, t, la, "s" if i and i % 2 else None, 1, "k", 1, 2, 3, 4, "s", "n", 5, 6, "_", 7) for i, t, la in texts]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty, wordless and long texts, ties, a null key, and columns whose names operators use inside."""
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
