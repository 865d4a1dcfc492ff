"""From documents to token ids in five stages; each works on all that the one before kept.

Rows are told apart by doc_id and text together: rows that share a doc_id, and rows with a null one, are
rows of their own in every stage. A null text counts as empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.llm.byte_bpe import encode_texts
from partweave.llm.common import cut, free_name, prepare, table, whole_text
from partweave.llm.exact_dedup import keep_one
from partweave.llm.jaccard_join import near_duplicates
from partweave.llm.language_id import PER_CLASS, UNKNOWN, fit, training_rows, with_language
from partweave.llm.mixing import mix_sources

#: A document is rejected where its language is unknown or its best language is less likely than this.
LEAST_CONFIDENCE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language with some confidence, go. Repeated rows stay as often as they come.

    Where no row has a language to learn from nothing can be told about a language: only documents
    without a letter go.
    """
    prepare(spark)
    rows = docs.select("doc_id", "text", "lang")
    model = fit(training_rows(rows, "lang", "doc_id", 4, 2), "text", "lang", "doc_id", PER_CLASS)
    if model is None:
        return docs.where(whole_text().rlike(r"\p{L}"))
    language, confidence = free_name(docs, "language"), free_name(docs, "confidence")
    found = with_language(docs, model, "text", language, confidence)
    return found.where((F.col(language) != UNKNOWN) & (F.col(confidence) >= LEAST_CONFIDENCE)).drop(language, confidence)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays, in one row however often that row is repeated."""
    return keep_one(docs)


def _numbered(docs: DataFrame, name: str) -> DataFrame | None:
    """``docs`` with a key of its own in ``name`` for each row, None if no ``doc_id`` repeats.

    Rows keep their doc_id; only those that share one are sorted, by text hash, and get numbers beyond the
    largest. Texts of the others are not moved.
    """
    again = free_name(docs, "again")
    counts = docs.groupBy(F.col("doc_id").alias(again)).agg(F.count(F.lit(1)).alias("rows"))
    repeated = cut(counts.where("rows > 1").select(again))
    if repeated.isEmpty():
        return None
    most = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0
    same = F.col("doc_id").eqNullSafe(F.col(again))
    shared = docs.join(repeated.hint("merge"), same, "left_semi").orderBy(F.asc_nulls_first("doc_id"), F.xxhash64(whole_text()))
    own = docs.join(repeated.hint("merge"), same, "left_anti").withColumn(name, F.col("doc_id").cast("long"))
    return cut(own.unionByName(shared.withColumn(name, F.lit(most) + 1 + F.monotonically_increasing_id())))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest doc_id stays; of texts with one doc_id, by a hash of the text.

    Where rows share a doc_id they are told apart by numbers, so that each comes or goes on its own.
    """
    row, name = free_name(docs, "row"), free_name(docs, "gone")
    numbered = _numbered(docs, row)
    if numbered is None:
        groups, key = near_duplicates(docs, key="doc_id"), "doc_id"
        stays = F.col("component_id").eqNullSafe(F.col(key))
        gone = groups.where(~stays).select(F.col(key).alias(name)).distinct()
        return docs.join(cut(gone).hint("merge"), F.col(key).eqNullSafe(F.col(name)), "left_anti")
    groups = cut(near_duplicates(numbered, key=row).select(F.col(row).alias(name), "component_id"))
    named = numbered.select(row, F.struct(F.col("doc_id").alias("id"), F.xxhash64(whole_text()).alias("fp"), F.col(row).alias("row")).alias("_place"))
    placed = groups.join(named.hint("merge"), F.col(name) == F.col(row))
    first = cut(placed.groupBy("component_id").agg(F.min("_place").alias("_first")))
    gone = cut(placed.select(name, "component_id").join(first, "component_id").where(F.col(name) != F.col("_first.row")).select(name))
    return numbered.join(gone.hint("merge"), F.col(row) == F.col(name), "left_anti").drop(row)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight has them emitted.

    Repeated rows are emitted each; they get a number first, so that none is multiplied by the others.
    """
    fp, doc, own, times, turn, row = (free_name(docs, n) for n in ("fp", "emitted_doc", "emitted_fp", "times", "turn", "row"))
    marked, key = docs.withColumn(fp, F.xxhash64(whole_text())), "doc_id"
    if not marked.groupBy("doc_id", fp).agg(F.count(F.lit(1)).alias(times)).where(F.col(times) > 1).isEmpty():
        key, marked = row, _numbered(docs, row).withColumn(fp, F.xxhash64(whole_text()))
    emitted, _ = mix_sources(marked, key=key)
    turns = cut(emitted.groupBy(F.col(key).alias(doc), F.col("fp").alias(own)).agg(F.count(F.lit(1)).cast("int").alias(times)))
    joined = marked.join(turns.hint("merge"), F.col(key).eqNullSafe(F.col(doc)) & (F.col(fp) == F.col(own)))
    if key == row:
        joined = joined.drop(row)
    return joined.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(fp, doc, own, times, turn)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and digests of them and of what they decode to."""
    return encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: The classifier and the shuffled orders are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written to the shared folder and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
