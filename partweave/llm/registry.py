"""Queries of this folder, by the names that the entry file registers, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.llm import oracle_rules, oracle_terms
from partweave.llm.byte_bpe import encode_texts
from partweave.llm.common import prepare, table
from partweave.llm.exact_dedup import exact_duplicates
from partweave.llm.importance_resampling import importance_resample
from partweave.llm.jaccard_join import near_duplicates
from partweave.llm.language_id import identify_languages
from partweave.llm.line_dedup import dedup_lines
from partweave.llm.mixing import mix_sources
from partweave.llm.quality_classifier import quality_scores
from partweave.llm.quality_rules import quality_rules
from partweave.llm.source_divergence import divergence
from partweave.llm.suffix_dedup import remove_repeats
from partweave.llm.token_counts import token_counts
from partweave.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learnt from the labelled ones outside the held-out fifth."""
    return quality_scores(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equal texts."""
    return exact_duplicates(table(prepare(spark), sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity and verdict for every document."""
    return toxicity(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document by the byte-level vocabulary."""
    return token_counts(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, base verdict and risk-controlled verdict of every document."""
    return quality_rules(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the lines that repeat earlier passages, and the digest of what is left."""
    clean = dedup_lines(table(prepare(spark), sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_deleted", "deleted", F.sha2(F.col("text").cast("binary"), 256).alias("clean_sha256"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document its number of shingles and the smallest doc_id that links reach."""
    return near_duplicates(table(prepare(spark), sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for every document, learnt outside the held-out quarter."""
    return identify_languages(table(prepare(spark), sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of what they decode to, for every document."""
    encoded = encode_texts(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the mix emits, in order, each as often as its source's weight asks."""
    rows, _ = mix_sources(table(prepare(spark), sf_dir, "documents"))
    return rows.select("doc_id", "source", "n_tokens", "turn", "block", "place")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergence of every pair of sources of a language, and the terms by which a source stands out."""
    return divergence(table(prepare(spark), sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document how much of it stands elsewhere too, and the digest of what is left without that."""
    clean = remove_repeats(table(prepare(spark), sf_dir, "documents"), keep_first=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["e"] - x["a"])
    return clean.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards the benchmark's texts, and its rank if it is drawn."""
    return importance_resample(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_language_id": op8_language_id,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_source_mixing": op10_source_mixing,
    "op11_source_divergence": op11_source_divergence,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, str] = {
    "op5_quality_rules": oracle_rules.sql(),
    "op11_source_divergence": oracle_terms.DIVERGENCE,
    "op13_importance_resampling": oracle_terms.RESAMPLING,
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (w ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
