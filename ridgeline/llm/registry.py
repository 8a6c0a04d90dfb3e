"""Queries of the operators and, where SQL can express them, their SQL.

Rows with nulls, empty and very long texts, ties, repeated rows, empty tables and
further columns give what the operator's docstring states; no query adds a rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import conversation_repair, jaccard, line_dedup, metric_search, mixing, packing, quality, secret_scan, substring_index, suffix_dedup, token_counts, toxicity, whitening

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of all documents."""
    return suffix_dedup.remove_repeated_bytes(table(spark, root, "documents"), keep_text=False).drop("kept_bytes")


def op2_token_counts(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of all documents; meets the shared folder's cache."""
    return token_counts.token_report(table(spark, root, "documents"))


def op3_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    """Base statistics, lost words, base_failed and kept of all documents."""
    return quality.clean_lines(table(spark, root, "documents"), keep_text=False)


def op4_source_mixing(spark: SparkSession, root: str) -> DataFrame:
    """Topic, tokens, calibrated weight, probability and choice of all documents."""
    return mixing.mix_report(table(spark, root, "documents"))


def op5_toxicity(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    return toxicity.toxicity(table(spark, root, "documents"), table(spark, root, "labels"))


def op6_metric_top_k(spark: SparkSession, root: str) -> DataFrame:
    """The 20 best candidates of every vector whose vec_id is divisible by 20."""
    return metric_search.top_k(table(spark, root, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    """Every piece of all documents and its place in a sequence."""
    return packing.pack(table(spark, root, "documents"))


def op8_secret_scans(spark: SparkSession, root: str) -> DataFrame:
    """Counts, base digest and spans of the secrets in all documents."""
    return secret_scan.secret_report(table(spark, root, "documents"))


def op9_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of all documents."""
    return substring_index.remove_repeats(table(spark, root, "documents"), keep_text=False).drop("kept_text")


def op10_ngram_jaccard(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, n_shingles, component_id of all documents."""
    return jaccard.near_duplicates(table(spark, root, "documents"))


def op11_embedding_whitening(spark: SparkSession, root: str) -> DataFrame:
    """Sixteen whitened components of every usable vector."""
    return whitening.whiten(table(spark, root, "embeddings"))


def op12_conversation_repair(spark: SparkSession, root: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every damaged conversation."""
    conversations = table(spark, root, "conversations")
    return conversation_repair.repair_report(conversation_repair.damaged(conversations), every=conversations)


def op13_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of all documents."""
    return line_dedup.drop_repeated_lines(table(spark, root, "documents"), keep_text=False)


def queries() -> dict[str, Query]:
    found = (
        op1_suffix_dedup, op2_token_counts, op3_quality_rules, op4_source_mixing, op5_toxicity,
        op6_metric_top_k, op7_best_fit_packing, op8_secret_scans, op9_substring_dedup, op10_ngram_jaccard,
        op11_embedding_whitening, op12_conversation_repair, op13_line_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Tokenizers (2, 7), a trained model (5) and eigenvectors (11) are beyond SQL."""
    return {
        "op1_suffix_dedup": suffix_dedup.SQL,
        "op3_quality_rules": quality.SQL,
        "op4_source_mixing": mixing.sql(),
        "op6_metric_top_k": metric_search.SQL,
        "op8_secret_scans": secret_scan.sql(),
        "op9_substring_dedup": substring_index.SQL,
        "op10_ngram_jaccard": jaccard.SQL,
        "op12_conversation_repair": conversation_repair.SQL,
        "op13_line_dedup": line_dedup.SQL,
    }
