"""The corpus operators as queries over whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import digest, kneser_ney, license_scan, merge_dropout, packing, pii, simhash, site_templates, telephony, token_counts
from keyloom.session import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), model=packing.MODEL)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licences(table(spark, sf_dir, "documents"))


def op3_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.main_text(table(spark, sf_dir, "pages"))


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_identifiers(table(spark, sf_dir, "documents"))


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.decode_calls(telephony.media_column(table(spark, sf_dir, "documents")))


def op6_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op8_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.exact_groups(table(spark, sf_dir, "documents"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_license_scan, op3_site_templates, op4_pii_spans, op5_telephony_audio, op6_trie_token_counts, op7_simhash_groups, op8_canonical_digest, op9_kneser_ney, op10_merge_dropout)}

# DuckDB has no NFKC and no case folding beyond lower(); for letters such as those in the tables NFC, lower() and the
# sharp s give the same groups.
ORACLES: dict[str, str] = {
    "op8_canonical_digest": r"""
        WITH folded AS (
            SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g')) AS body FROM documents
        )
        SELECT doc_id,
               CASE WHEN body IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY body) END AS canonical_id,
               CASE WHEN body IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY body) END AS n_copies
        FROM folded
    """,
}
