"""The queries of this subpackage, one for each operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, edit_fingerprint, exact_dedup, language_id, licenses, mixing, packing, periodic_runs, secrets, setsketch, toxicity, url_filter
from .common import table


def tokenizer_path() -> str:
    """The byte-level vocabulary that the contract names, where the installed tokenizer files are."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.fingerprint_classes(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digest(table(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), piece_model_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_language_id": op2_language_id,
    "op3_license_scans": op3_license_scans,
    "op4_bpe": op4_bpe,
    "op5_url_filters": op5_url_filters,
    "op6_source_mixing": op6_source_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}
ORACLES: dict[str, str] = {
    "op3_license_scans": licenses.oracle(),
    "op5_url_filters": url_filter.oracle(),
    "op6_source_mixing": mixing.oracle(),
    "op9_exact_dedup": exact_dedup.ORACLE,
}
