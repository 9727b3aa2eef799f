"""The registered queries of this package, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codequarry.llm import (
    decontaminate, fingerprints, html, mixture, neardup, negatives, oracles, pii, quality, records, secretscan, substrings, suffixes, whitening,
)
from codequarry.llm.shared import shared_folder, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.Classifier(table(spark, folder, "documents"), table(spark, folder, "labels")).results()


def document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, folder, "documents"))


def source_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mixture(table(spark, folder, "documents"))


def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digests(table(spark, folder, "documents"))


def suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digests(table(spark, folder, "documents"))


def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_texts(table(spark, folder, "pages"))


def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def token_output(spark: SparkSession, folder: str) -> DataFrame:
    return records.token_records(table(spark, folder, "documents"), shared_folder(spark), tokenizer_path())


def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mined(table(spark, folder, "embeddings"))


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secretscan.secrets(table(spark, folder, "documents"))


def embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {
    "op1_near_dedup": near_dedup,
    "op2_quality_classifier": quality_classifier,
    "op4_substring_dedup": substring_dedup,
    "op8_suffix_array_dedup": suffix_array_dedup,
    "op5_html_extraction": html_extraction,
    "op3_document_fingerprints": document_fingerprints,
    "op9_source_mixture": source_mixture,
    "op6_personal_data": personal_data,
    "op7_benchmark_decontamination": benchmark_decontamination,
    "op10_token_output": token_output,
    "op11_hard_negatives": hard_negatives,
    "op12_secret_scan": secret_scan,
    "op13_embedding_whitening": embedding_whitening,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op4_substring_dedup": oracles.SUBSTRINGS,
    "op7_benchmark_decontamination": oracles.DECONTAMINATION,
    "op11_hard_negatives": oracles.HARD_NEGATIVES,
    "op12_secret_scan": oracles.SECRETS,
}
