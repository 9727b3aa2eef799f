"""Documents to training records: quality, near-duplicates, decontamination, mixture, token records.

Each stage gets all that its predecessor kept and returns the columns of
documents, the last one the rows of the token records. Stages set the session's
``spark.sql.execution.arrow.maxBytesPerBatch``, as whoever runs them writes the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codequarry.llm import decontaminate, mixture, neardup, quality, records
from codequarry.llm.queries import tokenizer_path
from codequarry.llm.shared import shared_folder, table, written

#: Text that goes to a Python worker at once. Workers and the JVM beside them keep what the largest batch took, over all stages.
BATCH = "2m"


def _in_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is usual for their language."""
    _in_batches(spark)
    return quality.Classifier(docs, table(spark, sf_dir, "labels")).kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    _in_batches(spark)
    return neardup.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    _in_batches(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of smaller sources up to twice."""
    _in_batches(spark)
    return mixture.mixed(docs, budget_share=None, balance=0.95, max_repeats=2.0)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    _in_batches(spark)
    return records.token_records(docs, shared_folder(spark), tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixture", source_mixture),
    ("token_output", token_output),
]

#: The language model's floating-point scores and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return docs
