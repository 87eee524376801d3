"""A training corpus from `documents`: identified languages, one of each group of near copies, no benchmark passages, mixed sources, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinfold.llm import decontaminate, dedup, langid, mixing, tokens
from twinfold.session import settle

#: Most bytes of a batch that goes to a Python worker, but for its last row. Spark's own 64 MB are held by the JVM beside its heap and by the worker, for each task of an executor.
BATCH = "4m"


def small_batches(spark: SparkSession) -> None:
    """Stages run after they return, so this stays in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters and texts whose language the classifier rejects go."""
    small_batches(spark)
    return langid.drop_unidentified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five words, 0.8) the document with the smallest id stays. Texts without words and rows without an id are in no class and stay; of equal rows one stays."""
    small_batches(spark)
    return dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any passage of the benchmark go. Null and empty texts have none and stay, as does every document if the benchmark is empty."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of small sources come up to twice, in the order of the mixture."""
    return mixing.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows in the order of the mixture, which is that of docs' files, described as read back. Null texts are the end mark alone; null ids stay null."""
    small_batches(spark)
    return tokens.token_files(tokens.file_order(docs))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: The classifier, the sampled signatures and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Rows without an id, null and very long texts and repeated rows go through; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
