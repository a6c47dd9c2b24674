"""The corpus pipeline: five stages over `documents`, each applying one operator to all that the one before kept.

run(spark, sf_dir) returns what the last stage returns: doc_id, start, n_tokens and ids_crc32 of each document
of the final token dataset. There is no ORACLE_SQL: alignment and tokenisation aren't expressible in SQL; the
tests hold run() against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import decontaminate, language, minhash, mixing, token_files
from chronolith.llm.common import new_path, table

#: A document whose language is undetermined, or less sure than this, goes.
LEAST_SCORE = 0.5


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language isn't clear, go. The model is learned as in the
    query op7; every row is then judged by its own text, in place."""
    model = language.learn(docs.where(~language.is_held_out(F.col("doc_id"))))
    return language.keep(docs, model, LEAST_SCORE)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    found = minhash.near_duplicates(docs, width=5, percent=80)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times."""
    return mixing.repeated(docs, mixing.mix(docs))


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token dataset, as read back from its files."""
    return token_files.read_tokens(spark, token_files.write_tokens(docs))


STAGES = [
    ("language_id", stage_language),
    ("near_dedup", stage_near_dedup),
    ("decontamination", stage_decontaminate),
    ("mixing", stage_mix),
    ("token_output", stage_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
