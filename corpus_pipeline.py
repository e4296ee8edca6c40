"""The corpus pipeline: documents through five stages, each written and read again before the next.

Toxic documents go, one document of each near-duplicate group stays (the least doc_id), documents that a benchmark item
leaked into go, personal data is cut out of the rest, and what is left is encoded, with the decoded text compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabelion.llm import bpe, decontaminate, jaccard_join, pii, toxicity
from tabelion.llm.common import Stages, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.reject(docs, table(spark, sf_dir, "benchmark"))


def cut_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars, if there, follows the text."""
    cut = pii.redact(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_checked(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("decontamination", drop_leaks), ("pii", cut_personal_data), ("bpe", encode)]
#: Fitted models and edit distances have no SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stages.keep(stage(spark, docs, sf_dir), name)
        if k:
            stages.drop(before)  # what a later stage has taken over; the given table stays
    return STAGES[-1][1](spark, docs, sf_dir)
