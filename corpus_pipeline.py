"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glossator.llm.common import drop_path, scratch, shared_dir, table, tidy
from glossator.llm.decontaminate import without_leaks
from glossator.llm.dedup import deduplicated
from glossator.llm.language import with_language
from glossator.llm.mixing import mix_texts
from glossator.llm.tokenfile import token_output


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found."""
    return with_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: documents repeated, and some cut."""
    return mix_texts(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the corpus, read back: a row a document."""
    import public_tokenizers

    return token_output(docs, public_tokenizers.path("byte_bpe_50k.json"), folder=f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex[:12]}")


STAGES = [
    ("language ID", language),
    ("near-dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token ids", token_ids),
]

#: SQL can't express its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and reread as the next one's docs. What a stage made besides is deleted
    once its rows are written; the token files stay.

    Null texts, texts without letters and empty tables go through; a null id is a document like others, kept and mixed.
    """
    docs = table(spark, sf_dir, "documents")
    before = ()
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        tidy(spark, path)
        for old in before:
            drop_path(spark, old)
        before = (path,)
    return docs
