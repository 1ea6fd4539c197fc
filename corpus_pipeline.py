"""A pipeline from documents to token ids: language, exact copies, near copies, mixture, encoding."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import bpe, exact_dedup, langid, mixing, ngram_join
from evidentia.llm._common import filed, shared_folder, short_batches, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told from their text; those without letters, or that no language fits well, go."""
    return langid.keep_identified(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (but for the case of A to Z), that of the largest id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share four fifths of their five-word shingles, that of the least id."""
    with short_batches(spark):
        return ngram_join.one_of_each(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources: whole documents, repeated or left out as the targets demand."""
    return mixing.mixture(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mixture, with digests of the ids and of the text decoded from them."""
    with short_batches(spark):
        return filed(bpe.bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("ids",)))


STAGES = [("language", language), ("copies", copies), ("near_copies", near_copies), ("mixture", mixture), ("encode", encode)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of `sf_dir`, each written as Parquet to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
