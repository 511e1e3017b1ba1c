"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
to the shared folder and read again as the next stage's docs.  All but the last
return the columns of documents.

1. language: documents in no language, or of which no language makes up half, go.
2. near_duplicates: one document of each SimHash group stays, that of the least id.
3. secrets: secrets found are replaced by a mask; no document goes for them.
4. mixing: each document comes as often as the mix takes it, none, one or two times.
5. packing: pieces of documents and their places in sequences.

Defined cases: a null or empty text is in no language and goes in the first stage; null ids and sources stay
what they are; of rows with equal id and text one stays after the second stage; columns beyond those of documents
stay until packing; very long texts go through whole; an empty table gives an empty result.  The tables that a
stage makes, and its predecessor's result, are deleted when its own result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import language, mixing, packing, secrets, simhash
from tidemark.llm.shared import Tables, scratch


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(spark, docs, language.learn(spark, docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(spark, docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(spark, docs, secrets.learn(spark, docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", keep_one_of_each),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifiers, automata and the packing solution have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch():
            docs = tables.save(stage(spark, docs, sf_dir), name)
        if before:
            tables.drop(before)
        before = name
    return docs
