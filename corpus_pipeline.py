"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

Language identification drops what it rejects; MinHash near-duplicate detection keeps one document
of each group (five-word shingles, similarity 0.8 or more); decontamination drops documents that
leak a benchmark item; mixing repeats and thins documents to the sources' target weights; sharding
deals the rows to 16 shards. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shellgraph.llm import common, decontam, jump_hash, langid, minhash, mixing

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Models from all labelled documents; texts without letters and texts like none of the
    languages go."""
    return langid.predict(docs, langid.train(docs.select("text", "lang")), only_kept=True)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of the mixture; the
    repeats of a document follow each other in its shard."""
    return jump_hash.assign(docs, 16)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("dedup", dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: The language models can't be written in SQL; the tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = common.Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
