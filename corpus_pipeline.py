"""A corpus pipeline of five stages, each calling one operator of ``strandloom.llm``.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and
read again as the next one's ``docs``. Stages fit what they need on their own input.
Whole texts travel between Spark and Python in every stage, so its Arrow batches are
set to ``BATCH_ROWS`` rows; Spark's default of 10,000 holds five times that memory on
both sides of each worker.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe_codec, decontaminate, language, pii, simhash
from strandloom.session import scratch_path, table


BATCH_ROWS = 2000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those the classifier rejects go."""
    model = language.fit(docs.where(~language.held_out()))
    return language.keep_identified(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.drop_similar(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = pii.redact(docs, pii.fit(pii.labelled_table(spark)))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoding, as digests."""
    path = public_tokenizers.path(bpe_codec.VOCABULARY)
    return bpe_codec.digests(bpe_codec.decode(bpe_codec.encode(docs, ranks_path=path), ranks_path=path))


BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(stage):
    """The stage with its session's Arrow batches bounded: they must be while its result
    is written, so ``run`` sets them back in the end."""

    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return bounded


STAGES = [
    ("language", staged(language_stage)),
    ("near_duplicates", staged(near_duplicate_stage)),
    ("decontamination", staged(decontamination_stage)),
    ("pii", staged(pii_stage)),
    ("encoding", staged(encoding_stage)),
]

# Classifiers, fingerprints and merges are beyond SQL; tests hold the result
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES:
            path = scratch_path(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs
