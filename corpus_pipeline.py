"""A training corpus from raw documents in five stages.

Every stage works on all rows that the one before kept, takes ``(spark, docs, sf_dir)`` and returns a
DataFrame; all but the last return the columns of ``docs``.  ``run`` applies them to the documents
table and writes each result as Parquet to the shared checkpoint folder before the next one reads it.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe_codec, langid, mixing, ngram_join, secret_scan
from larkspur.sources.shared import shared_folder

#: SQL can express none of the first three stages and the last (models, MinHash, BPE): tests/llm hold them against plain versions.
ORACLE_SQL = None

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Sends texts to Python 4 MB at a time, so that the workers of small executors hold few of them.

    Spark reads the setting when a result is written, after its stage has returned: ``run`` puts it back at the end, a
    stage called by itself leaves it set.
    """
    spark.conf.set(BATCH, 4 << 20)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without a letter, those whose best language has a score below one half, and those whose words are unlike that language's (``langid.checked``).

    Null and empty texts go; repeated rows go or stay together; an empty table, or one without labelled
    languages, gives no rows.
    """
    small_batches(spark)
    return langid.keep_known(docs, langid.fit(docs), least=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of least id, of each class of texts linked by a Jaccard similarity of 0.8 or more on five-word n-grams.

    Null and blank texts stay; of repeated rows one stays; an empty table stays empty.
    """
    small_batches(spark)
    return ngram_join.keep_one(docs, width=5, threshold=0.8, recall=0.9999)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of each secret; no document goes.

    Null texts stay null and empty ones empty; repeated rows are treated alike; an empty table stays empty.
    """
    small_batches(spark)
    return secret_scan.redact(docs, secret_scan.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Returns each document as often as the mix takes it: up to three times, or not at all.

    Texts without words, null ones too, aren't taken; rows of one id, source and size share what they
    take evenly, in whole words, so that up to a word a row is missing; an empty table stays empty.
    """
    small_batches(spark)
    return mixing.apply_mix(docs, weights=(5, 2, 1), max_epochs=3)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian unsigned 32-bit), their number, and digests of ids and decoded text.

    Null and empty texts have no tokens; repeated rows have equal ids; an empty table gives no rows.
    """
    small_batches(spark)
    coded = bpe_codec.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("bpe_codec", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", spark.conf.get(BATCH)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    finally:
        spark.conf.set(BATCH, before)
    return docs
