"""Queries of this package's operators over the shared tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, fingerprints, importance, langid, line_dedup, media, mixing, ngram_join, secret_scan, suffix_dedup, token_counts, url_filter, whitening
from .common import table


def op1_media_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_features(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), width=5, threshold=0.8, recall=0.9999)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"), samples=128)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_epochs=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100)


URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "block_share")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit(docs))
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    kinds = F.transform("secrets", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("secrets")).alias("spans"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=2, buckets=10_000, seed=7, percent=25, least_words=20)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, sf_dir, "documents"), least=20, documents=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_store": op1_media_store,
    "op2_ngram_join": op2_ngram_join,
    "op3_fingerprints": op3_fingerprints,
    "op4_source_mixing": op4_source_mixing,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_secret_scan": op9_secret_scan,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_line_dedup": op12_line_dedup,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": ngram_join.SQL,
    "op4_source_mixing": mixing.SQL,
    "op7_suffix_dedup": suffix_dedup.SQL,
    "op8_url_filter": url_filter.sql(URL_RULES),
    "op11_importance_resampling": importance.SQL,
    "op12_line_dedup": line_dedup.SQL,
}
