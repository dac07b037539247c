"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; what is read later sees pruned columns and pushed filters."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``left`` joined to ``right``, which has a row a key and in ``weight`` how many rows of ``left`` have it.

    Keys with more rows than a quarter of a fair partition (fewer than four times as many as there are
    partitions) are sent to all tasks, so that their rows stay where they are; all others are shuffled on.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    right = checkpointed(right)
    least = max(1000, (right.agg(F.sum(weight)).first()[0] or 0) // (4 * parts))
    hot, cold = right.where(F.col(weight) > least), right.where(F.col(weight) <= least)
    if hot.isEmpty():
        return left.join(right, keys)
    hot = F.broadcast(hot)
    return left.join(hot, keys).unionByName(left.join(hot, keys, "left_anti").join(cold, keys))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over all output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(seed: int, n: int) -> np.ndarray:
    """``n`` reproducible 64-bit constants."""
    return mix64((np.arange(1, n + 1, dtype=U64) + (U64(seed) << U64(32))) * U64(0x9E3779B97F4A7C15))


def slabs(texts, limit: int):
    """Cut a list of str or bytes into runs (start, end) of about ``limit`` characters; one long item makes a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
