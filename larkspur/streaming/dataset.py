"""Datasets: ordered item pipelines on a ``DataFrame`` with an order column.

Every step is a plan; order lives in the column, not in how rows happen to lie.  Steps that number
rows anew (``take``, ``drop``, ``chunk``) do so without sorting all rows in one task: rows are sorted by
range, each range is counted, and ranks follow from the counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import running


def ranked(df: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """``df`` with each row's rank from 0 by ``order`` (which must be distinct, of any type with an order)."""
    return running(df, order, name)


def drawn(seed: Column, place: Column) -> Column:
    """Where a row stands in a seeded order: a digest that any engine can recompute."""
    return F.md5(F.concat_ws(":", seed.cast("string"), place.cast("string")))


@dataclass(frozen=True)
class Dataset:
    df: DataFrame
    order: str

    def map(self, columns: dict[str, Column]) -> Dataset:
        return Dataset(self.df.withColumns(columns), self.order)

    def map_batches(self, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> Dataset:
        """A Python step on Arrow batches; its schema must keep the order column."""
        return Dataset(self.df.mapInPandas(f, schema), self.order)

    def map_concurrent(self, f, schema: str, concurrency: int) -> Dataset:
        """The same on ``concurrency`` tasks; order is that of the column."""
        return Dataset(self.df.repartition(concurrency).mapInPandas(f, schema), self.order)

    def filter(self, condition: Column) -> Dataset:
        return Dataset(self.df.where(condition), self.order)

    def take(self, n: int) -> Dataset:
        return Dataset(self.df.orderBy(self.order).limit(max(0, n)), self.order)

    def drop(self, n: int) -> Dataset:
        rows = ranked(self.df, self.order, "__rank")
        return Dataset(rows.where(F.col("__rank") >= n).drop("__rank"), self.order)

    def chunk(self, n: int) -> DataFrame:
        """``(chunk, items)``: ``n`` rows each in order, the last maybe fewer."""
        rows = ranked(self.df, self.order, "__rank")
        item = F.struct("__rank", *self.df.columns)
        grouped = rows.groupBy(F.floor(F.col("__rank") / n).alias("chunk")).agg(F.sort_array(F.collect_list(item)).alias("items"))
        return grouped.withColumn("items", F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in self.df.columns])))

    def batch(self, n: int, collate: Callable[[Column], Column] | None = None) -> DataFrame:
        """Chunks, with a column ``batch`` that ``collate`` makes of their items."""
        chunks = self.chunk(n)
        return chunks if collate is None else chunks.select("chunk", collate(F.col("items")).alias("batch"))

    def shuffle(self, seed: int, buffer_size: int | None = None) -> Dataset:
        """The same rows in a seeded order that depends on nothing else.

        With a buffer, rows move only among the ``buffer_size`` neighbours they are cut into.
        """
        if buffer_size is not None and buffer_size < 1:
            raise ValueError("a buffer holds a row at least")
        rows, block = self.df, F.lit(0).cast("long")
        if buffer_size is not None:
            rows = ranked(rows, self.order, f"{self.order}_block")
            block = F.floor(F.col(f"{self.order}_block") / buffer_size)
        key = F.struct(block.alias("block"), drawn(F.lit(seed), F.col(self.order)).alias("h"), F.col(self.order).alias("o"))
        return Dataset(rows.select(*self.df.columns, key.alias(f"{self.order}_shuffled")), f"{self.order}_shuffled")

    def epochs(self, n: int, reshuffle_seed: int | None = None) -> Dataset:
        """All rows ``n`` times, epoch after epoch; with a seed each epoch in an order of its own (seed + epoch)."""
        rows = self.df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else self.df.withColumn("epoch", F.lit(0)).limit(0)
        inner = F.col(self.order) if reshuffle_seed is None else drawn(F.lit(reshuffle_seed) + F.col("epoch"), F.col(self.order))
        return Dataset(rows.withColumn("epoch_order", F.struct("epoch", inner.alias("place"), F.col(self.order).alias("item"))), "epoch_order")

    @contextmanager
    def abortable(self, tag: str):
        """Jobs that start inside carry the tag; ``spark.interruptTag(tag)`` from elsewhere stops them."""
        spark = self.df.sparkSession
        spark.addTag(tag)
        try:
            yield self
        finally:
            spark.removeTag(tag)

    def prefetched(self) -> Iterator:
        """Rows in order on the driver, the next partition read ahead."""
        return self.df.orderBy(self.order).toLocalIterator(prefetchPartitions=True)

    def fold(self, f: Callable, start):
        """Ordered reduction, row by row as they arrive; memory for one partition."""
        for row in self.prefetched():
            start = f(start, row)
        return start

    def to_list(self) -> list:
        return self.df.orderBy(self.order).collect()


def collate_vectors(field: str) -> Callable[[Column], Column]:
    """A matrix of the items' vectors; ragged ones raise."""

    def make(items: Column) -> Column:
        rows = F.transform(items, lambda x: x[field])
        same = F.size(F.array_distinct(F.transform(rows, lambda r: F.size(r)))) <= 1
        return F.when(same, rows).otherwise(F.raise_error(F.lit("vectors differ in length")))

    return make


def collate_scalars(field: str) -> Callable[[Column], Column]:
    return lambda items: F.transform(items, lambda x: x[field].cast("double"))


def collate_xy(x: str, y: str) -> Callable[[Column], Column]:
    return lambda items: F.struct(F.transform(items, lambda r: r[x]).alias("x"), F.transform(items, lambda r: r[y]).alias("y"))


def windowed_events(events: DataFrame, *, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", keys=("event_type",), value: str = "value") -> DataFrame:
    """Counts and sums by time window: an extension for streams (with a watermark) that batches take as well."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
