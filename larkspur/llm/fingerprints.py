"""Document fingerprints by consistent weighted sampling.

A document is a bag of terms weighted by their frequency.  Sample k draws for every term, from its hash
and k alone, two gamma variates r and c of shape 2 and a uniform b; a term of weight w has
``t = floor(ln w / r + b)`` and ``ln a = ln c - r (t - b) - r``, and the sample is the (term, t) of
least a.  Two documents agree on a sample with probability equal to their generalised Jaccard
similarity, the sum of smaller weights over the sum of larger ones.

What a (term, weight) draws is kept in a bounded table per task, so that the variates of frequent
terms are drawn once, and new ones are drawn for many texts at a time; the fingerprint does not depend
on what the table holds.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import range_of, range_starts
from .common import U64, mix64, seeds, slabs

SAMPLES = 128
#: (term, weight) pairs whose draws a task keeps, pairs drawn at a time, and characters looked at together.
STORE, DRAWN, SLAB = 98_304, 128, 100_000
#: Rows that a range of ids holds, and ranges a shuffle partition that the plan names at most.
RANGE, PARTS = 4096, 16
TERMS = re.compile(r"\w+|[^\w\s]")

#: Terms of weight 1 as they are, others with their weight.
Bag = list[str | tuple[str, int]]


def bag_of(text: str) -> Bag:
    return [t if w == 1 else (t, w) for t, w in Counter(TERMS.findall(text)).items()]


class Rows(dict):
    """Row of each pair, in order; a new pair gets the next row and waits to be drawn."""

    def __init__(self, pairs=()):
        super().__init__(zip(pairs, range(len(pairs))))
        self.waiting: Bag = []

    def __missing__(self, pair) -> int:
        row = self[pair] = len(self)
        self.waiting.append(pair)
        return row


def unit(bits: np.ndarray, low: int) -> np.ndarray:
    """Uniform numbers in (0, 1] from 24 bits."""
    part = (bits >> U64(low)).astype(np.uint32) & np.uint32(0xFFFFFF)
    return (part.astype(np.float32) + np.float32(1)) * np.float32(2.0**-24)


class Sampler:
    """Samples of bags.  A draw is a 64-bit number: ``ln a`` in its upper half, such that order is kept, the sample's name in the lower."""

    def __init__(self, samples: int = SAMPLES):
        self.seeds = seeds(21, 2 * samples).reshape(1, 2, samples)
        self.rows = Rows()
        self.table = np.empty((STORE, samples), U64)
        self.used = np.zeros(STORE, np.int64)

    def draw(self, pairs: Bag) -> np.ndarray:
        pairs = [(p, 1) if isinstance(p, str) else p for p in pairs]
        terms = np.frombuffer(b"".join([hashlib.blake2b(t.encode(), digest_size=8).digest() for t, _ in pairs]), "<u8")
        bits = mix64(terms[:, None, None] ^ self.seeds)
        one, two = bits[:, 0], bits[:, 1]
        tiny = np.float32(1e-7)
        # a gamma variate of shape 2 is the sum of two exponential ones
        r = np.maximum(-np.log(unit(one, 0) * unit(one, 24)), tiny)
        c = np.maximum(-np.log(unit(two, 0) * unit(two, 24)), tiny)
        b = (one >> U64(48)).astype(np.float32) * np.float32(2.0**-16)
        t = np.floor(np.log(np.array([w for _, w in pairs], np.float32))[:, None] / r + b)
        order = (np.log(c) - r * (t - b) - r).view(np.int32)
        order = (order ^ (order >> np.int32(31) | np.int32(-(2**31)))).view(np.uint32)  # the order of floats as that of whole numbers
        name = (terms >> U64(32)).astype(np.uint32) ^ terms.astype(np.uint32) * np.uint32(0x9E3779B1)
        name = name[:, None] + t.astype(np.int64).astype(np.uint32) * np.uint32(0x85EBCA6B)
        return order.astype(U64) << U64(32) | name

    def shrink(self, most: int) -> None:
        """Keep the pairs that were used most."""
        keep = np.sort(np.argsort(-self.used[: len(self.rows)], kind="stable")[:most])
        pairs = list(self.rows)
        self.table[: len(keep)], self.used[: len(keep)] = self.table[keep], self.used[keep] // 2
        self.used[len(keep) :] = 0
        self.rows = Rows([pairs[k] for k in keep.tolist()])

    def marks(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        """Names of the samples of each text, or None for one without terms."""
        for a, b in slabs(texts, SLAB):
            bags = [bag_of(t) for t in texts[a:b]]
            most = sum(map(len, bags))
            if most > STORE:  # bounded memory for texts of any length
                for bag in bags:
                    yield np.min([self.draw(bag[low : low + DRAWN]).min(0) for low in range(0, len(bag), DRAWN)], 0).astype(np.uint32) if bag else None
                continue
            if len(self.rows) + most > STORE:
                self.shrink(min(STORE // 2, STORE - most))
            found = [np.fromiter(map(self.rows.__getitem__, bag), np.int64, len(bag)) for bag in bags]
            new, at = self.rows.waiting, len(self.rows) - len(self.rows.waiting)
            for low in range(0, len(new), DRAWN):
                part = new[low : low + DRAWN]
                self.table[at + low : at + low + len(part)] = self.draw(part)
            new.clear()
            for rows in found:
                self.used[rows] += 1
                yield self.table.take(rows, 0, mode="clip").min(0).astype(np.uint32) if len(rows) else None


def as_text(mark: np.ndarray | None) -> str:
    """Eight hex digits a sample; empty for a text without terms."""
    return "" if mark is None else mark.astype(">u4").tobytes().hex()


def likeness(one: np.ndarray | None, two: np.ndarray | None) -> float:
    """Share of equal samples; two texts without terms are alike, one without isn't like any other."""
    if one is None or two is None:
        return float(one is two)
    return float((one == two).mean())


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Return ``(id_col, fingerprint)``, one row per row of ``docs``; no shuffle.

    Terms are words (runs of letters, digits and underscores, as written) and single other marks.
    Defined cases: a null, empty or blank text has the empty fingerprint; repeated rows and equal texts
    have equal fingerprints; an empty table gives no rows; other columns are ignored.
    """

    @F.pandas_udf("string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = Sampler(samples)
        for texts in batches:
            yield pd.Series([as_text(m) for m in tool.marks(texts.tolist())], dtype=object)

    return docs.select(F.col(id_col), find(F.coalesce(F.col(text_col), F.lit(""))).alias("fingerprint"))


def with_next(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Rows ``(part, loan, id, text)`` in ranges of about ``size`` rows (more, where that would be over ``PARTS`` ranges a shuffle partition), such that the row after any row is in its own range.

    The order is that of ids, and among rows of one id that of their texts' hashes, so that rows
    without an id make ranges too.  A range is known by its first row's id and hash (an entry a range
    comes to the driver).  These first rows are also lent to the range before, and that of the first
    range to the last.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.struct("id", F.xxhash64("text").alias("h")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = range_starts(rows, "key", min(math.ceil(docs.count() / size), PARTS * parts))
    rows = rows.withColumn("part", range_of(F.col("key"), starts).cast("int"))
    loans = [F.when(F.col("key").eqNullSafe(starts[0]), len(starts) - 1)] if starts else []
    if len(starts) > 1:
        first = F.col("key").eqNullSafe(F.element_at(F.array(*starts), F.col("part") + 1))
        loans.append(F.when(first & (F.col("part") > 0), F.col("part") - 1))
    before = F.coalesce(*loans, F.lit(None).cast("int"))
    own = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("loan")))
    at = F.when(before.isNotNull(), F.concat(own, F.array(F.struct(before.cast("int").alias("part"), F.lit(1).alias("loan"))))).otherwise(own)
    each = rows.select("key", "text", F.explode(at).alias("at")).select("at.part", "at.loan", "key", "text")
    dealt = each.repartitionById(max(1, len(starts)), F.col("part")).sortWithinPartitions("part", "loan", "key", "text")
    return dealt.select("part", "loan", "key.id", "text")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, size: int = RANGE) -> DataFrame:
    """Fingerprints of every text, and of the text with its last quarter replaced by the start of the next document.

    Return ``(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.
    The next document is that of the next id (after the last: the first).  Texts are shuffled once, to
    ranges of ids of about ``size`` rows; rows are compared with their neighbour as they stream by.
    Defined cases: ids may be of any type with an order; null ids come first; rows of one id follow
    each other by the hash of their text; a single row is its own next document; null and empty texts
    have the empty fingerprint, which is like itself only; an empty table gives no rows; other columns
    are ignored.
    """
    shape = f"id {docs.schema[id_col].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        tool = Sampler(samples)
        held = None  # the last row of the batch before, with its mark
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held[0], table])
            part, loan, texts = table["part"].to_pylist(), table["loan"].to_pylist(), table["text"].to_pylist()
            waiting = [i for i in range(len(texts) - 1) if not loan[i]]  # its part has at least a lent row after it
            if any(part[i] != part[i + 1] for i in waiting):
                raise ValueError("a range of ids lacks the row that follows it")
            edited = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for t, after in zip(texts, texts[1:])]
            # an edited text is looked at beside the text that it comes from
            found = [*tool.marks([t for two in zip(edited, texts[1:]) for t in two])]
            new, marks = found[::2], [held[1] if held is not None else next(tool.marks(texts[:1])), *found[1::2]]
            held = table.slice(len(texts) - 1), marks[-1]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": table["id"].take(pa.array(waiting, pa.int64())).combine_chunks(),
                    "n_chars": pa.array([len(texts[i]) for i in waiting], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in waiting], pa.string()),
                    "fingerprint": pa.array([as_text(marks[i]) for i in waiting], pa.string()),
                    "edited_fingerprint": pa.array([as_text(new[i]) for i in waiting], pa.string()),
                    "near_edited": pa.array([likeness(marks[i], new[i]) for i in waiting], pa.float64()),
                    "near_next": pa.array([likeness(marks[i], marks[i + 1]) for i in waiting], pa.float64()),
                }
            )

    return with_next(docs, id_col, text_col, size).mapInArrow(run, shape).withColumnRenamed("id", id_col)
