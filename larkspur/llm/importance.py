"""Importance resampling of documents towards a target distribution.

Features are runs of words, hashed to buckets by CRC-32.  A bucket's gain is the scaled log ratio of
its smoothed shares among the target's features and among all documents'; a document's weight is the
mean gain of its features, looked up in one array of all gains.  CRC-32 is linear, so a task finds
the checksums of all words of a batch with table look-ups, and those of runs by shifting a word's
checksum past the next word, without a string per feature.

A seeded Gumbel draw is added to every weight and the highest scores win.  Which ones those are is
found by a distributed quickselect: random pivot keys ``(score, id, row)`` cut the rows that are left
into those before, at and after each pivot, exact counts tell which part holds the k-th key, and only
that part goes on.  The winners alone are sorted, by ranges, and ranked.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import literal, running
from .common import stored

#: Bytes of words after lower case: digits, small letters, and all bytes of other characters.
IN_WORD = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in range(256)])
#: Words longer than this get their checksums one by one.
LONG = 255
#: Bytes of text that are looked at together.
PIECE = 1 << 20
PIVOTS = 31


@functools.cache
def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """``shift[n, j, b]``: what a byte b at place j of a checksum becomes past n more bytes; ``zeros[n]``: checksum of n zero bytes."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    shift = np.empty((LONG + 1, 4, 256), np.uint32)
    shift[0] = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)
    for n in range(LONG):
        shift[n + 1] = (shift[n] >> np.uint32(8)) ^ step[shift[n] & np.uint32(255)]
    return shift, np.array([zlib.crc32(bytes(n)) for n in range(LONG + 1)], np.uint32)


def _past(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    shift, _ = _shifts()
    out = shift[n, 0, crc & np.uint32(255)]
    for j in (1, 2, 3):
        out ^= shift[n, j, (crc >> np.uint32(8 * j)) & np.uint32(255)]
    return out


def word_checksums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and CRC-32 of every word of ``data`` (lower-cased bytes)."""
    edge = np.diff(IN_WORD[data].astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, end, np.empty(0, np.uint32)
    shift, zeros = _shifts()
    size = end - start
    at = np.flatnonzero(IN_WORD[data])
    after = np.minimum(np.repeat(end, size) - at - 1, LONG - 1)
    crc = np.bitwise_xor.reduceat(shift[after + 1, 0, data[at]], np.cumsum(size) - size)  # a byte enters as a shift by one of itself
    crc ^= zeros[np.minimum(size, LONG)]
    for i in np.flatnonzero(size > LONG).tolist():
        crc[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return start, end, crc


def lowered(text: bytes) -> bytes:
    """A-Z in lower case; other bytes stay."""
    return text.lower()


def pieces(texts: list[bytes], width: int) -> Iterator[tuple[list[tuple[int, bytes]], int]]:
    """Lower-cased texts of about ``PIECE`` bytes together, as ``(text number, bytes)``; a longer text comes in parts.

    A part begins with the last ``width - 1`` words of the one before, whose number is returned beside it.
    """
    group, size = [], 0
    for k, text in enumerate(texts):
        if len(text) <= PIECE:
            if size + len(text) > PIECE:
                yield group, 0
                group, size = [], 0
            group.append((k, lowered(text)))
            size += len(text)
            continue
        text = lowered(text)
        inside = IN_WORD[np.frombuffer(text, np.uint8)]
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        if inside[0]:
            starts = np.concatenate([[0], starts])
        first = 0  # word at which a part's own words begin
        while first < len(starts):
            stop = max(first + 1, int(np.searchsorted(starts, starts[first] + PIECE)))
            back = min(first, width - 1)
            yield [(k, text[int(starts[first - back]) : int(starts[stop]) if stop < len(starts) else len(text)])], back
            first = stop
    if group:
        yield group, 0


def features(texts: list[bytes], width: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(text number of each feature, its bucket, text number of each word)`` of one piece after the other."""
    space = np.uint32(zlib.crc32(b" "))
    for group, back in pieces(texts, width):
        data = np.frombuffer(b" ".join(t for _, t in group), np.uint8)
        ends = np.cumsum([len(t) + 1 for _, t in group])
        numbers = np.array([k for k, _ in group], np.int64)
        start, end, crc = word_checksums(data)
        which = np.searchsorted(ends, start, "right")
        size, run = end - start, crc
        owners, found = [numbers[which[back:]]], [crc[back:] % np.uint32(buckets)]
        own = owners[0]
        for w in range(2, width + 1):
            if len(crc) < w:
                break
            spaced = _past(run[:-1], np.ones(len(run) - 1, np.int64)) ^ space
            run = _past(spaced, np.minimum(size[w - 1 :], LONG)) ^ crc[w - 1 :]
            for i in np.flatnonzero(size[w - 1 :] > LONG).tolist():
                run[i] = zlib.crc32(data[start[i + w - 1] : end[i + w - 1]].tobytes(), int(spaced[i]))
            whole = which[: len(run)] == which[w - 1 :]
            whole[: max(0, back - w + 1)] = False  # these end among the words of the part before
            owners.append(numbers[which[w - 1 :][whole]])
            found.append(run[whole] % np.uint32(buckets))
        yield np.concatenate(owners), np.concatenate(found).astype(np.int64), own


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").to_pylist()]


def bucket_counts(docs: DataFrame, *, text_col: str = "text", width: int = 2, buckets: int = 10_000) -> DataFrame:
    """``(bucket, n)``: how many features of all texts fall into each bucket, buckets without any left out; a row a bucket and task is shuffled."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found, _ in features(_texts(batch), width, buckets):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["bucket", "n"])

    parts = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, *, text_col: str = "text", target_col: str = "text", width: int = 2, buckets: int = 10_000) -> np.ndarray:
    """Gain of every bucket: floor of 1000 times the log of its smoothed share in ``target`` over that in ``docs`` (a number a bucket comes to the driver)."""
    held = []
    for df, col in ((docs, text_col), (target, target_col)):
        n = [0] * buckets
        for bucket, count in bucket_counts(df, text_col=col, width=width, buckets=buckets).toPandas().itertuples(index=False):
            n[int(bucket)] = int(count)
        held.append(n)
    s, t = held
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s, t)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """``(id_col, n_words, n_features, weight)``, a row per row of ``docs``: the floored mean gain of its features, 0 where it has none.  No shuffle."""
    sent, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def score(batches):
        for batch in batches:
            texts = _texts(batch)
            words, held, total = (np.zeros(len(texts), np.int64) for _ in range(3))
            for owner, found, own in features(texts, width, buckets):
                words += np.bincount(own, minlength=len(texts))
                held += np.bincount(owner, minlength=len(texts))
                total += np.bincount(owner, sent.value[found], len(texts)).astype(np.int64)
            weight = total // np.maximum(held, 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, (words, held, weight))], ["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(score, f"id {kind}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def gumbel(id_col: Column, seed: int) -> Column:
    """Floor of 1000 times a Gumbel variate made of the SHA-256 of seed and id (a null id counts as the empty string)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def kth_key(keys: DataFrame, key: str, k: int):
    """The ``k``-th least (from 1) of the distinct keys in column ``key``, of any type with an order; ``keys`` is read several times.

    At most ``PIVOTS`` keys and twice as many counts come to the driver in a round; a round leaves
    about a fifteenth of the rows.
    """
    kind, low, high, turn = keys.schema[key].dataType.simpleString(), None, None, 0
    fixed = lambda row: literal(row).cast(kind)
    while True:
        left = keys if low is None else keys.where(F.col(key) > fixed(low))
        left = left if high is None else left.where(F.col(key) < fixed(high))
        drawn = left.orderBy(F.xxhash64(key, F.lit(turn))).limit(PIVOTS)
        pivots = [r[0] for r in drawn.orderBy(key).collect()]
        held = F.array(*map(fixed, pivots))
        below, upto = (F.size(F.filter(held, f)) for f in (lambda p: p < F.col(key), lambda p: p <= F.col(key)))
        counts = dict(map(tuple, left.groupBy((below + upto).alias("slot")).count().collect()))  # even: between pivots, odd: at one
        for slot in range(2 * len(pivots) + 1):
            if k <= counts.get(slot, 0):
                break
            k -= counts.get(slot, 0)
        at = slot // 2
        if slot % 2:
            return pivots[at]
        low, high, turn = pivots[at - 1] if at else low, pivots[at] if at < len(pivots) else high, turn + 1


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", width: int = 2, buckets: int = 10_000, seed: int = 7, percent: int = 25, least_words: int = 20
) -> DataFrame:
    """Return ``(id_col, n_features, weight, score, rank)``, a row per row of ``docs``; ``rank`` counts the drawn ones from 1 and is null for all others.

    Of the rows with at least ``least_words`` words, ``floor(percent * n / 100)`` are drawn: those of
    highest score, ties to the smaller id.

    Defined cases: a null or empty text, or one without words, has no features and weight 0 and isn't
    drawn; rows of equal id and score (repeated rows) are drawn and ranked in the order in which they
    were stored; a null id counts as the empty string in the draw and goes before all others of its
    score; an empty table gives no rows, and with an empty target all features of ``docs`` still get
    their smoothed gains; other columns are ignored.  A text is never shuffled.
    """
    gain = gains(docs, target, text_col=text_col, target_col=target_col, width=width, buckets=buckets)
    weighed = weigh(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), gain, id_col="id", width=width)
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    key = F.struct((-F.col("score")).alias("down"), "id", F.monotonically_increasing_id().alias("row"))
    rows = stored(scored.withColumn("key", key).withColumn("fit", F.col("n_words") >= least_words), "importance")
    fit = rows.where("fit")
    k = percent * fit.count() // 100
    out = ["id", "n_features", "weight", "score"]
    nobody = rows.select(*out, F.lit(None).cast("long").alias("rank"))
    if k:
        last = literal(kth_key(fit.select("key"), "key", k)).cast(rows.schema["key"].dataType.simpleString())
        won = F.col("fit") & (F.col("key") <= last)
        ranked = running(rows.where(won).select("key", *out), "key", "before").select(*out, (F.col("before") + 1).alias("rank"))
        nobody = ranked.unionByName(rows.where(~won).select(*out, F.lit(None).cast("long").alias("rank")))
    return nobody.withColumnRenamed("id", id_col)


#: ``resample`` of the documents towards the benchmark in DuckDB's SQL.
SQL = r"""WITH step AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT side, id, unnest(w) AS f FROM words UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
names AS (SELECT DISTINCT f FROM runs),
bytes AS (SELECT f, hex(encode(f)) AS h FROM names),
sums AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket FROM bytes, step),
found AS (SELECT side, id, bucket FROM runs JOIN sums USING (f)),
held AS (SELECT bucket, (count(*) FILTER (side = 'd'))::DOUBLE AS s, (count(*) FILTER (side = 'b'))::DOUBLE AS t FROM found GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM held) + 10000) / ((s + 1) * ((SELECT sum(t) FROM held) + 10000))))::BIGINT AS g FROM held),
mean AS (SELECT id, count(*) AS n_features, floor(sum(g) / count(*))::BIGINT AS weight FROM found JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
scored AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN mean ON doc_id = mean.id JOIN words ON side = 'd' AND doc_id = words.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM ranked"""
