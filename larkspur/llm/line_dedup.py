"""Removal of lines that many documents share, with two Bloom filters.

A line's key is the line without white space at both ends, in lower case; keys travel as 128-bit BLAKE2
digests.  Each task sets the bits of the keys it meets in a filter of once-seen keys, and those of keys
met again in a second document in a filter of twice-seen ones.  Filters of all tasks are merged chunk
by chunk: a bit that two tasks have set is set in the second filter, so no key of two documents is
missed.  Only keys whose bits are all in the second filter (those that repeat, and a few that don't)
are shuffled, as digest and document; exact counts confirm them and choose the document that keeps
the line.  Texts meet their list of dropped keys by id, as a broadcast join where that list is small.

The filters have a bit for each ``BYTES_A_BIT`` bytes of text, up to ``MAX_BITS`` (64 MB, the bound of what is
broadcast).  Far above 100 million distinct lines they fill up and more lines are suspected, until
all are: then about 40 bytes a line are shuffled.  Results don't depend on it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, spread_join, stored

SPACE = b" \t\n\v\f\r"
BYTES_A_BIT, MIN_BITS, MAX_BITS = 8, 1 << 20, 1 << 29
#: Bits of a chunk of a filter; each key has two bits.
CHUNK = 1 << 20


def line_key(line: bytes, least: int) -> bytes | None:
    """Digest of a line's key; None for keys of fewer than ``least`` code points."""
    key = line.strip(SPACE).lower()
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and sum(b & 0xC0 != 0x80 for b in key) < least):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_keys(text: bytes | None, least: int) -> dict[bytes, None]:
    """Distinct keys of a text, in order."""
    found = dict.fromkeys(line_key(line, least) for line in (text or b"").split(b"\n"))
    found.pop(None, None)
    return found


def places(keys: list[bytes], bits: int) -> np.ndarray:
    """Both bits of each key, one row a key."""
    words = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return (words & U64(bits - 1)).astype(np.int64)


def has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0


def mark(bits: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bits, places >> 3, np.uint8(1) << (places & 7).astype(np.uint8))


def meet(places: np.ndarray, once: np.ndarray, twice: np.ndarray) -> None:
    """Adds keys that are distinct in their documents, in any order, to both filters."""
    distinct, n = np.unique(places, axis=0, return_counts=True)
    mark(twice, distinct[has(once, distinct).all(1) | (n > 1)].ravel())
    mark(once, distinct.ravel())


def lean(bits: np.ndarray) -> bytes:
    """A chunk's bits: the places of those set, or all of them where that is shorter."""
    held = np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype(np.uint32)
    return held.tobytes() if 4 * len(held) < len(bits) else bits.tobytes()


def full(data: bytes, size: int) -> np.ndarray:
    if len(data) == size:
        return np.frombuffer(data, np.uint8)
    out = np.zeros(size, np.uint8)
    mark(out, np.frombuffer(data, np.uint32))
    return out


def twice_seen(texts: DataFrame, bits: int, least: int) -> np.ndarray:
    """The filter of twice-seen keys of ``texts(text binary)``, eight bits a byte (it comes to the driver: at most ``MAX_BITS``)."""
    size = min(CHUNK, bits) // 8

    def meet_all(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            keys = [k for t in batch.column("text") for k in line_keys(t.as_py(), least)]
            for a in range(0, len(keys), 100_000):
                meet(places(keys[a : a + 100_000], bits), once, twice)
        for chunk, a in enumerate(range(0, len(once), size)):
            seen = once[a : a + size]
            if seen.any():
                sides = ([lean(x)] for x in (seen, twice[a : a + size]))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), *(pa.array(x, pa.binary()) for x in sides)], ["chunk", "once", "twice"])

    def merge(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for chunk, *sides in zip(batch["chunk"], batch["once"], batch["twice"]):
                once, twice = held.setdefault(chunk, (np.zeros(size, np.uint8), np.zeros(size, np.uint8)))
                seen, again = (full(x, size) for x in sides)
                twice |= again | (once & seen)
                once |= seen
        for chunk, (_, twice) in held.items():
            if twice.any():
                yield pd.DataFrame({"chunk": [chunk], "bits": [twice.tobytes()]})

    parts = texts.mapInArrow(meet_all, "chunk int, once binary, twice binary")
    merged = parts.repartition("chunk").mapInPandas(merge, "chunk int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def suspects(rows: DataFrame, bits: int, least: int) -> DataFrame:
    """``(id, mark, key)``: a row for each distinct key of a document, of ``rows(id, mark, text binary)``, whose bits were all seen twice."""
    sent = rows.sparkSession.sparkContext.broadcast(twice_seen(rows.select("text"), bits, least))

    def probe(batches):
        twice = sent.value
        for batch in batches:
            found = [list(line_keys(t.as_py(), least)) for t in batch.column("text")]
            keys = [k for ks in found for k in ks]
            if not keys:
                continue
            owner = np.repeat(np.arange(len(found)), [len(ks) for ks in found])
            hit = np.flatnonzero(has(twice, places(keys, bits)).all(1))
            own = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(own), batch.column("mark").take(own), pa.array([keys[i] for i in hit.tolist()], pa.binary())], ["id", "mark", "key"])

    return rows.mapInArrow(probe, f"id {rows.schema['id'].dataType.simpleString()}, mark long, key binary")


def dropped_keys(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 20, documents: int = 3) -> DataFrame:
    """``(id, mark, keys)``: keys that a document loses; ``mark`` is the hash of its text."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (size // BYTES_A_BIT).bit_length()))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("binary").alias("text"))
    seen = stored(suspects(rows, bits, least), "lines")
    shared = seen.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= documents)
    lost = spread_join(seen, shared, ["key"], "n").where(~F.col("id").eqNullSafe(F.col("last")))
    return stored(lost.groupBy("id", "mark").agg(F.collect_set("key").alias("keys")), "lost")


def drop_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 20, documents: int = 3) -> DataFrame:
    """Return ``(id_col, n_lines, n_dropped, kept)``, a row per row of ``docs``: its lines before, how many went, and the text that stays.

    Lines whose key has at least ``least`` code points and is found in at least ``documents`` documents
    stay only in the document of the largest id that has it.

    Defined cases: a null or empty text is one empty line, which stays; a line that comes again in the
    same document counts once, and goes or stays with all its copies; each row counts as a document, and
    rows of one id are treated alike, so repeated rows of the largest id all keep their line; null ids
    are below all others; where all lines go the text is empty; an empty table gives no rows; other
    columns are ignored.
    """
    lost = dropped_keys(docs, id_col=id_col, text_col=text_col, least=least, documents=documents)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @F.pandas_udf("n_dropped long, kept binary")
    def without(text: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = []
        for t, gone in zip(text, keys):
            if t is None or gone is None:
                out.append((0, None))
                continue
            gone = {bytes(k) for k in gone}
            lines = bytes(t).split(b"\n")
            kept = [x for x in lines if line_key(x, least) not in gone]
            out.append((len(lines) - len(kept), b"\n".join(kept)))
        return pd.DataFrame(out, columns=["n_dropped", "kept"])

    gone = lost.select(F.col("id").alias("lost_id"), F.col("mark").alias("lost_mark"), "keys")
    both = texts.join(gone, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("mark") == F.col("lost_mark")), "left")
    text = F.when(F.col("keys").isNotNull(), F.col("text").cast("binary"))  # only texts that lose lines go to Python
    made = both.select("id", "text", without(text, "keys").alias("made"))
    lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1
    return made.select(F.col("id").alias(id_col), lines.cast("long").alias("n_lines"), "made.n_dropped", F.coalesce(F.col("made.kept").cast("string"), F.col("text")).alias("kept"))


#: ``drop_lines`` of the documents in DuckDB's SQL.
SQL = r"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.doc_id, k.line, k.place, s.key IS NOT NULL AND k.doc_id <> s.last AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""
