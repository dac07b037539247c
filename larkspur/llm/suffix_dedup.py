"""Removal of repeated byte strings with suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier: in a document of smaller
id, or further left in one of the same id.  Places are pairs (id, start); of rows with one id none is
earlier than another.

*Routing.*  Every string of ``length`` bytes has an anchor, its ``GRAM``-byte piece of least hash
(leftmost of equals).  Equal strings have equal anchors, so strings are routed by their anchor's hash.
Neighbouring starts mostly share an anchor; such a run of starts with its bytes is a *context*, one for
about 35 bytes of text.

*Pre-aggregation.*  Contexts of equal bytes, by their 128-bit BLAKE2 digests (no weaker hash ever decides
what goes), are one context: of all but the earliest every start is a repeat.  Each task settles this
for its own batch before anything is shuffled and joins what goes to spans, so that a passage in a
third of all documents is one row a batch.  Rows are dealt by anchor; anchors that a sample of the rows
shows to be hot are dealt by anchor and digest.  Anchors with one context are done.

*Shards.*  Of anchors with several different contexts, the first of each is cut from its text and sent
to a shard by anchor; anchors with very many are dealt over several shards.  A shard sorts its suffixes by
Larsson-Sadakane refinement (ranks by h bytes give ranks by 2h; only unsorted groups are sorted
again), takes common prefixes with Kasai's recurrence, and splits the suffix order where fewer than
``length`` bytes are common.  In each part the earliest start stays, the others are repeats.

*Merging.*  Of anchors dealt over several shards each shard also returns the first start of each part;
these lists, sorted by the string's digest, are merged by binary search.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, checkpointed, mix64, seeds, slabs

GRAM = 32
DIGEST = np.dtype([("a", "<i8"), ("b", "<i8")])
#: Starts that are hashed at a time, contexts of an anchor that one shard takes, and bytes of a shard.
PIECE, SPLIT, SHARD_BYTES = 1 << 19, 4096, 2_000_000
#: Characters of texts whose contexts a task compares before it passes them on.
SLAB = 8_000_000
BYTE_CODES = seeds(31, 256)
#: A difference of two 8-byte words with k equal leading bytes is at most LEADING[k - 1].
LEADING = np.array([(1 << (64 - 8 * k)) - 1 for k in range(1, 9)], U64)
#: Low bits of a gram's hash that give way to its place, the same for all batches.
PLACE_BITS = 21
BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of each."""
    size = max(PIECE * 2, 1 << (n - 1).bit_length())
    if size not in _powers:
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.cumprod(p))
        _powers[size] = (out[0], out[1])
    return _powers[size]


def contexts(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Contexts of texts that lie end to end in ``data``: anchor hash, text, first start in ``data``, starts."""
    n = len(data)
    begins = np.concatenate([[0], ends[:-1]])
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, empty, empty
    if n >> PLACE_BITS:
        raise ValueError("too many bytes at a time")
    up, down = powers(n + 1)
    prefix = np.concatenate([np.zeros(1, U64), np.cumsum(BYTE_CODES[data] * up[:n])])
    grams = mix64((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
    bits = U64(PLACE_BITS)
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=U64)  # the place breaks ties, leftmost first
    window, width = length - GRAM + 1, 1
    while width * 2 <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < window:
        low = np.minimum(low[: len(low) - (window - width)], low[window - width :])
    place = (low & ((U64(1) << bits) - U64(1))).astype(np.int64)
    starts = n - length + 1
    fits = np.zeros(starts + 1, np.int32)
    ok = ends - begins >= length
    np.add.at(fits, begins[ok], 1)
    np.add.at(fits, ends[ok] - length + 1, -1)
    fits = np.cumsum(fits)[:starts] > 0
    new = np.ones(starts, bool)
    new[1:] = (place[1:] != place[:-1]) | ~fits[:-1]
    head = np.flatnonzero(new & fits)
    stop = np.ones(starts, bool)
    stop[:-1] = new[1:] | ~fits[1:]
    tail = np.flatnonzero(stop & fits)
    return grams[place[head]].view(np.int64), np.searchsorted(ends, head, "right"), head, tail - head + 1


def digests(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """128-bit digests of pieces of ``raw``."""
    return np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), stops.tolist())]), DIGEST)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and for each place the first 8 bytes as a number (zeros past the end)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U64)
    word = np.zeros(n, U64)
    for k in range(8):
        word = word << U64(8) | padded[k : k + n]
    order = np.argsort(word, kind="stable")
    sorted_words = word[order]
    head = np.ones(n, bool)
    head[1:] = sorted_words[1:] != sorted_words[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    tied = ~head
    tied[:-1] |= ~head[1:]
    slots, h = np.flatnonzero(tied), 8
    while len(slots):
        at = order[slots]
        # past the end the shorter suffix comes first, before any that goes on
        beyond = np.where(at + h < n, rank[np.minimum(at + h, n - 1)], n - at - h)
        key = rank[at] * (3 * n + 1) + beyond + 2 * n
        by = np.argsort(key, kind="stable")
        order[slots], key = at[by], key[by]
        head = np.ones(len(slots), bool)
        head[1:] = key[1:] != key[:-1]
        rank[order[slots]] = np.maximum.accumulate(np.where(head, slots, 0)) + 1
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots = slots[tied]
        h = min(h * 2, n)
    return order, word


def common_prefixes(order: np.ndarray, word: np.ndarray, most: int, lane: int = 256) -> np.ndarray:
    """Common prefix, up to ``most`` bytes, of each suffix in ``order`` with the one before.

    Kasai's recurrence in lanes: going right by one place in the text loses one byte of the common
    prefix at most.  Each lane is a stretch of the text and takes its steps beside the others.
    """
    n = len(order)
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    out = np.zeros(n, np.int64)
    at = np.arange(0, n, lane)
    known = np.zeros(len(at), np.int64)
    for _ in range(min(lane, n)):
        other = before[at]
        known = np.where(other < 0, 0, np.maximum(known - 1, 0))
        live = np.flatnonzero((other >= 0) & (known < most))
        while len(live):
            a, b = at[live] + known[live], other[live] + known[live]
            inside = (a < n) & (b < n)
            live, a, b = live[inside], a[inside], b[inside]
            if not len(live):
                break
            differ = word[a] ^ word[b]
            same = (LEADING >= differ[:, None]).sum(1)
            room = np.minimum(n - a, n - b)
            known[live] += np.minimum(same, room)
            live = live[(same == 8) & (room > 8) & (known[live] < most)]
        out[at] = np.minimum(known, most)
        at = at + 1
        inside = at < n
        at, known = at[inside], known[inside]
    return out[order]


def joined(code: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans with touching and overlapping ones of a code joined."""
    by = np.lexsort((start, code))
    code, start, stop = code[by], start[by], stop[by]
    if not len(code):
        return code, start, stop
    # the furthest stop so far, from anew with each code
    far = int(stop.max()) + 1
    top = np.maximum.accumulate(stop + code * far) - code * far
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (start[1:] > top[:-1])
    first = np.flatnonzero(new)
    return code[first], start[first], top[np.append(first[1:], len(code)) - 1]


def numbered(ids: pd.Series) -> np.ndarray:
    """Numbers of sorted values, equal ones alike."""
    return (ids != ids.shift()).cumsum().to_numpy(np.int64)


def shard_repeats(pdf: pd.DataFrame, length: int, buckets: int) -> pd.DataFrame:
    """Repeats within one shard of contexts; of anchors dealt over shards also the first start of each string, as a sorted list for each bucket of digests."""
    pdf = pdf.sort_values(["id", "twin", "start"], kind="stable").drop_duplicates(["id", "twin", "start"]).reset_index(drop=True)
    shard = int(pdf["shard"].iloc[0])
    sizes = pdf["bytes"].map(len).to_numpy()
    raw = b"".join(pdf["bytes"])
    order, word = suffix_array(np.frombuffer(raw, np.uint8))
    common = common_prefixes(order, word, length)
    begin = np.cumsum(sizes) - sizes
    owner = np.searchsorted(begin, order, "right") - 1
    offset = order - begin[owner]
    part = np.cumsum(common < length)
    real = offset <= sizes[owner] - length
    owner, offset, part, order = owner[real], offset[real], part[real], order[real]
    ids, twins, code, dealt = pdf["id"].to_numpy(), pdf["twin"].to_numpy(), numbered(pdf["id"]), pdf["dealt"].to_numpy()
    start = pdf["start"].to_numpy()[owner] + offset
    by = np.lexsort((start, code[owner], part))
    owner, start, part, order = owner[by], start[by], part[by], order[by]
    new = np.ones(len(part), bool)
    new[1:] = part[1:] != part[:-1]
    least = np.maximum.accumulate(np.where(new, np.arange(len(part)), 0))
    gone = (code[owner] != code[owner[least]]) | (start != start[least])
    row, a, b = joined(owner[gone], start[gone], start[gone] + length)
    # lists fill the columns of spans too: nulls would make floats of them
    rows = [(i, t, a, b, shard, shard % buckets, None, None, None, None, None) for i, t, a, b in zip(ids[row].tolist(), twins[row].tolist(), a.tolist(), b.tolist())]
    lead = np.flatnonzero(~gone & (dealt[owner] > 1))
    if len(lead):
        digest = digests(raw, order[lead], order[lead] + length)
        bucket = digest["a"] % buckets
        by = np.lexsort((digest["b"], digest["a"], bucket))
        digest, bucket, lead = digest[by], bucket[by], lead[by]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(by)]):
            w = lead[a:b]
            rows.append((ids[owner[w[0]]], 0, 0, 0, shard, int(bucket[a]), digest["a"][a:b].tolist(), digest["b"][a:b].tolist(), ids[owner[w]].tolist(), twins[owner[w]].tolist(), start[w].tolist()))
    return pd.DataFrame(rows, columns=["id", "twin", "start", "stop", "shard", "bucket", "highs", "lows", "ids", "twins", "starts"], dtype=object)


def merge_shards(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Spans as they are; of the shards' lists of first starts, all but the earliest of each string."""
    spans = pdf[pdf["highs"].isna()]
    out = list(zip(spans["id"].tolist(), spans["twin"].tolist(), spans["start"].tolist(), spans["stop"].tolist()))
    lists = []
    for r in pdf[pdf["highs"].notna()].sort_values("shard").itertuples():
        digest = np.empty(len(r.highs), DIGEST)
        digest["a"], digest["b"] = r.highs, r.lows
        lists.append((digest, list(zip(r.ids, r.starts)), r.twins))
    merged, least = np.empty(0, DIGEST), np.empty(0, object)  # digests in order, and the earliest place of each
    for digest, places, _ in lists:
        at = np.searchsorted(merged, digest)
        known = at < len(merged)
        known[known] = merged[at[known]] == digest[known]
        for i, k in zip(at[known].tolist(), np.flatnonzero(known).tolist()):
            least[i] = min(least[i], places[k])
        new = np.flatnonzero(~known)
        new = new[np.concatenate([[True], digest[new][1:] != digest[new][:-1]])[: len(new)]]  # places of equal digests are equal
        firsts = np.empty(len(new), object)
        firsts[:] = [places[k] for k in new.tolist()]
        least = np.insert(least, at[new], firsts)
        merged = np.insert(merged, at[new], digest[new])
    for digest, places, twins in lists:
        for i, place, twin in zip(np.searchsorted(merged, digest).tolist(), places, twins):
            if place != least[i]:
                out.append((place[0], twin, int(place[1]), int(place[1]) + length))
    return pd.DataFrame(out, columns=["id", "twin", "start", "stop"])


def _context_rows(rows: DataFrame, length: int) -> DataFrame:
    """``(key, high, low, id, twin, start, size)`` of the contexts; rows without a key are spans that are settled: later repeats of a context of their batch."""

    def run(batches):
        for pdf in batches:
            pdf = pdf.drop_duplicates(["id", "twin"])
            for a, b in slabs(pdf["text"].tolist(), SLAB):
                yield from contexts_of(pdf.iloc[a:b].sort_values(["id", "twin"], kind="stable").reset_index(drop=True))

    def contexts_of(pdf):
        found = []
        group: list[tuple[int, int, bytes]] = []  # row, offset, bytes

        def flush():
            if group:
                sizes = np.array([len(b) for *_, b in group])
                raw, ends = b"".join([b for *_, b in group]), np.cumsum(sizes)
                key, text, head, starts = contexts(np.frombuffer(raw, np.uint8), ends, length)
                row, offset = np.array([g[0] for g in group]), np.array([g[1] for g in group])
                found.append((key, digests(raw, head, head + starts - 1 + length), row[text], head - (ends - sizes)[text] + offset[text], starts))
                group.clear()

        size = 0
        for row, t in enumerate(pdf["text"]):
            raw = t.encode()
            for at in range(0, max(0, len(raw) - length + 1), PIECE):
                piece = raw[at : at + PIECE + length - 1]
                group.append((row, at, piece))
                size += len(piece)
                if size > PIECE:
                    flush()
                    size = 0
        flush()
        if not found:
            return
        key, digest, row, start, starts = (np.concatenate(c) for c in zip(*found))
        code, stop = numbered(pdf["id"])[row], start + starts - 1 + length
        by = np.lexsort((start, code, digest["b"], digest["a"], key))
        key, digest, row, start, stop, code = key[by], digest[by], row[by], start[by], stop[by], code[by]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
        least = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        gone = (code != code[least]) | (start != start[least])
        span_row, span_start, span_stop = joined(row[gone], start[gone], stop[gone])
        stay = ~gone
        row = np.concatenate([row[stay], span_row])
        missing = np.zeros(len(span_row), np.int64)
        mask = np.repeat([False, True], [stay.sum(), len(missing)])
        yield pd.DataFrame(
            {
                "key": pd.arrays.IntegerArray(np.concatenate([key[stay], missing]), mask),
                "high": np.concatenate([digest["a"][stay], missing]),
                "low": np.concatenate([digest["b"][stay], missing]),
                "id": pdf["id"].iloc[row].to_numpy(),
                "twin": pdf["twin"].to_numpy()[row],
                "start": np.concatenate([start[stay], span_start]),
                "size": np.concatenate([(stop - start)[stay], span_stop - span_start]),
            }
        )

    return rows.mapInPandas(run, f"key long, high long, low long, id {rows.schema['id'].dataType.simpleString()}, twin long, start long, size long")


def hot_anchors(rows: DataFrame, length: int, parts: int, fraction: float = 1 / 64) -> list[int]:
    """Anchors with more contexts than a quarter of a fair partition, as a sample of the rows has it; fewer than ``4 * parts``.

    They only say how rows are dealt, never what is found.
    """
    counts = _context_rows(rows.sample(fraction, 5), length).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return [r["key"] for r in counts.where(F.col("n") > F.greatest(total / (4 * parts), F.lit(8))).select("key").collect()]


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """``(id, text, spans)`` of every row with an id: byte spans ``array<struct<start, stop>>`` that go (may touch or overlap)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id IS NOT NULL")
    # rows of one id are told apart by their texts; where there are none, contexts needn't carry that along
    single = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    keys, twin = (["id"], F.lit(0).cast("long")) if single else (["id", "twin"], F.xxhash64("text"))
    rows = rows.select("id", twin.alias("twin"), "text")
    hot = spark.createDataFrame([(k, True) for k in hot_anchors(rows, length, parts)], "key long, hot boolean")
    found = _context_rows(rows, length).join(F.broadcast(hot), "key", "left")
    # 0: a span; 1: a context, dealt by its anchor; 2: one of a hot anchor, dealt by its digest too
    what = F.when(F.col("key").isNull(), 0).when(F.col("hot"), 2).otherwise(1).cast("byte")
    deal = F.when(F.col("key").isNull(), F.xxhash64("id", "start")).when(F.col("hot"), F.xxhash64("key", F.pmod("high", F.lit(parts)))).otherwise(F.col("key"))
    found = found.select(deal.alias("deal"), what.alias("what"), "high", "low", "id", "twin", "start", "size").repartition("deal")
    same, anchor = Window.partitionBy("deal", "what", "high", "low"), Window.partitionBy("deal", "what")
    found = found.withColumn("first", (F.col("what") > 0) & (F.rank().over(same.orderBy("id", "start")) == 1))
    found = found.withColumn("n", F.sum(F.col("first").cast("long")).over(anchor))
    # a hot anchor's contexts may all differ from one another's neighbours: each is looked at, and over several shards
    dealt = F.when(F.col("what") == 2, F.greatest(F.lit(2), F.ceil(F.col("n") * parts / SPLIT))).otherwise(F.ceil(F.col("n") / SPLIT)).cast("int")
    found = checkpointed(found.where("NOT first OR n > 1 OR what = 2").select("deal", "id", "twin", "start", "size", "first", dealt.alias("dealt")))
    open_ones = found.where("first")
    total = open_ones.agg(F.sum("size")).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))
    wanted = open_ones.select(*keys, F.struct("deal", "start", "size", "dealt").alias("c")).groupBy(*keys).agg(F.collect_list("c").alias("wanted"))
    texts = rows.select(*keys, "text").repartition(*keys)

    def cut(batches):
        for pdf in batches:
            out = []
            for key, twin, text, wanted in zip(pdf["id"], pdf["twin"], pdf["text"], pdf["wanted"]):
                raw = text.encode()
                out += [(key, twin, w["deal"], w["start"], w["dealt"], raw[w["start"] : w["start"] + w["size"]]) for w in wanted]
            yield pd.DataFrame(out, columns=["id", "twin", "deal", "start", "dealt", "bytes"])

    once = texts if single else texts.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where("copy = 1")
    each = once.join(wanted, keys).select("id", (twin if single else F.col("twin")).alias("twin"), "text", "wanted")
    pieces = each.mapInPandas(cut, f"id {kind}, twin long, deal long, start long, dealt int, bytes binary")
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("deal", F.pmod(F.xxhash64("id", "twin"), F.col("dealt"))), F.lit(shards)))
    shape = f"id {kind}, twin long, start long, stop long, shard long, bucket long, highs array<long>, lows array<long>, ids array<{kind}>, twins array<long>, starts array<long>"
    local = pieces.groupBy("shard").applyInPandas(lambda pdf: shard_repeats(pdf, length, shards), shape)
    merged = local.groupBy("bucket").applyInPandas(lambda pdf: merge_shards(pdf, length), f"id {kind}, twin long, start long, stop long")
    spans = found.where("NOT first").select("id", "twin", "start", (F.col("start") + F.col("size")).alias("stop")).union(merged)
    return texts.join(spans.groupBy(*keys).agg(F.collect_list(F.struct("start", "stop")).alias("spans")), keys, "left").select("id", "text", "spans")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, keep_bytes: bool = False) -> DataFrame:
    """Return ``(id_col, n_bytes, n_removed, n_spans, kept_sha256[, kept])``, one row per row of ``docs``.

    Defined cases: a null or empty text and one shorter than ``length`` bytes lose nothing; rows
    without an id are not compared and lose nothing; rows that share an id are texts of their own, of
    which one loses what starts further left in another, but nothing that starts at the same place;
    strings are judged on the input, not on what is left; an empty table gives no rows; other columns
    are ignored.  ``kept`` are the bytes that stay, which may cut a character in two.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for key, text, spans in zip(pdf["id"], pdf["text"], pdf["spans"]):
                raw = text.encode()
                if spans is None or not len(spans):
                    out.append((key, len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw))
                    continue
                edges = np.zeros(len(raw) + 1, np.int64)
                starts, stops = np.array([s["start"] for s in spans]), np.array([s["stop"] for s in spans])
                np.add.at(edges, np.minimum(starts, len(raw)), 1)
                np.add.at(edges, np.minimum(stops, len(raw)), -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((key, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
            got = pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            yield got if keep_bytes else got.drop(columns="kept")

    shape = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    done = repeated_spans(docs, id_col=id_col, text_col=text_col, length=length).mapInPandas(run, shape)
    nameless = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast(kind).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(None).cast("array<struct<start:long,stop:long>>").alias("spans"))
    return done.union(nameless.mapInPandas(run, shape)).withColumnRenamed("id", id_col)


#: ``remove_repeats`` over the documents table, every string looked up by itself: for small tables only.
SQL = """
WITH h AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
strings AS (SELECT r, doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS s FROM (SELECT r, doc_id, x, unnest(range(0, n - 99)) AS i FROM h WHERE n >= 100 AND doc_id IS NOT NULL)),
late AS (SELECT r, i FROM (SELECT r, i, rank() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM strings) WHERE k > 1),
marked AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM late),
numbered AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM marked),
spans AS (SELECT r, k, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY 1, 2),
gaps AS (SELECT r, k, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY k), 0) AS from_ FROM spans),
kept AS (SELECT g.r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY k) || substr(any_value(x), 2 * max(b) + 1) AS y
  FROM gaps g JOIN h ON g.r = h.r GROUP BY 1)
SELECT h.doc_id, h.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM h LEFT JOIN kept ON h.r = kept.r
"""
