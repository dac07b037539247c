"""Near-duplicate self-join of texts on the Jaccard similarity of their word n-grams.

1. Texts become sets of hashed word n-grams; texts with the same set are one *set row* from here on, so
   that copies cost nothing more.
2. MinHash bands: as many bands as the target recall needs for the widest band that the hash budget
   allows.  Band hashes are shuffled; every set is tied to the least set of each of its buckets, so a
   bucket of n sets gives n ties, not n * n pairs.
3. Ties are joined to candidate components.  Every pair that shares a bucket lies within one.
4. Within a component all pairs are verified on their full n-gram sets: members are dealt into blocks,
   a task sees two blocks at most, multiplies their incidence matrices and returns a row per member
   (links and the class it belongs to).  Pairs are never rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, checkpointed, mix64, seeds, slabs, spread_join
from .graph import components

#: Members of a component, and n-grams of theirs, that one side of a verification task holds (a text of more n-grams is a side of its own).
BLOCK, BLOCK_GRAMS = 512, 4_000_000
#: Rows for verification that a partition gets.
DEALT = 2048
WORD_BYTES = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
BYTE_CODES = seeds(11, 256)


def choose_bands(threshold: float, recall: float, budget: int = 256) -> tuple[int, int]:
    """Bands and rows: the most rows a band can have so that ``1 - (1 - t**rows)**bands >= recall`` within ``budget`` hashes."""
    best = (max(1, budget), 1)
    for rows in range(1, budget + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows > budget:
            break
        best = (bands, rows)
    return best


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, in order, and where each text's words begin (one entry more than texts)."""
    parts = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])
    inside = WORD_BYTES[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, U64), np.zeros(len(texts) + 1, np.int64)
    lengths = ends - starts
    powers = np.full(int(lengths.max()), 0x9E3779B97F4A7C15 | 1, U64)
    powers[0] = 1
    powers = np.cumprod(powers)
    at = np.flatnonzero(inside)
    first = np.cumsum(lengths) - lengths
    within = np.arange(len(at)) - np.repeat(first, lengths)
    return mix64(np.add.reduceat(BYTE_CODES[data[at]] * powers[within], first)), np.searchsorted(starts, begins)


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text.

    Words are runs of ASCII letters, digits, underscores and non-ASCII characters, in lower case.  A
    text of fewer than ``width`` words has one n-gram of all of them; one without words but not blank
    has its stripped text; a blank text has none.
    """
    words, begin = word_hashes(texts)
    factors = seeds(12, width)
    n = len(words)
    grams = np.zeros(max(0, n - width + 1), U64)
    for k in range(width):
        grams += words[k : k + len(grams)] * factors[k]
    grams = mix64(grams)
    out = []
    for i, t in enumerate(texts):
        a, b = int(begin[i]), int(begin[i + 1])
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(mix64((words[a:b] * factors[: b - a]).sum(keepdims=True)))
        elif t.strip():
            out.append(np.frombuffer(hashlib.blake2b(t.strip().encode(), digest_size=8).digest(), U64))
        else:
            out.append(np.empty(0, U64))
    return out


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes that name each set of n-grams."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((2, len(sets)), U64)
    if sizes.any():
        flat = np.concatenate(sets)
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        out[0, full] = mix64(np.add.reduceat(mix64(flat), starts))
        out[1, full] = mix64(np.add.reduceat(mix64(flat ^ U64(0x5851F42D4C957F2D)), starts))
    return out[0].view(np.int64), out[1].view(np.int64)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """MinHash band hashes, one row of ``bands`` values for each (non-empty) set."""
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    flip, factor = seeds(13, bands * rows), seeds(14, bands * rows) | U64(1)
    out = np.empty((len(sets), bands), U64)
    for band in range(bands):
        acc = np.full(len(sets), band + 1, U64)
        for k in range(band * rows, band * rows + rows):
            acc = mix64(acc * U64(31) + np.minimum.reduceat((flat ^ flip[k]) * factor[k], starts))
        out[:, band] = acc
    return out.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """``(id, twin, n, s1, s2, bands)`` of every row: hash of its text, n-grams, names of their set, band hashes."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("twin"), "text")

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in slabs(texts, 400_000):
                sets = shingle_sets(texts[a:b], width)
                n = np.array([len(s) for s in sets], np.int64)
                s1, s2 = set_keys(sets)
                full = [s for s in sets if len(s)]
                hashes = iter(band_hashes(full, bands, rows)) if full else iter(())
                yield pd.DataFrame({"id": pdf["id"].iloc[a:b].reset_index(drop=True), "twin": pdf["twin"].to_numpy()[a:b], "n": n, "s1": s1, "s2": s2, "bands": [next(hashes) if k else None for k in n]})

    return source.mapInPandas(run, f"id {kind}, twin long, n long, s1 long, s2 long, bands array<long>")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right``."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    if len(column):
        column = np.cumsum(np.diff(column, prepend=column[0]) != 0)
        for low in range(0, int(column[-1]) + 1, 2048):
            a, b = np.searchsorted(column, [low, low + 2048])
            grid = np.zeros((len(left) + len(right), 2048), np.float32)
            grid[owner[a:b], column[a:b] - low] = 1
            out += grid[: len(left)] @ grid[len(left) :].T
    return out


def verify(pdf: pd.DataFrame, threshold: float, width: int) -> pd.DataFrame:
    """Links and local classes of the members of one block or pair of blocks of a component."""
    got = shingle_sets(pdf["text"].tolist(), width)
    s1, s2 = set_keys(got)
    right = (s1 == pdf["s1"].to_numpy()) & (s2 == pdf["s2"].to_numpy())
    pdf = pdf[right].assign(grams=[g for g, ok in zip(got, right) if ok]).drop_duplicates(["s1", "s2"]).reset_index(drop=True)
    one, two = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
    block = pdf["block"].to_numpy()
    rows, cols = np.flatnonzero(block == one), np.flatnonzero(block == two)
    links, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
    if len(rows) and len(cols):
        grams, copies = pdf["grams"].tolist(), pdf["copies"].to_numpy()
        size = np.array([len(g) for g in grams])
        common = common_counts([grams[i] for i in rows], [grams[i] for i in cols])
        like = common / (size[rows][:, None] + size[cols][None, :] - common) >= threshold - 1e-6
        if one == two:
            np.fill_diagonal(like, False)
            links[rows] = like @ copies[cols]
        else:
            links[rows], links[cols] = like @ copies[cols], like.T @ copies[rows]
        # classes: least member reached, to a fixed point
        while True:
            to_cols = np.where(like, root[rows][:, None], len(pdf)).min(0)
            root[cols] = np.minimum(root[cols], to_cols)
            to_rows = np.where(like, root[cols][None, :], len(pdf)).min(1)
            was = root.copy()
            root[rows] = np.minimum(root[rows], to_rows)
            root = np.minimum(root, root[root])
            if (was == root).all() and (np.where(like, root[rows][:, None], len(pdf)).min(0) >= root[cols]).all():
                break
    out = pdf[["comp", "blocks", "s1", "s2", "rep"]].assign(links=links, root=pdf["s1"].to_numpy()[root])
    out["class_rep"] = out.groupby("root")["rep"].transform("min")
    return out


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float, recall: float, hash_budget: int, block: int) -> DataFrame:
    """``(id, twin, class, class_id, n_links)``, one row per row; ``class`` tells classes apart where ids don't, and is null for a blank text."""
    bands, rows = choose_bands(threshold, recall, hash_budget)
    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sig = checkpointed(signatures(docs, id_col, text_col, width, bands, rows))
    some = sig.where("n > 0")
    sets = some.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("grams"))
    banded = some.groupBy("s1", "s2").agg(F.first("bands").alias("bands")).select("s1", F.explode("bands").alias("h"))
    buckets = banded.groupBy("h").agg(F.min("s1").alias("v"), F.max("s1").alias("top")).where("v <> top").select("h", "v")
    ties = banded.join(buckets, "h").where("s1 <> v").select(F.col("s1").alias("u"), "v")
    comps = components(ties)
    members = checkpointed(sets.join(comps, sets["s1"] == comps["node"]).drop("node"))
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("grams") / BLOCK_GRAMS)).cast("int")
    sizes = checkpointed(members.groupBy("comp").agg(blocks.alias("blocks"), F.count("*").alias("size")))
    work = sizes.agg(F.sum(F.col("blocks") * F.col("size"))).first()[0] or 0
    members = members.join(sizes.drop("size"), "comp").withColumn("block", F.pmod(F.xxhash64("s2", "s1"), F.col("blocks")).cast("int"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    loaded = texts.join(members, F.col("id").eqNullSafe(F.col("rep"))).drop("id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = loaded.withColumn("other", other).select(
        "comp", "blocks", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "s1", "s2", "rep", "copies", "text"
    )
    # the work of a group grows faster than its bytes: partitions aren't put together by these
    dealt = dealt.repartition(max(parts, math.ceil(work / DEALT)), "comp", "low", "high")
    shape = f"comp long, blocks int, s1 long, s2 long, rep {kind}, links long, root long, class_rep {kind}"
    seen = checkpointed(dealt.groupBy("comp", "low", "high").applyInPandas(lambda pdf: verify(pdf, threshold, width), shape))
    # a set of one block has one row
    counted = seen.where("blocks = 1").select("s1", "s2", "links", "class_rep", "root")
    split = seen.where("blocks > 1")
    if not split.isEmpty():
        joined = components(split.select(F.col("s1").alias("u"), F.col("root").alias("v")))
        added = split.groupBy("s1", "s2").agg(F.sum("links").alias("links"), F.min("class_rep").alias("class_rep"))
        # a set of several blocks that is linked to none is a class by itself
        added = checkpointed(added.join(joined, added["s1"] == joined["node"], "left").select("s1", "s2", "links", "class_rep", F.coalesce("comp", "s1").alias("root")))
        least = added.groupBy("root").agg(F.min("class_rep").alias("class_rep"), F.count("*").alias("size"))
        counted = counted.union(spread_join(added.drop("class_rep"), least, ["root"], "size").select("s1", "s2", "links", "class_rep", "root"))
    named_sets = sets.join(counted, ["s1", "s2"], "left").select(
        "s1", "s2", "copies", F.coalesce("root", "s1").alias("class"), F.coalesce("class_rep", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = spread_join(some.select("id", "twin", "s1", "s2"), named_sets, ["s1", "s2"], "copies").select("id", "twin", "class", "class_id", "n_links")
    blank = sig.where("n = 0").select("id", "twin", F.lit(None).cast("long").alias("class"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.union(blank)


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
    hash_budget: int = 256,
    block: int = BLOCK,
) -> DataFrame:
    """Return ``(id_col, class_id, n_links)``, one row per row of ``docs``.

    ``class_id`` is the least id of the texts that a document is linked to, directly or through
    others; ``n_links`` counts the other rows of similarity ``threshold`` or more within its
    candidates, copies included.  A pair of just that similarity becomes a candidate with
    probability ``recall``, more similar ones with a higher one.

    Defined cases: a blank or null text has no links and is a class of its own; texts of fewer than
    ``width`` words are alike only if all their words are; rows with a repeated id are rows of their
    own; a null id never names a class unless the class has no other; an empty table gives no rows;
    other columns are ignored.
    """
    found = _classes(docs, id_col, text_col, width, threshold, recall, hash_budget, block)
    return found.select(F.col("id").alias(id_col), "class_id", "n_links")


def keep_one(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.9999, hash_budget: int = 256, block: int = BLOCK
) -> DataFrame:
    """``docs`` with one row of each class of near duplicates: the one of least id, of equal ids that of the text of least hash.

    Defined cases: blank and null texts all stay; rows without an id come after all others of their
    class; of repeated rows any one stays; ids may be repeated, which ties no rows together; an empty
    table stays empty; the columns are those of ``docs``, whatever their names.
    """
    found = checkpointed(_classes(docs, id_col, text_col, width, threshold, recall, hash_budget, block).where("class IS NOT NULL").select("id", "twin", "class"))
    place = F.struct(F.col("id").isNull().alias("nameless"), "id", "twin")
    kept = found.groupBy("class").agg(F.min(place).alias("kept"), F.count("*").alias("size")).where("size > 1")
    rows = spread_join(found.groupBy("class", "id", "twin").agg(F.count("*").alias("n")), kept, ["class"], "size")
    # what to do with the rows of an id and text: 0 rows go, but one of them, or all of them
    known = checkpointed(rows.select(F.col("id").alias("__id"), F.col("twin").alias("__twin"), (place != F.col("kept")).alias("__gone"), "n").where("__gone OR n > 1").drop("n"))
    twin = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    match = lambda other: docs[id_col].eqNullSafe(other["__id"]) & (twin == other["__twin"])
    stay = docs.join(known, match(known), "left_anti")
    again = known.where("NOT __gone")
    if again.isEmpty():
        return stay
    key = "__key_" + "_".join(docs.columns)
    once = docs.join(again, match(again), "left_semi").withColumn(key, F.struct(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))
    return stay.union(once.dropDuplicates([key]).drop(key))


#: ``near_duplicates`` over the documents table by comparing all texts that share an n-gram: for small tables only.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, trim(coalesce(text, '')) AS t, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] WHEN t <> '' THEN ['=' || t] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
pairs AS (SELECT a.doc_id AS one, b.doc_id AS two, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT one, two FROM pairs JOIN sizes x ON x.doc_id = one JOIN sizes y ON y.doc_id = two WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
both_ways AS (SELECT one, two FROM links UNION SELECT two, one FROM links),
reach AS (SELECT one, two FROM both_ways UNION SELECT r.one, b.two FROM reach r JOIN both_ways b ON r.two = b.one),
classes AS (SELECT one, min(two) AS least FROM reach GROUP BY 1),
counts AS (SELECT one, count(*) AS n_links FROM both_ways GROUP BY 1)
SELECT d.doc_id, least(d.doc_id, coalesce(k.least, d.doc_id)) AS class_id, coalesce(n.n_links, 0) AS n_links
FROM documents d LEFT JOIN classes k ON k.one = d.doc_id LEFT JOIN counts n ON n.one = d.doc_id
"""
