"""Token counts of a byte-level BPE tokenizer by rank-synchronous array merging.

Distinct pre-tokens of a batch are laid end to end in one ragged numpy array of symbol ids.  In every
round each sequence finds the lowest rank among its adjacent pairs and merges all occurrences of
that pair at once; sequences without a pair leave.  What survives is counted.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slabs

#: The pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int32).max
#: Pre-tokens whose counts a task keeps; beyond it the store starts anew (results don't depend on it).
STORE = 400_000


@functools.cache
def byte_alphabet() -> str:
    """The printable character that stands for each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(other)) for b in range(256))


class Counter:
    """Counts the tokens of texts; ``path`` names a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.n = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.byte_ids = np.array([vocab[c] for c in byte_alphabet()], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in spec["model"]["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.store: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE).astype(np.int32)

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """Symbols that are left of each (non-empty) word when no pair can be merged."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = lengths.copy()
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        who = np.arange(len(words))
        starts = np.cumsum(lengths) - lengths
        rank = np.full(len(ids), NONE, np.int32)
        if len(ids) > 1:
            rank[:-1] = self.ranks(ids[:-1], ids[1:])
        rank[starts + lengths - 1] = NONE
        while len(who):
            low = np.minimum.reduceat(rank, starts)
            live = low < NONE
            if not live.all():
                out[who[~live]] = lengths[~live]
                stay = np.repeat(live, lengths)
                ids, rank, who, lengths, low = ids[stay], rank[stay], who[live], lengths[live], low[live]
                starts = np.cumsum(lengths) - lengths
                if not len(who):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, lengths))
            # of overlapping occurrences (a a a) every second one counts, from the left
            new_run = np.ones(len(hit), bool)
            new_run[1:] = np.diff(hit) != 1
            run_start = hit[np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))]
            hit = hit[(hit - run_start) % 2 == 0]
            ids[hit] = self.merged[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            last = np.zeros(len(ids), bool)
            last[starts + lengths - 1] = True
            last[hit] |= last[hit + 1]
            seq = np.searchsorted(starts, hit, "right") - 1
            lengths = lengths - np.bincount(seq, minlength=len(lengths))
            moved = hit - np.arange(len(hit))
            ids, rank, last = ids[keep], rank[keep], last[keep]
            starts = np.cumsum(lengths) - lengths
            rank[moved] = NONE
            ahead = moved[~last[moved]]
            rank[ahead] = self.ranks(ids[ahead], ids[ahead + 1])
            behind = moved[moved > 0] - 1
            behind = behind[~last[behind]]
            rank[behind] = self.ranks(ids[behind], ids[behind + 1])
        return out

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of ``text``, and how many special tokens stood between them."""
        if self.split is None or not any(s in text for s in self.special):
            return self.find(text), 0
        parts = self.split.split(text)
        return [w for p in parts for w in self.find(p)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        store, cut = self.store, [self.pieces(t) for t in texts]
        new = list(set().union(*(set(w).difference(store) for w, _ in cut)))
        for a, b in slabs(new, 1_000_000):
            store.update(zip(new[a:b], self.survivors([w.encode() for w in new[a:b]]).tolist()))
        out = [sum(map(store.__getitem__, w)) + n for w, n in cut]
        if len(store) > STORE:
            store.clear()
        return out


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Return ``(id_col, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``; no shuffle.

    Defined cases: a null or empty text has 0 bytes and 0 tokens; special token strings in a text
    count as one token each, as the library takes them by default; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        tool = counter(path)
        for pdf in batches:
            texts = pdf["text"].tolist()
            counts: list[int] = []
            for a, b in slabs(texts, 1_000_000):
                counts += tool.count(texts[a:b])
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": pdf["n_bytes"], "n_tokens": np.array(counts, np.int64)})

    counted = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInPandas(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
