"""BPE encoding and decoding of words with a contiguous rank array.

A word is a short list of part boundaries, with the part that begins there and the rank of every
adjacent pair beside it.  The lowest
rank is found by scanning, its boundary deleted, and the ranks on both sides looked up again: for
the few parts of a word this is faster than any queue.  Words above ``LONG`` parts (a line of a
thousand dashes) use a heap over the same pairs, which gives the same parts in n log n steps.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import struct
import unicodedata
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import slabs
from .token_counts import byte_alphabet

#: The tokenizer's word pattern and the suffix that ends a word.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
NONE, LONG = 1 << 30, 300
#: Words whose encoding a task keeps: those of late, and as many of before.
STORE = 125_000


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Odd(NamedTuple):
    """Code points that the library's Unicode tables treat unlike this Python's and ``regex``'s, and those this Python doesn't know, as first and last of ranges."""

    points: tuple[tuple[int, int], ...]
    differ: tuple[tuple[int, int], ...]
    letters: tuple[tuple[int, int], ...]
    numbers: tuple[tuple[int, int], ...]
    spaces: tuple[tuple[int, int], ...]


def _ranges(points) -> tuple[tuple[int, int], ...]:
    found = sorted(points)
    cuts = [i for i, (a, b) in enumerate(pairwise(found), 1) if b != a + 1]
    return tuple((found[a], found[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(found)])) if found else ()


@functools.cache
def odd_points(path: str) -> Odd:
    """Asks the library of ``path`` once (on the driver): classes of all code points younger than Unicode 3.2, and how it normalises every one that this Python knows."""
    tool = Tokenizer.from_file(path)
    old = unicodedata.ucd_3_2_0.category
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    unknown = {c for c in every if unicodedata.category(chr(c)) == "Cn"}
    young = [c for c in every if (c < 0x40000 or 0xE0000 <= c < 0xE1000) and old(chr(c)) == "Cn"]
    classes: dict[str, set[int]] = {k: set() for k in "LNSO"}
    for a in range(0, len(young), 50_000):
        part = [chr(c) for c in young[a : a + 50_000]]
        held: list[list[int]] = [[] for _ in part]
        at = np.arange(len(part) + 1) * 4
        for _, (start, end) in tool.pre_tokenizer.pre_tokenize_str("".join(f"a{c}{c}\n" for c in part)):
            held[int(np.searchsorted(at, start, "right")) - 1].append(end - start)
        for c, sizes in zip(young[a:], held):  # a letter joins the a; numbers stand alone; others join each other
            classes[{(3,): "L", (1, 1, 1): "N", (1,): "S", (1, 2): "O"}[tuple(sizes)]].add(c)
    own = {"L": regex.compile(r"\p{L}"), "N": regex.compile(r"\p{N}"), "S": regex.compile(r"\s")}
    text = "".join(map(chr, young))
    mine = {k: {ord(c) for c in p.findall(text)} for k, p in own.items()}
    differ = set().union(*(classes[k] ^ mine[k] for k in own))
    known = [c for c in every if c not in unknown and not chr(c).isspace() and c]
    for a in range(0, len(known), 50_000):
        part = [chr(c) for c in known[a : a + 50_000]]
        theirs = tool.normalizer.normalize_str("\0".join(part)).split("\0")
        unknown.update(ord(c) for c, x in zip(part, theirs) if x != normal(c))
    for c in known:
        if unicodedata.combining(chr(c)):  # marks whose order among others the library doesn't know, or knows otherwise
            near = [f"a{chr(c)}{m}" for m in "\u0334\u0316\u0301\u0345"] + [f"a{m}{chr(c)}" for m in "\u0334\u0316\u0301\u0345"]
            if any(tool.normalizer.normalize_str(t) != normal(t) for t in near):
                unknown.add(c)
    return Odd(_ranges(unknown | differ), *map(_ranges, (differ, *(classes[k] & differ for k in "LNS"))))


def normal(text: str) -> str:
    """The tokenizer's normalisation: NFC, and lower case of each character by itself."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def exact_pattern(odd: Odd) -> str:
    """``PATTERN`` with the library's classes."""
    one = lambda ranges: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    out = "(?V1)" + PATTERN
    letter, number, space = (f"[{p}--[{one(odd.differ)}]]" + (f"||[{one(more)}]" if more else "") for p, more in ((r"\p{L}", odd.letters), (r"\p{N}", odd.numbers), (r"\s", odd.spaces)))
    for name, full in ((r"[^\s\p{L}\p{N}]", f"[^[{space}]||[{letter}]||[{number}]]"), (r"[\p{L}]", f"[{letter}]"), (r"[\p{N}]", f"[{number}]")):
        out = out.replace(name, full)
    return out if odd.differ else "(?V1)" + PATTERN


class Codec:
    """Encoder and decoder for ``path``, a word-end BPE file of the tokenizers library."""

    def __init__(self, path: str, odd: Odd):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in spec["model"]["merges"]]
        self.rank = {self.vocab[a] << 17 | self.vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.names = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.find = regex.compile(PATTERN).findall
        self.path, self.exact, self.library = path, regex.compile(exact_pattern(odd)).findall, None
        self.odd = np.zeros(0x110000, bool)
        for a, b in odd.points:
            self.odd[a : b + 1] = True
        self.inner = [self.vocab[c] for c in byte_alphabet()]
        self.last = [self.vocab[c + END] for c in byte_alphabet()]
        self.store: dict[str, tuple[bytes, str]] = {}
        self.before: dict[str, tuple[bytes, str]] = {}

    def parts(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        ids = [*map(self.inner.__getitem__, word[:-1]), self.last[word[-1]]]
        if len(ids) > LONG:
            return self.long_parts(ids)
        rank, merged = self.rank.get, self.merged
        cuts = list(range(len(ids)))
        near = [rank(a << 17 | b, NONE) for a, b in zip(ids, ids[1:])]
        while near:
            low = min(near)
            if low == NONE:
                break
            i = near.index(low)
            del cuts[i + 1], ids[i + 1], near[i]
            part = ids[i] = merged[low]
            if i < len(near):
                near[i] = rank(part << 17 | ids[i + 1], NONE)
            if i:
                near[i - 1] = rank(ids[i - 1] << 17 | part, NONE)
        return ids

    def long_parts(self, part: list[int]) -> list[int]:
        n, rank = len(part), self.rank
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := rank.get(part[i] << 17 | part[i + 1], NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if part[i] < 0 or after[i] != j or rank.get(part[i] << 17 | part[j]) != r:
                continue
            part[i], part[j], after[i] = self.merged[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (q := rank.get(part[a] << 17 | part[b], NONE)) < NONE:
                    heapq.heappush(heap, (q, a, b))
        return [p for p in part if p >= 0]

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids of a word as little-endian unsigned 32-bit integers, and its tokens with spaces between."""
        ids = self.parts(word.encode())
        return pack(ids), self.decode(ids)

    def is_odd(self, text: str) -> bool:
        try:
            text.encode("latin-1")
            return False
        except UnicodeEncodeError:
            return bool(self.odd[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())

    def words(self, text: str) -> list[str]:
        """Words after the tokenizer's normalisation.  Texts with code points of other Unicode versions are normalised by the library itself and cut by its classes."""
        if not self.is_odd(text):
            return self.find(normal(text))
        self.library = self.library or Tokenizer.from_file(self.path)
        return self.exact(self.library.normalizer.normalize_str(text))

    def encode(self, text: str) -> tuple[bytes, str]:
        store, out = self.store, []
        for part in self.split.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append((pack([self.special[part]]), part))
                continue
            words = self.words(part)
            for w in set(words).difference(store):
                store[w] = self.before.get(w) or self.word(w)
            out += map(store.__getitem__, words)
        if len(store) > STORE:  # words that come up again move on, the others go
            self.store, self.before = {}, store
        return b"".join(x[0] for x in out), " ".join(x[1] for x in out)

    def decode(self, ids) -> str:
        """The library's decode for a file without decoder: token strings joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))


@functools.cache
def codec(path: str, odd: Odd) -> Codec:
    return Codec(path, odd)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``(id_col, ids binary, decoded string)``: token ids (little-endian unsigned 32-bit) and what they decode to.

    Defined cases: a null or empty text has no ids and decodes to the empty string; repeated rows and
    equal texts have equal ids; an empty table gives no rows; other columns are ignored.  No shuffle.
    """
    return _run(docs, path, id_col, text_col, "ids binary, decoded string", lambda ids, text: (ids, text))


def digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` with counts and SHA-256 digests in place of ids and texts, so that these never leave the task."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _run(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: (len(ids) // 4, sha(ids), sha(text.encode())))


def _run(docs, path, id_col, text_col, columns, what) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    names = [c.split()[0] for c in columns.split(", ")]

    odd = odd_points(path)

    def run(batches):
        tool = codec(path, odd)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in slabs(texts, 1_000_000):
                got = [what(*tool.encode(t)) for t in texts[a:b]]
                yield pd.DataFrame({"id": pdf["id"].iloc[a:b].reset_index(drop=True)} | dict(zip(names, map(list, zip(*got)))))
        tool.store, tool.before = {}, {}  # a worker that goes on to other work holds no words

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)
