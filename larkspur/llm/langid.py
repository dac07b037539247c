"""Language identification: known words first, then shorter and shorter character n-grams.

A word of the model scores by its log frequency in each language.  A word the model doesn't know
falls back to its longest character n-grams of which the model knows any, from ``ORDER`` characters
down to one, and scores by their mean log frequency.  A document's scores are summed over its words.

Words and n-grams are known by 64-bit hashes, in sorted arrays beside their scores, and looked up for
many texts at a time.

These sums say which language is likeliest, not whether any is likely: the longer a text, the nearer
the best share is to 1.  ``checked`` adds a measure that doesn't grow with the text, the mean over its
words of the mean log frequency of their 3-grams.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, mix64, slabs

ORDER = 5
LETTERS = regex.compile(r"\p{L}+")
#: The same runs but for numerals that aren't digits, and several times as fast.
NEARLY_LETTERS = re.compile(r"[^\W\d_]+")
#: Letters that don't touch digits: no pieces of keys and hex strings.
WHOLE = regex.compile(r"(?<![\p{L}\p{N}])\p{L}+(?![\p{L}\p{N}])")
SMOOTH = 0.5
#: Characters of texts that are looked at together.
SLAB = 400_000
BASE = 0x9E3779B97F4A7C15


@dataclass
class Scores:
    """Log frequencies by language of what has the (sorted) hash."""

    keys: np.ndarray
    logs: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and the rows of those."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[at] == hashes
        return known, at[known]


@dataclass
class Model:
    langs: list[str]
    #: Of words, then of n-grams of 1 to ``ORDER`` characters.
    orders: list[Scores]
    #: Log frequency of a 3-gram that was never seen, by language.
    unseen: np.ndarray
    #: Least mean log frequency of a text's 3-grams, by language.
    usual: np.ndarray | None = None


class Words(dict):
    """Number of each word, in order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Pieces:
    """Hashes of words and of their n-grams; a word counts with a mark on either side."""

    def __init__(self, words: list[str]):
        self.sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
        powers = np.full(len(codes) + 1, BASE, U64)
        powers[0] = 1
        self.up = np.cumprod(powers)
        powers[1:] = U64(pow(BASE, -1, 1 << 64))
        self.down = np.cumprod(powers)
        self.prefix = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(codes.astype(U64) + U64(1)) * self.up[:-1])])
        self.begins = np.cumsum(self.sizes) - self.sizes

    def _hashes(self, starts: np.ndarray, stops: np.ndarray, order: int) -> np.ndarray:
        return mix64((self.prefix[stops] - self.prefix[starts]) * self.down[starts] + U64(order))

    def whole(self) -> np.ndarray:
        return self._hashes(self.begins, self.begins + self.sizes, 0)

    def grams(self, n: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of some words, and whose they are."""
        of = of[self.sizes[of] >= n]
        many = self.sizes[of] - n + 1
        owner = np.repeat(of, many)
        starts = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + self.begins[owner]
        return self._hashes(starts, starts + n, n), owner


def words_of(texts: list[str]) -> list[list[str]]:
    """Runs of letters of each text, in lower case."""
    lower = [t.lower() for t in texts]
    found = [NEARLY_LETTERS.findall(t) for t in lower]
    return [f if "".join(f).isalpha() or not f else LETTERS.findall(t) for f, t in zip(found, lower)]


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs_per_lang: int = 5000) -> Model:
    """Learn from rows with a language.

    The only bound is on the documents learned from, so that the model can be sent to every task:
    about ``max_docs_per_lang`` of each language, chosen by a hash of the id, whole texts.  All their
    words and n-grams are known.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [Scores(np.empty(0, U64), np.empty((0, 0)))] * (ORDER + 1), np.zeros(0))
    cut = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, int(1_000_000 * min(1, max_docs_per_lang / sizes[lang])))])
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < cut[F.col("lang")]).select(number[F.col("lang")].alias("lang"), "text")

    def count(batches):
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                texts = part["text"].tolist()
                for a, b in slabs(texts, 4 * SLAB):
                    seen: Counter = Counter()
                    for found in words_of(texts[a:b]):
                        seen.update(found)
                    if not seen:
                        continue
                    pieces, n = Pieces(list(seen)), np.fromiter(seen.values(), np.int64, len(seen))
                    for k in range(ORDER + 1):
                        hashes, owner = pieces.grams(k, np.arange(len(n))) if k else (pieces.whole(), np.arange(len(n)))
                        hashes, at = np.unique(hashes, return_inverse=True)
                        yield pd.DataFrame({"k": k, "lang": lang, "hash": hashes.view(np.int64), "n": np.bincount(at, n[owner]).astype(np.int64)})

    counts = chosen.mapInPandas(count, "k int, lang int, hash long, n long").groupBy("k", "lang", "hash").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    orders, wholes = [], []
    for k in range(ORDER + 1):
        part = counts[counts["k"] == k]
        keys, at = np.unique(part["hash"].to_numpy(np.int64).view(U64), return_inverse=True)
        table = np.zeros((len(keys), len(langs)))
        table[at, part["lang"].to_numpy(np.int64)] = part["n"]
        wholes.append(table.sum(0) + SMOOTH * max(1, len(keys)))
        orders.append(Scores(keys, np.log((table + SMOOTH) / wholes[-1]).astype(np.float32)))
    return Model(langs, orders, np.log(SMOOTH / wholes[3]))


def checked(model: Model, depth: float = 0.5) -> Model:
    """A model that finds ``und`` with score 0 also where a text's words are unlike those of its best language.

    They are unlike where their mean log frequency of 3-grams is more than the part ``depth`` of the
    way down from the mean over the 3-grams learned from to that of a 3-gram never seen.  Letters beside
    digits are not held against a text that has other words.
    """
    if not model.langs:
        return model
    logs = model.orders[3].logs.astype(float)
    mean = (np.exp(logs) * logs).sum(0) / np.exp(logs).sum(0)
    return replace(model, usual=mean + depth * (model.unseen - mean))


def _means(scores: Scores, pieces: Pieces, n: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the log frequencies of the known n-grams of some words, and how many there are."""
    hashes, owner = pieces.grams(n, of)
    known, rows = scores.find(hashes)
    owner, words = owner[known], len(pieces.sizes)
    sums = [np.bincount(owner, scores.logs[rows, k], words) for k in range(scores.logs.shape[1])]
    return np.stack(sums, 1), np.bincount(owner, minlength=words)


def word_scores(model: Model, pieces: Pieces) -> np.ndarray:
    """Scores of words by language."""
    out = np.zeros((len(pieces.sizes), len(model.langs)))
    known, rows = model.orders[0].find(pieces.whole())
    out[known] = model.orders[0].logs[rows]
    for n in range(ORDER, 0, -1):
        sums, many = _means(model.orders[n], pieces, n, np.flatnonzero(~known))
        some = many > 0
        out[some] = sums[some] / many[some, None]
        known |= some
    return out


def word_levels(model: Model, pieces: Pieces) -> np.ndarray:
    """Mean log frequency of words' 3-grams by language, unseen ones included."""
    sums, many = _means(model.orders[3], pieces, 3, np.arange(len(pieces.sizes)))
    size = pieces.sizes - 2
    return (sums + (size - many)[:, None] * model.unseen) / size[:, None]


def totals(found: list[np.ndarray], of_words: np.ndarray) -> np.ndarray:
    """Sums over each text's words."""
    return np.array([of_words[f].sum(0) if len(f) < 50_000 else np.bincount(f, minlength=len(of_words)) @ of_words for f in found]).reshape(len(found), -1)


def predict_texts(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    for a, b in slabs(texts, SLAB) if model.langs else ():
        names, words = words_of(texts[a:b]), Words()
        found = [np.fromiter(map(words.__getitem__, w), np.int64, len(w)) for w in names]
        if not words:
            continue
        pieces = Pieces(list(words))
        total = totals(found, word_scores(model, pieces))
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        levels = None if model.usual is None else word_levels(model, pieces)
        for i, f in enumerate(found):
            if not len(f):
                continue
            known = levels is None or levels[f, best[i]].mean() >= model.usual[best[i]]
            if not known and (whole := WHOLE.findall(texts[a + i].lower())):  # all of them are among the words
                known = np.mean([levels[words[w], best[i]] for w in whole]) >= model.usual[best[i]]
            if known:
                langs[a + i], scores[a + i] = model.langs[best[i]], float(share[i])
    return langs, scores


def language(spark: SparkSession, model: Model, text: Column) -> Column:
    """Column ``struct<lang_pred, score>`` of a text column; see ``predict``."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for col in batches:
            langs, scores = predict_texts(sent.value, col.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return find(F.coalesce(text, F.lit("")))


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``(id_col, lang_pred, score)``, one row per row of ``docs``; no shuffle.

    ``score`` is the share of the best language in the exponentiated scores.  Defined cases: a null
    text, one without letters, and every text where the model knows no language is ``und`` with
    score 0; ties go to the language first in code point order; other columns are ignored.
    """
    found = docs.select(F.col(id_col), language(docs.sparkSession, model, F.col(text_col)).alias("found"))
    return found.select(id_col, "found.lang_pred", "found.score")


def keep_known(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without rows whose language is ``und`` or has a score below ``least``, by the ``checked`` model; all columns stay as they are."""
    model = checked(model)
    name = "found_" + "_".join(docs.columns)
    found = docs.withColumn(name, language(docs.sparkSession, model, F.col(text_col)))
    return found.where((F.col(name)["lang_pred"] != "und") & (F.col(name)["score"] >= least)).drop(name)


def held_out(id_col: str = "doc_id"):
    """True for the quarter of rows that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
