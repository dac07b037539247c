"""Secret scan: base patterns, and a linear-chain conditional random field that adds what they miss.

Tokens are tagged O (outside), B (first of a secret) or I (inside one).  A token's scores come from its
shape, how its kinds of characters alternate, what separates it from the token before, two words before
and one after, and features of the whole file.  The field is fitted on a bounded sample, by gradient
ascent on the exact log likelihood (forward and backward sums), to windows around secrets of the base
patterns and windows without any.  So that it doesn't only relearn the patterns, copies of these windows
hide what they look for: the secret's shape is that of a drawn token of another style, and its key word
is another one or none; other copies hold drawn tokens that are no secrets (dates, versions, paths,
names, numbers).  Texts are decoded by Viterbi.

All tokens of many texts form one chain that starts anew at each text.  It is cut into pieces of
``STEP`` tokens that are decoded side by side: the best path of each piece from each entry state to
each exit state, then the best states at the cuts, then the paths within the pieces.  The result is
the one a token-by-token pass gives.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, checkpointed, mix64, slabs

#: The base patterns.  A match counts if its secret part has the least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "crf")

STEP = 64
NEVER = -1e9
WORDS = 1 << 15
#: Shapes: 8 lengths, 4 shares of digits, and four yes/no features.  Mixes: 8 lengths and 5 rates of change between kinds of characters.
SHAPES, MIXES, GAPS, FILES = 512, 40, 8, 16
SIZES = (SHAPES, MIXES, GAPS, WORDS, WORDS, WORDS, FILES)
#: Words before a secret in copies of windows.
KEY_WORDS = "password passwd passphrase pwd pass secret token key apikey api_key api_token access_token access_key aws_key secret_key private_key client_secret credential credentials auth authorization bearer login".split()
#: Tokens on each side of a secret that a training window holds.
AROUND = 20

_DIGIT, _UPPER, _LOWER, _HEX, _MARK = 1, 2, 4, 8, 16
CLASS = np.zeros(129, np.uint8)
for _c in range(128):
    CLASS[_c] = (
        _DIGIT * (48 <= _c < 58) | _UPPER * (65 <= _c < 91) | _LOWER * (97 <= _c < 123) | _HEX * (chr(_c) in "0123456789abcdef") | _MARK * (chr(_c) in "+/_.-")
    )
CLASS[128] = _LOWER


def base_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """``(kind, start, end, secret start, secret end)`` of the base patterns, leftmost and not overlapping within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a line feed after each, and where each text begins (one entry more than texts)."""
    cp = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.cumsum([0] + [len(t) + 1 for t in texts])


@dataclass
class Tokens:
    start: np.ndarray  # in the joined code points
    end: np.ndarray
    text: np.ndarray  # which text
    shape: np.ndarray
    mix: np.ndarray
    gap: np.ndarray
    word: np.ndarray
    file: np.ndarray
    first: np.ndarray  # first token of its text
    hex_runs: np.ndarray  # (start, end) of long runs of hex digits


def tokens_of(texts: list[str]) -> Tokens:
    cp, begins = code_points(texts)
    cls = CLASS[np.minimum(cp, 128)]
    cls[(cp == 0x85) | (cp == 0xA0) | (cp == 0x2028) | (cp == 0x3000)] = 0
    edge = np.diff((cls > 0).astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hex_edge = np.diff(((cls & _HEX) > 0).astype(np.int8), prepend=np.int8(0))
    runs = np.stack([np.flatnonzero(hex_edge == 1), np.flatnonzero(hex_edge == -1)], 1)
    runs = runs[runs[:, 1] - runs[:, 0] >= LEAST["hex"]]
    count = {b: np.concatenate([[0], np.cumsum((cls & b) > 0, dtype=np.int32)]) for b in (_DIGIT, _UPPER, _LOWER, _HEX, _MARK)}
    within = {b: c[end] - c[start] for b, c in count.items()}
    size = end - start
    length = np.searchsorted([2, 4, 8, 16, 20, 24, 40], size, "right")
    share = np.where(within[_DIGIT] == 0, 0, np.where(within[_DIGIT] == size, 3, 1 + (within[_DIGIT] * 2 >= size)))
    yes = lambda x: x.astype(np.int64)
    shape = (((((length * 4 + share) * 2 + yes(within[_UPPER] > 0)) * 2 + yes(within[_LOWER] > 0)) * 2) + yes(within[_HEX] == size)) * 2 + yes(within[_MARK] > 0)
    kinds = np.where((cls & _DIGIT) > 0, 1, np.where((cls & _UPPER) > 0, 2, np.where((cls & _LOWER) > 0, 3, 4)))
    turns = np.concatenate([[0], np.cumsum(np.diff(kinds, prepend=0) != 0, dtype=np.int32)])
    rate = (turns[end] - turns[np.minimum(start + 1, end)]) / np.maximum(1, size - 1)
    mix = length * 5 + np.searchsorted([1e-9, 0.1, 0.25, 0.4], rate, "right")
    equal, colon, quote = (np.concatenate([[0], np.cumsum(m, dtype=np.int32)]) for m in (cp == 61, cp == 58, (cp == 34) | (cp == 39)))
    before = np.concatenate([[0], end[:-1]])
    gap = sum(w * yes(c[start] > c[before]) for w, c in ((1, equal), (2, colon), (4, quote))) if len(start) else np.empty(0, np.int64)
    text = np.searchsorted(begins, start, "right") - 1
    first = np.ones(len(start), bool)
    first[1:] = text[1:] != text[:-1]
    if len(start):
        at = np.flatnonzero(cls > 0)
        head = np.cumsum(size) - size
        powers = np.full(int(size.max()), 0x9E3779B97F4A7C15, U64)
        powers[0] = 1
        powers = np.cumprod(powers)
        low = np.where((cls[at] & _UPPER) > 0, cp[at] + 32, cp[at]).astype(U64)
        word = (mix64(np.add.reduceat(low * powers[np.arange(len(at)) - np.repeat(head, size)], head)) % U64(WORDS)).astype(np.int64)
    else:
        word = np.empty(0, np.int64)
    # file features: much '=' or ':', many digits, many marks of code
    total = np.maximum(1, np.diff(begins))
    per = lambda c: c[begins[1:]] - c[begins[:-1]]
    code = np.concatenate([[0], np.cumsum((cp == 123) | (cp == 125) | (cp == 59) | (cp == 40), dtype=np.int32)])
    file = yes(per(equal) * 200 > total) + 2 * yes(per(colon) * 200 > total) + 4 * yes(per(count[_DIGIT]) * 20 > total) + 8 * yes(per(code) * 200 > total)
    return Tokens(start, end, text, shape, mix, gap, word, file[text], first, runs)


def features(t: Tokens) -> np.ndarray:
    """Shape, mix, gap, both words before, word after and file of each token; words are 0 beyond the ends of a text."""
    if not len(t.word):
        return np.empty((0, len(SIZES)), np.int64)
    prev, after, older = (np.zeros_like(t.word) for _ in range(3))
    prev[1:] = np.where(t.first[1:], 0, t.word[:-1])
    after[:-1] = np.where(t.first[1:], 0, t.word[1:])
    older[1:] = np.where(t.first[1:], 0, prev[:-1])
    return np.stack([t.shape, t.mix, t.gap, prev, older, after, t.file], 1)


@dataclass
class Field:
    """Weights: one table of three scores for each feature, moves between tags, and the first tag."""

    tables: list[np.ndarray]
    moves: np.ndarray
    first: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sum(w[x[..., k]] for k, w in enumerate(self.tables))


def blank_field() -> Field:
    moves, first = np.zeros((3, 3)), np.zeros(3)
    moves[0, 2] = first[2] = NEVER
    return Field([np.zeros((n, 3)) for n in SIZES], moves, first)


def fit_field(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Fit to windows ``x`` (windows, tokens, features) with tags ``y`` (windows, tokens; -1 past the end)."""
    field = blank_field()
    if not len(x) or not (y > 0).any():
        return field
    n, size = y.shape
    real, hot = y >= 0, np.eye(3)[np.maximum(y, 0)]
    hot[~real] = 0
    squares = [np.full_like(w, 1e-8) for w in (*field.tables, field.moves, field.first)]
    alive = real.T[:, :, None]
    both = hot[:, :-1].reshape(-1, 3).T @ hot[:, 1:].reshape(-1, 3)
    for _ in range(rounds):
        e = field.scores(x).transpose(1, 0, 2)
        e, move = np.exp(e - e.max(2, keepdims=True)), np.exp(field.moves)
        fwd, bwd = np.ones((size, n, 3)), np.ones((size, n, 3))  # each scaled to a sum of 1: only ratios count
        fwd[0] = np.exp(field.first) * e[0]
        for i in range(size):
            step = fwd[0] if not i else (fwd[i - 1] @ move) * e[i]
            fwd[i] = np.where(alive[i], step / step.sum(1, keepdims=True), fwd[i - 1])
        for i in range(size - 2, -1, -1):
            step = (e[i + 1] * bwd[i + 1]) @ move.T
            bwd[i] = np.where(alive[i + 1], step / step.sum(1, keepdims=True), 1)
        p = fwd * bwd
        p = (p / p.sum(2, keepdims=True) * alive).transpose(1, 0, 2)
        gap = hot - p
        grads = [np.stack([np.bincount(x[..., k].ravel(), gap[..., c].ravel(), len(w)) for c in range(3)], 1) for k, w in enumerate(field.tables)]
        ahead = e[1:] * bwd[1:]
        total = ((fwd[:-1] @ move) * ahead).sum(2, keepdims=True)
        pairs = (fwd[:-1] * alive[1:] / total).reshape(-1, 3).T @ ahead.reshape(-1, 3) * move
        grads += [both - pairs, gap[:, 0].sum(0)]
        for w, g, s in zip((*field.tables, field.moves, field.first), grads, squares):
            g = g - decay * np.where(w > NEVER / 2, w, 0)
            s += g * g
            w += rate * g / np.sqrt(s)
        field.moves[0, 2] = field.first[2] = NEVER
    return field


def viterbi(scores: np.ndarray, first: np.ndarray, field: Field) -> np.ndarray:
    """Best tags of the chain; at tokens of ``first`` it starts anew."""
    n = len(scores)
    if not n:
        return np.empty(0, np.int64)
    pieces = -(-n // STEP)
    pad = pieces * STEP - n
    e = np.concatenate([scores, np.tile([0.0, NEVER, NEVER], (pad, 1))]).reshape(pieces, STEP, 3)
    new = np.concatenate([first, np.zeros(pad, bool)]).reshape(pieces, STEP)
    steps = np.where(new[:, :, None, None], field.first[None, None, None, :], field.moves) + e[:, :, None, :]
    best = steps[:, 0]
    for i in range(1, STEP):
        best = (best[:, :, :, None] + steps[:, i, None]).max(2)
    ahead = np.zeros((pieces + 1, 3))
    for k in range(pieces):
        ahead[k + 1] = (ahead[k][:, None] + best[k]).max(0)
    cut = np.empty(pieces + 1, np.int64)
    cut[-1] = ahead[-1].argmax()
    for k in range(pieces - 1, -1, -1):
        cut[k] = (ahead[k] + best[k][:, cut[k + 1]]).argmax()
    score = np.full((pieces, 3), 2 * NEVER * n)
    score[np.arange(pieces), cut[:-1]] = 0
    back = np.empty((STEP, pieces, 3), np.int8)
    for i in range(STEP):
        way = score[:, :, None] + steps[:, i]
        back[i] = way.argmax(1)
        score = way.max(1)
    tags = np.empty((pieces, STEP), np.int64)
    now = cut[1:]
    for i in range(STEP - 1, -1, -1):
        tags[:, i] = now
        now = back[i][np.arange(pieces), now]
    return tags.reshape(-1)[:n]


def spans_of(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans ``(kind, start, end)`` in code points of each text, by start and then kind.

    Spans of the field that touch a base span are left out: the base span stands for them.
    """
    out: list[list[tuple[str, int, int]]] = [[s[:3] for s in base_spans(t)] for t in texts]
    t = tokens_of(texts)
    begins = np.cumsum([0] + [len(x) + 1 for x in texts])
    for a, b in t.hex_runs.tolist():
        k = int(np.searchsorted(begins, a, "right")) - 1
        out[k].append(("hex", a - int(begins[k]), b - int(begins[k])))
    tags = viterbi(field.scores(features(t)), t.first, field)
    heads = np.flatnonzero(tags == 1)
    if len(heads):
        stops = np.flatnonzero(np.append(tags, 0) != 2)
        tails = stops[np.searchsorted(stops, heads + 1)] - 1
        for i, j in zip(heads.tolist(), tails.tolist()):
            k = int(t.text[i])
            a, b = int(t.start[i] - begins[k]), int(t.end[j] - begins[k])
            if not any(a < q and p < b for _, p, q in out[k]):
                out[k].append(("crf", a, b))
    return [sorted(s, key=lambda x: (x[1], KINDS.index(x[0]))) for s in out]


def training_windows(texts: list[str]) -> list[tuple[bytes, bytes]]:
    """Windows around secrets of the base patterns; of each text without any, one from the middle and one about the token with most changes of kind.  int32 features and int8 tags."""
    t = tokens_of(texts)
    x = features(t)
    begins = np.cumsum([0] + [len(s) + 1 for s in texts])
    y = np.zeros(len(x), np.int64)
    spans = [(a + int(begins[k]), b + int(begins[k])) for k, s in enumerate(texts) for *_, a, b in base_spans(s)] + [tuple(r) for r in t.hex_runs.tolist()]
    centres, marked = [], np.zeros(len(texts), bool)
    for a, b in sorted(spans, key=lambda s: s[0] - s[1]):
        i, j = int(np.searchsorted(t.end, a, "right")), int(np.searchsorted(t.start, b))
        if i < j and not y[i:j].any():
            y[i:j] = 2
            y[i] = 1
            centres.append(i)
            marked[t.text[i]] = True
    limits = np.searchsorted(t.text, np.arange(len(texts) + 1))
    for k in np.flatnonzero(~marked):
        a, b = int(limits[k]), int(limits[k + 1])
        if a < b:
            centres += [(a + b) // 2, a + int(((t.mix[a:b] % 5) * 8 + t.mix[a:b] // 5).argmax())]
    out = []
    for c in centres:
        a, b = max(int(limits[t.text[c]]), c - AROUND), min(int(limits[t.text[c] + 1]), c + AROUND + 1)
        out.append((x[a:b].astype(np.int32).tobytes(), y[a:b].astype(np.int8).tobytes()))
    return out


LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def drawn_secret(rng: random.Random) -> str:
    """A token of one of the styles of keys, tokens and passwords."""
    some = lambda letters, a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    mixed = LOWER + UPPER + DIGIT
    return rng.choice([
        lambda: some(DIGIT + "ABCDEF", 24, 64),
        lambda: some(DIGIT + "abcdef", 16, 64),
        lambda: some(mixed, 16, 64),
        lambda: some(mixed + "+/", 24, 64),
        lambda: some(mixed + "-_", 20, 48),
        lambda: some(LOWER, 2, 5) + rng.choice("_-") + some(mixed, 16, 40),
        lambda: some(LOWER, 2, 5) + "-" + some(DIGIT, 8, 12) + "-" + some(mixed, 12, 24),
        lambda: some(UPPER, 4, 4) + some(UPPER + DIGIT, 12, 20),
        lambda: some(LOWER, 2, 4) + "_" + some(LOWER, 3, 5) + "_" + some(mixed, 16, 32),
        lambda: some(LOWER, 1, 5) + some(DIGIT, 1, 4) + some(UPPER, 1, 3) + some(mixed, 3, 8),
        lambda: some(mixed, 8, 15) + some(DIGIT, 1, 2),
    ])()


def drawn_other(rng: random.Random) -> str:
    """A token that has digits, marks or capitals and is no secret."""
    some = lambda letters, a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    word = lambda: some(LOWER, 2, 9)
    return rng.choice([
        lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda: f"v{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}",
        lambda: some(DIGIT, 3, 18),
        lambda: f"{some(DIGIT, 1, 5)}.{some(DIGIT, 1, 3)}",
        lambda: f"+{some(DIGIT, 2, 3)}-{some(DIGIT, 3, 4)}-{some(DIGIT, 5, 8)}",
        lambda: f"www.{word()}.{some(LOWER, 2, 3)}/{word()}/{word()}-{some(DIGIT, 1, 5)}",
        lambda: f"{word()}{some(DIGIT, 1, 2)}.{word()}.com",
        lambda: "/".join(["", *(word() for _ in range(rng.randint(2, 5)))]),
        lambda: "_".join(word() for _ in range(rng.randint(2, 4))),
        lambda: "-".join(word() for _ in range(rng.randint(2, 4))),
        lambda: word() + "".join(word().title() for _ in range(rng.randint(1, 3))),
        lambda: f"{word()}.{rng.choice(['py', 'md', 'txt', 'html', 'c'])}",
        lambda: word().title() + some(DIGIT, 1, 4),
        lambda: some(UPPER, 2, 5) + rng.choice(["-", ""]) + some(DIGIT, 1, 4),
        lambda: some(UPPER, 8, 30),
        lambda: some(LOWER, 12, 40) + rng.choice(["", "."]),
        lambda: some(LOWER, 6, 30).title() + rng.choice(["", "."]),
        lambda: f"{rng.randint(0, 23):02}.{rng.randint(0, 59):02}",
        lambda: some(DIGIT, 1, 3) + rng.choice(["th", "km", "px", "GB", "x"]),
    ])()


def with_copies(x: np.ndarray, y: np.ndarray, copies: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows, and ``copies`` of drawn ones in which a token's features are those of a drawn one: the secret's, where there is one, or one in the middle; a third is no secret."""
    rng = random.Random(seed)
    word = lambda w: int(tokens_of([w]).word[0])
    keys = [word(w) for w in KEY_WORDS]
    number, between = word("is"), [0, 1, 2, 5, 6, 4]  # nothing, =, :, either with a quote, a quote
    more_x, more_y = [x], [y]
    for _ in range(copies if len(x) else 0):
        k = rng.randrange(len(x))
        a, tags = x[k].copy(), y[k].copy()
        held = np.flatnonzero(tags > 0)
        real = np.flatnonzero(tags >= 0)
        at = int(held[0]) if len(held) else int(real[rng.randrange(len(real))])
        secret = rng.random() < 0.67
        one = tokens_of([drawn_secret(rng) if secret else drawn_other(rng)])
        a[at, 0], a[at, 1] = one.shape[0], one.mix[0]
        if at + 1 < len(a):
            a[at + 1, 3] = one.word[0]
        if at + 2 < len(a):
            a[at + 2, 4] = one.word[0]
        if at:
            a[at - 1, 5] = one.word[0]
        key = rng.choice(keys)
        if secret:
            a[at, 2] = rng.choice(between)
            way = rng.random()
            if way < 0.25:
                a[at, 3] = key
            elif way < 0.35:
                a[at, 3:5] = number, key
            elif len(held):  # the key word is hidden
                a[at, 3:5] = a[rng.randrange(len(a)), 3], 0
        elif len(held) or rng.random() < 0.3:
            a[at, 2] = rng.choice((0, 0, 1, 2))
            a[at, 3] = a[rng.randrange(len(a)), 3]
        tags[held] = 0
        tags[at] = int(secret)
        more_x.append(a[None])
        more_y.append(tags[None])
    return np.concatenate(more_x), np.concatenate(more_y)


def fit(docs: DataFrame, *, text_col: str = "text", max_docs: int = 8000, max_windows: int = 1500) -> Field:
    """Fit the field on a bounded sample: windows of about ``max_docs`` texts (chosen by a hash of the text), at most ``max_windows`` of them, and twice as many copies."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    n = rows.count()
    if not n:
        return blank_field()
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * min(1, max_docs / n)) + 1)

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in slabs(texts, 500_000):
                got = training_windows(texts[a:b])
                if got:
                    yield pd.DataFrame(got, columns=["x", "y"])

    windows = chosen.mapInPandas(run, "x binary, y binary").withColumn("h", F.xxhash64("x", "y"))
    secret = F.when(F.instr(F.hex("y"), "01") > 0, 0).otherwise(1)
    ranked = checkpointed(windows.distinct().withColumn("kind", secret))
    half = max(1, max_windows // 2)
    got = [r for kind in (0, 1) for r in ranked.where(F.col("kind") == kind).orderBy("h").limit(half).collect()]
    size = 2 * AROUND + 1
    x, y = np.zeros((len(got), size, len(SIZES)), np.int64), np.full((len(got), size), -1)
    for k, r in enumerate(got):
        tags = np.frombuffer(bytes(r["y"]), np.int8)
        y[k, : len(tags)] = tags
        x[k, : len(tags)] = np.frombuffer(bytes(r["x"]), np.int32).reshape(-1, len(SIZES))
    return fit_field(*with_copies(x, y, 2 * max_windows))


def span_column(spark, field: Field, text: Column) -> Column:
    """Spans of a text column as ``array<struct<kind, start, end>>``."""
    sent = spark.sparkContext.broadcast(field)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def find(col: pd.Series) -> pd.Series:
        texts, out = col.tolist(), []
        for a, b in slabs(texts, 500_000):
            out += [[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in spans_of(texts[a:b], sent.value)]
        return pd.Series(out, dtype=object)

    return find(F.coalesce(text, F.lit("")))


def scan(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``(id_col, secrets)``, one row per row of ``docs``: spans by start, then kind; ends exclusive, in code points.

    Defined cases: a null or empty text has no spans; repeated rows have equal spans; an empty table
    gives no rows; other columns are ignored.  No shuffle.
    """
    return docs.select(F.col(id_col), span_column(docs.sparkSession, field, F.col(text_col)).alias("secrets"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, field: Field, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one); ``n_chars``, if there is one, follows.

    Defined cases: a null text stays null and an empty one empty; repeated rows are treated alike; an
    empty table stays empty; all columns stay, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("string")
    def clean(col: pd.Series) -> pd.Series:
        texts, out = col.tolist(), []
        for a, b in slabs([t or "" for t in texts], 500_000):
            part = texts[a:b]
            for t, spans in zip(part, spans_of([t or "" for t in part], sent.value)):
                if t is None or not spans:
                    out.append(t)
                    continue
                pieces, at = [], 0
                for _, p, q in spans:
                    if p >= at:
                        pieces += [t[at:p], mark]
                    at = max(at, q)
                out.append("".join([*pieces, t[at:]]))
        return pd.Series(out, dtype=object)

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    return out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
