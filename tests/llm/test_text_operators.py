import hashlib
import itertools
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from larkspur.llm import fingerprints, graph, langid, mixing, ngram_join, secret_scan, suffix_dedup, url_filter
from larkspur.llm.common import spread_join


def word_sets(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", (t or "").lower())
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else {(t or "").strip()} if (t or "").strip() else set()
        out.append((i, frozenset(grams)))
    return out


def brute_classes(rows, threshold=0.8):
    sets = word_sets(rows)
    parent, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p in range(len(sets)):
        for q in range(p):
            a, b = sets[p][1], sets[q][1]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[p] += 1
                links[q] += 1
                parent[find(p)] = find(q)
    least = {}
    for p in range(len(sets)):
        least[find(p)] = min(least.get(find(p), sets[p][0]), sets[p][0])
    return sorted((sets[p][0], least[find(p)], links[p]) for p in range(len(sets)))


def near_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 150))]
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    base = [word() for _ in range(200)]
    for _ in range(40):  # a large group: each an edit of the same text
        text = list(base)
        text[rng.randrange(200)] = word()
        rows.append(" ".join(text))
    rows += ["", None, "  ", "one two", "One, two!", "!!!", "!!!", "???", "five words are just enough", "five words are just enough"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates_against_all_pairs(spark, block):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("id", F.lit("x")).repartition(3)
    got = ngram_join.near_duplicates(df, block=block).collect()
    assert sorted(map(tuple, got)) == brute_classes(rows)
    kept = ngram_join.keep_one(df, block=block)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute_classes(rows)})


def test_near_duplicates_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(map(str, ngram_join.near_duplicates(rows).collect()))
    assert len(got) == 4 and sum("class_id=7, n_links=2" in g for g in got) == 3


def test_bands_reach_their_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.95), (0.9, 0.999)):
        bands, rows = ngram_join.choose_bands(threshold, recall)
        assert bands * rows <= 256 and 1 - (1 - threshold**rows) ** bands >= recall


def test_joins_of_hot_keys(spark):
    left = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 500).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = spread_join(left, right, ["k"], "n").collect()
    tops = {r.k: r.top for r in right.collect()}
    assert sorted(r.id for r in got) == list(range(9000)) and all(r.top == tops[r.k] for r in got)


def test_near_duplicates_of_a_hot_text(spark):
    hot = "one text that a third of all rows have in common, again and again"
    rows = [(i, hot if i % 2 else f"row {i} has words of its own, numbers {i * 7} and {i * 11} among them") for i in range(4400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()}
    assert all(got[i] == ((1, 2199) if i % 2 else (i, 0)) for i, _ in rows)
    assert sorted(r.doc_id for r in ngram_join.keep_one(df).collect()) == sorted({1, *range(0, 4400, 2)})


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == got[102] == 100 and 200 not in got


def test_components_of_stars_take_no_round(spark):
    """Stars are seen to be done: no joins, and few jobs for the driver to keep."""
    edges = spark.createDataFrame([(i, i % 5) for i in range(5, 60)], "u long, v long").repartition(3)
    spark.sparkContext.setJobGroup("stars", "stars")
    got = {r.node: r.comp for r in graph.components(edges).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("stars")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: i % 5 for i in range(60)} and len(jobs) <= 10


def plain_samples(text, samples):
    """The samples of a text drawn one by one, in double precision."""
    s64 = fingerprints.seeds(21, 2 * samples).tolist()
    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    out = []
    for k in range(samples):
        best = None
        for term, w in Counter(re.findall(r"\w+|[^\w\s]", text)).items():
            h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")
            one, two = mix(h ^ s64[k]), mix(h ^ s64[samples + k])
            u = lambda bits, low: ((bits >> low & 0xFFFFFF) + 1) / 2**24
            r, c, b = -math.log(u(one, 0) * u(one, 24)), -math.log(u(two, 0) * u(two, 24)), (one >> 48) / 2**16
            t = math.floor(math.log(w) / max(r, 1e-7) + b)
            a = math.log(max(c, 1e-7)) - r * (t - b) - r
            if best is None or a < best[0]:
                best = (a, term, t)
        out.append(best and best[1:])
    return out


def edited_of(rows):
    """(id, text, edited text, next text) in order of ids, nulls first, then of the texts' hashes."""
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        yield i, t, t[: len(t) - len(t) // 4] + n[: len(t) // 4], n


def test_fingerprints(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words[: 40 + 5 * i]) for _ in range(rng.randint(0, 300)))) for i in range(60)] + [(60, None), (61, ""), (62, "Ä" * 11), (63, rng.choice(words)), (70, "same text"), (71, "same text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("id", "part", "loan", "key")}).repartition(5)
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(df).collect()}
    errors, order = [], sorted((i, t or "") for i, t in rows)
    for size in (11, 1, 1000):
        got = {r.doc_id: r for r in fingerprints.edited_fingerprints(df, size=size).collect()}
        assert len(got) == len(rows) and got[70].fingerprint == got[71].fingerprint and got[70].near_next == 1
        for i, t, edited, n in edited_of(order):
            r = got[i]
            assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), plain[i])
            for other, near in ((edited, r.near_edited), (n, r.near_next)):
                a, b = Counter(fingerprints.TERMS.findall(t)), Counter(fingerprints.TERMS.findall(other))
                real = sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0
                errors.append(near - real)
    assert np.abs(errors).max() < 0.25 and np.std(errors) < 0.06 and abs(np.mean(errors)) < 0.01


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,2)", "double"])
def test_fingerprints_of_any_id(spark, kind):
    df = spark.range(200).select(F.when(F.col("id") % 40 != 7, F.lit("2001-01-01").cast("date") + F.col("id").cast("int") if kind == "date" else (F.col("id") * 7 % 211).cast(kind)).alias("key"), F.concat_ws(" ", F.lit("some words"), "id").alias("text"))
    want = [(r.key, r.text) for r in df.orderBy(F.asc_nulls_first("key"), F.xxhash64("text")).collect()]
    want = [(str(i), hashlib.sha256(e.encode()).hexdigest()) for i, _, e, _ in edited_of(want)]
    for size in (9, 500):
        got = fingerprints.edited_fingerprints(df.repartition(6), id_col="key", samples=16, size=size).collect()
        assert sorted((str(r.key), r.edited_sha256) for r in got) == sorted(want)


def test_fingerprints_odd_tables(spark):
    make = lambda rows: fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), size=1)
    assert make([]).count() == 0 and fingerprints.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert make([(1, "only one here")]).first()["near_next"] == 1
    assert make([(None, "x y"), (1, "x"), (1, "z"), (None, None)]).count() == 4
    assert make([(3, "a row"), (3, "a row"), (3, "a row"), (4, "b")]).count() == 4  # repeated rows
    big = [(2**62 + 1, "x"), (2**62 + 3, "y"), (None, "z")]
    assert {r.doc_id for r in make(big).collect()} == {i for i, _ in big}
    long = [(1, "ein langes Wort " * 60_000 + " ".join(map(str, range(70_000)))), (2, " ".join(map(str, range(70_000, 0, -1))))]
    got = {r.doc_id: r for r in make(long).collect()}
    assert got[1].n_chars == len(long[0][1]) and got[1].near_next > 0.2


def test_samples_against_a_plain_sampler():
    texts = ["a b c d e e e f", "one, two; one. Three", " ".join(f"w{i % 37}" for i in range(200)), "x"]
    tool, want = fingerprints.Sampler(64), [plain_samples(t, 64) for t in texts]
    got = [*tool.marks(texts)]
    names = {}
    for marks, samples in zip(got, want):
        same = [names.setdefault(s, m) == m for m, s in zip(marks.tolist(), samples)]
        assert sum(same) >= 63  # single precision may decide a tie otherwise
    assert len(set(names.values())) == len(names)


def test_table_does_not_change_fingerprints(monkeypatch):
    texts = [" ".join(f"w{i % 900}" for i in range(3000)), *[" ".join(f"w{i % k}" for i in range(60)) for k in range(1, 40)]]
    want = [*fingerprints.Sampler(32).marks(texts)]
    for store, slab in ((50, 100), (300, 200), (10, 100_000)):
        monkeypatch.setattr(fingerprints, "STORE", store)
        monkeypatch.setattr(fingerprints, "SLAB", slab)
        assert all((a == b).all() for a, b in zip(fingerprints.Sampler(32).marks(texts), want))


def plain_targets(sizes, weights, cap=3):
    total, left, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    budget = total
    while True:
        level = budget / sum(weights[i] for i in left) if left else 0
        over = {i for i in left if level * weights[i] > cap * sizes[i] + 1e-9}
        if not over:
            for i in left:
                target[i] = level * weights[i]
            return target
        for i in over:
            target[i] = cap * sizes[i]
            budget -= target[i]
        left -= over


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "c", "d", "é", None, "a", "a", "a"])) for i in range(800)]
    rows += [(900, None, "a"), (901, "x y z", "tiny"), (901, "x y z", "tiny"), (902, "  \x1c a\tb", "zero")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("h", F.lit(1))
    got = mixing.mix(df).collect()
    count = lambda t: len(re.findall("[^\\x20\\x09-\\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(order, plain_targets([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])))
    taken = {}
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))
    mixed = mixing.apply_mix(df)
    assert mixed.columns == df.columns
    by_source = {}
    for r in mixed.collect():
        by_source[r.source] = by_source.get(r.source, 0) + count(r.text)
    assert {s: n for s, n in taken.items() if n} == by_source
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.apply_mix(df.limit(0)).count() == 0


def test_language(spark):
    words = {"en": "the of and with from house water river green", "de": "der die und mit von haus wasser fluss grün", "fr": "le la et avec de maison eau rivière vert"}
    rng = random.Random(8)
    rows = [(i, lang, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randint(3, 30)))) for i in range(300) for lang in [rng.choice(list(words))]]
    rows += [(900, None, None), (901, "en", ""), (902, "en", "123 ... 45²"), (903, "fr", "x"), (904, "de", "Wasserhaus " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("score", F.lit("clash"))
    model = langid.fit(df.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert all(got[i].lang_pred == lang for i, lang, _ in rows[:300]) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[904].lang_pred == "de"
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and not {900, 901, 902} & {r.doc_id for r in kept.collect()} and kept.count() >= 301
    blank = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, blank).collect()} == {"und"}


def plain_language(learn, texts):
    """Word-first backoff with dicts of strings, word by word."""
    letters = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    grams = lambda w, n: [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    langs = sorted({lang for lang, _ in learn})
    counts = [{lang: Counter() for lang in langs} for _ in range(6)]
    for lang, t in learn:
        for w in letters(t):
            counts[0][lang][w] += 1
            for n in range(1, 6):
                counts[n][lang].update(grams(w, n))
    known = [set().union(*c.values()) for c in counts]

    def log(n, lang, piece):
        return math.log((counts[n][lang][piece] + 0.5) / (sum(counts[n][lang].values()) + 0.5 * max(1, len(known[n]))))

    def word(lang, w):
        if w in known[0]:
            return log(0, lang, w)
        for n in range(5, 0, -1):
            if some := [g for g in grams(w, n) if g in known[n]]:
                return sum(log(n, lang, g) for g in some) / len(some)
        return 0.0

    for t in texts:
        words = letters(t)
        if not words:
            yield "und", 0.0
            continue
        scores = [sum(word(lang, w) for w in words) for lang in langs]
        best = max(scores)
        yield langs[scores.index(best)], 1 / sum(math.exp(s - best) for s in scores)


def test_language_against_a_plain_version(spark):
    rng = random.Random(12)
    letters = {"aa": "abcdeéf", "bb": "cdefßgh", "cc": "efghijя", "dd": "中文字母文"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 7)))
    learn = [(lang, " ".join(word(lang) for _ in range(rng.randint(0, 30)))) for _ in range(60) for lang in [rng.choice(list(letters))]]
    learn += [("aa", ""), ("bb", "x² ½ ⅷ y_z 12a3"), ("cc", "İstanbul DŽ")]
    texts = [" ".join(word(rng.choice(list(letters))) for _ in range(rng.choice([1, 2, 40]))) for _ in range(60)] + ["", None, "² 3", "zzz qqq", "a" * 900, "x²y", "İ", "Ünseen wörds ½a", "wort " * 100_000]
    model = langid.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(learn)], "doc_id long, lang string, text string"))
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, (lang, score) in zip(got, plain_language(learn, texts)):
        assert (r.lang_pred == lang or score < 0.51) and abs(r.score - score) < 1e-3


def test_language_unlike_the_learned(spark):
    words = {"en": "the of and with from house water river green", "de": "der die und mit von haus wasser fluss grün"}
    rng = random.Random(11)
    rows = [(i, lang, " ".join(rng.choice(words[lang].split()) for _ in range(rng.choice([2, 20, 200])))) for i in range(300) for lang in [rng.choice(list(words))]]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    letters = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n))
    other = [(1000 + n, None, letters(n)) for n in (5, 20, 100, 1000)]
    other += [(2000, None, "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan"), (2001, None, "все люди рождаются свободными")]
    # words of the language that were not learned stay
    new = [(3000, None, "greenhouse riverhouse"), (3001, None, "Hauswasser und Grünfluss"), (3002, None, "water 4f0e7bc9d2a86b1c3d5e7f9a0b2c4d6e8f1a3b5c7d9e0f2a river")]
    kept = langid.keep_known(spark.createDataFrame(rows + other + new, "doc_id long, lang string, text string"), model)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows + new}


def brute_repeats(rows, length=100):
    """Every string looked up by itself; of rows of one id none is earlier than another."""
    least, out = {}, []
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1 if i is not None else 0):
            s = raw[p : p + length]
            least[s] = min(least.get(s, (i, p)), (i, p))
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1 if i is not None else 0):
            if least[raw[p : p + length]] != (i, p):
                gone[p : p + length] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((i, len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeats(df):
    return sorted(map(tuple, suffix_dedup.remove_repeats(df).collect()), key=str)


def passages(seed, n=60):
    rng = random.Random(seed)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    base = pick("abcdefgh ", 2500)
    return [(i, pick("xyzw ", rng.randint(0, 150)) + base[(a := rng.randint(0, 300)) : a + rng.randint(60, 1500)] + pick("xyz ", 60)) for i in range(n)]


@pytest.mark.parametrize("split, piece", [(4096, 1 << 19), (16, 1 << 19), (4096, 700)])
def test_repeats_against_all_strings(spark, monkeypatch, split, piece):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rows = passages(9)
    rows += [(500, "q" * 700), (501, "q" * 99), (502, ""), (503, "é" * 200), (504, "ab" * 300), (505, None), (506, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "start", "twin", "key", "hot")}).repartition(5)
    assert repeats(df) == brute_repeats(rows)


@pytest.mark.parametrize("split", [4096, 8])
def test_repeats_with_hot_anchors(spark, monkeypatch, split):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    found = []
    plain = suffix_dedup.hot_anchors
    monkeypatch.setattr(suffix_dedup, "hot_anchors", lambda rows, length, parts: found.append(plain(rows, length, parts, 1.0)) or found[-1])
    rng = random.Random(3)
    middle = "".join(rng.choice("abcdefgh ") for _ in range(160))
    rows = [(i, "".join(rng.choice("stuv") for _ in range(130)) + middle + "".join(rng.choice("wxyz") for _ in range(130))) for i in range(150)]
    assert repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)) == brute_repeats(rows)
    assert found[0]


def test_repeats_with_repeated_ids(spark):
    rng = random.Random(2)
    pick = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    once, two, short = pick(300), pick(400), pick(78)
    assert repeats(spark.createDataFrame([(1, once), (1, once)], "doc_id long, text string").repartition(2))[0][2] == 0
    rows = [(1, once), (1, once), (1, short), (2, two), (2, short + two), (2, pick(20) + two), (3, two + once), (3, two + once), (None, once)]
    rows += [(7 + i % 3, t) for i, t in passages(4, 24)]
    assert repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute_repeats(rows)
    named = [(None if i is None else f"d{i}", t) for i, t in rows]
    assert repeats(spark.createDataFrame(named, "doc_id string, text string").repartition(4)) == brute_repeats(named)


def test_repeats_in_a_very_long_text(spark):
    rng = random.Random(8)
    part = "".join(rng.choice("abcdefghijk ") for _ in range(5000))
    at = suffix_dedup.PIECE
    long = "".join(rng.choice("lmnopqrs ") for _ in range(at + 150_000))
    long = long[: at - 2500] + part + long[at + 2500 :]
    rows = [(1, long), (2, part[:3000]), (3, long[at - 200 : at + 90] + "tail"), (4, long[:300] + long[-300:])]
    assert repeats(spark.createDataFrame(rows, "doc_id long, text string")) == brute_repeats(rows)


def test_repeats_odd_tables(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(None, "a" * 300), (None, None)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0]


@pytest.mark.parametrize("text", [b"banana" * 40, b"\0" * 200, b"abc" * 100 + b"\0\0" + b"abc" * 60, b"x"])
def test_suffix_array_and_prefixes(text):
    order, word = suffix_dedup.suffix_array(np.frombuffer(text, np.uint8))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])

    def common(a, b):
        k = 0
        while k < 100 and a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        return k

    got = suffix_dedup.common_prefixes(order, word, 100, lane=29)
    assert got.tolist() == [0] + [common(a, b) for a, b in zip(order[:-1], order[1:])]


RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/1?x"), (2, "https://x.net/de"), (3, "http://x.net?q=/"), (4, "http://my.org/fr/a#b"), (5, None), (6, "no scheme"), (7, "://"), (8, "http://planet/x"), (9, "http://example.com/de/7"), (10, "ftp://example.com/DE/7"), (1, "http://é.ORG/fr/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("template", F.lit(1))
    got = sorted([tuple(r)[:5] for r in url_filter.judge(df, RULES).collect()], key=str)
    want = {(1, "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "x.net", "/de", "net/", "block"), (4, "my.org", "/fr/a", "org/fr/", "allow"), (9, "example.com", "/de/7", "example.com/de/", "block"), (1, "é.org", "/fr/", "org/fr/", "allow")}
    assert len(got) == len(rows) and want <= set(got)
    rest = {r[0]: r for r in got if r[3] is None}
    assert rest[5][1:3] == rest[6][1:3] == rest[7][1:3] == ("", "") and rest[3][1:3] == ("x.net", "") and set(r[4] for r in rest.values()) <= {"allow", "block"}
    assert url_filter.judge(df.limit(0), RULES).count() == 0


def test_url_templates_learn_branches(spark):
    rows = [(i, f"http://h.example/{'bad' if i % 2 else 'good'}/{i}") for i in range(200)] + [(900, "http://h.example/bad/zzz9"), (901, "http://h.example/good/77")]
    rules = [("block", f"h.example/bad/{i}") for i in range(1, 60, 2)] + [("allow", f"h.example/good/{i}") for i in range(0, 60, 2)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[199].verdict == "block" and got[901].verdict == "allow" and got[199].template == "/bad/<number>"


def test_url_labels_stay_in_their_branch(spark):
    """Of a host whose only labels are one blocked branch, the other branches fall back to the share of all urls."""
    names = ["de", "en", "es", "fr"]
    rows = [(i, f"http://h.com/{names[i % 4]}/{i}") for i in range(400)]
    rows += [(1000 + i, f"http://ok.org/x/{i}") for i in range(150)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), [("block", "h.com/de/"), ("allow", "ok.org/")]).collect()}
    assert all(got[i].verdict == ("block" if i % 4 == 0 else "allow") for i in range(400))
    assert {got[i].template for i in range(4)} == {f"/{n}/<number>" for n in names}


def test_urls_of_any_depth(spark):
    deep = "/".join("abcdefghijk")
    rows = [(i, f"http://h.com/{deep}/{'bad' if i % 2 else 'good'}/{i}") for i in range(80)] + [(500, "http://h.com/" + "x/" * 14)]
    rules = [("block", f"h.com/{deep}/bad/{i}") for i in range(1, 40, 2)] + [("allow", f"h.com/{deep}/good/{i}") for i in range(0, 40, 2)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert [got[i].verdict for i in (78, 79)] == ["allow", "block"] and got[79].template == f"/{deep}/bad/<number>" and len(got) == 81


def test_url_branches_alike_merge(spark):
    rows = [(i, f"http://h.com/{'one' if i % 2 else 'two'}/{i}") for i in range(100)]
    rules = [("block", f"h.com/{'one' if i % 2 else 'two'}/{i}") for i in range(60, 100)]
    got = {r.template for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got == {"/*/<number>"}


def brute_base(text):
    ci = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join([ci("password"), ci("passwd"), ci("secret"), ci("token"), ci("api") + "_?" + ci("key")])
    patterns = [("assign", rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, g, least) in enumerate(patterns) for m in re.finditer(p, text) if len(m.group(g)) >= least]
    return [s for *_, s in sorted(found)]


def test_secrets(spark):
    rng = random.Random(10)
    token = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(250):
        words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            words.insert(len(words) // 2, rng.choice(['token = "%s"', "API_KEY:%s", "passwd='%s'", "secret=token:%s", "%s"]) % token(rng.choice([5, 6, 23, 24, 40])))
        if i % 7 == 0:
            words.append("AKIA" + "ABCDEFGHIJKLMNOPQRST"[: rng.randint(10, 20)])
        rows.append((i, " ".join(words)))
    rows += [(900, None), (901, ""), (902, "ſecret=abcdefgh Kelvin toKen=abcdefgh"), (903, "é" * 50 + ' token = "' + token(40) + '"'), (904, "x " * 30000 + token(30))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("secrets", F.lit("clash")).withColumn("n_chars", F.char_length("text").cast("long"))
    field = secret_scan.fit(df)
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.secrets] for r in secret_scan.scan(df, field).collect()}
    for i, t in rows:
        assert [s for s in got[i] if not s.startswith("crf")] == brute_base(t or "")
    twice = secret_scan.scan(df.where("doc_id < 12").union(df.where("doc_id < 12")).repartition(3), field).collect()
    assert len(twice) == 24 and all([f"{s.kind}:{s.start}:{s.end}" for s in r.secrets] == got[r.doc_id] for r in twice)
    clean = {r.doc_id: r for r in secret_scan.redact(df, field).collect()}
    assert clean[900].text is None and "[SECRET]" in clean[903].text and clean[903].n_chars == len(clean[903].text) and len(clean) == len(rows)
    assert not any(brute_base(r.text or "") for r in clean.values())
    assert secret_scan.scan(df.limit(0), secret_scan.fit(df.limit(0))).count() == 0


def plain_likelihood(field, x, y):
    """Log likelihood of one window's tags, over all paths."""
    e, n = field.scores(x), len(y)
    score = lambda tags: field.first[tags[0]] + sum(e[i, t] for i, t in enumerate(tags)) + sum(field.moves[a, b] for a, b in zip(tags, tags[1:]))
    every = [score(tags) for tags in itertools.product(range(3), repeat=n)]
    return score(y) - np.log(np.exp(np.array(every) - max(every)).sum()) - max(every)


def test_field_follows_the_exact_gradient():
    rng = np.random.default_rng(6)
    x = np.stack([rng.integers(0, k, (3, 4)) for k in (5, 3, 4, 6, 6, 6, 2)], 2)
    y = np.array([[0, 1, 2, 0], [1, 2, -1, -1], [0, 0, 1, 1]])
    field = secret_scan.fit_field(x, y, rounds=1, rate=1e-6, decay=0.0)  # one step of rate * g / |g|: its sign is the gradient's
    start = secret_scan.blank_field()
    total = lambda: sum(plain_likelihood(start, a[b >= 0], b[b >= 0].tolist()) for a, b in zip(x, y))
    before = total()
    for k, (row, tag) in ((0, (int(x[0, 1, 0]), 1)), (2, (int(x[2, 3, 2]), 0)), (3, (int(x[1, 0, 3]), 2))):
        start.tables[k][row, tag] += 1e-5
        slope = (total() - before) / 1e-5
        start.tables[k][row, tag] -= 1e-5
        step = field.tables[k][row, tag]
        assert abs(slope) < 1e-4 or np.sign(step) == np.sign(slope)
    for move in ((0, 1), (1, 2), (2, 0)):
        start.moves[move] += 1e-5
        slope = (total() - before) / 1e-5
        start.moves[move] -= 1e-5
        assert abs(slope) < 1e-4 or np.sign(field.moves[move]) == np.sign(slope)


def test_field_finds_what_the_patterns_miss(spark):
    """Secrets of ten styles put into given documents at any place, none of which a base pattern matches; right spans count, and spans elsewhere."""
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no tables")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = secret_scan.fit(docs)
    texts = [r.text for r in docs.where("text IS NOT NULL").orderBy("doc_id").limit(300).collect()]
    rng = random.Random(99)
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda n, letters=mixed: "".join(rng.choice(letters) for _ in range(n))
    styles = [
        lambda: ("credential = ", some(20)), lambda: ("the key ", some(32, "0123456789ABCDEF")), lambda: ("Authorization: Bearer ", some(36)), lambda: ("use ", "ghp_" + some(36)),
        lambda: ("aws_key=", "ASIA" + some(16, mixed[:26])), lambda: ('private_key = "', some(44)), lambda: ("auth=", some(24)), lambda: ("pwd: ", some(10) + "7"),
        lambda: ("password is ", some(12) + "9"), lambda: ("", "xoxb-" + some(11, "0123456789") + "-" + some(24)),
    ]
    rows, planted = [], {}
    for k, text in enumerate(texts):
        words = text[:2000].split(" ")
        at = rng.randrange(len(words) + 1)
        lead, secret = styles[k % 10]()
        head = " ".join([*words[:at], lead])
        planted[k] = (len(head), len(head) + len(secret))
        rows.append((k, head + secret + " " + " ".join(words[at:])))
    rows += [(1000 + k, t) for k, t in enumerate(texts)]
    found = {r.doc_id: [(s.start, s.end) for s in r.secrets if s.kind == "crf"] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    hits = sum(any(a <= p and q <= b for a, b in found[k]) for k, (p, q) in planted.items())
    wrong = sum(not (k in planted and a < planted[k][1] and planted[k][0] < b) for k, spans in found.items() for a, b in spans)
    assert hits >= 0.9 * len(planted) and hits >= 0.9 * (hits + wrong)


def test_field_learns_and_decodes_exactly():
    rng = np.random.default_rng(11)
    x = np.zeros((60, 12, 7), int)
    x[..., 0] = rng.integers(0, 50, (60, 12))
    y = np.where(x[..., 0] > 44, 1, 0)
    field = secret_scan.fit_field(x, y)
    tags = secret_scan.viterbi(field.scores(x.reshape(-1, 7)), np.arange(720) % 12 == 0, field)
    assert (tags == y.ravel()).mean() > 0.97
    e, first = rng.normal(size=(500, 3)), rng.random(500) < 0.1
    first[0] = True
    field.moves[:] = rng.normal(size=(3, 3))
    score, back = np.zeros(3), []
    for i in range(500):
        way = score[:, None] + (np.tile(field.first, (3, 1)) if first[i] else field.moves) + e[i]
        back.append(way.argmax(0))
        score = way.max(0)
    path = [int(score.argmax())]
    for b in back[:0:-1]:
        path.append(int(b[path[-1]]))
    assert secret_scan.viterbi(e, first, field).tolist() == path[::-1]
