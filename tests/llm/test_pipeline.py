import random
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_base, brute_classes, near_rows, plain_language, plain_targets
from tokenizers import Tokenizer

STAGES = dict(corpus_pipeline.STAGES)
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, id string, key long, twin string, class string, size int"


def documents():
    """Texts in near copies, of several sources, with nulls, repeated ids and rows, secrets and other columns."""
    out = []
    for i, t in near_rows():
        if t and i % 9 == 0:
            t += ' token = "0123456789abcdef0123456789abcdef"'
        out.append((i if i % 13 else 7, t, ["en", None][i % 2], [None, "b", "a"][i % 3], len(t or ""), "x", i, "y", "z", 3))
    long = "a very long text of many words " * 8000
    return out + [out[5], out[5], (500, long, "en", "a", len(long), "", 0, "", "", 0), (None, "nameless words that go on and on", "en", "a", 5, "", 0, "", "", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SHAPE).repartition(4)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_odd_tables(spark, docs, name):
    """Empty tables and tables of nulls pass through; all stages but the last return the columns they got."""
    for rows in ([], [(None,) * 10] * 3):
        got = STAGES[name](spark, spark.createDataFrame(rows, SHAPE), "")
        assert got.count() == (0 if name in ("language_id", "source_mixing") else len(rows))
        assert name == "bpe_codec" or (got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema])


def test_language_stage_keeps_learned_languages(spark, docs):
    """Texts in a learned language stay, labelled or not; those without letters or in letters at random go."""
    words = {"en": "the of and with from house water river green", "de": "der die und mit von haus wasser fluss grün"}
    rng = random.Random(4)
    said = [(lang, " ".join(rng.choice(words[lang].split()) for _ in range(rng.choice([3, 30])))) for _ in range(200) for lang in [rng.choice(list(words))]]
    noise = [" ".join("".join(rng.choice("qxzjkvwp") for _ in range(7)) for _ in range(n)) for n in (3, 30, 300)]
    rows = [(i % 150, t, lang if i % 3 else None, "a", 1, "", 0, "", "", 0) for i, (lang, t) in enumerate(said)]
    rows += [(1000 + i, t, None, "a", 1, "", 0, "", "", 0) for i, t in enumerate([*noise, None, "", "12 34 ...", "² ½"])]
    got = STAGES["language_id"](spark, spark.createDataFrame(rows, SHAPE).repartition(3), "")
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == Counter(rows[:200])
    plain = plain_language([(r[2], r[1]) for r in rows if r[2] and r[1]], [t for _, t in said])
    assert [lang for lang, _ in plain] == [lang for lang, _ in said]


def test_near_duplicate_stage_keeps_one_row_a_class(spark, docs):
    rows = documents()
    got = STAGES["ngram_join"](spark, docs, "").collect()
    number = [(k, r[1]) for k, r in enumerate(rows)]
    classes = {}
    for k, c, _ in brute_classes(number):
        classes.setdefault(c, set()).add(k)
    texts = Counter(r.text for r in got if (r.text or "").strip())
    for members in classes.values():
        if (rows[min(members)][1] or "").strip():
            assert sum(texts[t] for t in {rows[k][1] for k in members}) == 1
            kept = next(r for r in got if r.text in {rows[k][1] for k in members})
            ids = [rows[k][0] for k in members if rows[k][0] is not None]
            assert kept.doc_id == min(ids, default=None)
    assert sum(not (r.text or "").strip() for r in got) == sum(not (r[1] or "").strip() for r in rows)


def test_secret_stage_keeps_rows_and_removes_secrets(spark, docs):
    got = STAGES["secret_scan"](spark, docs, "").collect()
    assert len(got) == len(documents()) and not any(brute_base(r.text or "") for r in got)
    assert all(r.n_chars == len(r.text) for r in got if r.text) and sum("[SECRET]" in (r.text or "") for r in got) >= 8
    clean = Counter(r[1] for r in documents() if not brute_base(r[1] or ""))
    assert sum((clean - Counter(r.text for r in got)).values()) <= 0.02 * len(got)


def test_mixing_stage_meets_the_targets(spark, docs):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in documents():
        sizes[r[3]] += count(r[1])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, plain_targets([sizes[s] for s in names], [5, 2, 1])))
    got = Counter()
    for r in STAGES["source_mixing"](spark, docs, "").collect():
        got[r.source] += count(r.text)
    # rows of one id, source and size share what is taken of them, to whole words
    assert all(abs(got[s] - want[s]) <= 3 for s in names)


def test_encoding_stage_is_the_library(spark, docs):
    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tool.no_padding()
    tool.no_truncation()
    got = STAGES["bpe_codec"](spark, docs, "").collect()
    want = Counter((r[0], tuple(tool.encode(r[1] or "", add_special_tokens=False).ids)) for r in documents())
    assert Counter((r.doc_id, tuple(int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4))) for r in got) == want


def test_run_applies_all_stages(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    batch = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and got.count() > 10
    assert got.where(F.col("n_tokens") == 0).isEmpty() and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == batch
