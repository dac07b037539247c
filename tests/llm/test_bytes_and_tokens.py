import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import bpe_codec, media, token_counts

ODD = ["", " ", "a" * 700, "aaa bbb  \n\n c", "<|endoftext|> hi<|endoftext|>", "İstanbul ΣΑΣ Σ ΟΔΟΣ", "é ẞ ß ſ K", "it's they'll I'D 'S", "====" * 300, "日本語テキスト 한국어 ²³ Ⅷ", "a\x1cb\x1d c\x85d\xa0e", "<|startoftext|>X<|ENDOFTEXT|>", "🙂🙂 👩‍👩‍👧", "'''s 'sx", "\x00\x01\x02"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    more = ["".join(rng.choice("aAbB éÉ'sS\n\t 12-_=.Σ<|>日") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(ODD + more)] + [(900, None), (901, "same"), (901, "same")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("id", F.lit(1))


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_token_counts_agree_with_the_library(docs):
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i, len(t.encode()), len(tool.encode(t, add_special_tokens=False).ids)) for i, t in texts(docs))
    got = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=5).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 5) for r in got)


def test_codec_agrees_with_the_library(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    want = []
    for i, t in texts(docs):
        ids = tool.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe_codec.digests(docs, path).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    coder = bpe_codec.codec(path, bpe_codec.odd_points(path))
    full = {r.doc_id: r for r in bpe_codec.encode(docs, path).collect()}
    assert full[4]["decoded"] == coder.decode(np.frombuffer(full[4]["ids"], "<u4").tolist())


def test_empty_tables(docs):
    assert token_counts.token_counts(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert bpe_codec.digests(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert media.stored_features(docs.limit(0)).count() == 0


def test_long_words_have_the_same_parts():
    coder = bpe_codec.codec(public_tokenizers.path("word_bpe_49k.json"), bpe_codec.odd_points(public_tokenizers.path("word_bpe_49k.json")))
    rng = random.Random(2)
    for _ in range(20):
        word = bytes(rng.choice(b"abcdefgh=-") for _ in range(rng.randint(2, 250)))
        ids = [*map(coder.inner.__getitem__, word[:-1]), coder.last[word[-1]]]
        assert coder.parts(word) == coder.long_parts(ids)


def test_media_round_trip(docs):
    got = {}
    for r in media.stored_features(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    files = {}
    for r in media.stored(docs).collect():
        files[r.doc_id] = bytes(r.media)
    for i, t in texts(docs):
        raw = t.encode()
        padded = raw + b" " * (192 - len(raw) if len(raw) <= 192 else -len(raw) % 192)
        for r in got[i]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
            assert r.media_sha256 == hashlib.sha256(files[i]).hexdigest() and r.media_bytes == len(files[i])


def plain_frame(samples):
    """A frame of flat blocks, byte by byte and bit by bit: levels as differences, each ended by the one AC symbol."""
    lengths, code, table = media.DC_COUNTS, 0, {}
    size = iter(range(12))
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            table[next(size)] = f"{code:0{n}b}"
            code += 1
        code *= 2
    bits, last = "", 0
    for level in (v - 128 for v in samples):
        d = level - last
        last = level
        n = abs(d).bit_length()
        bits += table[n] + (f"{d if d > 0 else d + 2**n - 1:0{n}b}" if n else "") + "0"
    bits += "1" * (-len(bits) % 8)
    coded = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    part = lambda marker, body: b"\xff" + bytes([marker]) + (len(body) + 2).to_bytes(2, "big") + body
    head = b"\xff\xd8" + part(0xDB, b"\0" + b"\x08" * 64) + part(0xC0, bytes([8, 0, 24, 2, 0, 1, 1, 0x11, 0]))
    head += part(0xC4, bytes([0, *lengths, *range(12)])) + part(0xC4, bytes([16, 1, *[0] * 16])) + part(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    return head + coded + b"\xff\xd9"


def plain_file(frames):
    word = lambda *v: b"".join(int(x).to_bytes(4, "little") for x in v)
    half = lambda *v: b"".join(int(x).to_bytes(2, "little") for x in v)
    box = lambda name, body: name + word(len(body)) + body + b"\0" * (len(body) % 2)
    most, n = max(map(len, frames)), len(frames)
    header = box(b"avih", word(40_000, most * 25, 0, 16, n, 0, 1, most, 512, 24, 0, 0, 0, 0))
    stream = box(b"strh", b"vidsMJPG" + word(0) + half(0, 0) + word(0, 1, 25, 0, n, most, 2**32 - 1, 0) + half(0, 0, 512, 24))
    stream += box(b"strf", word(40, 512, 24) + half(1, 24) + b"MJPG" + word(512 * 24 * 3, 0, 0, 0, 0))
    movie, index = b"movi", b""
    for f in frames:
        index += b"00dc" + word(16, len(movie), len(f))
        movie += box(b"00dc", f)
    return box(b"RIFF", b"AVI " + box(b"LIST", b"hdrl" + header + box(b"LIST", b"strl" + stream)) + box(b"LIST", movie) + box(b"idx1", index))


def plain_feature(frames):
    """Shots by loops: half the L1 distance of histograms against the mean and deviation of up to 8 neighbours on either side."""
    shares = [[sum(v // 8 == b for v in f) / len(f) for b in range(32)] for f in frames]
    d = [0.0, *[sum(abs(x - y) for x, y in zip(p, q)) / 2 for p, q in zip(shares, shares[1:])]]
    cuts = [0]
    for i in range(1, len(d)):
        near = [d[j] for j in range(max(1, i - 8), min(len(d), i + 9)) if j != i] or [0.0]
        mean = sum(near) / len(near)
        spread = max(0.0, sum(x * x for x in near) / len(near) - mean * mean) ** 0.5
        if d[i] > mean + 3 * spread + 0.05 and all(d[i] >= d[j] for j in range(max(0, i - 2), min(len(d), i + 3))):
            cuts.append(i)
    return f"{len(frames)}:{','.join(map(str, cuts))}"


def test_stored_files_against_a_plain_writer(docs, spark):
    rng = random.Random(8)
    scenes = ["".join(rng.choice(letters) for _ in range(192 * n)) for letters, n in (("abc ", 7), ("XYZ!", 5), ("0123", 1), ("éüß", 6), ("abc ", 4))]
    rows = [*texts(docs), (1000, "".join(scenes)), (1001, "x" * 192 * 3), (1002, "a" * 191 + "é")]
    got = {(r.doc_id, r.media_sha256): r for r in media.stored_features(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        raw = t.encode()
        raw += b" " * (192 - len(raw) if len(raw) <= 192 else -len(raw) % 192)
        pieces = [raw[k : k + 192] for k in range(0, len(raw), 192)]
        file = plain_file([plain_frame(p) for p in pieces])
        r = got[i, hashlib.sha256(file).hexdigest()]
        assert r.media_bytes == len(file) and r.feature == plain_feature(pieces)
    assert any("," in r.feature for r in got.values())


def jpeg(coefficients, interval=0):
    """A plain baseline encoder for tests: bits as text, one component, code of 8 bits for every symbol."""
    symbols = [0x00, 0xF0, *[r << 4 | s for r in range(3) for s in range(1, 9)]]
    code = {s: f"{i:08b}" for i, s in enumerate(symbols)}
    dc = {s: f"{i:04b}" for i, s in enumerate(range(12))}

    def number(v):
        n = abs(v).bit_length()
        return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""

    blocks, bits, out, last = coefficients.reshape(-1, 64), "", b"", 0

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for k, b in enumerate(blocks):
        if interval and k and k % interval == 0:
            out += flush(bits) + bytes([0xFF, 0xD0 + (k // interval - 1) % 8])
            bits, last = "", 0
        z = b[media.ZIGZAG].tolist()
        n, text = number(z[0] - last)
        last = z[0]
        bits += dc[n] + text
        run = 0
        for v in z[1:]:
            if v == 0:
                run += 1
                continue
            while run > 2:
                bits += code[0xF0] if run >= 16 else ""
                if run < 16:
                    raise AssertionError("test data has runs of 0 to 2, or 16 and more")
                run -= 16
            n, text = number(v)
            bits += code[run << 4 | n] + text
            run = 0
        bits += code[0] if run else ""
    out += flush(bits)
    h, w = coefficients.shape[:2]
    head = b"\xff\xd8" + media.segment(0xDB, bytes([0]) + bytes([2] * 64)) + media.segment(0xC0, bytes([8, 0, h * 8, 0, w * 8, 1, 1, 0x11, 0]))
    head += media.segment(0xC4, bytes([0, 0, 0, 0, 12, *[0] * 12, *range(12)])) + media.segment(0xC4, bytes([0x10, *[0] * 7, len(symbols), *[0] * 8, *symbols]))
    return head + (media.segment(0xDD, bytes([0, interval])) if interval else b"") + media.segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + out + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 2])
def test_frames_with_all_frequencies(interval):
    rng = np.random.default_rng(3)
    c = np.zeros((2, 3, 64), int)
    c[..., 0] = rng.integers(-60, 60, (2, 3))
    c[..., media.ZIGZAG[1:9]] = rng.integers(1, 20, (2, 3, 8)) * rng.choice([-1, 1], (2, 3, 8))
    frame = memoryview(jpeg(c, interval))
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    t = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    want = np.block([[t.T @ (b.reshape(8, 8) * 2.0) @ t for b in row] for row in c]) + 128
    assert np.abs(media.brightness([frame], 1)[0] - np.clip(want, 0, 255)).max() <= 0.5001
    small = media.brightness([frame, frame], 8)[1]
    assert np.abs(small - np.clip(c[..., 0] * 2 / 8 + 128, 0, 255)).max() <= 1


def test_clips_and_broken_files(spark):
    rng = np.random.default_rng(4)
    shots = [rng.integers(0, 60, (30, 192)), rng.integers(120, 160, (20, 192)), rng.integers(200, 250, (25, 192))]
    film = media.store([np.concatenate(shots).astype(np.uint8).tobytes()])[0]
    bare = film[: film.rindex(b"idx1")]
    rows = [(1, film), (2, b"RIFF"), (3, None), (4, bare)]
    got = {}
    for r in media.clips(spark.createDataFrame(rows, "k long, media binary"), id_col="k").collect():
        got.setdefault(r.k, []).append(r)
    assert [(r.start_s, r.end_s, r.first_frame, r.n_frames) for r in got[1]] == [(0.0, 1.2, 0, 30), (1.2, 2.0, 30, 20), (2.0, 3.0, 50, 25)]
    assert len(got[2]) == 1 and got[2][0].problem and got[3][0].problem == "no file" and len(got[4]) == 3


def test_every_code_point_is_encoded_as_the_library_does():
    path = public_tokenizers.path("word_bpe_49k.json")
    tool, coder = Tokenizer.from_file(path), bpe_codec.codec(path, bpe_codec.odd_points(path))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 2000):
        text = "".join(f"a{c}b {c}1!{c} " for c in points[a : a + 2000])
        assert coder.encode(text)[0] == bpe_codec.pack(tool.encode(text, add_special_tokens=False).ids), hex(ord(points[a]))
