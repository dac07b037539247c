"""Media columns: AVI with motion JPEG.

Reading parses the RIFF index, decodes intra frames and finds shots.  Frames are baseline JPEG with
their own tables.  Entropy-coded data of all frames with equal headers (and of all restart intervals
in them) is decoded side by side: each numpy step takes the next symbol of every lane.  At scale 8
only the DC terms are kept, which gives the image at one eighth of its width and height exactly as
the mean of each block; at scale 1 blocks are dequantised and transformed back.

Storing bytes as samples: a byte is the level of a flat 8 x 8 block (DC step 8, so no rounding), a
frame holds 64 x 3 blocks, and reading at scale 8 gives the bytes back.

Shots: the difference of two frames is half the L1 distance of their histograms.  A cut is a
difference that exceeds the mean of its neighbourhood by ``sigmas`` deviations, and all close ones.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slabs

#: Fixed values of the JPEG format: zigzag order by diagonals, and the usual DC code (counts by length; symbols 0 to 11).
ZIGZAG = np.array([r * 8 + c for s in range(15) for r, c in [(s - i, i) if s % 2 == 0 else (i, s - i) for i in range(s + 1)] if r < 8 and c < 8])
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]

BLOCKS_WIDE, BLOCKS_HIGH = 64, 3
FRAME = BLOCKS_WIDE * BLOCKS_HIGH
RATE = 25
BINS, NEAR, SIGMAS, FLOOR = 32, 8, 3.0, 0.05
SLAB = 1_500_000


# --- writing ---------------------------------------------------------------------------------------


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def codes(counts: list[int]) -> list[tuple[int, int]]:
    """Canonical (code, length) of each symbol in order."""
    out, code = [], 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length))
            code += 1
        code <<= 1
    return out


HEADER = (
    b"\xff\xd8"
    + segment(0xDB, bytes([0]) + bytes([8] * 64))
    + segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * BLOCKS_HIGH, 8 * BLOCKS_WIDE, 1, 1, 0x11, 0))
    + segment(0xC4, bytes([0x00, *DC_COUNTS, *range(12)]))
    + segment(0xC4, bytes([0x10, 1, *[0] * 15, 0]))  # AC: the end of a block is the only symbol, one bit
    + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits of a DC difference from -383 to 383 with the end of its block, and how many they are."""
    table = codes(DC_COUNTS)
    value, size = [], []
    for d in range(-383, 384):
        s = abs(d).bit_length()
        code, length = table[s]
        value.append((code << s | (d if d > 0 else d + (1 << s) - 1)) << 1)
        size.append(length + s + 1)
    return np.array(value, np.int64), np.array(size, np.int64)


CODE, CODE_SIZE = _difference_codes()


def entropy_coded(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coded bytes of all frames of ``samples`` (frames, FRAME), and where each frame's end."""
    level = samples.astype(np.int64) - 128
    d = np.diff(level, axis=1, prepend=0) + 383
    value, size = CODE[d], CODE_SIZE[d]
    stop = np.cumsum(size, 1)
    length = (stop[:, -1] + 7) // 8
    begin = np.cumsum(length) - length
    at = (begin[:, None] * 8 + stop - size).ravel()
    word = value.ravel() << (24 - (at & 7) - size.ravel())
    byte = at >> 3
    total = int(length.sum())
    out = sum(np.bincount(byte + k, (word >> (16 - 8 * k)) & 255, total + 3) for k in range(3))[:total].astype(np.uint8)
    out[begin + length - 1] |= ((1 << (length * 8 - stop[:, -1])) - 1).astype(np.uint8)
    full = out == 255
    shift = np.cumsum(full) - full
    stuffed = np.zeros(total + int(full.sum()), np.uint8)
    stuffed[np.arange(total) + shift] = out
    return stuffed, begin + length + np.concatenate([[0], np.cumsum(full)])[begin + length]


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], width: int, height: int, rate: int = RATE) -> bytes:
    """An AVI file of JPEG frames with an index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    body, index, at = [b"movi"], [], 4
    for f in frames:
        c = chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(c)
        at += len(c)
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl) + chunk(b"LIST", b"".join(body)) + chunk(b"idx1", b"".join(index)))


def store(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload (a positive multiple of FRAME bytes)."""
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
    coded, ends = entropy_coded(samples)
    coded, ends = coded.tobytes(), [0, *ends.tolist()]
    out, at = [], 0
    for p in payloads:
        n = len(p) // FRAME
        frames = [HEADER + coded[ends[k] : ends[k + 1]] + b"\xff\xd9" for k in range(at, at + n)]
        out.append(avi(frames, 8 * BLOCKS_WIDE, 8 * BLOCKS_HIGH))
        at += n
    return out


# --- reading ---------------------------------------------------------------------------------------


@dataclass
class Video:
    rate: float
    frames: list[memoryview]


def parse_avi(data: bytes) -> Video:
    """Frames of the first video stream, by the index where there is one, else by walking the chunks."""
    view = memoryview(data)
    if view[:4] != b"RIFF" or view[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movi, index = float(RATE), None, None
    stack = [(12, len(view))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
            if name == b"LIST":
                kind = bytes(view[at + 8 : at + 12])
                if kind == b"movi":
                    movi = (at + 8, min(at + 8 + size, len(view)))
                elif kind in (b"hdrl", b"strl"):
                    stack.append((at + 12, at + 8 + size))
            elif name == b"strh" and view[at + 8 : at + 12] == b"vids":
                scale, per = struct.unpack_from("<II", view, at + 28)
                rate = per / scale if scale else rate
            elif name == b"idx1":
                index = view[at + 8 : at + 8 + size]
            at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no movi list")
    frames = []
    if index is not None:
        entries = np.frombuffer(index[: len(index) // 16 * 16], np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
        entries = entries[(entries["name"] == b"00dc") | (entries["name"] == b"00db")]
        # offsets count from the word movi or from the start of the file
        base = movi[0] if len(entries) and view[movi[0] + int(entries["at"][0]) :][:2] == b"00" else 0
        frames = [view[base + a + 8 : base + a + 8 + s] for a, s in zip(entries["at"].tolist(), entries["size"].tolist())]
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
            if name in (b"00dc", b"00db"):
                frames.append(view[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
    return Video(rate, [f for f in frames if len(f)])


@dataclass
class Layout:
    """What a frame's headers say."""

    size: int  # bytes of headers
    width: int
    height: int
    parts: list[tuple[int, int, int, int, int]]  # of each component: across, down, quantiser, DC and AC table
    steps: dict[int, np.ndarray]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]
    interval: int

    @property
    def wide(self) -> int:
        return -(-self.width // (8 * max(p[0] for p in self.parts)))

    @property
    def high(self) -> int:
        return -(-self.height // (8 * max(p[1] for p in self.parts)))

    @property
    def unit(self) -> list[int]:
        """Component of each block of a minimum coded unit."""
        return [k for k, p in enumerate(self.parts) for _ in range(p[0] * p[1])]


def look_up_table(counts: list[int], symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every 16-bit window."""
    symbol, size = np.zeros(1 << 16, np.int64), np.full(1 << 16, 16, np.int64)
    for (code, length), s in zip(codes(counts), symbols):
        low = code << (16 - length)
        symbol[low : low + (1 << (16 - length))] = s
        size[low : low + (1 << (16 - length))] = length
    return symbol, size


def parse_headers(frame: memoryview) -> Layout:
    steps: dict[int, np.ndarray] = {}
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    shape: tuple[int, int] = (0, 0)
    kinds: dict[int, tuple[int, int, int]] = {}
    interval, at = 0, 2
    while True:
        if frame[at] != 0xFF:
            raise ValueError("marker expected")
        marker = frame[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", frame, at + 2)[0]
        body = bytes(frame[at + 4 : at + 2 + size])
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                steps[body[0] & 15] = np.frombuffer(body[1 : n + 1], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[n + 1 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = look_up_table(list(body[1:17]), body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            shape = struct.unpack(">HH", body[1:5])
            kinds = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])}
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            parts = [(*kinds[c], t >> 4, 16 | t & 15) for c, t in scan]
            if len(parts) == 1:  # a single component is never interleaved
                parts = [(1, 1, *parts[0][2:])]
            return Layout(at, shape[1], shape[0], parts, steps, tables, interval)
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline frames are decoded")


def decode_lanes(data: np.ndarray, starts: np.ndarray, units: int, layout: Layout, scale: int) -> np.ndarray:
    """Coefficients of ``units`` coded units from each start (unstuffed bytes): (lanes, blocks) of DC terms at scale 8, else (lanes, blocks, 64)."""
    d = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.int64)
    word = d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]
    last = len(word) - 1
    at = starts.astype(np.int64) * 8
    lanes, kinds = len(starts), layout.unit

    def peek(pos: np.ndarray) -> np.ndarray:
        return (word[np.minimum(pos >> 3, last)] >> (16 - (pos & 7))) & 0xFFFF

    def signed(pos: np.ndarray, size: np.ndarray) -> np.ndarray:
        bits = peek(pos) >> (16 - size)
        return np.where(bits >> np.maximum(size - 1, 0), bits, bits - (1 << size) + 1) * (size > 0)

    levels = [np.zeros(lanes, np.int64) for _ in layout.parts]
    out = np.zeros((units * len(kinds), lanes) if scale == 8 else (units * len(kinds), lanes, 64), np.int32)
    for block in range(units * len(kinds)):
        k = kinds[block % len(kinds)]
        symbols, sizes = layout.tables[layout.parts[k][3]]
        window = peek(at)
        size = symbols[window]
        at = at + sizes[window]
        levels[k] = levels[k] + signed(at, size)
        at = at + size
        if scale == 8:
            out[block] = levels[k]
        else:
            out[block, :, 0] = levels[k]
        symbols, sizes = layout.tables[layout.parts[k][4]]
        live, place = np.arange(lanes), np.ones(lanes, np.int64)
        while len(live):
            window = peek(at[live])
            symbol = symbols[window]
            run, size = symbol >> 4, symbol & 15
            pos = at[live] + sizes[window]
            where = place[live] + run
            if scale != 8 and size.any():
                has = (size > 0) & (where < 64)
                out[block, live[has], ZIGZAG[where[has]]] = signed(pos[has], size[has])
            at[live] = pos + size
            place[live] = np.where((size == 0) & (run < 15), 64, where + 1)
            live = live[place[live] < 64]
    return out.swapaxes(0, 1)


def inverse_transform(coefficients: np.ndarray) -> np.ndarray:
    """Samples (..., 8, 8) of dequantised blocks (..., 64)."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return basis.T @ coefficients.reshape(*coefficients.shape[:-1], 8, 8) @ basis


def brightness(frames: list[memoryview], scale: int = 8) -> list[np.ndarray]:
    """First component (brightness) of each frame as 8-bit samples, at full size or one eighth."""
    by_header: dict[bytes, tuple[Layout, list[int]]] = {}
    last: tuple[bytes, tuple[Layout, list[int]]] | None = None
    for i, f in enumerate(frames):
        if last is None or f[: len(last[0])] != last[0]:
            layout = parse_headers(f)
            head = bytes(f[: layout.size])
            last = (head, by_header.setdefault(head, (layout, [])))
        last[1][1].append(i)
    out: list[np.ndarray] = [np.empty(0)] * len(frames)
    for layout, members in by_header.values():
        coded = [bytes(frames[i][layout.size :]) for i in members]
        data = np.frombuffer(b"".join(coded), np.uint8)
        begin = np.cumsum([0] + [len(c) for c in coded])[:-1]
        after = np.append(data[1:], 0)
        escape = data == 255
        restart = escape & (after >= 0xD0) & (after <= 0xD7)
        drop = np.zeros(len(data), bool)
        drop[1:] = escape[:-1] & (data[1:] == 0)
        drop |= restart
        drop[1:] |= restart[:-1]
        kept = np.cumsum(~drop) - ~drop
        units = layout.wide * layout.high
        each = layout.interval or units
        lanes_per = -(-units // each)
        starts = kept[begin]
        if layout.interval:
            marks = np.flatnonzero(restart)
            owner = np.searchsorted(begin, marks, "right") - 1
            starts = np.concatenate([starts, kept[np.minimum(marks + 2, len(data) - 1)]])
            order = np.lexsort((starts, np.concatenate([np.arange(len(begin)), owner])))
            starts = starts[order]
            if len(starts) != lanes_per * len(begin):
                raise ValueError("restart markers don't match the interval")
        got = decode_lanes(data[~drop], starts, each, layout, scale)
        kinds = layout.unit
        got = got.reshape(len(members), lanes_per * each, len(kinds), *got.shape[2:])[:, :units]
        across, down, quantiser = layout.parts[0][:3]
        steps = layout.steps[quantiser]
        got = got[:, :, : across * down].reshape(len(members), layout.high, layout.wide, down, across, *got.shape[3:])
        if scale == 8:
            plane = got.transpose(0, 1, 3, 2, 4).reshape(len(members), layout.high * down, layout.wide * across) * int(steps[0])
            plane = np.clip((plane + 4) // 8 + 128, 0, 255).astype(np.uint8)
            high, wide = -(-layout.height // 8), -(-layout.width // 8)
        else:
            natural = np.empty(64)
            natural[ZIGZAG] = steps
            plane = np.clip(np.rint(inverse_transform(got * natural) + 128), 0, 255).astype(np.uint8)
            plane = plane.transpose(0, 1, 3, 5, 2, 4, 6).reshape(len(members), layout.high * down * 8, layout.wide * across * 8)
            high, wide = layout.height, layout.width
        for i, p in zip(members, plane[:, :high, :wide]):
            out[i] = p
    return out


# --- shots -----------------------------------------------------------------------------------------


def shot_cuts(frames: list[np.ndarray], near: int = NEAR, sigmas: float = SIGMAS) -> tuple[np.ndarray, np.ndarray]:
    """First frames of the shots (0 among them), and the histogram difference of each frame to the one before."""
    n = len(frames)
    if not n:
        return np.empty(0, np.int64), np.empty(0)
    sizes = np.array([f.size for f in frames])
    flat = np.concatenate([f.ravel() for f in frames]) >> 3
    hist = np.bincount(np.repeat(np.arange(n), sizes) * BINS + flat, minlength=n * BINS).reshape(n, BINS) / np.maximum(sizes, 1)[:, None]
    d = np.zeros(n)
    d[1:] = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    i = np.arange(1, n)
    low, high = np.maximum(1, i - near), np.minimum(n, i + near + 1)
    total, square = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    count = np.maximum(1, high - low - 1)
    mean = (total[high] - total[low] - d[1:]) / count
    spread = np.sqrt(np.maximum(0, (square[high] - square[low] - d[1:] ** 2) / count - mean**2))
    side = np.concatenate([[0, 0], d, [0, 0]])
    peak = np.max([side[k : k + n] for k in (0, 1, 3, 4)], 0)[1:]
    cut = (d[1:] > mean + sigmas * spread + FLOOR) & (d[1:] >= peak)
    return np.concatenate([[0], np.flatnonzero(cut) + 1]), d


def clips(videos: DataFrame, *, id_col: str, media_col: str = "media", scale: int = 8) -> DataFrame:
    """Timed clip rows ``(id_col, clip, start_s, end_s, first_frame, n_frames, cut_difference, problem)`` of AVI files.

    Defined cases: a null file or one that can't be read has one row without times that names the
    problem; a file without frames has none; repeated rows have equal clips each.
    """
    kind = videos.schema[id_col].dataType.simpleString()
    columns = ["id", "clip", "start_s", "end_s", "first_frame", "n_frames", "cut_difference", "problem"]

    def run(batches):
        for pdf in batches:
            for key, data in zip(pdf["id"], pdf["media"]):
                try:
                    video = parse_avi(bytes(data)) if data is not None else None
                    frames = brightness(video.frames, scale) if video else []
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    yield pd.DataFrame([(key, None, None, None, None, None, None, str(e) or type(e).__name__)], columns=columns)
                    continue
                if video is None:
                    yield pd.DataFrame([(key, None, None, None, None, None, None, "no file")], columns=columns)
                    continue
                cuts, d = shot_cuts(frames)
                ends = np.append(cuts[1:], len(frames))
                if len(cuts):
                    yield pd.DataFrame([(key, k, a / video.rate, b / video.rate, a, b - a, float(d[a]), None) for k, (a, b) in enumerate(zip(cuts.tolist(), ends.tolist()))], columns=columns)

    shape = f"id {kind}, clip int, start_s double, end_s double, first_frame long, n_frames long, cut_difference double, problem string"
    return videos.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInPandas(run, shape).withColumnRenamed("id", id_col)


def payload(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes with spaces up to a positive multiple of FRAME, and how many bytes there were."""
    raw = text.encode()
    return raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME), len(raw)


def stored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as an AVI file: ``(id_col, n_bytes, media)``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in slabs(texts, SLAB):
                raw = [payload(t) for t in texts[a:b]]
                yield pd.DataFrame({"id": pdf["id"].iloc[a:b].reset_index(drop=True), "n_bytes": [n for _, n in raw], "media": store([p for p, _ in raw])})

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def stored_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``stored`` writes, read back: payload and file digests, and a feature string of the shots.

    Return ``(id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature)``, one row per row of ``docs``.  ``feature`` is the number of frames and the first frames
    of the clips.  Files stay inside their task; no shuffle.  Defined cases: a null or empty text is
    one frame of spaces; equal texts have equal values; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    columns = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in slabs(texts, SLAB):
                raw = [payload(t) for t in texts[a:b]]
                files = store([p for p, _ in raw])
                videos = [parse_avi(f) for f in files]
                frames = brightness([f for v in videos for f in v.frames])
                out, at = [], 0
                for (_, n), data, v in zip(raw, files, videos):
                    own = frames[at : at + len(v.frames)]
                    at += len(own)
                    back = np.concatenate([f.ravel() for f in own]).tobytes()
                    cuts, _ = shot_cuts(own)
                    out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"{len(own)}:{','.join(map(str, cuts.tolist()))}"))
                yield pd.DataFrame(out, columns=columns).assign(id=pdf["id"].iloc[a:b].reset_index(drop=True))[["id", *columns]]

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shape = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInPandas(run, shape).withColumnRenamed("id", id_col)
