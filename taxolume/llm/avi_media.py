"""Media columns: bytes as motion-JPEG in AVI, and the timed clips of such videos.

A payload's bytes are the samples of grey frames of 24 by 24; each frame is a JPEG of its own (lossless process, SOF3,
prediction from the left), so it is stored exactly and any frame decodes alone. The reader follows the RIFF lists and
the idx1 index, decodes the intra frames, and finds shots where a frame's histogram differs from the one before by more
than the differences around it explain. Baseline frames of other writers are decoded too. Coding and decoding run over all frames of a batch at once in numpy.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, utf8_slices

SIDE = 24
FRAME = SIDE * SIDE
#: Microseconds a frame.
PERIOD = 40_000
#: The difference categories (0 to 8) by code length in bits; no code is all ones.
CODES = {3: (5, 4, 3, 6, 2, 7), 4: (1, 0, 8)}
#: Histogram bins; frames on each side that a difference is held against; its least size, from 0 to 1.
BINS, AROUND, LEAST = 16, 4, 0.12
#: Bytes of text that are coded at a time.
SLICE = 2 << 20


@cache
def _code() -> tuple[dict[int, tuple[int, int]], bytes]:
    """The canonical code (value, length) of each category, and the DHT segment that defines it."""
    codes, value, counts, order = {}, 0, [0] * 16, []
    for n in range(1, 17):
        for s in CODES.get(n, ()):
            codes[s] = (value, n)
            value += 1
            counts[n - 1] += 1
            order.append(s)
        value <<= 1
    return codes, b"\xff\xc4" + struct.pack(">HB", 19 + len(order), 0) + bytes(counts) + bytes(order)


@cache
def _header() -> bytes:
    frame = b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, SIDE, SIDE, 1) + bytes([1, 0x11, 0])
    scan = b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 1, 0, 0])
    return b"\xff\xd8" + _code()[1] + frame + scan


@cache
def _emit() -> tuple[np.ndarray, np.ndarray]:
    """For each difference + 255: its bits, code and magnitude together, and how many."""
    bits, sizes = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        value, n = _code()[0][s]
        bits[d + 255] = value << s | (d if d >= 0 else d + (1 << s) - 1)
        sizes[d + 255] = n + s
    return bits, sizes


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """The JPEG of each frame of samples (frames, SIDE, SIDE)."""
    n = len(samples)
    if not n:
        return []
    x = samples.astype(np.int32)
    guess = np.empty_like(x)
    guess[:, :, 1:] = x[:, :, :-1]
    guess[:, 1:, 0] = x[:, :-1, 0]
    guess[:, 0, 0] = 128
    at = (x - guess + 255).reshape(n, FRAME)
    value, size = _emit()
    bits, sizes = value[at], size[at]
    ends = np.cumsum(sizes, axis=1)
    lengths = (ends[:, -1] + 7) >> 3
    first = np.concatenate([[0], np.cumsum(lengths)])
    place = (ends - sizes + 8 * first[:-1, None]).ravel()
    bits, sizes = bits.ravel().astype(np.uint64), sizes.ravel()
    word, inside = place >> 5, place & 31
    pair = bits << (64 - inside - sizes).astype(np.uint64)  # over the word that it begins in and the next
    words = (int(first[-1]) + 3 >> 2) + 1
    high = np.bincount(word, weights=(pair >> np.uint64(32)).astype(np.float64), minlength=words + 1)
    high[1:] += np.bincount(word, weights=(pair & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words + 1)[:-1]
    data = high.astype(np.uint32).astype(">u4").view(np.uint8)[: first[-1]].copy()
    used = ends[:, -1] & 7
    last = first[1:] - 1
    data[last] |= np.where(used, 0xFF >> used, 0).astype(np.uint8)
    full = data == 255  # each such byte is followed by a zero
    shift = np.concatenate([[0], np.cumsum(full)])
    out = np.zeros(len(data) + shift[-1], np.uint8)
    out[np.arange(len(data)) + shift[:-1]] = data
    whole, bounds, head = out.tobytes(), (first + shift[first]).tolist(), _header()
    return [head + whole[a:b] + b"\xff\xd9" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def avi(frames: list[bytes], side: int = SIDE, period: int = PERIOD) -> bytes:
    """An AVI file of MJPG frames with its index."""
    listed = lambda kind, body: b"LIST" + struct.pack("<I", len(body) + 4) + kind + body
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", period, most * 1_000_000 // period, 0, 0x10, len(frames), 0, 1, most, side, side, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4h", 0, 0, 0, 0, period, 1_000_000, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, side, side)
    form = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", side * side, 0, 0, 0, 0)
    movie, index, at = [], [], 4
    for f in frames:
        c = chunk(b"00dc", f)
        movie.append(c)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    body = listed(b"hdrl", chunk(b"avih", main) + listed(b"strl", chunk(b"strh", stream) + chunk(b"strf", form))) + listed(b"movi", b"".join(movie)) + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


def index_of(media: bytes) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(microseconds a frame, width, height, [(offset, size) of each frame]) by the file's lists and index.

    Index offsets count from the list of frames or from the file's begin. Without an index the list itself is walked.
    """
    if media[:4] != b"RIFF" or media[8:12] != b"AVI " or len(media) < 12:
        raise ValueError("not an AVI file")
    period = width = height = movie = 0
    rows = np.zeros(0, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    walked: list[tuple[int, int]] = []
    stack = [(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", media, at)
            if name == b"LIST":
                if media[at + 8 : at + 12] == b"movi":
                    movie = at + 8
                stack.append((at + 8 + size + (size & 1), end))
                at, end = at + 12, min(end, at + 8 + size)
                continue
            if name == b"avih":
                period = struct.unpack_from("<I", media, at + 8)[0]
                width, height = struct.unpack_from("<II", media, at + 40)
            elif name == b"idx1":
                rows = np.frombuffer(media, rows.dtype, min(size, len(media) - at - 8) // 16, at + 8)
            elif movie and name[2:] in (b"dc", b"db"):
                walked.append((at + 8, size))
            at += 8 + size + (size & 1)
    shown = [(int(a), int(s)) for i, a, s in zip(rows["id"], rows["at"], rows["size"], strict=True) if i[2:] in (b"dc", b"db")]
    base = movie if shown and media[movie + shown[0][0] : movie + shown[0][0] + 4][2:] in (b"dc", b"db") else 0
    frames = [(base + a + 8, s) for a, s in shown] or walked
    if any(a + s > len(media) for a, s in frames):
        raise ValueError("frames beyond the end of the file")
    return period, width, height, frames


def _parsed(head: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(height, width, difference and bits by the next 16 bits) of a JPEG's segments up to its entropy-coded data."""
    at, shape, table, predictor = 2, None, {}, None
    while at < len(head):
        mark, size = struct.unpack_from(">xBH", head, at)
        body = head[at + 4 : at + 2 + size]
        if mark == 0xC4:
            counts, symbols, value, k = body[1:17], body[17:], 0, 0
            for n in range(1, 17):
                for _ in range(counts[n - 1]):
                    table[(value, n)] = symbols[k]
                    value, k = value + 1, k + 1
                value <<= 1
        elif mark == 0xC3:
            precision, height, width, parts = struct.unpack_from(">BHHB", body)
            if precision != 8 or parts != 1:
                raise ValueError("only 8-bit grey frames")
            shape = (height, width)
        elif mark == 0xDA:
            predictor = body[3]
        at += 2 + size
    if shape is None or predictor != 1:
        raise ValueError("not a lossless frame with prediction from the left")
    diff, bits = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.uint8)
    for (value, n), s in table.items():
        for extra in range(1 << s):
            low = (value << s | extra) << (16 - n - s)
            span = slice(low, low + (1 << (16 - n - s)))
            diff[span] = extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1
            bits[span] = n + s
    return *shape, diff, bits


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples (frames, height, width) of JPEGs that share their segments, decoded in step."""
    head_size = frames[0].index(b"\xff\xda") + 2
    head_size += struct.unpack_from(">H", frames[0], head_size)[0]
    head = frames[0][:head_size]
    if not all(f.startswith(head) and f.endswith(b"\xff\xd9") for f in frames):
        raise ValueError("frames of different kinds")
    height, width, diff, bits = _parsed(head)
    coded = [f[head_size:-2] for f in frames]
    data = np.frombuffer(b"".join(coded), np.uint8)
    sizes = np.array([len(c) for c in coded])
    stuffed = np.zeros(len(data), bool)
    stuffed[1:] = (data[:-1] == 255) & (data[1:] == 0)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    start = first - np.concatenate([[0], np.cumsum(stuffed)])[first]
    data = np.concatenate([data[~stuffed], np.full(4, 255, np.uint8)]).astype(np.uint32)
    window = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    place = 8 * start.astype(np.int64)
    out = np.empty((height, width, len(frames)), np.uint8)
    row = np.full(len(frames), 128, np.int32)
    for y in range(height):
        value = row
        for x in range(width):
            key = (window[place >> 3] >> (8 - (place & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
            value = value + diff[key]
            place = place + bits[key]
            out[y, x] = value
            if x == 0:
                row = value
    return out.transpose(2, 0, 1)


@cache
def _zigzag() -> np.ndarray:
    """Where each coefficient of a block stands, in the order of the scan: diagonal by diagonal, up and down in turn."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


@cache
def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)


def _lookup(body: bytes) -> list[tuple[int, int]]:
    """(symbol, bits) by the next 16 bits; 0 bits where no code begins so."""
    table, value, k = [(0, 0)] * (1 << 16), 0, 0
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            low = value << (16 - n)
            table[low : low + (1 << (16 - n))] = [(body[16 + k], n)] * (1 << (16 - n))
            value, k = value + 1, k + 1
        value <<= 1
    return table


class _Bits:
    """Entropy-coded bits of one interval between restarts."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 1
            self.held, self.n = (self.held << 8 | byte) & 0xFFFFFFFF, self.n + 8

    def symbol(self, table: list[tuple[int, int]]) -> int:
        self.need(16)
        symbol, n = table[self.held >> (self.n - 16) & 0xFFFF]
        if not n or self.at > len(self.data) + 4:
            raise ValueError("bits that are no code")
        self.n -= n
        return symbol

    def value(self, s: int) -> int:
        """The signed number of s bits."""
        if not s:
            return 0
        self.need(s)
        self.n -= s
        v = self.held >> self.n & ((1 << s) - 1)
        return v if v >> (s - 1) else v - (1 << s) + 1


def decode_baseline(frame: bytes) -> np.ndarray:
    """Luminance samples (height, width) of a baseline JPEG with its Huffman tables, grey or with subsampled colours."""
    at, steps, tables, parts, restart = 2, {}, {}, [], 0
    while True:
        mark, size = struct.unpack_from(">xBH", frame, at)
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                steps[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int64)
                body = body[1 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                tables[body[0]] = _lookup(body[1:])
                body = body[17 + sum(body[1:17]) :]
        elif mark == 0xC0:
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("only 8-bit frames")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif mark == 0xDD:
            restart = struct.unpack_from(">H", body)[0]
        elif mark == 0xDA:
            if body[0] != len(parts):
                raise ValueError("only one scan of all colours")
            dealt = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    if not parts:
        raise ValueError("not a baseline frame")
    coded = frame[at : frame.rindex(b"\xff\xd9")]
    intervals = [_Bits(x.replace(b"\xff\x00", b"\xff")) for x in re.split(rb"\xff[\xd0-\xd7]", coded)]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    if len(parts) == 1:  # a single colour is not interleaved: its blocks lie row by row
        parts, most_h, most_v = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
        across, down = -(-width // 8), -(-height // 8)
    _, first_h, first_v, quant = parts[0]
    blocks = np.zeros((down * first_v, across * first_h, 64))
    zigzag = _zigzag()
    for unit in range(across * down):
        if unit % (restart or across * down) == 0:
            bits, before = intervals[unit // restart if restart else 0], [0] * len(parts)
        for i, (name, h, v, _) in enumerate(parts):
            dc, ac = tables[dealt[name] >> 4], tables[16 | dealt[name] & 15]
            for k in range(h * v):
                before[i] += bits.value(bits.symbol(dc))
                own = [0] * 64
                own[0], j = before[i], 1
                while j < 64:
                    symbol = bits.symbol(ac)
                    if not symbol:
                        break
                    j += symbol >> 4
                    if symbol & 15:
                        own[j] = bits.value(symbol & 15)
                    j += 1
                if i == 0:
                    blocks[unit // across * v + k // h, unit % across * h + k % h, zigzag] = own
    turned = np.zeros(64)
    turned[zigzag] = steps[quant]
    c = _cosines()
    x = np.einsum("ky,abkl,lx->abyx", c, (blocks * turned).reshape(*blocks.shape[:2], 8, 8), c)
    plane = np.clip(np.round(x + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(8 * blocks.shape[0], -1)
    # A first colour that is itself subsampled keeps its own size.
    return plane[: -(-height * first_v // most_v), : -(-width * first_h // most_h)]


def _frame(f: bytes) -> np.ndarray:
    at = 2
    while at + 4 <= len(f):
        mark, size = struct.unpack_from(">xBH", f, at)
        if mark in (0xC0, 0xC3):
            return decode_baseline(f) if mark == 0xC0 else decode_frames([f])[0]
        if mark == 0xDA:
            break
        at += 2 + size
    raise ValueError("neither a baseline nor a lossless frame")


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot, by the frames' histograms as shares of their samples. A cut lies where the histogram difference is at least LEAST
    and exceeds the mean of those around it by three of their standard deviations, or by half where there are none."""
    n = len(histograms)
    d = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    cuts = [0]
    for i in np.flatnonzero(d >= LEAST).tolist():
        near = np.concatenate([d[max(0, i - AROUND) : i], d[i + 1 : i + 1 + AROUND]])
        if not len(near) or d[i] > max(near.mean() + 3 * near.std(), 1.5 * near.mean()):
            cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def encode_text(docs: DataFrame, text: str = "text", out: str = "media", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of docs (all but text by default) with `out`: each whole text's UTF-8 as an AVI file.

    The bytes are filled up with 255, which UTF-8 never holds, to a positive multiple of 576. A null or empty text is
    one frame of 255. Rows, nulls and repeats stay; a column that has the new one's name gives way to it.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if (keep is not None or c != text) and c != out]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(out, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in utf8_slices(batch.column(0), SLICE):
                sizes = np.diff(offsets)
                counts = np.maximum(1, -(-sizes // FRAME))
                ends = np.cumsum(counts)
                padded = np.full(int(ends[-1]) * FRAME, 255, np.uint8)
                padded[np.arange(len(data)) + np.repeat((ends - counts) * FRAME - offsets[:-1], sizes)] = data
                frames: list[bytes] = []
                for lo in range(0, int(ends[-1]), 4096):
                    frames += encode_frames(padded[lo * FRAME : (lo + 4096) * FRAME].reshape(-1, SIDE, SIDE))
                media = [avi(frames[a - c : a]) for a, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                rows = [batch.column(1 + i).slice(first, len(sizes)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(media, pa.binary())], [*keep, out])

    return docs.select(F.col(text), *[F.col(f"`{c}`") for c in keep]).mapInArrow(releasing(run), schema)


CLIPS = "array<struct<clip:int,first_frame:int,last_frame:int,start_ms:long,end_ms:long,mean:double>>"
DECODED = f"frames int, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips {CLIPS}, error string"


def _histograms(x: np.ndarray) -> np.ndarray:
    """Shares of each frame's samples in BINS bins. x: (frames, samples)."""
    n, size = x.shape
    return np.bincount((np.repeat(np.arange(n), size) * BINS + (x >> 4).ravel()), minlength=n * BINS).reshape(-1, BINS) / max(size, 1)


def _decoded(media: list[bytes]) -> list[tuple]:
    """(payload, microseconds a frame, histograms, means) of each file; all their frames are decoded in step."""
    rows = [index_of(f) for f in media]
    frames = [f[a : a + s] for f, r in zip(media, rows, strict=True) for a, s in r[3]]
    samples = [decode_frames(frames[i : i + 8192]) for i in range(0, len(frames), 8192)]
    x = np.concatenate(samples).reshape(len(frames), -1) if samples else np.zeros((0, FRAME), np.uint8)
    bins, means, out, at = _histograms(x), x.mean(axis=1) if len(x) else np.zeros(0), [], 0
    for r in rows:
        own = slice(at, at + len(r[3]))
        out.append((x[own].tobytes(), r[0], bins[own], means[own]))
        at += len(r[3])
    return out


def _decoded_alone(f: bytes) -> tuple:
    """As _decoded for one file whose frames may differ in kind and size; raises ValueError with the reason if it can't be read."""
    try:
        period, _, _, at = index_of(f)
        frames = [_frame(f[a : a + s]).reshape(1, -1) for a, s in at]
    except (ValueError, IndexError, KeyError, struct.error) as e:
        raise ValueError(str(e) or type(e).__name__) from e
    bins = np.concatenate([_histograms(x) for x in frames]) if frames else np.zeros((0, BINS))
    return b"".join(x.tobytes() for x in frames), period, bins, np.array([x.mean() for x in frames])


def _told(f: bytes, payload: bytes, period: int, bins: np.ndarray, means: np.ndarray) -> tuple:
    n, ms = len(bins), period / 1000
    cuts = shots(bins) if n else []
    clips = [{"clip": i, "first_frame": a, "last_frame": b - 1, "start_ms": round(a * ms), "end_ms": round(b * ms), "mean": round(float(means[a:b].mean()), 4)} for i, (a, b) in enumerate(cuts)]
    return n, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(f), hashlib.sha256(f).hexdigest(), clips, None


def decode(media: DataFrame, column: str = "media", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all but the media by default) with what the stored bytes hold once read back: frames, n_bytes
    (without the filling), payload_bytes, payload_sha256, tail_crc32 (of the last 32 payload bytes), media_bytes,
    media_sha256, clips and error.

    Frames are lossless grey JPEGs, or baseline ones with their tables, of which the luminance counts; they may differ
    in size and tables. A null medium gives nulls. One that is malformed or of another kind gives its media_bytes and
    media_sha256, nulls, and the reason as error; other rows are not touched by it. Repeated rows stay; columns with these names give way to the new ones.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    extra = _parse_datatype_string(DECODED)
    keep = [c for c in (media.columns if keep is None else keep) if (keep is not None or c != column) and c not in extra.names]
    schema = media.select(*[F.col(f"`{c}`") for c in keep]).schema
    for f in extra.fields:
        schema = schema.add(f)
    kinds = [to_arrow_type(f.dataType) for f in extra.fields]

    def rows(group: list[bytes | None]) -> Iterator[tuple]:
        known = [f for f in group if f is not None]
        try:
            found = iter(_decoded(known))
        except (ValueError, IndexError, KeyError, struct.error):  # one of them is of another kind
            found = None
        for f in group:
            if f is None:
                yield (None,) * len(kinds)
                continue
            try:
                yield _told(f, *(next(found) if found else _decoded_alone(f)))
            except ValueError as e:
                yield (None,) * 5 + (len(f), hashlib.sha256(f).hexdigest(), None, str(e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(0)
            first = 0
            while first < len(files):
                group, held, last = [], 0, first
                while last < len(files) and (last == first or held < SLICE):
                    f = files[last].as_py()
                    group.append(f)
                    held += len(f or b"")
                    last += 1
                own = [batch.column(1 + i).slice(first, last - first) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(zip(*rows(group), strict=True), kinds, strict=True))], schema.names)
                first = last

    return media.select(F.col(column), *[F.col(f"`{c}`") for c in keep]).mapInArrow(releasing(run), schema)


def clip_rows(media: DataFrame, column: str = "media") -> DataFrame:
    """One row a clip: the other columns of media, clip, first_frame, last_frame, start_ms, end_ms, mean."""
    rows = decode(media, column)
    kept = [F.col(f"`{c}`") for c in media.columns if c != column and c in rows.columns and c not in ("clip", "first_frame", "last_frame", "start_ms", "end_ms", "mean")]
    return rows.select(F.struct(F.lit(0), *kept).alias("_own"), F.explode("clips").alias("_clip")).select("_own.*", "_clip.*").drop("col1")
