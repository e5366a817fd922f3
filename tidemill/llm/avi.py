"""AVI files of motion JPEG: written losslessly, parsed, decoded and cut into shots.

A stored byte is one DCT coefficient of category 8, which has 256 values (-255..-128 and 128..255): the category's
extra bits are the byte itself. A frame is a strip of up to 64 blocks, quantised by 1, with a restart after every
block, so that every block can be decoded on its own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed, tune

BLOCK, BLOCKS, FPS, BINS = 64, 64, 25, 32


def _zigzag() -> np.ndarray:
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


ZIGZAG = _zigzag()
_COS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: coefficients in zigzag order times this are samples in rows
INVERSE = np.kron(_COS, _COS)[ZIGZAG].astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbol: int) -> bytes:
    """A Huffman table of one code, eight zero bits."""
    return bytes([kind]) + bytes([0] * 7 + [1] + [0] * 8) + bytes([symbol])


def jpeg(payload: bytes) -> bytes:
    """A grey baseline JPEG of 8 rows whose coefficients hold the payload, a multiple of 64 bytes."""
    data = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    n = len(data)
    head = b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC0, struct.pack(">BHHBBBB", 8, 8, 8 * n, 1, 1, 0x11, 0))
    head += _segment(0xC4, _table(0x00, 8) + _table(0x10, 8)) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    scan = np.zeros((n, 2 * BLOCK + 2), np.uint8)
    scan[:, 1 : 2 * BLOCK : 2] = data
    scan[:, -2], scan[:, -1] = 0xFF, 0xD0 + np.arange(n) % 8
    flat, stuffed = scan.ravel(), np.zeros(scan.shape, bool)
    stuffed[:, 1 : 2 * BLOCK : 2] = data == 0xFF
    flat = np.insert(flat, np.flatnonzero(stuffed.ravel()) + 1, 0) if stuffed.any() else flat
    return head + flat[:-2].tobytes() + b"\xff\xd9"


def avi(payload: bytes, fps: int = FPS) -> bytes:
    """The payload as an AVI file of motion JPEG with an index."""
    step = BLOCK * BLOCKS
    frames = [jpeg(payload[i : i + step]) for i in range(0, len(payload), step)]
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        chunk = b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) % 2)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(chunk)
        at += len(chunk)

    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)

    width, most = 8 * BLOCKS, max(map(len, frames))
    avih = struct.pack("<10I16x", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, 8)
    strh = struct.pack("<4s4sIHHIIIIIIiI4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, -1, 0, 0, 0, width, 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, 8, 1, 24, b"MJPG", width * 8 * 3, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index)))


@dataclass
class Movie:
    fps: float
    width: int
    height: int
    frames: list[bytes]


def parse(file: bytes) -> Movie:
    """The frames of the first video stream, by the index (or in file order without one), then those of AVIX parts of
    long files, which the index doesn't cover. ValueError if it's no AVI file."""
    if file[:4] != b"RIFF" or file[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[bytes, tuple[int, int]] = {}
    loose: list[tuple[int, bytes, int, int]] = []  # RIFF part, stream, place, size

    def walk(part: int, at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
            if name == b"LIST":
                found.setdefault(file[at + 8 : at + 12], (at + 8, size))
                walk(part, at + 12, min(end, at + 8 + size))
            elif name[2:] in (b"dc", b"db"):
                loose.append((part, name[:2], at + 8, size))
            else:
                found.setdefault(name, (at + 8, size))
            at += 8 + size + size % 2

    at, part = 0, 0
    while at + 12 <= len(file) and file[at : at + 4] == b"RIFF":
        size = struct.unpack_from("<I", file, at + 4)[0]
        walk(part, at + 12, min(len(file), at + 8 + size))
        at, part = at + 8 + size + size % 2, part + 1
    if b"movi" not in found:
        raise ValueError("no movi list")
    frames = loose
    if b"idx1" in found:
        at, size = found[b"idx1"]
        base = found[b"movi"][0]
        index = [(name, o, n) for name, _, o, n in struct.iter_unpack("<4sIII", file[at : at + size - size % 16]) if name[2:] in (b"dc", b"db")]
        if index and file[base + index[0][1] : base + index[0][1] + 4] != index[0][0]:
            base = 0  # some writers count from the file's start
        frames = [(0, name[:2], base + o + 8, n) for name, o, n in index] + [x for x in loose if x[0]]
    us, width, height = 1_000_000 // FPS, 0, 0
    if b"avih" in found:
        us, width, height = (struct.unpack_from("<I", file, found[b"avih"][0] + o)[0] for o in (0, 32, 36))
    return Movie(1_000_000 / max(us, 1), width, height, [file[o : o + n] for _, stream, o, n in frames if stream == frames[0][1]])


def _codes(body: bytes) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 16
    for size in range(1, 17):
        for _ in range(body[size - 1]):
            out[size, code] = body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


#: The Huffman tables of the JPEG standard, which motion JPEG frames may leave out. Counts of codes by
#: length, then symbols; the symbols after the listed ones follow in order of value.
_AC = {16 * run + size for run in range(16) for size in range(1, 11)} | {0x00, 0xF0}
_AC_LUMA = bytes([1, 2, 3, 0, 4, 0x11, 5, 0x12, 0x21, 0x31, 0x41, 6, 0x13, 0x51, 0x61, 7, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 8, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82])
_AC_CHROMA = bytes([0, 1, 2, 3, 0x11, 4, 5, 0x21, 0x31, 6, 0x12, 0x41, 0x51, 7, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 8, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 9, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1])
DEFAULT_TABLES = {
    0x00: bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(12)),
    0x01: bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]) + bytes(range(12)),
    0x10: bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]) + _AC_LUMA + bytes(sorted(_AC - set(_AC_LUMA))),
    0x11: bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]) + _AC_CHROMA + bytes(sorted(_AC - set(_AC_CHROMA))),
}


def coefficients(frame: bytes) -> tuple[np.ndarray, int, int]:
    """Dequantised coefficients (blocks x 64, zigzag) of the luma component, width and height of a baseline JPEG, grey or colour.

    ValueError for other kinds of JPEG. Blocks come in the order they are coded.
    """
    at, tables, quant, restart, width, height, parts = 2, dict(DEFAULT_TABLES), {}, 0, 0, 0, []
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker in (0xC0, 0xC1):
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]  # name, across, down, table
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
    if not parts or body[0] != len(parts):
        raise ValueError("not one scan of all components")
    scan = np.frombuffer(frame, np.uint8)[at:-2]
    plain = _table(0, 8)[1:]
    if len(parts) == 1 and restart == 1 and tables[0] == plain and tables[0x10] == plain:
        blocks = -(-width // 8) * -(-height // 8)
        full = scan == 0xFF
        after = np.concatenate([[False], full[:-1]])
        mark = after & (scan >= 0xD0) & (scan <= 0xD7)
        drop = (after & (scan == 0)) | mark  # stuffing, and restart markers
        drop[:-1] |= mark[1:]
        extra = scan[~drop].reshape(blocks, 2 * BLOCK)[:, 1::2].astype(np.int32)
        values = np.where(extra < 128, extra - 255, extra)
    else:
        if len(parts) == 1:
            parts = [(parts[0][0], 1, 1, parts[0][3])]
        across, down = max(p[1] for p in parts), max(p[2] for p in parts)
        units = -(-width // (8 * across)) * -(-height // (8 * down))
        codes = {k: _codes(t) for k, t in tables.items()}
        chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
        plan = [(p[1] * p[2], codes[chosen[p[0]] >> 4], codes[0x10 | chosen[p[0]] & 15]) for p in parts]
        values = _decoded(scan.tobytes(), plan, units, restart)
    return values * quant.get(parts[0][3], np.ones(64, np.int32)), width, height


def _decoded(scan: bytes, plan: list[tuple[int, dict, dict]], units: int, restart: int) -> np.ndarray:
    """The first component's blocks, bit by bit. plan: each component's blocks in a unit and its DC and AC codes."""
    out, at, held, bits, last = [], 0, 0, 0, [0] * len(plan)

    def take(n: int) -> int:
        nonlocal at, held, bits
        while bits < n:
            byte = scan[at] if at < len(scan) else 0
            at += 2 if byte == 0xFF else 1
            held, bits = held << 8 | byte, bits + 8
        bits -= n
        value = held >> bits
        held &= (1 << bits) - 1
        return value

    def symbol(codes: dict) -> int:
        code = 0
        for size in range(1, 17):
            code = code << 1 | take(1)
            if (size, code) in codes:
                return codes[size, code]
        raise ValueError("bad code")

    def value(n: int) -> int:
        x = take(n) if n else 0
        return x if not n or x >> (n - 1) else x - (1 << n) + 1

    for u in range(units):
        if restart and u and u % restart == 0:
            held = bits = 0
            last = [0] * len(plan)
            at += 2
        for i, (blocks, dc, ac) in enumerate(plan):
            for _ in range(blocks):
                last[i] += value(symbol(dc))
                block, k = [0] * 64, 1
                block[0] = last[i]
                while k < 64:
                    s = symbol(ac)
                    if not s:
                        break
                    k += s >> 4
                    if s & 15:
                        v = value(s & 15)
                        if k > 63:
                            raise ValueError("bad run")
                        block[k] = v
                    k += 1
                if i == 0:
                    out.append(block)
    return np.array(out, np.int32).reshape(-1, 64)


def stored(frames: list[np.ndarray]) -> bytes:
    """The bytes that coefficients of avi()'s making hold."""
    every = np.concatenate(frames).ravel()
    return np.where(every < 0, every + 255, every).astype(np.uint8).tobytes()


def histograms(frames: list[np.ndarray]) -> np.ndarray:
    """Shares of sample values in each frame."""
    out = np.zeros((len(frames), BINS))
    for i, c in enumerate(frames):
        samples = np.clip(c.astype(np.float32) @ INVERSE + 128, 0, 255).astype(np.uint8)
        out[i] = np.bincount(samples.ravel() // (256 // BINS), minlength=BINS) / samples.size
    return out


def shots(hist: np.ndarray, window: int = 8, factor: float = 3.0, least: float = 0.1) -> list[tuple[int, int]]:
    """Frames [start, end) of each shot: a cut stands where the histogram difference is above what the last `window` led to expect. No frames, no shots."""
    if not len(hist):
        return []
    cuts, past = [0], []
    for i in range(1, len(hist)):
        d = 0.5 * float(np.abs(hist[i] - hist[i - 1]).sum())
        recent = past[-window:]
        if d > max(least, (np.mean(recent) + factor * np.std(recent)) if recent else least):
            cuts.append(i)
            past = []
        else:
            past.append(d)
    return list(zip(cuts, [*cuts[1:], len(hist)], strict=True))


def clips(media: DataFrame) -> DataFrame:
    """One row per shot of each (id, media) row: id, clip, first_frame, end_frame, start_s, end_s, error.

    Media that can't be read (null, no AVI, frames that are no baseline JPEG) and movies without frames have one row with
    the reason in error and nulls for the rest. Repeated rows each give theirs, an empty table none. Other columns are
    ignored.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    movie = parse(blob or b"")
                    if not movie.frames:
                        raise ValueError("no frames")
                    found = shots(np.concatenate([histograms([coefficients(f)[0]]) for f in movie.frames]))
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    rows.append((key, None, None, None, None, None, "no media" if blob is None else f"{type(e).__name__}: {e}"))
                    continue
                rows += [(key, k, a, b, a / movie.fps, b / movie.fps, None) for k, (a, b) in enumerate(found)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "clip", "first_frame", "end_frame", "start_s", "end_s", "error"])

    return media.select(F.col("id").cast("long"), "media").mapInArrow(trimmed(run), "id long, clip int, first_frame int, end_frame int, start_s double, end_s double, error string")


def media_rows(docs: DataFrame) -> DataFrame:
    """Every text of docs (doc_id, text) stored as an AVI file and read back.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Null counts as
    empty; an empty text's payload is 64 zero bytes. Equal texts give equal values; repeated rows each give a row. An
    empty table gives an empty result. feature: frames, each shot's frames and its brightest share of samples. A file's
    sizes have 32 bits, so that a text may have some 1.9 GB; frames are decoded one at a time, and beside the text its
    file, about twice as long, is all that is held.
    """
    tune(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def row(doc, text):
        raw = (text or "").encode()
        file = avi(raw + b"\0" * (-len(raw) % BLOCK if raw else BLOCK))
        size, tail, back, hist = 0, b"", hashlib.sha256(), []
        for f in parse(file).frames:
            c = coefficients(f)[0]
            data = stored([c])
            size, tail = size + len(data), data[-64:]
            back.update(data)
            hist.append(histograms([c])[0])
        hist = np.array(hist)
        cut = " ".join(f"{a}-{b}:{hist[a:b].mean(axis=0).max():.4f}" for a, b in shots(hist))
        return doc, len(raw), size, back.hexdigest(), zlib.crc32(tail), len(file), hashlib.sha256(file).hexdigest(), f"{len(hist)}|{cut}"

    def run(batches):
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            rows = [row(*x) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), schema)
