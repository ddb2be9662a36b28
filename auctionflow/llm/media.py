"""Media columns: payloads in AVI files of motion-JPEG frames, and clips found in them.

A payload byte is one 8 x 8 block of a grey baseline JPEG: quantized by 8, its DC
term is the byte less 128, so the frame holds the byte without loss and any
player shows it.  The Huffman table gives category c a code of 9 - c bits; with
the c bits of the difference and the end-of-block code of one bit each block
takes 10 bits, which numpy packs and unpacks for all frames at once.  Frames are
64 blocks wide and at most ``FRAME_ROWS`` high; all frames of a file have one
size, the last is filled with zeros, and the chunk ``plen`` has the payload's length.

Reading goes through the RIFF chunks and the ``idx1`` index, decodes each intra
frame as its own tables tell (any baseline JPEG, down to the mean level of each
block of its first component), and finds shots where the histogram difference of consecutive frames
exceeds the running mean of the differences in the shot by ``SPREAD`` deviations
(a difference that only reaches it starts no shot).

Null and empty texts are one payload of 64 zero bytes.  Repeated rows give a row
each; equal texts give equal values.  An empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

WIDTH, FRAME_ROWS, RATE = 64, 16, 25
SPREAD, LEAST_DIFFERENCE, BINS = 3.0, 0.15, 32
DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
MEDIA = "doc_id bigint, n_bytes bigint, media binary"
CLIPS = "doc_id bigint, clip int, first_frame int, last_frame int, start_ms bigint, end_ms bigint, mean_level double"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """10-bit code of each difference + 255, and the difference of each code (999: none)."""
    codes, back = np.zeros(511, np.uint16), np.full(1024, 999, np.int16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        prefix = (1 << (9 - c)) - 2  # 8 - c ones and a zero
        code = ((prefix << c) | (d if d > 0 else d + (1 << c) - 1 if d else 0)) << 1
        codes[d + 255], back[code] = code, d
    return codes, back


_CODES, _BACK = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    """All of a frame before its entropy-coded data."""
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0, *[8] * 64]))
        + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDTH * 8, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, bytes([0x00, *[1] * 9, *[0] * 7, *range(8, -1, -1)]))
        + _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0]))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode_frames(payload: np.ndarray) -> tuple[list[bytes], int]:
    """JPEG frames of a payload whose length is a multiple of 64, and their height in blocks."""
    total = len(payload) // WIDTH
    rows = min(total, FRAME_ROWS)
    n = -(-total // rows)
    levels = np.zeros(n * rows * WIDTH, np.int16)
    levels[: len(payload)] = payload
    levels = levels.reshape(n, -1) - 128
    codes = _CODES[np.diff(levels, axis=1, prepend=np.int16(0)) + 255].reshape(n, -1, 4).astype(np.uint64)
    word = codes[..., 0] << 30 | codes[..., 1] << 20 | codes[..., 2] << 10 | codes[..., 3]
    data = word.astype(">u8").view(np.uint8).reshape(n, -1, 8)[..., 3:].reshape(n, -1)
    stuffed = data == 0xFF
    ends = np.cumsum(data.shape[1] + stuffed.sum(axis=1))
    flat = np.insert(data.reshape(-1), np.flatnonzero(stuffed.reshape(-1)) + 1, 0).tobytes() if stuffed.any() else data.tobytes()
    head = _head(rows)
    return [head + flat[a:b] + b"\xff\xd9" for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], rows


def encode_avi(payload: bytes) -> bytes:
    frames, rows = encode_frames(np.frombuffer(payload, np.uint8))
    width, height, largest = WIDTH * 8, rows * 8, max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    body = b"AVI " + hdrl + _chunk(b"plen", struct.pack("<Q", len(payload))) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def parse_avi(media: bytes) -> tuple[list[tuple[int, int]], int, int]:
    """((offset, length) of each frame, from the index), the payload's length, microseconds of a frame."""
    name, size, kind = struct.unpack("<4sI4s", media[:12])
    if name != b"RIFF" or kind != b"AVI " or len(media) < 8 + size:
        raise ValueError("not an AVI file")
    at, end = 12, 8 + size
    movi, index, length, pace = None, b"", None, 0
    while at + 8 <= end:
        name, size = struct.unpack("<4sI", media[at : at + 8])
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            pace = struct.unpack("<I", media[at + 20 : at + 24])[0]
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
        elif name == b"plen":
            length = struct.unpack("<Q", media[at + 8 : at + 16])[0]
        at += 8 + size + size % 2
    if movi is None:
        raise ValueError("no frames")
    entries = np.frombuffer(index, np.dtype([("id", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("length", "<u4")]))
    return [(movi + int(e["offset"]) + 8, int(e["length"])) for e in entries if e["id"] == b"00dc"], length, pace


@dataclass
class Frame:
    """What the segments of a JPEG frame announce, and where its entropy-coded data begin."""

    height: int
    width: int
    parts: list[tuple[int, int, int, int]]  # of each component: id, horizontal and vertical sampling, quantization table
    steps: dict[int, int]  # of each quantization table: the DC step
    codes: dict[int, dict[tuple[int, int], int]]  # class * 16 + table: (length, code) -> symbol
    scan: list[tuple[int, int]]  # of each component: DC and AC table
    restart: int
    data: int

    @classmethod
    def read(cls, frame: bytes) -> Frame:
        if frame[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        found, at = cls(0, 0, [], {}, {}, [], 0, 0), 2
        while not found.data:
            marker, size = struct.unpack(">HH", frame[at : at + 4])
            body, at = frame[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xFFDB:
                while body:
                    wide = body[0] >> 4
                    found.steps[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker in (0xFFC0, 0xFFC1):
                _, found.height, found.width, n = struct.unpack(">BHHB", body[:6])
                found.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xFFC2 <= marker <= 0xFFCF and marker not in (0xFFC4, 0xFFC8, 0xFFCC):
                raise ValueError("not a baseline frame")
            elif marker == 0xFFC4:
                while body:
                    counts, code, k, table = body[1:17], 0, 17, {}
                    for length, count in enumerate(counts, 1):
                        for symbol in body[k : k + count]:
                            table[length, code] = symbol
                            code += 1
                        code, k = code << 1, k + count
                    found.codes[body[0]] = table
                    body = body[k:]
            elif marker == 0xFFDD:
                found.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFFDA:
                found.scan = [(body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                found.data = at
        if not found.parts or len(found.scan) != len(found.parts):
            raise ValueError("a frame of several scans")
        return found

    def is_plain(self) -> bool:
        """The tables of ``encode_frames``: grey, and every block takes ten bits."""
        return self.width == WIDTH * 8 and self.parts == _PLAIN.parts and self.steps == _PLAIN.steps and self.codes == _PLAIN.codes and self.scan == _PLAIN.scan and not self.restart

    def levels(self, data: bytes) -> np.ndarray:
        """Mean level of each 8 x 8 block of the first component, row by row, from the DC terms; bit by bit as the tables tell."""
        most_h, most_v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        one = len(self.parts) == 1  # a single component isn't interleaved
        across, down = (-(-self.width // 8), -(-self.height // 8)) if one else (-(-self.width // (8 * most_h)), -(-self.height // (8 * most_v)))
        h0, v0 = (1, 1) if one else self.parts[0][1:3]
        out = np.zeros((down * v0, across * h0), np.int64)
        pieces = re.split(rb"\xff[\xd0-\xd7]", data) if self.restart else [data]
        mcu = 0
        for piece in pieces:
            bits = np.unpackbits(np.frombuffer(piece.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
            place, dc = 0, [0] * len(self.parts)

            def symbol(table: dict[tuple[int, int], int]) -> int:
                nonlocal place
                code = 0
                for length in range(1, 17):
                    code = code << 1 | bits[place]
                    place += 1
                    if (length, code) in table:
                        return table[length, code]
                raise ValueError("no such code")

            for _ in range(min(self.restart or across * down, across * down - mcu)):
                for c, (_, h, v, quant) in enumerate(self.parts):
                    dc_table, ac_table = self.codes[self.scan[c][0]], self.codes[16 + self.scan[c][1]]
                    for block in range(1 if one else h * v):
                        n = symbol(dc_table)
                        x = int("".join(map(str, bits[place : place + n])) or "0", 2)
                        place += n
                        dc[c] += x if n == 0 or x >> (n - 1) else x - (1 << n) + 1
                        k = 1
                        while k < 64:
                            run = symbol(ac_table)
                            if run == 0:
                                break
                            k, place = k + (run >> 4) + 1, place + (run & 15)
                        if c == 0:
                            out[mcu // across * v0 + block // h0, mcu % across * h0 + block % h0] = dc[0] * self.steps[quant]
                mcu += 1
        return np.clip(np.round(out.reshape(-1) / 8) + 128, 0, 255).astype(np.uint8)


_PLAIN = Frame.read(_head(1))


def decode_frames(media: bytes, places: list[tuple[int, int]]) -> np.ndarray:
    """Levels of the blocks of each frame, a row each; frames with the tables of ``encode_frames`` all at once."""
    if not places:
        raise ValueError("no frames")
    first = Frame.read(media[places[0][0] : sum(places[0])])
    head = media[places[0][0] : places[0][0] + first.data]
    plain = first.is_plain()
    parts = []
    for offset, length in places:
        if media[offset + length - 2 : offset + length] != b"\xff\xd9":
            raise ValueError("a frame without its end")
        plain = plain and media[offset : offset + len(head)] == head
        parts.append(media[offset + len(head) : offset + length - 2])
    if not plain:
        read = [(f := Frame.read(media[a : a + n])).levels(media[a + f.data : a + n - 2]) for a, n in places]
        if len({len(x) for x in read}) > 1:
            raise ValueError("frames of several sizes")
        return np.stack(read)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    keep = np.ones(len(flat), bool)
    keep[1:] = ~((flat[1:] == 0) & (flat[:-1] == 0xFF))
    data = flat[keep].reshape(-1, 5).astype(np.uint64)
    word = data[:, 0] << 32 | data[:, 1] << 24 | data[:, 2] << 16 | data[:, 3] << 8 | data[:, 4]
    codes = np.stack([word >> 30, word >> 20, word >> 10, word], axis=1) & 0x3FF
    return (np.cumsum(_BACK[codes].reshape(len(places), -1), axis=1, dtype=np.int32) + 128).astype(np.uint8)


def shots(levels: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) frame of each shot."""
    n = len(levels)
    if n == 1:
        return [(0, 0)]
    bins = (levels >> 3).astype(np.int64) + np.arange(n)[:, None] * BINS
    hist = np.bincount(bins.reshape(-1), minlength=n * BINS).reshape(n, BINS) / levels.shape[1]
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1).tolist()
    out, first, count, total, squares = [], 0, 0, 0.0, 0.0
    for i, x in enumerate(d):
        mean = total / count if count else x
        spread = max(0.0, squares / count - mean * mean) ** 0.5 if count else 0.0
        if count and x > max(LEAST_DIFFERENCE, mean + SPREAD * spread):
            out.append((first, i))
            first, count, total, squares = i + 1, 0, 0.0, 0.0
        else:
            count, total, squares = count + 1, total + x, squares + x * x
    return [*out, (first, n - 1)]


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, payload)."""
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores each text, reads the stored bytes back and describes both."""

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {x.split()[0]: [] for x in DIGEST.split(", ")}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n, payload = padded(text)
            media = encode_avi(payload)
            places, length, _ = parse_avi(media)
            levels = decode_frames(media, places)
            back = levels.reshape(-1)[:length].tobytes()
            feature = f"{WIDTH}x{levels.shape[1] // WIDTH};frames={len(levels)};mean={levels.mean():.4f};shots=" + ",".join(f"{a}-{b}" for a, b in shots(levels))
            for k, v in zip(out, (doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)):
                out[k].append(v)
        return out

    return common.map_text(docs.select("doc_id", "text"), DIGEST, work)


def to_media(docs: DataFrame) -> DataFrame:
    """A binary column ``media`` with the AVI file of each text."""

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        made = [padded(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_bytes": [n for n, _ in made], "media": [encode_avi(p) for _, p in made]}

    return common.map_text(docs.select("doc_id", "text"), MEDIA, work)


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of a table with doc_id and ``media``; a null medium has none, nor has one that can't be read (empty, cut off, no baseline JPEG frames)."""
    schema = common.arrow_schema(CLIPS)

    def run(batches):
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    places, _, pace = parse_avi(data)
                    levels = decode_frames(data, places)
                except (ValueError, struct.error, LookupError):
                    continue
                rows += [(doc, k, a, b, a * pace // 1000, (b + 1) * pace // 1000, float(levels[a : b + 1].mean())) for k, (a, b) in enumerate(shots(levels))]
            if rows:
                yield common.to_batch(dict(zip(schema.names, zip(*rows))), schema)

    return media.select("doc_id", "media").mapInArrow(run, CLIPS)
