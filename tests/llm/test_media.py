import hashlib
import random
import struct
import zlib

import numpy as np
from cases import HOSTILE, hostile

from auctionflow.llm import media as M


def test_round_trip(spark):
    got = {}
    for r in M.media_digest(hostile(spark)).collect():
        got.setdefault(r["doc_id"], r)
    for d, t in HOSTILE:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[0][1:] == got[1][1:] == got[9][1:]
    assert M.media_digest(hostile(spark, [])).collect() == []


def test_any_bytes():
    random.seed(1)
    for n in (1, 2, 15, 16, 17, 33, 400):
        for kind in range(3):
            payload = bytes(random.choice([0, 255]) if kind == 0 else random.randrange(256) if kind == 1 else 127 for _ in range(64 * n))
            media = M.encode_avi(payload)
            places, length, _ = M.parse_avi(media)
            assert M.decode_frames(media, places).reshape(-1)[:length].tobytes() == payload


def test_codes_are_a_huffman_code():
    # 9 bits of a difference, then the end of the block; decoded bit by bit as the tables of the header tell
    for d in range(-255, 256):
        bits = f"{int(M._CODES[d + 255]):010b}"
        c = 8 - bits.index("0")
        extra = bits[9 - c : 9]
        value = int(extra, 2) if c else 0
        assert (value if c == 0 or extra[0] == "1" else value - (1 << c) + 1) == d and bits[9] == "0"


def test_clips(spark):
    dark, light = " " * 64 * 16 * 6, "~" * 64 * 16 * 5
    df = M.to_media(spark.createDataFrame([(1, dark + light + dark), (2, "a"), (3, None)], "doc_id int, text string"))
    got = [tuple(r)[:6] for r in M.clips(df).orderBy("doc_id", "clip").collect()]
    assert got == [(1, 0, 0, 5, 0, 240), (1, 1, 6, 10, 240, 440), (1, 2, 11, 16, 440, 680), (2, 0, 0, 0, 0, 40), (3, 0, 0, 0, 0, 40)]
    assert np.array_equal(np.unique(M._BACK[M._BACK < 999]), np.arange(-255, 256))


def test_general_decoder_equals_the_fast_one():
    random.seed(4)
    payload = bytes(random.randrange(256) for _ in range(64 * 40))
    media = M.encode_avi(payload)
    places, _, _ = M.parse_avi(media)
    for (a, n), row in zip(places, M.decode_frames(media, places)):
        frame = M.Frame.read(media[a : a + n])
        assert frame.is_plain() and (frame.levels(media[a + frame.data : a + n - 2]) == row).all()


def foreign(levels, step=4):
    """A frame of another coding: two components, 2 x 1 sampling, codes of its own, an AC term in each block, restarts."""
    bits = lambda v, n: f"{v:0{n}b}" if n else ""
    codes = {s: bits(s, 4) for s in range(12)}  # sizes 0 to 11 in four bits each
    head = b"\xff\xd8" + M._segment(0xFE, b"note") + M._segment(0xDB, bytes([0, *[step] * 64]))
    head += M._segment(0xC0, struct.pack(">BHHB", 8, 8 * levels.shape[0], 8 * levels.shape[1], 2) + bytes([1, 0x21, 0, 2, 0x11, 0]))
    head += M._segment(0xC4, bytes([0, 0, 0, 0, 12, *[0] * 12, *range(12)])) + M._segment(0xC4, bytes([0x10, 0, 2, *[0] * 14, 0x00, 0x11]))
    head += M._segment(0xDD, struct.pack(">H", 1)) + M._segment(0xDA, bytes([2, 1, 0x00, 2, 0x00, 0, 63, 0]))
    out = []
    for k, pair in enumerate(levels.reshape(-1, 2)):
        text, last = "", 0
        for v in [*pair.tolist(), None]:
            d = 0 if v is None else (v - 128) * 8 // step - last
            last += 0 if v is None else d
            n = abs(d).bit_length()
            text += codes[n] + bits(d if d > 0 else d + (1 << n) - 1, n) + "01" + "1" + "00"  # one AC term after a zero, then the end
        text += "1" * (-len(text) % 8)
        out.append(int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0") + (bytes([0xFF, 0xD0 + k % 8]) if k < levels.size // 2 - 1 else b""))
    return head + b"".join(out) + b"\xff\xd9"


def test_frames_of_another_coding():
    levels = np.random.default_rng(1).integers(0, 256, (3, 6))
    frame = foreign(levels)
    assert (M.decode_frames(frame, [(0, len(frame))])[0] == levels.reshape(-1)).all()


def test_broken_media(spark):
    good = M.encode_avi(b"a" * 640)
    at = good.index(b"\xff\xc0")
    bad = [None, b"", b"RIFF", b"x" * 500, good[:-40], good[: len(good) // 2], good[:at] + b"\xff\xc2" + good[at + 2 :], good.replace(b"00dc", b"01wb"), good.replace(b"\xff\xd9", b"\xff\xd8")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*bad, good])], "doc_id int, media binary")
    assert [r["doc_id"] for r in M.clips(df).collect()] == [len(bad)]
