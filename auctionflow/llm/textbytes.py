"""Vectorised views of text columns: UTF-8 bytes of an Arrow batch, words in them, hashes of words.

All functions work on one flat ``uint8`` array that holds the texts of a batch
one after another, with ``bounds`` (n + 1 offsets).  A null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)
# Random-looking value of each byte, never zero.
_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(flat bytes, bounds) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(column: pa.Array | pa.ChunkedArray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``most`` bytes each (a longer text is alone)."""
    _, bounds = text_buffers(column)
    at, n = 0, len(bounds) - 1
    while at < n:
        stop = int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1
        stop = min(max(stop, at + 1), n)
        yield at, stop
        at = stop


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)])
            _inverses = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _INVERSE, np.uint64)])
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads hash bits (splitmix64's finisher)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_sums(buf: np.ndarray) -> np.ndarray:
    """n + 1 running sums from which ``span_hashes`` gets the hash of any span."""
    powers, _ = power_tables(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_VALUE[buf] * powers[: len(buf)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans, equal hashes, wherever they stand."""
    _, inverses = power_tables(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is in lower case.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
WORD_BYTE[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(buf: np.ndarray, bounds: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text: n + 1 offsets) of the runs of word bytes in lower-cased ``buf``."""
    inside = WORD_BYTE[buf] if inside is None else inside
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    edges = bounds[:-1][bounds[:-1] < n]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def sequence_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive values (len(h) - k + 1 of them)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(_BASE) + h[i : i + len(out)]
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] numbers, then from starts[1], and so on."""
    stops = np.cumsum(lengths)
    total = int(stops[-1]) if len(stops) else 0
    return np.repeat(starts - (stops - lengths), lengths) + np.arange(total)
