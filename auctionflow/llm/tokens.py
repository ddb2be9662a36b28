"""Exact, cached encoding with the word-level BPE of the tokenizers library.

The pre-tokenizer of the vocabulary file drops white space and cuts a text into
words that are encoded independently of each other, so the ids of a text are the
ids of its words in order.  ``WordEncoder`` finds the words of a whole batch with
numpy, keeps the ids of the words that it has seen in a bounded hash table, and
asks the library's model for each new one.  A word found in the table is compared
byte for byte with the one that is kept there.  Texts with characters outside ASCII
and the Latin-1 letters (for which normalization is more than lower case), texts
that hold ``<|`` (special tokens), words of over ``LONGEST`` bytes or a word whose
hash is that of another one go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import textbytes as tb

#: Vocabulary file that the contract names; other files are a parameter.
DEFAULT_VOCAB = "word_bpe_49k.json"
END_ID = 1
LONGEST = 256
_SPACE, _LETTER, _DIGIT, _OTHER, _BAD = 0, 1, 2, 3, 4
_CLASS = np.full(256, _BAD, np.uint8)
_CLASS[0x20:0x7F] = _OTHER
_CLASS[list(b" \t\n\r")] = _SPACE
_CLASS[list(b"0123456789")] = _DIGIT
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = _LETTER
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _LETTER
_CLASS[0xC3] = _LETTER
_LEAD, _TIMES, _DIVIDED = 0xC3, 0x97, 0xB7


def vocab_path(name: str = DEFAULT_VOCAB) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """``encode(column)``: (flat ids, n + 1 offsets), little-endian uint16, or uint32 for larger vocabularies.

    ``cache_bits``: the table has 2**cache_bits places; it is emptied when it is
    more than half full, so memory is bounded whatever the corpus.
    """

    def __init__(self, path: str | None = None, cache_bits: int = 21):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocab_path())
        self.model = self.tokenizer.model
        most = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.dtype = np.dtype("<u2" if most < 1 << 16 else "<u4")
        self._bits = cache_bits
        self._spelled = _byte_alphabet()
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(1 << self._bits, np.uint64)
        self._slot = np.zeros(1 << self._bits, np.int32)
        self._n = 0
        self._at = np.zeros(1, np.int64)  # where the ids of each known word begin
        self._ids = np.zeros(0, self.dtype)
        self._word_at = np.zeros(1, np.int64)  # where the bytes of each known word begin
        self._bytes = np.zeros(0, np.uint8)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each word in the table, or -1."""
        mask, shift = np.uint64((1 << self._bits) - 1), np.uint64(64 - self._bits)
        place = h >> shift
        out = np.full(len(h), -1, np.int32)
        keys = self._keys[place]
        hit = keys == h
        out[hit] = self._slot[place[hit]]
        left = np.flatnonzero(~hit & (keys != 0))
        while len(left):
            place[left] = (place[left] + np.uint64(1)) & mask
            keys = self._keys[place[left]]
            hit = keys == h[left]
            out[left[hit]] = self._slot[place[left[hit]]]
            left = left[~hit & (keys != 0)]
        return out

    def _insert(self, h: np.ndarray, numbers: np.ndarray) -> None:
        mask, shift = np.uint64((1 << self._bits) - 1), np.uint64(64 - self._bits)
        place = h >> shift
        left = np.arange(len(h))
        while len(left):
            free = left[self._keys[place[left]] == 0]
            self._keys[place[free]] = h[free]
            won = free[self._keys[place[free]] == h[free]]
            self._slot[place[won]] = numbers[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            place[left] = (place[left] + np.uint64(1)) & mask

    def _learn(self, h: np.ndarray, spelled: list[str], raw: np.ndarray, lengths: np.ndarray) -> None:
        self._bytes = np.concatenate([self._bytes, raw])
        self._word_at = np.concatenate([self._word_at, self._word_at[-1] + np.cumsum(lengths)])
        tokenize = self.model.tokenize
        ids = [[t.id for t in tokenize(w)] for w in spelled]
        self._insert(h, np.arange(self._n, self._n + len(h), dtype=np.int32))
        self._ids = np.concatenate([self._ids, np.array([i for x in ids for i in x], self.dtype)])
        self._at = np.concatenate([self._at, self._at[-1] + np.cumsum([len(x) for x in ids])])
        self._n += len(h)

    def _others(self, number: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The words that aren't the ones kept under their numbers."""
        size = e - s
        wrong = self._word_at[number + 1] - self._word_at[number] != size
        same = np.flatnonzero(~wrong)
        differ = buf[tb.ragged(s[same], size[same])] != self._bytes[tb.ragged(self._word_at[number[same]], size[same])]
        if differ.any():
            wrong[same[np.searchsorted(np.cumsum(size[same]), np.flatnonzero(differ), "right")]] = True
        return np.flatnonzero(wrong)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, bounds = tb.text_buffers(column)
        n = len(bounds) - 1
        if not len(raw):
            return np.zeros(0, self.dtype), np.zeros(n + 1, np.int64)
        # lower case, and the class of each byte
        buf = tb.LOWER[raw]
        kind = _CLASS[raw]
        trail = np.flatnonzero(raw[:-1] == _LEAD) + 1
        after = raw[trail]
        kind[trail] = np.where((after == _TIMES) | (after == _DIVIDED) | (after < 0x80), _BAD, _LETTER)
        buf[trail] = np.where(after <= 0x9E, after + 0x20, after)
        bad = kind == _BAD
        bad[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
        whole = np.zeros(n, bool)
        whole[np.searchsorted(bounds, np.flatnonzero(bad), "right") - 1] = True
        # words begin where the class changes, at each digit, and as the contractions tell
        first = bounds[:-1][bounds[:-1] < len(raw)]
        earlier = np.zeros(len(raw), np.uint8)
        earlier[1:] = kind[:-1]
        earlier[first] = _SPACE
        start = (kind != _SPACE) & ((kind != earlier) | (kind == _DIGIT))
        for i in np.flatnonzero((buf == 0x27) & start):
            text_end = bounds[np.searchsorted(bounds, i, "right")]
            rest = buf[i + 1 : min(i + 3, text_end)].tobytes()
            k = 1 if rest[:1] in (b"s", b"t", b"m", b"d") else 2 if rest in (b"re", b"ve", b"ll") else 0
            if k and earlier[i] != _OTHER:
                start[i + 1] = False
                if i + 1 + k < text_end:
                    start[i + 1 + k] = kind[i + 1 + k] != _SPACE
        edge = start | (kind == _SPACE)
        edge[first] = True
        edges = np.r_[np.flatnonzero(edge), len(raw)]
        begins = start[edges[:-1]]
        s, e = edges[:-1][begins], edges[1:][begins]
        owner = np.searchsorted(s, bounds)
        whole[np.searchsorted(bounds, s[e - s > LONGEST], "right") - 1] = True
        if whole.any():
            keep = ~np.repeat(whole, np.diff(owner))
            s, e = s[keep], e[keep]
            owner = np.r_[0, np.cumsum(np.where(whole, 0, np.diff(owner)))]
        h = tb.span_hashes(tb.byte_sums(buf), s, e) | np.uint64(1)
        number = self._find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh, where = np.unique(h[new], return_index=True)
            if self._n + len(fresh) > 1 << (self._bits - 1):
                new = np.arange(len(h))
                fresh, where = np.unique(h, return_index=True)
                while len(fresh) > 1 << (self._bits - 1):  # the words of one batch have to fit
                    self._bits += 1
                self._clear()
            at = new[where]
            lengths = e[at] - s[at]
            raw_words = buf[tb.ragged(s[at], lengths)]
            spelled = raw_words.tobytes().decode("latin-1").translate(self._spelled)
            stops = np.cumsum(lengths)
            self._learn(fresh, [spelled[a:b] for a, b in zip((stops - lengths).tolist(), stops.tolist())], raw_words, lengths)
            number[new] = self._find(h[new])
        whole[np.searchsorted(bounds, s[self._others(number, buf, s, e)], "right") - 1] = True
        lengths = self._at[number + 1] - self._at[number]
        ids = self._ids[tb.ragged(self._at[number], lengths)]
        offsets = np.r_[0, np.cumsum(lengths)][owner]
        if whole.any():
            texts = column.fill_null("")
            parts = [self._whole(texts[i].as_py()) if whole[i] else ids[offsets[i] : offsets[i + 1]] for i in range(n)]
            ids = np.concatenate(parts)
            offsets = np.r_[0, np.cumsum([len(p) for p in parts])]
        return ids, offsets


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in that byte-level pre-tokenizers give each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
