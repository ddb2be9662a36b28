"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words, and beginnings of words, that labelled toxic
documents hold far more often than others, with their log-odds as weights.
Features are densities of lexicon hits, their nearness to second-person words,
capitals, punctuation and obfuscation rates.  Lexicon features of a training row
come from lexicons learned without its fold, so the trees see them as they are
on new rows; the isotonic calibration is fitted on predictions for folds that
neither lexicon nor trees have seen.

Training takes a bounded sample of labelled rows (``per_class`` of each label,
``max_bytes`` of text in all) and runs on the driver; the model, at most
``MOST_ENTRIES`` hashes and a few thousand numbers, is broadcast.  Texts are
scored whole, batch by batch.

Null and empty texts have all densities zero and get the score of that; with no
labelled rows of one class, the score is the share of label 1 (0 without any).
Labels without an id or value are ignored; an id with several labels counts for
each.  Repeated rows give a row each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb
from .boosting import Trees, isotonic

SCORED = "doc_id bigint, held_out boolean, score double, predicted int"
FOLDS, MOST_ENTRIES, THRESHOLD = 3, 20_000, 0.7
PREFIXES = (4, 5, 6, 7, 8)  # bytes
NEAR = 5  # words
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú usted ustedes vosotros os ti tus".split()
#: Signs that stand for letters.
_STANDS_FOR = np.arange(256, dtype=np.uint8)
for _sign, _letter in zip(b"013457@$!", b"oieastasi"):
    _STANDS_FOR[_sign] = _letter
_MASKED = tb.WORD_BYTE.copy()
_MASKED[list(b"@$!*_-")] = True


def _hash_words(words: list[str]) -> np.ndarray:
    raw, bounds = tb.text_buffers(pa.array(words))
    return np.sort(tb.span_hashes(tb.byte_sums(raw), bounds[:-1], bounds[1:]))


@dataclass
class Batch:
    """What lexicons are looked up in: hashes of words, of their beginnings and of words with signs read as letters."""

    n: int
    owner: np.ndarray
    hashes: np.ndarray
    prefixes: dict[int, tuple[np.ndarray, np.ndarray]]  # k -> (word index, hash)
    masked: tuple[np.ndarray, np.ndarray]  # (text, hash)
    plain: np.ndarray  # features that need no lexicon
    near: np.ndarray  # of each word: a second-person word is near


def _in(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each hash in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return np.where(keys[at] == h, at, -1)


def read(column: pa.Array) -> Batch:
    raw, bounds = tb.text_buffers(column)
    n = len(bounds) - 1
    buf = tb.LOWER[raw]
    starts, ends, first = tb.words(buf, bounds)
    owner = np.repeat(np.arange(n), np.diff(first))
    sums = tb.byte_sums(buf)
    hashes = tb.span_hashes(sums, starts, ends)
    size = ends - starts
    prefixes = {}
    for k in PREFIXES:
        long = np.flatnonzero(size > k)
        prefixes[k] = (long, tb.span_hashes(sums, starts[long], starts[long] + k))
    signs = _STANDS_FOR[buf]
    s2, e2, first2 = tb.words(signs, bounds, _MASKED[buf])
    changed = np.r_[0, np.cumsum(signs != buf)]
    odd = changed[e2] > changed[s2]
    owner2 = np.repeat(np.arange(n), np.diff(first2))[odd]
    masked = (owner2, tb.span_hashes(tb.byte_sums(signs), s2[odd], e2[odd]))
    second = _in(hashes, _hash_words(SECOND_PERSON)) >= 0
    run = np.r_[0, np.cumsum(second)]
    low = np.maximum(np.arange(len(owner)) - NEAR, first[:-1][owner])
    high = np.minimum(np.arange(len(owner)) + NEAR + 1, first[1:][owner])
    near = run[high] > run[low]

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)

    words = np.maximum(np.diff(first), 1)
    chars = np.maximum(np.diff(bounds), 1)
    upper = (raw >= 65) & (raw <= 90)
    upper_run = np.r_[0, np.cumsum(upper)]
    shouted = np.bincount(owner, ((upper_run[ends] - upper_run[starts] == size) & (size > 1)), n)
    marks = np.isin(raw, list(b"!?"))
    punctuation = (raw < 128) & ~tb.WORD_BYTE[buf] & (raw > 32)
    same = np.r_[False, raw[1:] == raw[:-1]]
    thrice = same & np.r_[False, same[:-1]] & (raw != 32)
    digits = (buf >= 48) & (buf <= 57)
    digit_run = np.r_[0, np.cumsum(digits)]
    mixed = np.bincount(owner, ((d := digit_run[ends] - digit_run[starts]) > 0) & (d < size), n)
    plain = np.stack(
        [
            np.log1p(np.diff(first)), np.log1p(np.diff(bounds)), np.bincount(owner, size, n) / words, per_text(upper) / chars, shouted / words,
            per_text(marks) / words, per_text(punctuation) / chars, per_text(thrice) / chars, mixed / words, np.bincount(owner2, minlength=n) / words,
            per_text(raw >= 128) / chars, np.bincount(owner, second, n) / words,
        ],
        axis=1,
    )
    return Batch(n, owner, hashes, prefixes, masked, plain, near)


@dataclass
class Lexicon:
    keys: np.ndarray  # of words
    weight: np.ndarray
    prefix_keys: np.ndarray
    prefix_weight: np.ndarray

    def features(self, b: Batch) -> np.ndarray:
        words = np.maximum(np.bincount(b.owner, minlength=b.n), 1)
        at = _in(b.hashes, self.keys)
        value = np.where(at >= 0, self.weight[at] if len(self.weight) else 0, 0.0)
        deep = np.zeros(len(b.owner))
        for word, h in b.prefixes.values():
            place = _in(h, self.prefix_keys)
            hit = np.flatnonzero(place >= 0)
            np.maximum.at(deep, word[hit], self.prefix_weight[place[hit]])
        both = np.maximum(value, deep)
        masked = _in(b.masked[1], self.keys) >= 0
        out = []
        for v in (value, deep):
            hits = np.bincount(b.owner, v > 0, b.n)
            top = np.zeros(b.n)
            np.maximum.at(top, b.owner, v)
            out += [hits, hits / words, np.bincount(b.owner, v, b.n) / words, top]
        strong = both > 4
        out += [np.bincount(b.owner, both, b.n), np.bincount(b.owner, strong, b.n), np.bincount(b.owner, (both > 0) & b.near, b.n), np.bincount(b.owner, (both > 0) & b.near, b.n) / words, np.bincount(b.masked[0], masked, b.n)]
        return np.column_stack([b.plain, *out])


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]  # hashes, and in how many texts of label 1 and 0 each occurs


def _merged(parts: list[Counts]) -> Counts:
    keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *(np.bincount(place, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int32) for i in (1, 2))


def count_entries(b: Batch, y: np.ndarray) -> tuple[Counts, Counts]:
    """Of words and of beginnings of words."""

    def of(owner: np.ndarray, h: np.ndarray) -> Counts:
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
        new = np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
        keys, place = np.unique(h[new], return_inverse=True)
        label = y[owner[new]]
        return keys, np.bincount(place, label == 1, len(keys)).astype(np.int32), np.bincount(place, label == 0, len(keys)).astype(np.int32)

    return of(b.owner, b.hashes), _merged([of(b.owner[w], h) for w, h in b.prefixes.values()])


def learn_lexicon(counts: list[tuple[Counts, Counts]], n1: int, n0: int) -> Lexicon:
    """Entries that toxic texts hold at odds of over ``e**2`` against the others, and in more than chance would put there."""

    def entries(parts: list[Counts]) -> tuple[np.ndarray, np.ndarray]:
        keys, c1, c0 = _merged(parts)
        odds = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
        expected = (c1 + c0) * n1 / max(1, n1 + n0)
        strength = (c1 - expected) / np.sqrt(expected + 0.25)
        good = (odds > 2) & (c1 >= max(3, 0.004 * n1)) & (strength > 4)
        keep = np.flatnonzero(good)
        if len(keep) > MOST_ENTRIES // 2:
            keep = np.sort(keep[np.argsort(-strength[keep], kind="stable")[: MOST_ENTRIES // 2]])
        return keys[keep], odds[keep]

    return Lexicon(*entries([w for w, _ in counts]), *entries([p for _, p in counts]))


@dataclass
class Model:
    lexicon: Lexicon | None
    trees: Trees | None
    centres: np.ndarray
    means: np.ndarray
    constant: float = 0.0

    def score(self, batch: Batch) -> np.ndarray:
        if self.trees is None:
            return np.full(batch.n, self.constant)
        return self.calibrated(self.trees.margin(self.lexicon.features(batch)))

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        """Isotonic means, with a hundredth of the trees' own probability so that steps keep their order."""
        return np.clip(0.99 * np.interp(margin, self.centres, self.means) + 0.01 / (1 + np.exp(-margin)), 0, 1)


def fit(texts: list[str], labels: list[int]) -> Model:
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(None, None, np.zeros(0), np.zeros(0), float(y.mean()) if len(y) else 0.0)
    fold = np.arange(len(y)) % FOLDS
    portions = [(k, own[a : a + 400]) for k in range(FOLDS) for own in [np.flatnonzero(fold == k)] for a in range(0, len(own), 400)]
    batch = lambda part: read(pa.array([texts[i] for i in part], pa.string()))  # noqa: E731  read again when needed: only counts stay in memory
    counts = []
    for k in range(FOLDS):
        own = [count_entries(batch(part), y[part]) for f, part in portions if f == k]
        counts.append(tuple(_merged(list(c)) for c in zip(*own)) if own else None)

    def lexicon(left_out: int | None) -> Lexicon:
        rest = [k for k in range(FOLDS) if k != left_out and counts[k]]
        labels = y[np.isin(fold, rest)]
        return learn_lexicon([counts[k] for k in rest], int((labels == 1).sum()), int((labels == 0).sum()))

    without = [lexicon(k) for k in range(FOLDS)]
    x = np.concatenate([without[k].features(batch(part)) for k, part in portions])
    target = np.concatenate([y[part] for _, part in portions])
    at = np.concatenate([np.full(len(part), k) for k, part in portions])
    margin = np.zeros(len(target))
    for k in range(FOLDS):
        margin[at == k] = Trees().fit(x[at != k], target[at != k]).margin(x[at == k])
    centres, means = isotonic(margin, target)
    return Model(lexicon(None), Trees().fit(x, target), centres, means)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, max_bytes: int = 12_000_000) -> Model:
    """On labelled rows whose crc32(doc_id as text) mod 3 is not 1."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(F.pmod(common.id_text_crc("doc_id"), F.lit(3)) != 1).select("doc_id", "toxic")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(8)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return fit([], [])
    share = F.coalesce(*(F.when(F.col("toxic") == k, F.lit(min(1.0, per_class / n))) for k, n in counts.items()))
    chosen = known.where(place < share)  # about 2 x per_class rows: small enough to broadcast
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    sample = common.bounded_sample(rows, "doc_id", "toxic", per_class, max_bytes, seed=9)
    model = fit([r["text"] for r in sample], [r["toxic"] for r in sample])
    del sample
    common.release()  # the driver works on beside its model
    return model


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))
    held_out = F.coalesce(F.pmod(common.id_text_crc("doc_id"), F.lit(3)) == 1, F.lit(False)).alias("held_out")

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        s = model.value.score(read(batch.column(1)))
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

    return common.map_text(docs.select("doc_id", "text", held_out), SCORED, work)


def reject(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that the score rejects; all columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))
    return common.keep_rows(docs, lambda text: model.value.score(read(text)) < THRESHOLD)
