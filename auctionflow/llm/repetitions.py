"""Periodic runs of words: stretches that repeat themselves, found by internal pattern matching.

Words are ``[^\\x20\\x09-\\x0D]+``.  A run is a stretch of words with smallest
period q (words q apart are identical) of at least ``max(LEAST, 2 q)`` words that
no neighbouring word extends.  Texts of a slice are worked on together, one after
another with a separator of its own behind each:

* Doubling ranks the factors of 1, 2, 4, ... words; only factors that occur again are
  sorted further.  The last order is the suffix array (up to the longest factor needed).
* A run of period q in [2 b, 4 b), b a power of two, has a block of b words at
  a multiple of b whose next period starts 2 b to 4 b words on.  The occurrences of
  every such block in these two windows come from a wavelet matrix over the suffix
  array: successors of the window's start within the block's interval.
* Within a window of b starts the occurrences are an arithmetic progression; its
  terms give the candidate periods.  A progression that lies in one periodic stretch
  with the block itself gives none: its terms are multiples of that stretch's period.
* Candidates are extended both ways by ranks, and of equal stretches the smallest period is kept.

``collapse`` drops each word that a run holds behind the run's first period.

Null and empty texts have no words and no runs; rows without doc_id and repeated
rows are documents of their own; an empty table gives no rows.  Texts are read
whole; a text of over half a megabyte is worked on alone, with about 100 bytes of
memory a word.  Of runs with the same length the first start is the greatest run, then the
smallest period.  Other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

LEAST = 12
RUNS = "doc_id bigint, starts array<bigint>, lengths array<bigint>, periods array<bigint>, collapsed string"
_SPACE = "[\\x20\\x09-\\x0D]+"


class WaveletMatrix:
    """Counts and order statistics of ``values`` (0 to 2**bits - 1) within ranges of places, for arrays of queries."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros = bits, []
        for bit in range(bits - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            self.zeros.append(np.r_[0, np.cumsum(zero)])
            values = np.r_[values[zero], values[~zero]]

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values at places low to high - 1 are smaller than ``value``."""
        found = np.zeros(len(low), np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            a, b = zeros[low], zeros[high]
            one = (value >> bit) & 1 == 1
            found += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return found

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value that has ``n`` smaller ones at places low to high - 1; with ``below`` this is the range successor."""
        found = np.zeros(len(low), np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            a, b = zeros[low], zeros[high]
            one = n >= b - a
            found |= np.where(one, 1 << bit, 0)
            n = np.where(one, n - (b - a), n)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return found


class Factors:
    """Ranks of the factors of 2**k words at each place of ``t`` (which ends with a value of its own), for k up to ``levels``.

    ``repeated[k]``: places, and first and last + 1 place in the suffix array, of factors that occur more than once.
    """

    def __init__(self, t: np.ndarray, levels: int):
        m = len(t)
        self.order = np.argsort(t, kind="stable")
        self.ranks: list[np.ndarray] = []
        self.repeated: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        slots, key, rank = np.arange(m), t[self.order], np.empty(m, np.int64)
        for k in range(levels + 1):
            if k:
                at = self.order[slots]
                key = rank[at] * (m + 1) + rank[at + (1 << (k - 1))]
                by = np.argsort(key, kind="stable")
                key, self.order[slots] = key[by], at[by]
                rank = rank.copy()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            at, low, size = self.order[slots], np.repeat(slots[first], size), np.repeat(size, size)
            rank[at] = low
            more = size > 1
            self.ranks.append(rank)
            self.repeated.append((at[more], low[more], (low + size)[more]))
            slots = slots[more]
            if not len(slots):
                break

    def common_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on are those from b on (a != b)."""
        a, start, b = a.copy(), a, b.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, left = self.ranks[k], np.arange(len(a))
            while len(left):  # more than once only for the longest factors
                left = left[rank[a[left]] == rank[b[left]]]
                a[left] += 1 << k
                b[left] += 1 << k
                left = left if k == len(self.ranks) - 1 else left[:0]
        return a - start

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a are those before b (a < b)."""
        a, start, b = a.copy(), a, b.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, left, step = self.ranks[k], np.arange(len(a)), 1 << k
            while len(left):
                left = left[a[left] >= step]
                left = left[rank[a[left] - step] == rank[b[left] - step]]
                a[left] -= step
                b[left] -= step
                left = left if k == len(self.ranks) - 1 else left[:0]
        return start - a


def _candidates(factors: Factors, matrix: WaveletMatrix, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance): blocks of 2**k words and their occurrences that may be a period further on."""
    b = 1 << k
    at, low, high = factors.repeated[k]
    aligned = at % (b // 2 if k == 2 else b) == 0  # the shortest blocks stand at every other word: runs of twelve words have few
    at, low, high = at[aligned], low[aligned], high[aligned]
    places, distances = [], []
    for first, last in [(1, 5), (5, 9), (9, 13), (13, 16)] if k == 2 else [(2 * b, 3 * b), (3 * b, 4 * b)]:
        limit = (1 << matrix.bits) - 1
        skip = matrix.below(low, high, np.minimum(at + first, limit))
        n = matrix.below(low, high, np.minimum(at + last, limit)) - skip
        some = np.flatnonzero(n > 0)
        x, lo, hi, skip, n = at[some], low[some], high[some], skip[some], n[some]
        one = matrix.nth(lo, hi, skip)
        step = np.zeros(len(x), np.int64)
        several = np.flatnonzero(n > 1)
        step[several] = matrix.nth(lo[several], hi[several], skip[several] + 1) - one[several]
        if k > 2:  # a progression in one stretch with the block has no period of its own
            reach = one[several] + (n[several] - 1) * step[several] + b - x[several] - step[several]
            within = factors.common_after(x[several], x[several] + step[several]) >= reach
            n[several[within]] = 0
        places.append(np.repeat(x, n))
        distances.append(np.repeat(one - x, n) + np.repeat(step, n) * tb.ragged(np.zeros(len(n), np.int64), n))
    return np.concatenate(places), np.concatenate(distances)


def runs(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs by start, then period; text i has the words ``ids[bounds[i]:bounds[i + 1]]`` (ids from 0)."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(bounds)
    longest = int(sizes.max(initial=0))
    if longest < least:
        return none, none, none
    text = np.repeat(np.arange(len(sizes)), sizes)
    t = np.empty(len(ids) + len(sizes), np.int64)
    t[np.arange(len(ids)) + text] = ids
    t[bounds[1:] + np.arange(len(sizes))] = int(ids.max()) + 1 + np.arange(len(sizes))
    factors = Factors(t, max(2, (longest // 4).bit_length() - 1))
    if len(factors.ranks) < 3:
        return none, none, none
    matrix = WaveletMatrix(factors.order, len(t).bit_length())
    found = [_candidates(factors, matrix, k) for k in range(2, len(factors.ranks))]
    x, q = (np.concatenate(c) for c in zip(*found))
    start, end = x - factors.common_before(x, x + q), x + q + factors.common_after(x, x + q)
    fit = end - start >= np.maximum(least, 2 * q)
    start, end, q = start[fit], end[fit], q[fit]
    by = np.lexsort((q, end, start))  # of equal stretches the smallest period comes first
    start, end, q = start[by], end[by], q[by]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    start, end, q = start[new], end[new], q[new]
    by = np.lexsort((q, start))
    before = np.searchsorted(bounds[1:] + np.arange(len(sizes)), start, "right")[by]  # separators before it
    return start[by] - before, end[by] - before, q[by]


def _work(batch: pa.RecordBatch, least: int) -> dict[str, object]:
    texts = [t.encode().split() for t in common.texts(batch)]
    bounds = np.r_[0, np.cumsum([len(w) for w in texts], dtype=np.int64)]
    words = pa.array(itertools.chain.from_iterable(texts), pa.binary())
    start, end, q = runs(words.dictionary_encode().indices.to_numpy().astype(np.int64), bounds, least)
    text = np.searchsorted(bounds, start, "right") - 1
    edges = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(edges, start + q, 1)
    np.add.at(edges, end, -1)
    kept = np.cumsum(edges)[:-1] == 0
    whole = np.bincount(text, minlength=len(texts)) == 0
    joined = [b" ".join(w if whole[i] else itertools.compress(w, kept[bounds[i] : bounds[i + 1]])) for i, w in enumerate(texts)]
    offsets = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (start - bounds[text], end - start, q)]
    return {"doc_id": batch.column(0), "starts": lists[0], "lengths": lists[1], "periods": lists[2], "collapsed": pa.array(joined, pa.binary()).cast(pa.string())}


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, starts, lengths and periods of the runs (by start, then period), and the collapsed text."""
    return common.map_text(docs.select("doc_id", "text"), RUNS, lambda batch: _work(batch, least))


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text): each text without the words that repeat a period, joined by one space."""
    return find_runs(docs, least).select("doc_id", F.col("collapsed").alias("text"))


def repeat_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): about a tenth of the texts, by the crc32 of doc_id, repeat their words from some place on, as the query's contract has it.

    Those of h % 10 = 0 (g = h / 10, n words) go on from word a = g % n with the p = 1 + (n - a) / (3 + g % 8) words from there.
    """
    text = F.coalesce("text", F.lit(""))
    h = common.id_text_crc("doc_id")
    g = F.floor(h / F.lit(10))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n = F.size("words")
    some = docs.select("doc_id", text.alias("text"), g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    some = some.withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int"))).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), n - F.col("a"))
    damaged = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return some.select("doc_id", F.when(F.col("a").isNotNull(), damaged).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns: counts, the greatest run, hashes of all runs and of the collapsed text."""
    each = F.arrays_zip("starts", "lengths", "periods")
    best = F.array_max(F.transform(each, lambda r: F.struct(r["lengths"].alias("length"), (-r["starts"]).alias("start"), (-r["periods"]).alias("period"))))
    lines: Column = F.array_join(F.transform(each, lambda r: F.concat(F.concat_ws(",", r["starts"], r["lengths"], r["periods"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("starts").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The runs of documents some of which repeat their tails; one row a document."""
    return digest(find_runs(repeat_tails(docs)))
