import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from cases import HOSTILE, hostile

from auctionflow.llm import common
from auctionflow.llm import repetitions as R


def brute_runs(words, least=12):
    """Maximal stretches by trying each period; of equal stretches the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            e = s + q
            while e < n and words[e] == words[e - q]:
                e += 1
            if e - s >= max(least, 2 * q):
                found.setdefault((s, e), q)
            s = max(s + 1, e - q + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def brute(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    dropped = {i for s, e, q in found for i in range(s + q, e)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def several(sequences):
    ids = np.array([w for s in sequences for w in s], np.int64)
    bounds = np.r_[0, np.cumsum([len(s) for s in sequences], dtype=np.int64)]
    start, end, q = R.runs(ids, bounds)
    out = [[] for _ in sequences]
    for s, e, p in zip(start.tolist(), end.tolist(), q.tolist()):
        i = int(np.searchsorted(bounds, s, "right")) - 1
        out[i].append((s - int(bounds[i]), e - int(bounds[i]), p))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_by_brute_force(seed):
    random.seed(seed)
    sequences = []
    for _ in range(120):
        kinds = random.choice([1, 2, 2, 3, 5, 40])
        s = [random.randrange(kinds) for _ in range(random.randint(0, 90))]
        for _ in range(random.randint(0, 3)):  # a stretch that repeats, cut anywhere, perhaps with a period inside its period
            unit = [random.randrange(kinds) for _ in range(random.randint(1, 25))]
            unit = unit * random.choice([1, 1, 3]) + unit[: random.randint(0, len(unit))]
            at = random.randint(0, len(s))
            s[at:at] = (unit * 4)[: random.randint(len(unit), 4 * len(unit))]
        sequences.append(s)
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 300:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    sequences += [fibonacci[1], [bin(i).count("1") % 2 for i in range(256)], [0] * 500, [], [1], sequences[0], sequences[0]]
    for s, found in zip(sequences, several(sequences)):
        assert found == brute_runs(s), s


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    values = rng.permutation(300)
    matrix = R.WaveletMatrix(values, 9)
    low = rng.integers(0, 300, 500)
    high = low + rng.integers(0, 301 - low)
    limit = rng.integers(0, 300, 500)
    assert matrix.below(low, high, limit).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(low, high, limit)]
    some = high > low
    n = rng.integers(0, np.maximum(high - low, 1))
    assert matrix.nth(low[some], high[some], n[some]).tolist() == [int(sorted(values[a:b])[k]) for a, b, k in zip(low[some], high[some], n[some])]


def test_query_by_brute_force(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    got = {r["doc_id"]: tuple(r) for r in R.periodic_runs(docs).collect()}
    for r in docs.collect():
        if len((r["text"] or "").split()) < 2500:
            assert got[r["doc_id"]] == brute(r["doc_id"], r["text"])
    assert len(got) == docs.count() and sum(r[1] for r in got.values()) > 10


def test_hostile_rows(spark):
    damaged = next(i for i in range(100, 1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [*HOSTILE, (damaged, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3), (damaged + 1, "the same again " * 12 + "  ende"), (damaged, None)]
    got = sorted((tuple(r) for r in R.periodic_runs(hostile(spark, rows)).collect()), key=repr)
    assert got == sorted((brute(*r) for r in rows), key=repr)
    assert R.periodic_runs(hostile(spark, [])).collect() == []
    texts = {r["doc_id"]: r["text"] for r in R.collapse(hostile(spark, rows)).collect()}
    assert texts[6] == "word" and texts[3] == "one" and texts[0] == ""
