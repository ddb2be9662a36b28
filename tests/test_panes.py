"""Hot items by ranges of windows."""

import numpy as np
import pytest
from test_queries import bids

from auctionflow.operators import panes, verify
from auctionflow.plans import logical


@pytest.mark.parametrize("seed", range(5))
def test_best_of_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    slices, length, base = int(rng.integers(1, 9)), int(rng.integers(1, 200)), int(rng.integers(-50, 50))
    rows = sorted({(int(a), int(p)): int(k) for a, p, k in zip(rng.integers(0, 12, 300), rng.integers(base - 20, base + length + 20, 300), rng.integers(1, 4, 300))}.items())
    auction, pane, k = (np.array(x, np.int64) for x in zip(*((a, p, k) for (a, p), k in rows)))
    got_a, got_n = panes.best_of(auction, pane, k, base, length, slices)
    for i in range(length):
        inside = (pane >= base + i) & (pane < base + i + slices)
        counts = {a: int(k[inside & (auction == a)].sum()) for a in set(auction[inside].tolist())}
        n, a = max(((n, a) for a, n in counts.items()), default=(0, 0))
        assert (got_n[i], got_a[i] if n else 0) == (n, a)


@pytest.mark.parametrize("slide,slices", [(1, 1), (2, 5), (7, 3)])
def test_against_other_forms(spark, slide, slices):
    b = bids(spark, [(n * n % 5, n, n, n * 3.7 % 61) for n in range(150)] + [(900, 1, 1, 40_000.0), (901, 1, 1, 40_000.5)])
    assert verify.same(logical.hot_items(b, slide, slices, "direct"), logical.hot_items(b, slide, slices, "incremental"))
    assert verify.same(logical.hot_items(b, slide, slices, "changes"), logical.hot_items(b, slide, slices, "incremental"))
    assert logical.hot_items(b.limit(0), slide, slices, "incremental").count() == 0


def test_chunks_and_pieces(spark, monkeypatch):
    """One auction with most of the bids over many pieces, chunks that cut pieces; the operator's parts run here, as executors don't see the patch."""
    monkeypatch.setattr(panes, "CHUNK", 50)
    length = 4 * panes.PIECE
    rows = sorted({(p // length, a, p): 1 + p % 3 for a in range(5) for p in range(0, 2_000, 1 + 7 * a)}.items())
    spread = sorted({(q, a, p): k for (_, a, p), k in rows for q in {(p - 3) // length, p // length}}.items())
    table = panes.pa.table({c: panes.pa.array([key[i] for key, _ in spread], panes.pa.int64()) for i, c in enumerate(("piece", "auction", "pane"))} | {"k": [k for _, k in spread]})
    got = {r["start"]: (r["n"], r["auction"]) for batch in panes._swept(iter(table.to_batches(max_chunksize=17)), 4) for r in batch.to_pylist()}
    counts = {}
    for (_, a, p), k in rows:
        for s in range(p - 3, p + 1):
            counts[s, a] = counts.get((s, a), 0) + k
    want = {}
    for (s, a), n in counts.items():
        want[s] = max(want.get(s, (0, 0)), (n, a))
    assert got == want
