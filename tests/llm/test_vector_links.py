import math

import numpy as np
import pytest

from auctionflow.llm import common
from auctionflow.llm import vector_links as L

SCHEMA = "vec_id long, embedding array<float>, label int, vec string, rep string, c int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "clash", "clash", 1) for i, v in rows], SCHEMA)


def brute(rows, least=0.95):
    """(vec_id, n_links, component_id, kept) by all pairs; rows are nodes of their own."""
    vectors = []
    for i, v in rows:
        v = None if v is None or i is None or any(x is None for x in v) else np.array(v, np.float32).astype(float)
        vectors.append(v if v is not None and np.isfinite(v).all() and (v != 0).any() else None)
    n, top = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for size in {len(v) for v in vectors if v is not None}:
        own = [k for k, v in enumerate(vectors) if v is not None and len(v) == size]
        m = np.array([vectors[k] / np.abs(vectors[k]).max() for k in own])
        m /= np.sqrt((m * m).sum(1))[:, None]
        for a, b in zip(*np.nonzero(m @ m.T >= least)):
            if a != b:
                n[own[a]] += 1
                top[find(own[a])] = find(own[b])
    least_id = {}
    for k, (i, _) in enumerate(rows):
        least_id.setdefault(find(k), []).append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        first = min((x for x in least_id[find(k)] if x is not None), default=None)
        out.append((i, n[k], first, i == first))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def planted(n, dim, seed):
    """Random vectors, near copies in chains, a large group within the radius, and copies."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    chain = [base[0]]
    for _ in range(40):  # each links with the one before, the ends don't
        step = rng.normal(size=dim)
        chain.append(chain[-1] + 0.25 * np.linalg.norm(chain[-1]) * step / np.linalg.norm(step))
    group = base[1] + 0.2 * np.linalg.norm(base[1]) / math.sqrt(dim) * rng.normal(size=(n // 3, dim))
    pairs = base[2:60] + 0.25 * np.linalg.norm(base[2:60], axis=1)[:, None] / math.sqrt(dim) * rng.normal(size=(58, dim))
    return [*base, *chain, *group, *pairs, *[base[5]] * (n // 4)]


def test_graph_finds_all_of_a_shard():
    v = np.array(planted(900, 32, 1))
    v /= np.sqrt((v * v).sum(1))[:, None]
    v = np.unique(v, axis=0)
    u, x = L.build(v)
    found = set()
    for q, at in L.range_search(v, np.searchsorted(u, np.arange(len(v) + 1)), x, 0.95, 32):
        assert not found & (new := set(zip(q.tolist(), at.tolist()))) and len(new) == len(q)
        found |= new
    true = {(a, b) for a, b in zip(*np.nonzero(v @ v.T >= 0.95)) if a != b}
    assert found <= true and len(found) >= 0.995 * len(true)


def test_shards_and_cells_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD", 400)
    rows = list(enumerate(planted(1200, 24, 2)))
    table = frame(spark, rows)
    got, want = result(L.linked_vectors(table)), brute(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want) and all(a[1] <= b[1] for a, b in zip(got, want))
    assert sum(a == b for a, b in zip(got, want)) >= 0.97 * len(want)
    # shards cut into cells, which cover all pairs
    nodes = common.cut(L.unit_vectors(table).groupBy("vec").agg(L.F.min("vec_id").alias("rep"), L.F.count(L.F.lit(1)).alias("copies")))
    found = common.cut(L.links(nodes, 0.95, 3, 32, most=150))
    got, there = L.audit(nodes, found, 0.95)
    assert there and got >= 0.98 * there
    total = sum((r["n"] + r["copies"] - 1) * r["copies"] for r in nodes.join(found.groupBy("rep").agg(L.F.sum("n").alias("n")), "rep", "left").fillna(0).collect())
    assert 0.99 * sum(r[1] for r in want) <= total <= sum(r[1] for r in want)


def test_low_recall_is_noticed(spark, monkeypatch):
    """With centres and a search that find too little, overlap and beam grow."""
    asked = []
    links = L.links
    monkeypatch.setattr(L, "links", lambda nodes, least, overlap, beam: asked.append(overlap) or links(nodes, 1.1 if len(asked) == 1 else least, overlap, beam))
    rows = list(enumerate(planted(300, 24, 3)))
    assert sum(r[1] for r in result(L.linked_vectors(frame(spark, rows)))) >= 0.99 * sum(r[1] for r in brute(rows))
    assert asked == [3, 6]


def test_query_by_brute_force(spark, sf_dir):
    table = common.table(spark, sf_dir, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert result(L.linked_vectors(table)) == brute(rows)


def test_hostile_rows(spark):
    e = [1.0, 2.0, 3.0]
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, e), (7, e), (7, e), (8, [2.0, 4.0, 6.0]), (None, e), (9, [-1.0, -2.0, -3.0]), (10, [1.0, 2.0]), (11, [1e-30, 2e-30]), (12, [1e30, 2e30]), (13, [1.0, 2.0, 3.0, 0.0]), (14, [0.0, -0.0, 1.0]), (15, [-0.0, 0.0, 1.0])]
    rows += [(7, [0.0, 1.0, 0.0]), (20, [0.0, 2.0, 0.0]), *[(100 + i, [1.0, 1.0, 1.0]) for i in range(700)]]
    assert result(L.linked_vectors(frame(spark, rows))) == brute(rows)
    assert L.linked_vectors(frame(spark, [])).collect() == []


@pytest.mark.parametrize("folder", ["check_s"])
def test_recall_on_a_larger_table(spark, folder):
    import os

    path = f"/root/testdata/{folder}"
    if not os.path.isdir(path):
        pytest.skip("no such table")
    table = common.table(spark, path, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in table.select("vec_id", "embedding").collect()]
    got, want = result(L.linked_vectors(table)), brute(rows)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want) and all(a[1] <= b[1] for a, b in zip(got, want))
