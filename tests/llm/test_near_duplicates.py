import random
import re

import numpy as np
import pytest
import xxhash
from cases import HOSTILE, hostile
from pyspark.sql import functions as F

from auctionflow.llm import near_duplicates as N


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, radius=4):
    """nodes: (doc_id, fingerprint); component by row, as a plain search over all pairs tells."""
    group = list(range(len(nodes)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if (nodes[i][1] ^ nodes[j][1]).bit_count() <= radius or nodes[i][0] == nodes[j][0]:
                group[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(nodes):
        least[top(i)] = min(least.get(top(i), d), d)
    return [least[top(i)] for i in range(len(nodes))]


def check(spark, df, docs, **options):
    got = sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in N.near_duplicates(df, **options).collect() if r["doc_id"] is not None)
    nodes = sorted((d, brute_print(t)) for d, t in docs if d is not None)
    assert [x[:2] for x in got] == nodes
    assert [x[2] for x in got] == brute_components(nodes)
    return got


def test_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = check(spark, docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert any(d != c for d, _, c in got)


def test_hostile(spark):
    got = check(spark, hostile(spark), HOSTILE)
    assert {c for d, _, c in got if d in (0, 1, 2, 9)} == {0} and {c for d, _, c in got if d in (4, 11)} == {4}
    without = [r for r in N.near_duplicates(hostile(spark)).collect() if r["doc_id"] is None]
    assert len(without) == 1 and without[0]["component_id"] is None
    assert N.near_duplicates(hostile(spark, [])).collect() == []


@pytest.mark.parametrize("tree_nodes", [8, 4096])
def test_chains_and_split_trees(spark, tree_nodes):
    random.seed(5)
    codes = {random.getrandbits(64) for _ in range(150)}
    for c in list(codes)[:6]:
        for _ in range(40):  # chains of small steps
            for _ in range(random.randint(1, 4)):
                c ^= 1 << random.randrange(64)
            codes.add(c)
    nodes = list(enumerate(sorted(codes)))
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c, d) for d, c in nodes], "fp bigint, rep bigint")
    found = {r["a"]: r["b"] for r in N.components(N.node_links(df, 4, tree_nodes)).collect()}
    assert [found.get(d, d) for d, _ in nodes] == brute_components(nodes)


def signed(c):
    return c - (1 << 64) if c >> 63 else c


def test_large_group_costs_rows_in_proportion(spark, monkeypatch):
    """100,000 near copies of one text, one of them linked with nothing but a few strangers: no link is lost, and rows grow with the group."""
    random.seed(6)
    base, codes = random.getrandbits(64), set()
    while len(codes) < 100_000:
        c = base
        for b in random.sample(range(64), random.randint(0, 4)):
            c ^= 1 << b
        codes.add(c)
    chain, c = [], base
    for step in range(30):  # away from the group, four bits at a time, in order
        for b in range(2 * step, 2 * step + 4):
            c ^= 1 << (b % 64)
        chain.append(c)
    lone = [random.getrandbits(64) for _ in range(200)]
    nodes = [(signed(c), i) for i, c in enumerate([*codes, *(set(chain) - codes), *lone])]
    df = spark.createDataFrame(nodes, "fp bigint, rep bigint")
    asked = []
    in_cells = N._in_cells
    monkeypatch.setattr(N, "_in_cells", lambda rows, radius: asked.append(rows.count()) or in_cells(rows, radius))
    found = {r["a"]: r["b"] for r in N.components(N.node_links(df, 4, 1024)).collect()}
    masks = len(N.bands(len(nodes), 4))
    assert sum(asked) <= 8 * masks * len(nodes)  # about 98 times with each pair of parts a cell
    group = [i for f, i in nodes if found.get(i, i) == 0]
    assert len(group) >= 100_000
    # who is within four bits of the group, or of one that is, by brute force
    fps = np.array([f for f, _ in nodes], np.int64).view(np.uint64)
    inside = np.arange(len(nodes)) < 100_000
    grown = True
    while grown:
        grown = False
        for i in np.flatnonzero(~inside):
            if (np.bitwise_count(fps[inside] ^ fps[i]) <= 4).any():
                inside[i] = grown = True
    assert sorted(group) == np.flatnonzero(inside).tolist()


@pytest.mark.parametrize("seed", range(2))
def test_large_shards_of_several_groups(spark, seed):
    """Shards whose largest component is part of them only, with small trees."""
    random.seed(20 + seed)
    nodes = set()
    for _ in range(3):
        base = random.getrandbits(64)
        for _ in range(150):
            c = base
            for b in random.sample(range(64), random.choice([1, 2, 3, 7])):
                c ^= 1 << b
            nodes.add(c)
    nodes = list(enumerate(sorted(nodes)))
    df = spark.createDataFrame([(signed(c), d) for d, c in nodes], "fp bigint, rep bigint")
    for tree_nodes, rounds in ((10, 1), (40, 3)):
        found = {r["a"]: r["b"] for r in N.components(N.node_links(df, 4, tree_nodes, rounds)).collect()}
        assert [found.get(d, d) for d, _ in nodes] == brute_components(nodes)


def test_hub_of_100000(spark):
    """A node with 100,000 neighbours, and a path that hangs on the last of them."""
    links = spark.range(1, 100_001).select(F.col("id").alias("a"), F.lit(0).cast("bigint").alias("b"))
    links = links.unionAll(spark.range(100_000, 100_020).select((F.col("id") + 1).alias("a"), F.col("id").alias("b")))
    assert N.components(links).groupBy("b").count().collect() == [(0, 100_020)]


def test_bands_cover_the_radius():
    for n in (10, 10_000, 10**7, 10**11):
        masks = N.bands(n, 4)
        for _ in range(300):
            flips = sum(1 << b for b in random.sample(range(64), 4))
            assert any(m & flips == 0 for m in masks)


def test_majority_beyond_a_byte():
    h = np.random.default_rng(1).integers(0, 1 << 63, 2000, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > 2000)
    assert int(N.majority(h, np.array([0, 2000]))[0]) == want
