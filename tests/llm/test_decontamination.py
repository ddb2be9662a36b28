import hashlib
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from cases import HOSTILE, hostile

from auctionflow.llm import decontamination as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        m = min(10, len(w))
        for a in range(len(w) - m + 1):
            windows.setdefault(tuple(w[a : a + m]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for m in sizes:
            for a in range(len(w) - m + 1):
                if (k := tuple(w[a : a + m])) in windows:
                    hit |= set(range(a, a + m))
                    found |= windows[k]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def check(spark, docs_df, docs, items, **options):
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in D.decontaminate(docs_df, bench, **options).collect()}
    assert got == brute(docs, items)
    return got


def test_planted_passages(spark):
    a = " ".join(f"alpha{i}" for i in range(30))
    b = " ".join(f"beta{i}" for i in range(12))
    items = [(1, a), (2, b), (3, "short one"), (4, None), (5, ""), (None, a), (6, " ".join(a.split()[5:25])), (7, b), (2, "other text of the same id that has more than ten words in it"), (8, "rep " * 15)]
    docs = [
        (1, "x " * 20 + a.upper() + " y"),
        (2, " ".join(a.split()[3:12])),
        (3, " ".join(a.split()[3:13])),
        (4, "A short, one. and short one"),
        (5, a.replace("alpha15", "gamma") + " " + b),
        (6, "rep " * 40),
        (7, None),
        (8, " -- ".join(b.split()) + b),
        (9, "rep " * 9),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = check(spark, df, docs, items)
    assert got[2][1] == 0 and got[3][1] == 10
    # many small blocks give the same as one
    check(spark, df, docs, items, block_bytes=60)


def test_repeated_words_cost_no_more(spark):
    docs = [(1, "word " * 20_000), (2, "word " * 500 + "other " + "word " * 9), (3, "a b " * 3_000)]
    items = [(1, "word " * 5_000), (2, "a b " * 700), (3, "word"), (4, "b a b")]
    index = D.Index([str(i) for i, _ in items], [t for _, t in items], 10, 5)
    began = time.perf_counter()
    words_of = D.Words(pa.array([t for _, t in docs]))
    assert sum(len(p) for p, _, _ in index.hits(words_of)) > 20_000
    assert time.perf_counter() - began < 2
    check(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), docs, items)


def test_windows_of_equal_hash(monkeypatch):
    monkeypatch.setattr(D.tb, "sequence_hashes", lambda h, k: np.full(max(0, len(h) - k + 1), 7, np.uint64))
    index = D.Index(["x", "y", "z"], [" ".join(f"w{i}" for i in range(14)), "one two", "two one"], 10, 5)
    docs = D.Words(pa.array([" ".join(f"w{i}" for i in range(1, 13)) + " two one", "one"]))
    found = [(table.m, int(p), [index.ids[i] for i in table.items[table.bounds[n] : table.bounds[n + 1]]]) for ps, ns, table in index.hits(docs) for p, n in zip(ps, ns)]
    assert found == [(2, 12, ["z"]), (10, 0, ["x"]), (10, 1, ["x"]), (10, 2, ["x"])]


def test_hostile(spark):
    docs = [x for x in HOSTILE]
    check(spark, hostile(spark), docs, [(1, "one two three"), (2, "word " * 12), (3, "ΣΑΣ")])
    check(spark, hostile(spark), docs, [])
    # the join of fingerprints, with a bit map that holds nearly nothing back and with one that does
    for bits in (64, 1 << 20):
        check(spark, hostile(spark), docs, [(1, "one two three"), (2, "word " * 12), (3, "ΣΑΣ")], block_bytes=1, filter_bits=bits)
    assert D.decontaminate(hostile(spark, []), spark.createDataFrame([(1, "a b")], "item_id int, text string"), block_bytes=1).collect() == []
    assert D.decontaminate(hostile(spark, []), spark.createDataFrame([(1, "a b")], "item_id int, text string")).collect() == []


def test_hot_passages_by_join(spark):
    """One passage in a third of the documents and half of the items; the join gives what the index gives, spans and ids too."""
    hot = " ".join(f"hot{i}" for i in range(14))
    docs = [(d, f"own{d} " * 5 + (hot if d % 3 == 0 else f"calm{d} " * 14) + (" tail" * (d % 7))) for d in range(3_000)] + [(3, "again " + hot), (3, None), (None, hot)]
    items = [(i, (hot + f" item{i}") if i % 2 else f"item{i} " * 12) for i in range(40)]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id int, text string")
    by_index, by_join = (sorted(map(repr, D.decontaminate(df, bench, block_bytes=b).collect())) for b in (8_000_000, 1))
    assert by_index == by_join and sum("contaminated=True" in r for r in by_join) == 1_002
    kept = [sorted(map(repr, D.drop_contaminated(df, bench, block_bytes=b).collect())) for b in (8_000_000, 1)]
    assert kept[0] == kept[1] and len(kept[0]) == 2_001


def test_window_of_many_items_costs_a_document_one_key(spark):
    """A sentence in all of 2,000 items and 300 documents: one set of items, whatever the documents; digests as the index has them."""
    hot = " ".join(f"hot{i}" for i in range(12))
    docs = spark.createDataFrame([(d, f"own{d} " * 4 + hot + (" also" + hot if d % 2 else "")) for d in range(300)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, f"{hot} item{i}") for i in range(2_000)], "item_id int, text string")
    _, hits, sets = D._joined(docs, bench, 10, 5, 1 << 20)
    assert sets.count() == 1 and hits.count() == 300 * 3 + 150 * 2
    by_index, by_join = (sorted(map(repr, D.decontaminate(docs, bench, block_bytes=b).drop("spans").collect())) for b in (8_000_000, 1))
    assert by_index == by_join and "n_items=2000" in by_join[0]


@pytest.mark.parametrize("block_bytes", [8_000_000, 2_000])
def test_corpus(spark, sf_dir, block_bytes):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = check(spark, docs, [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()], block_bytes=block_bytes)
    assert any(x[4] for x in got.values()) and not all(x[4] for x in got.values())
