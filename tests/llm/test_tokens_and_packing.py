import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import HOSTILE, hostile
from tokenizers import Tokenizer

from auctionflow.llm import packing, token_files
from auctionflow.llm import textbytes as tb
from auctionflow.llm.tokens import WordEncoder, vocab_path


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(vocab_path())


def encoded(plain, text):
    return np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_encoder_equals_library(plain):
    random.seed(3)
    texts = [t for _, t in HOSTILE] + ["".join(random.choice("aé's. 9t'reÉ!-\nlL×ß") for _ in range(random.randint(0, 30))) for _ in range(2000)]
    for bits in (4, 21):  # the first is emptied all the time
        encoder = WordEncoder(cache_bits=bits)
        for a in range(0, len(texts), 500):
            part = texts[a : a + 500]
            ids, offsets = encoder.encode(pa.array(part))
            assert [ids[x:y].tolist() for x, y in zip(offsets, offsets[1:])] == [encoded(plain, t)[:-1].tolist() for t in part]


def test_words_of_equal_hash(plain):
    """Words of 64 bytes whose polynomial hashes would be equal are beyond reach; equal keys are put into the table by hand."""
    encoder = WordEncoder()
    real = tb.span_hashes
    try:
        tb.span_hashes = lambda sums, s, e: np.full(len(s), 12345, np.uint64)  # all words have one hash
        texts = ["alpha beta alpha", "gamma", "beta beta", "alpha", "delt"]
        for part in (texts, texts[::-1]):
            ids, offsets = encoder.encode(pa.array(part))
            assert [ids[x:y].tolist() for x, y in zip(offsets, offsets[1:])] == [encoded(plain, t)[:-1].tolist() for t in part]
    finally:
        tb.span_hashes = real
    thue = "a"
    for _ in range(11):
        thue += thue.translate(str.maketrans("ab", "ba"))
    pair = [thue, thue.translate(str.maketrans("ab", "ba"))]
    ids, offsets = encoder.encode(pa.array(pair))
    assert [ids[x:y].tolist() for x, y in zip(offsets, offsets[1:])] == [encoded(plain, t)[:-1].tolist() for t in pair]


def test_corpus_equals_library(spark, plain):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    ids, offsets = WordEncoder().encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == encoded(plain, t)[:-1].tolist()


def test_token_files_round_trip(spark, plain):
    docs = sorted(HOSTILE, key=lambda r: (r[0] is not None, r[0] or 0))
    got = token_files.token_files(hostile(spark), length=16, rows=8).orderBy("start").collect()
    at = 0
    assert [r["doc_id"] for r in got] == [d for d, _ in docs]
    for r, (_, text) in zip(got, docs):
        ids = encoded(plain, text)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_files(hostile(spark, [])).collect() == []


def test_sequences_by_number(spark, plain, tmp_path):
    manifest = token_files.write_token_files(hostile(spark), f"file://{tmp_path}", length=32, rows=4)
    for m in manifest:
        file = token_files.SequenceFile(m["path"])
        rows = [file.sequence(i) for i in range(m["n_sequences"])]
        assert all(len(ids) == len(mask) == 32 for ids, mask in rows)
        flat = np.concatenate([ids[mask] for ids, mask in rows])
        assert len(flat) == m["n_tokens"] and (flat.tolist() == np.concatenate([ids for _, _, ids in file.documents()]).tolist())


def check_packing(got, docs, plain, capacity):
    want = sorted((d is not None, d or 0, k // capacity, k, len(p := ids[k : k + capacity]), zlib.crc32(p.tobytes())) for d, t in docs for ids in [encoded(plain, t)] for k in range(0, len(ids), capacity))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r["length"] for r in got) // capacity)


def test_packing(spark, plain, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    used, least = check_packing(packing.pack_documents(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], plain, 4096)
    assert used <= least + 1
    check_packing(packing.pack_documents(hostile(spark), capacity=64, shard_docs=4).collect(), HOSTILE, plain, 64)
    assert packing.pack_documents(hostile(spark, [])).collect() == []


def test_local_search_beats_best_fit():
    rng = np.random.default_rng(0)
    saved = 0
    for _ in range(40):
        lengths = rng.integers(20, 61, 60)
        bins = packing.pack(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(lengths[b].sum() <= 100 for b in bins)
        before = len(packing.best_fit_decreasing(lengths, 100))
        assert len(bins) <= before
        saved += before - len(bins)
    assert saved >= 10


def test_search_ends_only_without_an_exchange():
    lengths = np.random.default_rng(2).integers(820, 1500, 700)
    bins = packing.pack(lengths, 4096)
    fill = [int(lengths[b].sum()) for b in bins]
    assert len(bins) > -(-int(lengths.sum()) // 4096)
    for a, items in enumerate(bins):
        if fill[a] == 4096:
            continue
        for b, others in enumerate(bins):
            if a == b or fill[b] == 4096:
                continue
            back = [0, *lengths[others].tolist(), *(int(lengths[j] + lengths[k]) for n, j in enumerate(others) for k in others[:n])]
            for x in lengths[items].tolist():
                assert not any(0 < x - y <= 4096 - fill[b] and fill[b] + x - y > fill[a] for y in back), (a, b, x)


def test_shards_get_each_length_evenly(spark, plain):
    docs = [(i, "the " * (39 if i % 2 else 23)) for i in range(800)]
    docs = [(i, t.strip()) for i, t in docs]
    sizes = {len(encoded(plain, t)) for _, t in docs}
    assert sizes == {24, 40}
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    used, least = check_packing(packing.pack_documents(df, capacity=64, shard_docs=20).collect(), docs, plain, 64)
    assert used == least == 400
