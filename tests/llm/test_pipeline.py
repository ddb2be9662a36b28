import re
import zlib

import corpus_pipeline
import numpy as np
from cases import HOSTILE, hostile
from test_findings import brute_private
from test_similar_texts import brute_kept
from tokenizers import Tokenizer

from auctionflow.llm import common, private_data, toxicity
from auctionflow.llm.tokens import vocab_path
from test_decontamination import brute as brute_contaminated


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = common.table(spark, sf_dir, "documents")
    columns = docs.columns
    bench = [(r["item_id"], r["text"]) for r in common.table(spark, sf_dir, "benchmark").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf_dir).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        rows = {r["doc_id"]: r["text"] for r in before.collect()}
        if name != "packing":
            assert after.columns == columns
            kept = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score(before, common.table(spark, sf_dir, "labels")).where("predicted = 1").collect()}
            assert set(kept) == set(rows) - bad
        elif name == "near_duplicates":
            assert sorted(kept) == brute_kept(list(rows.items()))
        elif name == "decontamination":
            assert set(kept) == {d for d, x in brute_contaminated(list(rows.items()), bench).items() if not x[4]}
        elif name == "private_data":
            assert set(kept) == set(rows)
            assert not any(brute_private(t) for t in kept.values()) and any("[EMAIL]" in t for t in kept.values())
            for d, t in rows.items():
                if not re.search("[0-9@]", t):
                    assert kept[d] == t
        else:
            assert {r["doc_id"] for r in after.select("doc_id").collect()} == set(rows)
        before = after


def test_run_by_brute_force(spark, sf_dir):
    """Which documents come out, each piece's ids, and a packing without gaps or overlaps; toxicity and masks by their operators, whose own tests compare them."""
    docs = common.table(spark, sf_dir, "documents")
    bad = {r["doc_id"] for r in toxicity.score(docs, common.table(spark, sf_dir, "labels")).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in bad]
    first = set(brute_kept(rows))
    rows = [(d, t) for d, t in rows if d in first]
    bench = [(r["item_id"], r["text"]) for r in common.table(spark, sf_dir, "benchmark").collect()]
    leaks = brute_contaminated(rows, bench)
    rows = [(d, t) for d, t in rows if not leaks[d][4]]
    clean = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain, want = Tokenizer.from_file(vocab_path()), {}
    for r in private_data.mask(clean).collect():
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want[r["doc_id"], piece] = (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == want and len(out) == len(want) > 50
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        assert [at for at, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 4096
    assert len(sequences) <= 1.1 * sum(n for _, n, _ in want.values()) / 4096 + 1


def test_training_gives_memory_back(spark, sf_dir, monkeypatch):
    """The driver keeps the model of a stage, not the memory that its training took, while the next stages run."""
    given = []
    monkeypatch.setattr(common, "release", lambda: given.append(True))
    docs = common.table(spark, sf_dir, "documents")
    toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    private_data.train(docs)
    assert len(given) == 2


def test_stages_on_hostile_rows(spark, sf_dir):
    """All stages bear nulls, empty and very long texts, repeated rows, clashing columns and an empty table, and keep the columns."""
    for rows in (HOSTILE, []):
        docs = hostile(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            kept = out.collect()
            if name == "near_duplicates":
                assert sorted({r["doc_id"] for r in kept} - {None}) == brute_kept(rows)
            else:
                assert len(kept) == len(rows), name
                assert all((r["text"] is None) == (r["doc_id"] in (0, 9)) for r in kept)
        assert len({r["doc_id"] for r in corpus_pipeline.packed(spark, docs, sf_dir).collect()}) == len({d for d, _ in rows})
