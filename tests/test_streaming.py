"""Streams flushed to their end give what the static plans give."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_queries import T0, at, auctions, bids

from auctionflow.operators import closing, sliding, verify
from auctionflow.plans import catalog, logical
from auctionflow.streaming import stateful
from auctionflow.streaming.run import FiniteRun


def as_stream(spark, df, tmp_path, name, parts=1):
    path = f"{tmp_path}/{name}"
    for i in range(parts):
        df.where(F.pmod(F.hash(*df.columns), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(path)


@pytest.mark.parametrize("name", ["q3", "q5", "q7", "q8", "window_count", "window_rank"])
def test_twins_over_tables(spark, sf_dir, name):
    static = {"q3": "q3_local_items", "q5": "q5_hot_items_direct", "q7": "q7_highest_bid", "q8": "q8_new_users"}.get(name, name)
    want = catalog.QUERIES[static](spark, sf_dir)
    assert want.count() and verify.same(want, catalog.QUERIES[f"stream_{name}"](spark, sf_dir))


def test_winning_bids_and_averages(spark, tmp_path):
    rows = [(i, 10, i * 3, i * 3 + 100, i % 4, 10 + i % 3) for i in range(60)]
    made = [(i, (i * 7 + k) % 9, 5 + (i * k * 13) % 40, i * 3 - 20 + k * 25) for i in range(70) for k in range(6)]
    a, b = auctions(spark, rows), bids(spark, made)
    run = FiniteRun(spark)
    got = run.append(stateful.winning_bids(run.ending(as_stream(spark, a, tmp_path, "a")), run.ending(as_stream(spark, b, tmp_path, "b"))))
    want = closing.winning_bids(a, b)
    assert want.count() > 20 and verify.same(want, got)
    landed = spark.readStream.schema(got.schema).parquet(f"{run.folder}/out")
    assert verify.same(logical.category_average(want), FiniteRun(spark).complete(logical.category_average(landed)))
    assert verify.same(logical.last_average(want, last=3), FiniteRun(spark).append(stateful.last_average(landed, last=3)))


@pytest.mark.parametrize("form", ["direct", "sliced"])
def test_hot_items_forms(spark, tmp_path, form):
    b = bids(spark, [(n * n % 7, n, n, n * 3.7 % 61) for n in range(150)])
    run = FiniteRun(spark)
    got = run.append(logical.hot_items(run.ending(as_stream(spark, b, tmp_path, "b", 3)), 2, 5, form))
    assert verify.same(logical.hot_items(b, 2, 5), got)


@pytest.mark.parametrize("backend", ["memory", "rocksdb"])
def test_backends(spark, tmp_path, backend):
    b = bids(spark, [(n % 7, n, n, n * 3.7 % 61) for n in range(150)])
    run = FiniteRun(spark, backend)
    got = run.append(sliding.window_counts(run.ending(as_stream(spark, b, tmp_path, "b", 3)), 2, 10))
    assert verify.same(sliding.window_counts(b, 2, 10), got)
    assert got.agg({"window_end": "max"}).first()[0] > T0 + timedelta(seconds=60) and at(0) == T0


def test_winning_bids_in_batches(spark, tmp_path):
    """Several batches, auctions of several spans of ids, bids before their auctions, nulls, equal bids; no state is left."""
    rows = [(i * 40, None if i % 7 == 0 else 10, i * 3, i * 3 + 100, i % 4, 10 + i % 3) for i in range(90)]
    made = [((i * 40), None if (i + k) % 11 == 0 else (i * 7 + k) % 9, 5 + (i * k * 13) % 40, i * 3 - 20 + k * 25) for i in range(100) for k in range(6)]
    made += [(None, 1, 90, 50), (40, 1, None, 50), (80, 4, 1_000, 60), (80, 2, 1_000, 60), (80, 3, 1_000, 61)]
    a, b = auctions(spark, rows), bids(spark, made)
    want = closing.winning_bids(a, b)
    run, streams = FiniteRun(spark, delay="400 seconds"), []
    for x, name in ((a, "a"), (b, "b")):
        as_stream(spark, x, tmp_path, name, 5)
        streams.append(run.ending(spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/{name}")))
    got = run.append(stateful.winning_bids(*streams))
    assert want.count() > 30 and verify.same(want, got)
    assert spark.read.format("statestore").option("stateVarName", "auctions").load(f"{run.folder}/checkpoint").count() == 0
