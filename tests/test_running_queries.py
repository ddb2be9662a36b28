"""Probes and latencies of running streams, results compared while they come."""

import threading
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_queries import T0, at, bids

from auctionflow import metrics
from auctionflow.operators import sliding, verify
from auctionflow.sources.tables import Tables
from auctionflow.streaming.run import FiniteRun


def started(spark, tmp_path, write=None):
    bids(spark, [(1, 1, 1, 0)]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(bids(spark, [(1, 1, 1, 0)]).schema).parquet(f"{tmp_path}/in").withWatermark("date_time", "0 seconds")
    writer = sliding.window_counts(stream, 5, 5).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/checkpoint")
    return (writer.foreachBatch(write) if write else writer.format("noop")).start()


def test_probe_blocks_until_a_time_has_passed(spark, tmp_path):
    query = started(spark, tmp_path)
    try:
        probe = metrics.Probe(query)
        query.processAllAvailable()
        assert probe.less_than(at(50)) and not probe.wait_for(at(50), timeout_s=0.5)
        came = []

        def later():
            time.sleep(2)
            came.append(time.monotonic())
            bids(spark, [(2, 1, 1, 60)]).write.mode("append").parquet(f"{tmp_path}/in")

        thread = threading.Thread(target=later)
        thread.start()
        assert probe.wait_for(at(50), timeout_s=60) and time.monotonic() > came[0]
        thread.join()
        assert not probe.less_than(at(60)) and probe.less_than(at(61))
    finally:
        query.stop()
    assert not metrics.Probe(query).wait_for(datetime(2100, 1, 1))


def test_event_latency_is_a_histogram_of_rows(spark, tmp_path):
    seen = []

    def write(batch, number):
        seen.extend(batch.collect())

    latency = metrics.EventLatency("window_end", write)
    query = started(spark, tmp_path, latency)
    try:
        for k in range(1, 4):
            bids(spark, [(1, 1, 1, 100 * k + n) for n in range(0, 60, 5)]).write.mode("append").parquet(f"{tmp_path}/in")
            query.processAllAvailable()
        bids(spark, [(1, 1, 1, 1_000)]).write.mode("append").parquet(f"{tmp_path}/in")
        query.processAllAvailable()
        counts = latency.counts()
        assert sum(counts.values()) == len(seen) >= 30
        age = (datetime.now(UTC).replace(tzinfo=None) - T0) / timedelta(microseconds=1) * 1000
        assert all(0.9 * age < ns <= age for ns in counts)
    finally:
        query.stop()


def test_batches_of_latency_by_brute_force(spark):
    """Counts of the rows of a batch on many tasks, against each row's own latency; a batch that comes again replaces its counts."""
    latency = metrics.EventLatency("ts", lambda batch, number: None)
    made = spark.range(5_000).repartition(7).select((F.current_timestamp() - F.make_interval(secs=F.col("id"))).alias("ts"), "id")
    began = time.time()
    latency(made, 0)
    latency(made, 0)
    latency(made.limit(10), 1)
    counts, took = latency.counts(), time.time() - began
    assert sum(counts.values()) == 5_010
    for bound in (0, 60, 600, 3_000, 4_999):  # rows older than so many seconds, give or take the time the batch took
        older = sum(n for ns, n in counts.items() if ns * (1 + 1 / 16) >= bound * 1e9)
        assert 5_000 - bound <= older + 1 and older <= 5_010 - bound + bound / 16 + took + 1
    values = [0, 1, 2, 15, 16, 17, 31, 32, 33, 1_000, 2**40 + 12345, 2**62]
    got = {r["v"]: r["b"] for r in spark.createDataFrame([(v,) for v in values], "v bigint").select("v", metrics.log_bucket(F.col("v")).alias("b")).collect()}
    for v in values:
        size = 1 << max(0, v.bit_length() - 5)
        assert got[v] == v // size * size


@pytest.mark.parametrize("change", ["nothing", "order", "one more", "one less", "one value", "nulls swapped"])
def test_streams_compared(spark, sf_dir, change):
    rows = Tables(spark, sf_dir).bids().where("bidder < 200").orderBy("bidder")
    pick = rows.orderBy(F.desc("bidder")).limit(1)
    if change == "nulls swapped":  # a row with two equal values, one of which is null
        swapped = pick.select(F.lit(None).cast("bigint").alias("auction"), F.lit(7).cast("bigint").alias("bidder"), "price", "date_time"), pick.select(F.lit(7).cast("bigint").alias("auction"), F.lit(None).cast("bigint").alias("bidder"), "price", "date_time")
        rows, other = rows.unionAll(swapped[0]), rows.unionAll(swapped[1])
    else:
        other = {
            "nothing": lambda: rows,
            "order": lambda: rows.orderBy(F.desc("price")),
            "one more": lambda: rows.unionAll(pick),
            "one less": lambda: rows.join(pick, "bidder", "left_anti").select(rows.columns),
            "one value": lambda: rows.withColumn("price", F.when(F.col("bidder") == pick.first()["bidder"], F.col("price") + 1).otherwise(F.col("price"))),
        }[change]()
    found = verify.unequal_times(rows, other).collect()
    if change in ("nothing", "order"):
        assert found == []
    else:
        when = pick.first()["date_time"]
        assert [(r["date_time"], r["more"]) for r in found] == [(when, {"one more": -1, "one less": 1}.get(change, 0))]


def test_streams_compared_as_they_come(spark, sf_dir, tmp_path):
    """Two sources of which one has a row twice; the state holds nothing when both have ended."""
    b = bids(spark, [(n % 7, n, n, n % 50) for n in range(300)])
    b.write.parquet(f"{tmp_path}/a")
    b.repartition(5).write.parquet(f"{tmp_path}/b")
    bids(spark, [(3, 3, 3, 3)]).write.mode("append").parquet(f"{tmp_path}/b")
    run = FiniteRun(spark)
    one, two = (run.ending(spark.readStream.schema(b.schema).parquet(f"{tmp_path}/{x}")) for x in "ab")
    assert [tuple(r) for r in run.append(verify.unequal_times(one, two)).collect()] == [(at(3), -1)]
    assert spark.read.format("statestore").load(f"{run.folder}/checkpoint").count() == 0
