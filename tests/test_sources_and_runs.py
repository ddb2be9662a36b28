"""Generator, demux, options, registry, metrics, runner."""

import io
import itertools

import pytest
from pyspark.sql import functions as F

from auctionflow import metrics, runner
from auctionflow.config import GeneratorConfig
from auctionflow.operators import verify
from auctionflow.plans.registry import QUERIES, Params, Streams, select
from auctionflow.schema import demux, event_id, event_time, mux
from auctionflow.sources import generator

NAMES = """q3_faster q3_rocksdb q4_flex q4_faster q4_rocksdb q5_faster q5_rocksdb q5_faster_index q5_rocksdb_index q6_faster q6_rocksdb q7_faster q7_rocksdb
q8_faster q8_rocksdb q8_faster_map q8_rocksdb_map window_2_faster_count window_2_faster_rank window_2a_rocksdb_count window_2a_rocksdb_rank
window_2b_rocksdb_count window_2b_rocksdb_rank q3 q4 q5 q5_index q6 q7 q8""".split()


def test_mix_and_ranges(spark):
    people, auctions, bids = generator.generate(spark, 50_000, GeneratorConfig(events_per_second=1_000))
    assert (people.count(), auctions.count(), bids.count()) == (1_000, 3_000, 46_000)
    assert people.select("id").distinct().count() == 1_000 and auctions.select("id").distinct().count() == 3_000
    assert auctions.where("expires <= date_time or reserve <= initial_bid or category not between 10 and 14").isEmpty()
    assert bids.where("price not between 100 and 100000000").isEmpty()
    hot = bids.where("(bidder - 1001) % 100 = 0").count() / 46_000
    assert 0.74 < hot < 0.78
    hot = bids.where("(auction - 1000) % 100 = 0").count() / 46_000
    assert 0.49 < hot < 0.54
    assert people.select("state").distinct().count() == 6 and people.select("city").distinct().count() == 10
    a, b = bids.stat.corr("auction", "price"), bids.stat.corr("bidder", "price")
    assert abs(a) < 0.03 and abs(b) < 0.03


def test_pieces_equal_the_whole(spark):
    c = GeneratorConfig()
    whole = generator.generate(spark, 5_000, c)
    parts = [generator.generate(spark, 2_500, c, first=f) for f in (0, 2_500)]
    for w, x, y in zip(whole, *parts):
        assert verify.same(w, x.unionAll(y))


def test_out_of_order_groups(spark):
    plain = generator.generate(spark, 5_000, GeneratorConfig())[2]
    mixed = generator.generate(spark, 5_000, GeneratorConfig(out_of_order_group_size=50))[2]
    assert verify.same(plain, mixed)
    times = [r["date_time"] for r in mixed.coalesce(1).collect()]
    assert any(a > b for a, b in itertools.pairwise(times))


def test_demux_and_mux(spark):
    streams = generator.generate(spark, 1_000)
    events = mux(*streams)
    assert all(verify.same(a, b) for a, b in zip(streams, demux(events)))
    carried = events.select(F.struct("*").alias("event"))
    assert carried.where(event_id().isNull() | event_time().isNull()).isEmpty()


def test_rate_stream(spark):
    bids = generator.stream(spark, GeneratorConfig(), 200)[2]
    q = bids.writeStream.format("memory").queryName("rate_bids").start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            if spark.table("rate_bids").count():
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert spark.table("rate_bids").count()


def test_options():
    given = {"in-flight-auctions": "7", "us-states": "A,B", "unknown": "x"}
    g = GeneratorConfig.of(given)
    assert (g.in_flight_auctions, g.us_states, g.denominator, g.us_cities[0]) == (7, ("A", "B"), 50, "phoenix")
    assert GeneratorConfig.of(given | {"first-event-rate": 10}).events_per_second == 10
    for wrong in ({"first-event-rate": 10, "next-event-rate": 20}, {"threads": "many"}):
        with pytest.raises(ValueError):
            GeneratorConfig.of(wrong)
    for missing in (["--rate"], ["--option", "threads"]):  # a key without its value
        with pytest.raises(SystemExit):
            runner.parser().parse_args(missing)


def test_registry(spark):
    assert sorted(QUERIES) == sorted(NAMES) and len(NAMES) == 30
    assert [q.name for q in select(["q7", "unknown", "q3", "q7"])] == ["q7", "q3"]
    config = GeneratorConfig(events_per_second=100)
    streams = Streams(*(s.cache() for s in generator.generate(spark, 4_000, config)))
    found = {n: QUERIES[n].plan(streams, Params(2, 3)) for n in NAMES}
    for n in NAMES:  # names that differ in the backend or the form alone
        other = n.replace("rocksdb", "faster").replace("2a_", "2_").replace("2b_", "2_").replace("_index", "").replace("_map", "")
        if other != n and other in found:
            assert verify.same(found[n], found[other]), n
    assert verify.same(found["q5"], found["q5_faster"]) and verify.same(found["q4"], found["q4_flex"])
    assert all(not found[n].isEmpty() for n in ("q3", "q4", "q5", "q6", "q7", "q8", "window_2_faster_count", "window_2_faster_rank"))
    with pytest.raises(ValueError):
        QUERIES["window_2_faster_count"].plan(streams, Params(0, 3))


def test_latency_tables(spark):
    rows = [(i * 1_000_000, 1_000 + i) for i in range(1_000)]
    df = spark.createDataFrame(rows, "time_ns bigint, latency_ns bigint")
    dist = [tuple(r) for r in metrics.ccdf(df).orderBy("latency_ns").collect()]
    assert dist[0][1] == 1.0 and sum(r[2] for r in dist) == 1_000 and all(a[1] > b[1] for a, b in itertools.pairwise(dist))
    lines = metrics.timeline(df).collect()
    assert len(lines) == 4 and lines[0]["max"] == 1_249 and lines[0]["p25"] <= lines[0]["p50"] <= lines[0]["p999"]
    assert len(metrics.timeline(df, trim_s=0.25).collect()) == 2
    assert metrics.timeline(df.where("false")).collect() == []
    # a batch counts for each of its rows, an empty one not at all
    batches = spark.createDataFrame([(0, 100, 3), (1, 900, 1), (2, 5_000, 0)], "time_ns bigint, latency_ns bigint, rows bigint")
    assert [tuple(r)[1:] for r in metrics.ccdf(batches, weight="rows").orderBy("latency_ns").collect()] == [(1.0, 3), (0.25, 1)]
    line = metrics.timeline(batches, weight="rows").first()
    assert (line["p50"], line["max"]) == (100, 900)


def test_runner(spark, tmp_path):
    args = runner.parser().parse_args(["--rate", "200", "--duration", "5", "--queries", "q7", "nothing", "window_2_faster_count", "--print-rss", "--sink", "parquet", "--sink-path", str(tmp_path), "--latency-output", f"{tmp_path}/latency"])
    out = io.StringIO()
    assert list(runner.run(spark, args, out)) == ["q7", "window_2_faster_count"]
    assert "statm_RSS\t" in out.getvalue() and "summary_timeline\t" in out.getvalue()
    assert open(f"{tmp_path}/latency").read().startswith("latency_ccdf\t") and not spark.read.parquet(f"{tmp_path}/q7").isEmpty()


def test_runner_streams(spark, tmp_path):
    args = runner.parser().parse_args(["--rate", "50", "--duration", "12", "--queries", "q7_rocksdb", "--stream", "--metrics", f"{tmp_path}/progress", "--timeline-output", f"{tmp_path}/timeline"])
    assert list(runner.run(spark, args, io.StringIO())) == ["q7_rocksdb"]
    assert '"numInputRows"' in open(f"{tmp_path}/progress").read() and open(f"{tmp_path}/timeline").read().startswith("summary_timeline\t")
