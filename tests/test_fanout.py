"""One source for several queries."""

import io

from auctionflow import runner
from auctionflow.operators import sliding, verify
from auctionflow.plans import catalog, logical
from auctionflow.sources.tables import Tables
from auctionflow.streaming import queries
from auctionflow.streaming.fanout import FanOut, run_finite
from auctionflow.streaming.run import FiniteRun


def test_shared_run_over_tables(spark, sf_dir):
    """Four results of one run, each as its static plan has it; the events are read once."""
    read = []
    capture = FanOut.capture

    def watched(self, **trigger):
        query = capture(self, **trigger)
        query.awaitTermination()
        read.append([p["numInputRows"] for p in query.recentProgress])
        return query

    FanOut.capture = watched
    try:
        fan, got = queries._shared(spark, sf_dir)
    finally:
        FanOut.capture = capture
    for name, static in (("hot_items", "q5_hot_items_sliced"), ("highest_bid", "q7_highest_bid"), ("new_users", "q8_new_users"), ("window_counts", "window_count")):
        out = got[name]
        want = catalog.QUERIES[static](spark, sf_dir)
        times = [c for c, t in out.dtypes if t == "timestamp"]
        assert want.count() and verify.same(want, out.withColumns({c: out[c].cast("timestamp_ntz") for c in times})), name
    assert len(read) == 1 and sum(read[0]) == Tables(spark, sf_dir).read("events").count()
    # a query that comes later replays its feed; the events aren't read again
    late = run_finite_feed(spark, fan)
    assert verify.same(late, sliding.window_counts(Tables(spark, sf_dir).bids(), 86_400, 86_400))


def run_finite_feed(spark, fan):
    run = FiniteRun(spark)
    return run.append(sliding.window_counts(run.ending(fan.feed("bids")), 86_400, 86_400))


def test_batches_come_once(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    fan = FanOut(spark, Tables(spark, sf_dir, streaming=True).read("events"), {"bids": t.bids_of, "people": t.people_of})
    batch = t.read("events")
    fan.take(batch, 0)
    fan.take(batch, 0)  # repeated by Spark after a failure
    (half := f"{fan.folder}/people/batch-{1:08d}")
    batch.limit(3).write.parquet(half)
    assert fan._whole(half)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{half}/_SUCCESS")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)  # a write that didn't end
    fan.take(batch, 1)
    read = lambda name: spark.read.option("recursiveFileLookup", "true").schema(fan.schemas[name]).parquet(f"{fan.folder}/{name}")
    assert read("bids").count() == 2 * t.bids().count() and read("people").count() == 2 * t.new_people().count()


def test_failed_query_is_reported(spark, sf_dir):
    fan = FanOut(spark, Tables(spark, sf_dir, streaming=True).read("events"), {"bids": Tables.bids_of})
    out = run_finite(fan, {"q7": lambda run, f: run.append(logical.highest_bid(run.ending(f.feed("bids")), 86_400))})
    assert out["q7"].count()
    try:
        run_finite(fan, {"wrong": lambda run, f: run.append(f.feed("bids").select("nothing"))})
    except Exception as error:
        assert "nothing" in str(error)
    else:
        raise AssertionError("no error")


def test_runner_shared(spark, tmp_path):
    args = runner.parser().parse_args(["--rate", "50", "--duration", "15", "--queries", "q7_rocksdb", "window_2b_rocksdb_count", "--shared", "--sink", "parquet", "--sink-path", str(tmp_path), "--event-latency", f"{tmp_path}/latency"])
    assert list(runner.run(spark, args, io.StringIO())) == ["q7_rocksdb", "window_2b_rocksdb_count"]
    assert (tmp_path / "q7_rocksdb").exists() and (tmp_path / "window_2b_rocksdb_count").exists()
    written = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/q7_rocksdb").count()
    lines = [line.split("\t") for line in open(f"{tmp_path}/latency").read().splitlines()] if written else []
    assert not written or (lines[0][0] == "event_latency_ccdf" and float(lines[0][2]) == 1.0)


def test_each_result_runs_its_own_query(spark, sf_dir, monkeypatch):
    """Asking for one result doesn't run the other queries, and the source is captured once for all."""
    ran, captured = [], []
    capture = FanOut.capture
    monkeypatch.setattr(FanOut, "capture", lambda self, **trigger: captured.append(1) or capture(self, **trigger))
    own = f"{sf_dir}/../sf0.001"  # a path of its own: results are kept by path
    for name, query in list(queries.SHARED.items()):
        monkeypatch.setitem(queries.SHARED, name, lambda run, fan, name=name, query=query: ran.append(name) or query(run, fan))
    first = queries.shared(spark, own, "highest_bid")
    assert ran == ["highest_bid"] and first.count()
    assert queries.shared(spark, own, "highest_bid") is first and queries.shared(spark, own, "window_counts").count()
    assert ran == ["highest_bid", "window_counts"] and captured == [1]
