"""Runs registered queries over generated events, in one go or as streams.

    python -m auctionflow.runner --rate 10000 --duration 10 --queries q3 q7 --window-slide 1 --window-slice-count 30
"""

from __future__ import annotations

import argparse
import sys
import time
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .config import GeneratorConfig
from .metrics import EventLatency, Progress, ResidentMemory, ccdf, timeline, write_rows
from .plans.registry import Params, Query, Streams, select
from .sources import generator
from .streaming.fanout import FanOut
from .streaming.run import shared_folder, state_backend


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--rate", type=int, default=1_000, help="events a second")
    p.add_argument("--duration", type=int, default=10, help="seconds of events")
    p.add_argument("--queries", nargs="+", default=[])
    p.add_argument("--window-slide", type=float, default=1)
    p.add_argument("--window-slice-count", type=int, default=60)
    p.add_argument("--stream", action="store_true", help="run as streams for the duration; else in one go")
    p.add_argument("--shared", action="store_true", help="as streams, all at once over one reading of the events; else one after another, each with a source of its own")
    p.add_argument("--print-rss", action="store_true")
    p.add_argument("--metrics", metavar="FILE", help="progress reports of streams as JSON lines, every 30 s")
    p.add_argument("--latency-output", help="file of the latency distribution; else the standard output")
    p.add_argument("--timeline-output")
    p.add_argument("--event-latency", metavar="FILE", help="as streams: distribution of the time from a result's event time to its emission")
    p.add_argument("--trim", type=float, default=2, help="seconds at both ends of a stream that the timeline leaves out")
    p.add_argument("--sink", default="noop", help="format that takes the results: noop, console, parquet")
    p.add_argument("--sink-path")
    p.add_argument("--option", nargs=2, action="append", default=[], metavar=("KEY", "VALUE"), help="setting of the generator")
    return p


def _start(spark: SparkSession, query: Query, streams: Streams, args: argparse.Namespace, params: Params, latencies: list[EventLatency]) -> StreamingQuery:
    result, path = query.plan(streams, params), f"{args.sink_path}/{query.name}" if args.sink_path else None
    writer, each = result.writeStream.outputMode(query.mode), None

    def put(batch: DataFrame, number: int) -> None:
        out = batch.write.format(args.sink).mode("overwrite" if path else "append")
        out.save(f"{path}/batch-{number:08d}") if path else out.save()

    if query.finish:
        each = lambda batch, number: put(query.finish(batch), number)
    times = [c for c, kind in result.dtypes if kind == "timestamp"]
    if args.event_latency and times and query.mode == "append":
        each = EventLatency(times[0], each or put)
        latencies.append(each)
    writer = (writer.foreachBatch(each) if each else writer.format(args.sink)).option("checkpointLocation", shared_folder(spark, "runner"))
    with state_backend(spark, query.backend):
        return writer.start(path) if path and not each else writer.start()


def _run_shared(spark: SparkSession, args: argparse.Namespace, config: GeneratorConfig, params: Params, latencies: list[EventLatency]) -> dict[str, float]:
    """All queries at once: one query captures the events, the others follow its feeds."""
    fan = FanOut(spark, generator.numbers(spark, args.rate), generator.picks(config))
    began, running = time.monotonic(), [fan.capture()]
    queries = select(args.queries)
    try:
        for query in queries:
            running.append(_start(spark, query, Streams(*(fan.feed(n).withWatermark("date_time", "0 seconds") for n in fan.feeds)), args, params, latencies))
        running[0].awaitTermination(args.duration)
    finally:
        for query in running:
            query.stop()
    return {q.name: time.monotonic() - began for q in queries}


def run(spark: SparkSession, args: argparse.Namespace, out=sys.stdout) -> dict[str, float]:
    """Seconds by query name."""
    config, params = GeneratorConfig.of({"in-flight-auctions": args.rate * 2592, "events-per-second": args.rate, **dict(args.option)}), Params(args.window_slide, args.window_slice_count)
    took: dict[str, float] = {}
    log = open(args.metrics, "a") if args.metrics else None
    progress, latencies = Progress(log), []
    spark.streams.addListener(progress)
    try:
        with log or nullcontext(), ResidentMemory(out) if args.print_rss else nullcontext():
            if args.shared:
                took |= _run_shared(spark, args, config, params, latencies)
            for query in () if args.shared else select(args.queries):
                began = time.monotonic()
                if args.stream:
                    running = _start(spark, query, Streams(*(s.withWatermark("date_time", "0 seconds") for s in generator.stream(spark, config, args.rate))), args, params, latencies)
                    running.awaitTermination(args.duration)
                    running.stop()
                else:
                    result = query.plan(Streams(*generator.generate(spark, args.rate * args.duration, config)), params)
                    writer = result.write.format(args.sink).mode("overwrite")
                    writer.save(f"{args.sink_path}/{query.name}") if args.sink_path else writer.save()
                    progress.rows.append((time.time_ns(), int((time.monotonic() - began) * 1e9), args.rate * args.duration))
                took[query.name] = time.monotonic() - began
    finally:
        spark.streams.removeListener(progress)
    if progress.rows:
        of_batches = spark.createDataFrame(progress.rows, "time_ns bigint, latency_ns bigint, rows bigint")  # a batch's latency counts for each of its events
        for path, label, table in ((args.latency_output, "latency_ccdf", ccdf(of_batches, weight="rows")), (args.timeline_output, "summary_timeline", timeline(of_batches, trim_s=args.trim if args.stream or args.shared else 0, weight="rows"))):
            rows = [tuple(r) for r in table.collect()]
            with open(path, "w") if path else nullcontext(out) as f:
                write_rows(label, rows, f)
    if counts := [(ns, n) for x in latencies for ns, n in x.counts().items() if ns is not None]:
        with open(args.event_latency, "w") as f:
            write_rows("event_latency_ccdf", [tuple(r) for r in ccdf(spark.createDataFrame(counts, "latency_ns bigint, n bigint"), weight="n").collect()], f)
    return took


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("auctionflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name, seconds in run(spark, args).items():
        print(f"{name}\t{seconds:.3f}")


if __name__ == "__main__":
    main()
