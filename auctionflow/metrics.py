"""Latency distributions, timelines and resident memory of runs."""

from __future__ import annotations

import threading
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime
from pathlib import Path
from typing import TextIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

PERCENTILES = (0.25, 0.5, 0.75, 0.95, 0.99, 0.999, 1.0)


def ccdf(latencies: DataFrame, column: str = "latency_ns", weight: str | None = None) -> DataFrame:
    """(latency_ns, fraction, count): buckets of 1/16 octave and the share of samples at or above each; a row counts ``weight`` times."""
    latencies = latencies.withColumn("_n", F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")).where("_n > 0")
    buckets = latencies.select(log_bucket(F.col(column)).alias("latency_ns"), "_n").groupBy("latency_ns").agg(F.sum("_n").alias("n"))
    rows, out = buckets.orderBy("latency_ns").collect(), []  # at most 16 a doubling: about a thousand
    total = left = sum(r["n"] for r in rows)
    for r in rows:
        out.append((r["latency_ns"], left / total, r["n"]))
        left -= r["n"]
    return latencies.sparkSession.createDataFrame(out, "latency_ns bigint, fraction double, count bigint")


def timeline(latencies: DataFrame, time_ns: str = "time_ns", column: str = "latency_ns", bucket_ms: int = 250, trim_s: float = 0, weight: str | None = None) -> DataFrame:
    """Percentiles (p25, p50, p75, p95, p99, p99.9, max) of each interval; ``trim_s`` seconds are left out at both ends, a row counts ``weight`` times."""
    width = bucket_ms * 1_000_000
    ends = latencies.agg(F.min(time_ns).alias("a"), F.max(time_ns).alias("b")).first()
    if ends["a"] is None:
        return latencies.sparkSession.createDataFrame([], "time_ns bigint, " + ", ".join(f"{n} bigint" for n in ("p25", "p50", "p75", "p95", "p99", "p999", "max")))
    cut = int(trim_s * 1e9)
    kept = latencies.where(F.col(time_ns).between(ends["a"] + cut, ends["b"] - cut)) if cut else latencies
    if weight:
        kept = kept.where(F.col(weight) > 0)
    percentiles = F.percentile(column, list(PERCENTILES), F.col(weight)) if weight else F.percentile_approx(column, list(PERCENTILES), 10_000)
    found = kept.groupBy((F.floor((F.col(time_ns) - ends["a"]) / width) * width).alias("time_ns")).agg(percentiles.alias("p"))
    return found.select("time_ns", *(F.col("p")[i].cast("bigint").alias(n) for i, n in enumerate(("p25", "p50", "p75", "p95", "p99", "p999", "max")))).orderBy("time_ns")


class Probe:
    """How far a running query's event time has come, by its watermark."""

    def __init__(self, query: StreamingQuery):
        self.query = query

    def time(self) -> datetime | None:
        """The last watermark that a batch ran with, in UTC without a zone; None before the first."""
        found = [t for p in self.query.recentProgress[-5:] if (t := p.eventTime.get("watermark"))]
        return max(datetime.fromisoformat(t.replace("Z", "+00:00")).replace(tzinfo=None) for t in found) if found else None

    def less_than(self, t: datetime) -> bool:
        """Whether results of times before ``t`` may still come."""
        now = self.time()
        return now is None or now < t

    def wait_for(self, t: datetime, timeout_s: float | None = None, every_s: float = 0.05) -> bool:
        """Blocks until all before ``t`` has been worked on; False if the query ended or time ran out before that.  A failed query raises."""
        began = time.monotonic()
        while self.less_than(t):
            if not self.query.isActive:
                if self.query.exception():
                    raise self.query.exception()
                return not self.less_than(t)
            if timeout_s is not None and time.monotonic() - began >= timeout_s:
                return False
            time.sleep(every_s)
        return True


def log_bucket(value: Column) -> Column:
    """The lower bound of the bucket of 1/16 octave that holds a value; what is under 1 counts as 0 or 1."""
    whole = F.greatest(value, F.lit(0)).cast("bigint")
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.lit(0), F.length(F.bin(whole)) - 5))  # bin() has a digit a bit
    return whole - whole % size


class EventLatency:
    """Writes the batches of a stream and keeps how long each of their rows took, from event time to when a task emitted it.

    Use as the function of ``foreachBatch``.  Rows are stamped in Arrow batches as
    they are computed, counted in log buckets on every task, and the counts of all tasks are
    added up; counts of batches merge by addition.  A batch that Spark repeats replaces its counts.
    """

    def __init__(self, ts: str, write: Callable[[DataFrame, int], None]):
        self.ts, self.write = ts, write
        self.batches: dict[int, dict[int, int]] = {}

    def __call__(self, batch: DataFrame, number: int) -> None:
        names = batch.columns

        def stamp(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in rows:
                now = pa.array(np.full(r.num_rows, time.time_ns() // 1000), pa.int64())
                yield pa.RecordBatch.from_arrays([*r.columns, now], names=[*names, "_emitted_us"])

        stamped = batch.mapInArrow(stamp, StructType([*batch.schema, StructField("_emitted_us", LongType())])).persist()
        try:
            self.write(stamped.select(names), number)
            latency = (F.col("_emitted_us") - F.unix_micros(F.col(self.ts).cast("timestamp"))) * 1000
            counts = stamped.select(log_bucket(latency).alias("latency_ns")).groupBy("latency_ns").count().collect()  # at most 16 a doubling
            self.batches[number] = {r["latency_ns"]: r["count"] for r in counts}
        finally:
            stamped.unpersist()

    def counts(self) -> dict[int, int]:
        """Rows by bucket, nanoseconds; rows without an event time under None."""
        total: Counter = Counter()
        for counts in self.batches.values():
            total.update(counts)
        return dict(total)


def write_rows(label: str, rows: Iterable[tuple], out: TextIO) -> None:
    """Tab-separated rows, each with its label first."""
    for r in rows:
        print(label, *r, sep="\t", file=out)


class Progress(StreamingQueryListener):
    """Batch latencies of streaming queries: (time_ns, latency_ns, rows).  With ``log``, whole progress reports as JSON lines, at most one each ``every_s`` seconds."""

    def __init__(self, log: TextIO | None = None, every_s: float = 30):
        self.rows: list[tuple[int, int, int]] = []
        self.log, self.every, self.logged = log, every_s, float("-inf")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((time.time_ns(), int(p.batchDuration) * 1_000_000, int(p.numInputRows)))
        if self.log and time.monotonic() - self.logged >= self.every:
            self.logged = time.monotonic()
            print(" ".join(p.json.split()), file=self.log, flush=True)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class ResidentMemory:
    """Prints this process's resident memory (``statm_RSS``, time in ns, bytes) at intervals, in a thread."""

    def __init__(self, out: TextIO, every_s: float = 0.5, page: int = 4096):
        self.out, self.every, self.page = out, every_s, page
        self.ended = threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        began = time.monotonic_ns()
        while not self.ended.is_set():
            pages = int(Path("/proc/self/statm").read_text().split()[1])
            write_rows("statm_RSS", [(time.monotonic_ns() - began, pages * self.page)], self.out)
            self.ended.wait(self.every)

    def __enter__(self) -> ResidentMemory:
        self.thread.start()
        return self

    def __exit__(self, *error) -> None:
        self.ended.set()
        self.thread.join()
