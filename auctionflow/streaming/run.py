"""Running streams: state backends, finite inputs to their very end, sinks."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: State backends by the name that query names carry; the log-structured in-memory one maps to Spark's default provider.
BACKENDS = {
    "memory": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "faster": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "rocksdb": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
#: Beyond all data: a row of this time moves the watermark past every window and timer.
END = "2262-01-01 00:00:00"


#: Settings of the session are changed while a query starts, one at a time.
_starting = threading.Lock()


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir or the context's checkpoint folder; local only where neither is set and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            base = "file://" + tempfile.mkdtemp(prefix="auctionflow-")
        else:
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


@contextmanager
def state_backend(spark: SparkSession, name: str):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, BACKENDS[name])
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class FiniteRun:
    """A query over finite input whose tail is flushed.

    Spark closes a window only when a later event moves the watermark, so the
    last ones of a finite input would stay open.  ``ending`` joins an empty side
    source to a stream; when the input is read to its end, a row at ``END`` is put
    into the side sources and the query is resumed from its checkpoint: the
    watermark passes everything, and all pending results come.
    """

    def __init__(self, spark: SparkSession, backend: str = "rocksdb", delay: str = "0 seconds"):
        self.spark, self.backend, self.delay = spark, backend, delay
        self.folder = shared_folder(spark, "stream")
        self.sides: list[tuple[str, DataFrame]] = []

    def ending(self, stream: DataFrame, ts: str = "date_time") -> DataFrame:
        """``stream`` with a watermark on ``ts`` and an end that the run can announce."""
        path = f"{self.folder}/side-{len(self.sides)}"
        empty = self.spark.createDataFrame([], stream.schema)
        empty.write.parquet(path)
        row = self.spark.range(1).select(*(F.lit(END if f.name == ts else None).cast(f.dataType).alias(f.name) for f in stream.schema))
        self.sides.append((path, row))
        side = self.spark.readStream.schema(stream.schema).parquet(path)
        # the condition on ts keeps the filter above the watermark, which has to see the row
        return stream.unionByName(side).withWatermark(ts, self.delay).where(F.col(ts) < F.lit(END).cast("timestamp"))

    def _once(self, result: DataFrame, mode: str, each: Callable[[DataFrame, int], None] | None, out: str) -> None:
        writer = result.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{self.folder}/checkpoint")
        with _starting, state_backend(self.spark, self.backend):
            query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(out)
        query.awaitTermination()
        if query.exception():
            raise query.exception()

    def append(self, result: DataFrame) -> DataFrame:
        """All rows of an append-mode query, from its Parquet sink."""
        out = f"{self.folder}/out"
        self._once(result, "append", None, out)
        if self.sides:
            for path, row in self.sides:
                row.write.mode("append").parquet(path)
            self._once(result, "append", None, out)
        return self.spark.read.schema(result.schema).parquet(out)

    def append_each(self, result: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``work`` on each batch of an append-mode query, as a static frame; a batch that Spark repeats replaces what it wrote."""
        out = f"{self.folder}/each"
        schema: list = []

        def each(batch: DataFrame, number: int) -> None:
            done = work(batch)
            schema[:] = [done.schema]
            done.write.mode("overwrite").parquet(f"{out}/batch-{number:08d}")

        self._once(result, "append", each, "")
        for path, row in self.sides:
            row.write.mode("append").parquet(path)
        if self.sides:
            self._once(result, "append", each, "")
        reader = self.spark.read.option("recursiveFileLookup", "true")
        return reader.schema(schema[0]).parquet(out) if schema else work(self.spark.createDataFrame([], result.schema))

    def complete(self, result: DataFrame) -> DataFrame:
        """The last state of a complete-mode query: each batch replaces the result."""
        paths: list[str] = []

        def replace(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(path := f"{self.folder}/state-{number}")
            paths.append(path)

        self._once(result, "complete", replace, "")
        return self.spark.read.schema(result.schema).parquet(paths[-1]) if paths else self.spark.createDataFrame([], result.schema)
