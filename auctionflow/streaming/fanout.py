"""Several queries on one source at once: the source is read once, each batch goes to the feed of every query.

A capture query keeps each batch of the source while it writes, for each feed, the
columns and rows that the feed picks to a folder of the batch.  The queries are
streams over these folders, with checkpoints, watermarks and backends of their own; they
run while the capture runs, or after it for finite inputs, and one that is started later
or fails and resumes replays its feed without reading the source again.

A batch that Spark repeats after a failure is the same batch: folders of it that
are whole are left as they are, others are replaced, so each row comes to a feed once.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .run import FiniteRun, shared_folder

Pick = Callable[[DataFrame], DataFrame]


class FanOut:
    """``feeds``: what each feed takes from the source, by filters and projections; any number of queries may read a feed."""

    def __init__(self, spark: SparkSession, source: DataFrame, feeds: dict[str, Pick]):
        self.spark, self.source, self.feeds = spark, source, feeds
        self.folder = shared_folder(spark, "fanout")
        self.schemas = {name: pick(source).schema for name, pick in feeds.items()}
        for name, schema in self.schemas.items():  # a stream over a folder that isn't there fails
            spark.createDataFrame([], schema).write.parquet(f"{self.folder}/{name}/none")

    def _whole(self, path: str) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(conf).exists(mark)

    def take(self, batch: DataFrame, number: int) -> None:
        """Writes one batch to all feeds."""
        missing = {name: path for name in self.feeds if not self._whole(path := f"{self.folder}/{name}/batch-{number:08d}")}
        if not missing:
            return
        batch = batch.persist()
        try:
            for name, path in missing.items():
                self.feeds[name](batch).write.mode("overwrite").parquet(path)
        finally:
            batch.unpersist()

    def capture(self, **trigger) -> StreamingQuery:
        """Starts reading the source; ``trigger`` as for ``DataStreamWriter.trigger``."""
        writer = self.source.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(**trigger) if trigger else writer).start()

    def read_all(self) -> None:
        """Captures a finite source to its end."""
        captured = self.capture(availableNow=True)
        captured.awaitTermination()
        if captured.exception():
            raise captured.exception()

    def feed(self, name: str) -> DataFrame:
        """A stream of what has come and will come to a feed; each call is a reader of its own."""
        return self.spark.readStream.schema(self.schemas[name]).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}")


def run_finite(fan: FanOut, queries: dict[str, Callable[[FiniteRun, FanOut], DataFrame]], at_once: int = 4) -> dict[str, DataFrame]:
    """Reads a finite source once and runs all queries over its feeds to their end, up to ``at_once`` at a time.

    A query gets its run and the fan-out, and returns the static frame of its results.
    """
    fan.read_all()
    with ThreadPoolExecutor(at_once) as pool:
        started = {name: pool.submit(query, FiniteRun(fan.spark), fan) for name, query in queries.items()}
        return {name: result.result() for name, result in started.items()}
