"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb


#: glibc's; other systems have none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder of this machine only where that is unset and all runs on it (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="auctionflow-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that a lost executor costs no recomputation.

    Its shuffle files go at once: they would else stay until the driver happens to collect its
    garbage, which large inputs don't make it do any sooner.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # planned under the setting
    finally:
        spark.conf.set(_CLEANUP, before)


def discard(checked: DataFrame) -> None:
    """Removes the files of a frame that ``cut`` gave and that nothing will read any more."""
    held = checked._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if held.isDefined():
        path = checked.sparkSession._jvm.org.apache.hadoop.fs.Path(held.get())
        path.getFileSystem(checked.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def own_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: A key of fewer rows is never dealt over several tasks; keys that are, number at most this many.
LEAST_HOT, MOST_HOT = 256, 100_000


def spread_join(rows: DataFrame, small: DataFrame, key: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``small`` (one row a key, ``size``: how many of ``rows`` have it), a hot key's rows over many tasks.

    Keys of over ``total / MOST_HOT`` rows (``LEAST_HOT`` at least) are hot: there
    are at most ``MOST_HOT`` of them, so their number of parts is broadcast.  Their rows are
    dealt by a hash over the parts, and the row of ``small`` is repeated for each part.
    """
    most = max(LEAST_HOT, total // MOST_HOT)
    hot = F.broadcast(small.where(F.col(size) > most).select(*key, F.ceil(F.col(size) / most).cast("int").alias("_parts")))
    part = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_parts", F.lit(1))).cast("int").alias("_part")
    dealt = rows.join(hot, key, "left").select(*rows.columns, part)
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col(size) > most, F.ceil(F.col(size) / most) - 1).otherwise(0).cast("int"))).alias("_part")
    return dealt.join(small.select("*", copies), [*key, "_part"], how).drop("_part")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of 8 MB to Python where the session has Spark's 64: texts are wide, and each task holds a batch several times."""
    if spark.conf.get(_BATCH) in ("67108864b", "64m", "64MB"):
        spark.conf.set(_BATCH, "8m")


def release() -> None:
    """Gives memory that a task is done with back to the system: Python workers are used again, and hold on to it otherwise."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with ``release`` at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def map_text(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], dict[str, object]], most: int = 500_000) -> DataFrame:
    """mapInArrow over slices of about ``most`` bytes of text; ``work`` gets a slice (its ``text`` column is a string) and returns columns."""
    arrow = arrow_schema(schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for a, b in tb.slices(text, most):
                yield to_batch(work(batch.slice(a, b - a)), arrow)

    return df.mapInArrow(released(run), schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}


def arrow_schema(ddl: str) -> pa.Schema:
    """Of a flat DDL string, on the driver or on an executor."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def to_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) and x.type == f.type else pa.array(x, f.type) for f in schema], schema=schema)


def texts(batch: pa.RecordBatch) -> list[str]:
    return ["" if x is None else x for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def keep_rows(df: DataFrame, keep: Callable[[pa.Array], np.ndarray], most: int = 500_000) -> DataFrame:
    """The rows of ``df``, all columns as they are, for whose texts ``keep`` gives True; nothing is shuffled."""
    at = df.columns.index("text")
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tb.slices(batch.column(at), most):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(np.asarray(keep(part.column(at)), bool)))

    return df.mapInArrow(released(run), df.schema)


def id_text_crc(column: str | Column) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) if isinstance(column, str) else F.crc32(column.cast("string").cast("binary"))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ids_crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def bounded_sample(rows: DataFrame, key: str, group: str, per_group: int, max_bytes: int, seed: int) -> list:
    """About ``per_group`` rows of each value of ``group``, chosen by a hash of ``key``; the same rows whatever the partitioning.

    ``rows`` has key, text and group.  The result is bounded: at most
    ``max_bytes`` of text in expectation and texts of over ``max_bytes / 50``
    bytes are left out of the sample (of the sample only).
    """
    size = F.octet_length("text")
    rows = rows.where(size <= max_bytes // 50)
    stats = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).collect()
    share = {}
    for r in stats:
        want = min(per_group, max(1, int(max_bytes / max(1, len(stats)) / max(1.0, r["bytes"] / r["n"]))))
        share[r[group]] = min(1.0, want / r["n"])
    if not share:
        return []
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    limit = F.coalesce(*(F.when(F.col(group).eqNullSafe(F.lit(k)), F.lit(v)) for k, v in share.items()), F.lit(0.0))
    return sorted((r for r in rows.where(place < limit).select(key, "text", group).collect()), key=lambda r: (str(r[key]), r["text"]))
