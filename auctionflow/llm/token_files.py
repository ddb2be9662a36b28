"""Token ids as Arrow files of fixed-size lists.

``write_token_files`` encodes documents in ascending ``doc_id`` order.  Each
range partition becomes one Arrow IPC file of record batches with ``rows``
sequences: ``input_ids`` is a fixed-size list of ``length`` ids (uint16 where the
vocabulary allows, else uint32), ``mask`` a fixed-size list of ``length / 8``
bytes, a bit for each id (0: padding at the end of the file).  Any sequence is at
a place that follows from its number, so readers map the file and take views
without a copy.  A second file of the same name, ``.index``, has doc_id, start
and n_tokens of each document within the file.

The files go to a folder that all executors share, under a temporary name, and
are renamed when whole: a task that runs again replaces its file by an equal one.

Null and empty texts are the end id alone; documents without an id come first.
Repeated rows are written as often as they occur; rows with one id are ordered by
a hash of their text.  An empty table gives no files and no rows.  Other columns
are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb
from .tokens import END_ID, WordEncoder

MANIFEST = "part int, path string, n_docs bigint, n_tokens bigint, n_sequences bigint"
READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, part int, sequence bigint, place int"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


class SequenceWriter:
    """Writes ids one after another as rows of ``length``; holds at most one batch of ``rows``."""

    def __init__(self, path: str, dtype: np.dtype, length: int, rows: int):
        self.length, self.rows, self.dtype = length, rows, dtype
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), length // 8))])
        self.files, place = _open(path)
        self.files.create_dir(place.rpartition("/")[0], recursive=True)
        self.path, self.tag = place, f".{uuid.uuid4().hex}.tmp"
        self.out = self.files.open_output_stream(place + self.tag)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.index_out = self.files.open_output_stream(place + ".index" + self.tag)
        self.index = pa.ipc.new_file(self.index_out, INDEX)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = self.n_sequences = 0

    def add(self, ids: np.ndarray, doc_ids: pa.Array, counts: np.ndarray) -> None:
        starts = self.n_tokens + np.cumsum(counts) - counts
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(starts), pa.array(counts)], schema=INDEX))
        self.n_tokens += len(ids)
        self.n_docs += len(counts)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= (most := self.rows * self.length):
            flat = np.concatenate(self.held)
            whole = len(flat) // most * most
            for a in range(0, whole, most):
                self._write(flat[a : a + most], most)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, real: int) -> None:
        n = len(flat) // self.length
        mask = np.packbits(np.arange(len(flat)) < real)
        self.writer.write_batch(
            pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length // 8)], schema=self.schema)
        )
        self.n_sequences += n

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            self._write(np.r_[flat, np.zeros(-len(flat) % self.length, flat.dtype)], len(flat))
        for writer, out in ((self.writer, self.out), (self.index, self.index_out)):
            writer.close()
            out.close()
        for name in (self.path, self.path + ".index"):
            try:
                self.files.move(name + self.tag, name)
            except OSError:  # stores that don't replace: an earlier attempt left an equal file
                self.files.delete_file(name)
                self.files.move(name + self.tag, name)


class SequenceFile:
    """Random access to a written file; local files are mapped, so that rows are views."""

    def __init__(self, path: str):
        files, place = _open(path)
        source = pa.memory_map(place) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(place)
        self.reader = pa.ipc.open_file(source)
        self.index = pa.ipc.open_file(files.open_input_file(place + ".index"))
        self.length = self.reader.schema.field("input_ids").type.list_size
        self.n_batches = self.reader.num_record_batches
        self.rows = self.reader.get_batch(0).num_rows if self.n_batches else 0

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and masks of batch k as two-dimensional views."""
        b = self.reader.get_batch(k)
        return b.column(0).flatten().to_numpy(zero_copy_only=True).reshape(b.num_rows, self.length), b.column(1).flatten().to_numpy(zero_copy_only=True).reshape(b.num_rows, -1)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.batch(i // self.rows)
        return ids[i % self.rows], np.unpackbits(mask[i % self.rows]).astype(bool)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) in order, a batch of sequences in memory at a time."""
        size, k, base, flat = self.rows * self.length, 0, 0, None
        for b in range(self.index.num_record_batches):
            rows = self.index.get_batch(b)
            for doc, start, n in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist()):
                parts, at = [], start
                while at < start + n:
                    if flat is None or at // size != k:
                        k = at // size
                        ids, mask = self.batch(k)
                        flat, base = ids.reshape(-1), k * size
                        real = int(np.bitwise_count(mask).sum())
                    stop = min(start + n, base + real)
                    if stop <= at:
                        raise ValueError("the index reaches into the padding")
                    parts.append(flat[at - base : stop - base])
                    at = stop
                yield doc, start, parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_token_files(docs: DataFrame, folder: str, length: int = 2048, rows: int = 512, vocab: str | None = None, end_id: int = END_ID) -> list:
    """Writes the files and returns the manifest: a row for each file, in the order of doc_id."""
    ordered = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    schema = common.arrow_schema(MANIFEST)
    common.small_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}.arrow"
        encoder, out = WordEncoder(vocab), None
        for batch in batches:
            for a, b in tb.slices(batch.column(1)):
                piece = batch.slice(a, b - a)
                ids, offsets = encoder.encode(piece.column(1))
                out = out or SequenceWriter(path, encoder.dtype, length, rows)
                counts = np.diff(offsets) + 1
                out.add(np.insert(ids, offsets[1:], end_id), piece.column(0), counts)
        if out:
            out.close()
            yield common.to_batch({"part": [part], "path": [path], "n_docs": [out.n_docs], "n_tokens": [out.n_tokens], "n_sequences": [out.n_sequences]}, schema)

    return sorted(ordered.mapInArrow(write, MANIFEST).collect(), key=lambda r: r["part"])


def read_token_files(spark: SparkSession, manifest: list) -> DataFrame:
    """A row for each document of the files: where its ids are, and their checksum.  One file is one task."""
    files, base = [], 0
    for r in manifest:
        files.append((r["part"], r["path"], base))
        base += r["n_tokens"]
    if not files:
        return spark.createDataFrame([], READ)
    schema = common.arrow_schema(READ)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                part, path, before = files[k]
                file = SequenceFile(path)
                out: list[tuple] = []
                for doc, start, ids in file.documents():
                    out.append((doc, before + start, len(ids), common.ids_crc(ids), part, start // file.length, start % file.length))
                    if len(out) == 10_000:
                        yield common.to_batch(dict(zip(schema.names, zip(*out))), schema)
                        out = []
                if out:
                    yield common.to_batch(dict(zip(schema.names, zip(*out))), schema)

    return spark.range(0, len(files), 1, len(files)).mapInArrow(read, READ)


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Writes ``docs`` to a new folder of the shared place and reads the files back."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, common.own_folder(spark, "token-files"), **options))
