"""Best-fit packing with swap-based local search.

``pack_documents`` turns documents into pieces of at most ``capacity`` tokens
and puts the pieces into as few sequences as it can.  Token ids never move: the
map side emits a row of a few numbers for each piece.  Pieces that fill a
sequence have one of their own.  The others are dealt into shards of about
``shard_docs`` documents, each length evenly, and each shard is packed by best fit decreasing
and then improved: documents are moved or exchanged, one for one or two for one,
between underfull bins so that the sum of squared fills grows, until the
total needs no fewer bins or nothing fits better.

Null and empty texts are the end id alone.  Repeated rows are packed as often as
they occur.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import END_ID, WordEncoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, own bigint, task bigint, place bigint"
PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers; each item goes to the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room := room - size:
            if not by_room.setdefault(room, []):
                insort(rooms, room)
            by_room[room].append(b)
    return bins


class _Search:
    """Bins with room as flat arrays, so that one step looks at all of them at once."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.capacity, self.bins = capacity, bins
        self.sizes = lengths
        self.where = np.empty(len(lengths), np.int64)
        for b, items in enumerate(bins):
            self.where[items] = b
        self.fill = np.bincount(self.where, weights=lengths, minlength=len(bins)).astype(np.int64)
        self.pairs_of: list[tuple[np.ndarray, ...] | None] = [None] * len(bins)
        self.pairs: tuple[np.ndarray, ...] | None = None

    def _put(self, i: int, b: int) -> None:
        a = self.where[i]
        self.pairs_of[a] = self.pairs_of[b] = self.pairs = None
        self.bins[a].remove(i)
        self.bins[b].append(i)
        self.fill[a] -= self.sizes[i]
        self.fill[b] += self.sizes[i]
        self.where[i] = b

    def _all_pairs(self) -> tuple[np.ndarray, ...]:
        """(size, document, document) of two documents of a bin, one for each pair of sizes, for all bins with room."""
        if self.pairs is None:
            parts = []
            for b in np.flatnonzero((self.fill > 0) & (self.fill < self.capacity)).tolist():
                if (own := self.pairs_of[b]) is None:
                    items = np.array(self.bins[b])
                    items = items[np.argsort(self.sizes[items], kind="stable")]
                    sizes = self.sizes[items]
                    items = items[(np.arange(len(items)) < 2) | (sizes != np.r_[0, 0, sizes[:-2]][: len(sizes)])]  # two of a size at most
                    j, k = np.triu_indices(len(items), 1)
                    own = self.pairs_of[b] = (self.sizes[items[j]] + self.sizes[items[k]], items[j], items[k])
                parts.append(own)
            self.pairs = tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        return self.pairs

    def step(self, source: int) -> bool:
        """One exchange out of the bin ``source`` that makes the squared fill larger; False if there is none."""
        room = self.capacity - self.fill
        room[source] = -1
        room[self.fill == 0] = -1
        short = self.fill[source]
        items = sorted({int(self.sizes[i]): i for i in self.bins[source]}.values(), key=lambda i: -self.sizes[i])  # one of each size
        for i in items:  # move
            fits = np.where((room >= self.sizes[i]) & (self.fill + self.sizes[i] > short), room, self.capacity + 1)
            if fits.min() <= self.capacity:
                self._put(i, int(fits.argmin()))
                return True
        away = room[self.where]
        for i in items:  # one for one: a larger document for a smaller one
            gain = self.sizes[i] - self.sizes
            ok = (gain > 0) & (gain <= away) & (self.fill[self.where] + gain > short)
            if ok.any():
                j = int(np.where(ok, gain, 0).argmax())
                b = int(self.where[j])
                self._put(i, b)
                self._put(j, source)
                return True
        pair, first, second = self._all_pairs()
        at = self.where[first]
        room_at, fill_at = room[at], self.fill[at]
        for i in items:  # two for one: a document for two smaller ones that together are less
            gain = self.sizes[i] - pair
            ok = (gain > 0) & (gain <= room_at) & (fill_at + gain > short)
            if ok.any():
                best = int(np.where(ok, gain, 0).argmax())
                b = int(at[best])
                self._put(i, b)
                self._put(int(first[best]), source)
                self._put(int(second[best]), source)
                return True
        return False


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers, improved by local search while more bins are used than the total needs.

    Sweeps go over all bins with room, the emptiest first, and exchange out of each
    until nothing fits better.  An exchange makes the sum of squared fills larger, so
    the search ends; it ends when a whole sweep finds none.
    """
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths):
        return []
    bins = best_fit_decreasing(lengths, capacity)
    need = -(-int(lengths.sum()) // capacity)
    search = _Search(lengths, bins, capacity)
    better = np.count_nonzero(search.fill) > need
    while better:
        better = False
        used = np.flatnonzero((search.fill > 0) & (search.fill < capacity))
        for b in used[np.argsort(search.fill[used], kind="stable")].tolist():
            while 0 < search.fill[b] < capacity and search.step(b):
                better = True
            if search.fill[b] == 0 and np.count_nonzero(search.fill) <= need:
                return [b for b in bins if b]
    return [b for b in bins if b]


def pack_documents(docs: DataFrame, capacity: int = 4096, shard_docs: int = 8192, vocab: str | None = None) -> DataFrame:
    docs = docs.select("doc_id", "text")
    shards = max(1, -(-docs.count() // shard_docs))
    state: dict[str, object] = {}

    def pieces(batch: pa.RecordBatch) -> dict[str, object]:
        task = TaskContext.get()
        if state.get("task") != (key := task.taskAttemptId() if task else 0):
            state.update(task=key, made=0, places={})
        encoder = state.get("encoder") or state.setdefault("encoder", WordEncoder(vocab))
        ids, offsets = encoder.encode(batch.column(1))
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "own", "task", "place")}
        number, places = task.partitionId() if task else 0, state["places"]
        for n, doc in enumerate(batch.column(0).to_pylist()):
            own = np.append(ids[offsets[n] : offsets[n + 1]], np.array(END_ID, ids.dtype))
            for piece, start in enumerate(range(0, len(own), capacity)):
                part = own[start : start + capacity]
                full = None
                if len(part) == capacity:
                    state["made"] += 1
                    full = -(number * (1 << 33) + state["made"])
                place = places[len(part)] = places.get(len(part), -1) + 1
                for k, v in zip(out, (doc, piece, start, len(part), common.ids_crc(part), full, number, place)):
                    out[k].append(v)
        return out

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; full pieces pass, the others of a shard wait for its end."""
        schema = common.arrow_schema(PACKED)
        names = PACKED_NAMES[:5]
        waiting: list[pa.Table] = []
        shard = None

        def close() -> Iterator[pa.RecordBatch]:
            if waiting:
                rows = pa.concat_tables(waiting).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
                lengths = rows.column("length").to_numpy()
                sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
                for b, items in enumerate(pack(lengths, capacity)):
                    sequence[items] = (shard << 32) + b
                    offset[items] = np.cumsum(np.r_[0, lengths[items[:-1]]])
                waiting.clear()
                yield from pa.Table.from_arrays([*(rows.column(n) for n in names), pa.array(sequence), pa.array(offset)], schema=schema).to_batches()

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            full = rows.filter(pc.is_valid(rows.column("own")))
            if len(full):
                yield from pa.Table.from_arrays([*(full.column(n) for n in names), full.column("own"), pa.array(np.zeros(len(full), np.int64))], schema=schema).to_batches()
            rest = rows.filter(pc.is_null(rows.column("own")))
            of = rest.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if of[a] != shard:
                        yield from close()
                        shard = int(of[a])
                    waiting.append(rest.slice(a, b - a))
        yield from close()

    rows = common.map_text(docs, PIECES, pieces)
    rows = rows.withColumn("shard", F.lit(0).cast("bigint")) if shards == 1 else _dealt(common.cut(rows), shards)
    rows = rows.select(*(c.split()[0] for c in PIECES.split(", ")[:6]), "shard")
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(common.released(packed), PACKED)


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    """``shard``: the place among all pieces by (length, task, place) modulo ``shards``, so any range of lengths is spread evenly.

    Only counts are ordered: of each length and task, and of each length.
    """
    spark = rows.sparkSession
    counts = common.cut(rows.where("own is null").groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    start, before = [], 0
    for r in sorted(counts.groupBy("length").agg(F.sum("n").alias("n")).collect()):
        start.append((r["length"], before))
        before += r["n"]
    within = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "task", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("first"))
    first = first.join(F.broadcast(spark.createDataFrame(start, "length bigint, start bigint")), "length").select("length", "task", (F.col("first") + F.col("start")).alias("first"))
    # pieces that fill a sequence are spread by their number and not packed
    return rows.join(first, ["length", "task"], "left").withColumn("shard", F.pmod(F.coalesce(F.col("first") + F.col("place"), F.col("own")), F.lit(shards)).cast("bigint"))


PACKED_NAMES = [x.split()[0] for x in PACKED.split(", ")]
