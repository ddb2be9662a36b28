"""Hot items as streams with managed maps: an index of slides, or counts that panes enter and leave.

Auctions are dealt into ``parts`` by a hash.  A part's bids are counted by slide and
auction; when the watermark passes the end of a slide, the part emits the auction with most
bids of the window that ends there.  The best of a window's parts is found by the
caller's second aggregate.  A window ends with every slide as long as it holds a
bid, and what no window needs any more is removed, so a finite stream leaves no state.

Bids are counted by slide and auction where they are read, before the shuffle, so a
hot auction costs a row a slide, task and ``CHUNK`` of bids.  Counts travel and are kept
as lists, a slide's in pieces of up to ``PIECE`` auctions: a call to the state leaves the Python worker, and
a call for each auction would take most of the time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.windows import seconds
from .managed import Alarm, ManagedMap

BEST = "end_us bigint, auction bigint, n bigint"
CHUNK = 500_000
PIECE = 8_192
#: Auctions, ascending, and their bids.
Counts = tuple[np.ndarray, np.ndarray]


def _summed(parts: list) -> Counts:
    """Counts of several lists of auctions, each with the list of their bids, put together."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    auctions, n = (np.concatenate([np.asarray(x, np.int64) for x in column]) for column in zip(*parts))
    ids, at = np.unique(auctions, return_inverse=True)
    out = np.zeros(len(ids), np.int64)
    np.add.at(out, at, n)
    return ids, out


def _pieces(counts: Counts) -> list[tuple[list[int], list[int]]]:
    return [tuple(x[i : i + PIECE].tolist() for x in counts) for i in range(0, len(counts[0]), PIECE)]


class IndexedCounts(StatefulProcessor):
    """State: slide -> how many pieces it has, and (slide, piece) -> auctions and their bids.  A window's counts are looked up by the index of its slides."""

    def __init__(self, slide_us: int, slices: int):
        self.slide, self.slices = slide_us, slices

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.index = ManagedMap(handle, "index", "slide bigint", "pieces bigint")
        self.counts = ManagedMap(handle, "counts", "slide bigint, piece bigint", "auctions array<bigint>, n array<bigint>")
        self.alarm = Alarm(handle)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh: dict[int, list] = {}
        passed = max(0, timerValues.getCurrentWatermarkInMs()) * 1_000 // self.slide
        for r in rows:
            if r.slide >= passed:  # else its first window has been emitted
                fresh.setdefault(r.slide, []).append((np.array(r.auctions, np.int64), np.array(r.k, np.int64)))
        for slide, parts in fresh.items():
            known = self.index.get(slide, 0)
            whole = max(0, known - 1)  # the last piece may have room
            if known:
                parts.append(self.counts.get((slide, whole)))
            for piece, value in enumerate(_pieces(_summed(parts)), whole):
                self.counts.insert((slide, piece), value)
            self.index.insert(slide, piece + 1)
            if not known:
                self.alarm.earliest(self._ms(slide + 1))
        return iter(())

    def _ms(self, slide: int) -> int:
        return -(-slide * self.slide // 1_000)

    def _entering(self, slides: list[int]) -> Counts:
        return _summed([self.counts.get((s, p)) for s in slides for p in range(self.index.get(s, 0))])

    def _leaving(self, slide: int) -> Counts:
        """The counts of a slide that no later window holds; they go."""
        return _summed([self.counts.remove((slide, p)) for p in range(self.index.remove(slide))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """All windows whose end has passed, in order: the timer of one end stands for those behind it."""
        end = expiredTimerInfo.getExpiryTimeInMs() * 1_000 // self.slide
        last = timerValues.getCurrentWatermarkInMs() * 1_000 // self.slide
        self.alarm.rang()
        slides = set(self.index.keys())
        running = self._begin(sorted(s for s in slides if end - self.slices <= s < end - 1))
        changed = False
        while slides and end <= last:
            changed = True
            # as many windows at once as there are slides in one: over the auctions of all of them, a change is one sum of arrays
            stop = min(last, end + self.slices - 1)
            entering = {s: self._entering([s]) for s in sorted(slides) if end - 1 <= s < stop}
            ids = np.unique(np.concatenate([running[0], *(a for a, _ in entering.values())]))
            n = np.zeros(len(ids), np.int64)
            n[np.searchsorted(ids, running[0])] = running[1]
            while slides and end <= stop:
                if end - 1 in entering:
                    auctions, more = entering.pop(end - 1)
                    n[np.searchsorted(ids, auctions)] += more
                most = int(n.max()) if len(n) else 0
                if most:
                    yield Row(end_us=end * self.slide, auction=int(ids[len(n) - 1 - int(n[::-1].argmax())]), n=most)
                if (gone := end - self.slices) in slides:
                    auctions, less = self._leaving(gone)
                    n[np.searchsorted(ids, auctions)] -= less
                    slides.remove(gone)
                    most = n.any()
                # no window between them holds a bid
                end = end + 1 if most or not slides else max(end + 1, min(slides) + 1)
            running = ids[n > 0], n[n > 0]
        if changed:
            self._finish(running)
        if slides:
            self.alarm.earliest(self._ms(end))

    def _begin(self, slides: list[int]) -> Counts:
        return self._entering(slides)

    def _finish(self, running: Counts) -> None:
        pass

    def close(self) -> None:
        pass


class RunningCounts(IndexedCounts):
    """State besides: piece -> auctions and their bids in the window that ended last.  A slide is added when it ends and taken off when the window has passed it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.running = ManagedMap(handle, "running", "piece bigint", "auctions array<bigint>, n array<bigint>")

    def _begin(self, slides: list[int]) -> Counts:
        held = list(self.running.items())
        self.before = len(held)
        return _summed([v for _, v in held])

    def _finish(self, running: Counts) -> None:
        pieces = _pieces(running)
        for i, value in enumerate(pieces):
            self.running.insert(i, value)
        for i in range(len(pieces), self.before):
            self.running.remove(i)


FORMS = {"indexed": IndexedCounts, "running": RunningCounts}


_LISTS = pa.schema([("part", pa.int32()), ("slide", pa.int64()), ("auctions", pa.list_(pa.int64())), ("k", pa.list_(pa.int64()))])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, auction, slide); the counts of each part and slide, in lists."""
    held: list[pa.RecordBatch] = []

    def lists() -> pa.RecordBatch:
        counts = pa.Table.from_batches(held).group_by(["part", "auction", "slide"]).aggregate([("auction", "count")])
        part, auction, slide, k = (counts.column(c).to_numpy() for c in ("part", "auction", "slide", "auction_count"))
        order = np.lexsort((slide, part))
        part, auction, slide, k = (x[order] for x in (part, auction, slide, k))
        first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (slide[1:] != slide[:-1])])
        bounds = pa.array(np.r_[first, len(part)], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(slide[first]), *(pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (auction, k))], schema=_LISTS)

    n = 0
    for batch in batches:
        # not a filter of the plan, which would go below the watermark and take away the row that ends a stream
        held.append(batch.filter(pc.and_(batch.column("auction").is_valid(), batch.column("slide").is_valid())))
        n += held[-1].num_rows
        if n >= CHUNK:
            yield lists()
            held, n = [], 0
    if n:
        yield lists()


def part_hottest(bids: DataFrame, slide: float, slices: int, form: str = "indexed", parts: int = 16) -> DataFrame:
    """(window_end, auction, n): for each part of the auctions the hottest of each window.  ``bids`` is a stream with a watermark."""
    slide_us = int(slide * 1_000_000)
    number = F.floor(F.unix_micros("date_time") / F.lit(slide_us))
    part = F.pmod(F.xxhash64("auction"), F.lit(parts)).cast("int")
    counts = bids.select(part.alias("part"), "auction", number.alias("slide")).mapInArrow(_counted, "part int, slide bigint, auctions array<bigint>, k array<bigint>")
    best = counts.groupBy("part").transformWithState(statefulProcessor=FORMS[form](slide_us, slices), outputStructType=BEST, outputMode="Append", timeMode="EventTime")
    return best.select(F.timestamp_micros("end_us").alias("window_end"), "auction", "n")


def hottest_of_parts(best: DataFrame, size: float) -> DataFrame:
    """The hottest auction of each window among its parts; equal ones: the largest id."""
    top = best.groupBy("window_end").agg(F.max(F.struct("n", "auction")).alias("top"))
    return top.select((F.col("window_end") - F.expr(f"INTERVAL {seconds(size)}")).alias("window_start"), "window_end", F.col("top.auction").alias("auction"), F.col("top.n").alias("n"))
