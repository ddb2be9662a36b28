"""Processors with state of their own: winning bids at the close, last-n averages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .managed import Alarm

#: Ids of one key of the state, and rows that are put into lists together.
SPAN, CHUNK = 1_024, 500_000
#: Stand for null in lists: category and seller, or no price yet; bidder, which is last among equals.
NONE, LAST = -(1 << 63), (1 << 63) - 1

LISTED = ("id", "at", "price", "bidder", "category", "seller", "reserve", "expires")
CLOSED = ("id", "category", "seller", "expires_us", "bidder", "price", "bid_us")


def _lists(names: tuple[str, ...]) -> str:
    return ", ".join(f"{x} array<bigint>" for x in names)


def _listed(rows: DataFrame, needed: tuple[str, ...], **optional: int) -> DataFrame:
    """Rows by ``SPAN`` ids, in lists; those without a value of ``needed`` can't matter and go, ``optional`` ones have a stand-in."""
    names = [x for x in LISTED if x in needed or x in optional]
    schema = pa.schema([("span", pa.int64()), *((x, pa.list_(pa.int64())) for x in LISTED)])

    def lists(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        columns = {x: pc.fill_null(table.column(x), optional[x]) if x in optional else table.column(x) for x in names}
        columns = {x: c.to_numpy() for x, c in columns.items()}
        span = columns["id"] // SPAN
        order = np.argsort(span, kind="stable")
        span = span[order]
        first = np.flatnonzero(np.r_[True, span[1:] != span[:-1]])
        bounds = pa.array(np.r_[first, len(span)], pa.int32())
        made = [pa.ListArray.from_arrays(bounds, pa.array(columns[x][order])) if x in columns else pa.nulls(len(first), pa.list_(pa.int64())) for x in LISTED]
        return pa.RecordBatch.from_arrays([pa.array(span[first]), *made], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            # not a filter of the plan, which would go below the watermark and take away the row that ends a stream
            for x in needed:
                batch = batch.filter(batch.column(batch.schema.get_field_index(x)).is_valid())
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield lists(held)
                held, n = [], 0
        if n:
            yield lists(held)

    return rows.select(*names).mapInArrow(work, f"span bigint, {_lists(LISTED)}")


def _columns(rows: list, n: int) -> np.ndarray:
    """Rows of ``n`` lists each as one array of ``n`` lines."""
    return np.concatenate([np.array(r, np.int64).reshape(n, -1) for r in rows], axis=1) if rows else np.zeros((n, 0), np.int64)


class WinningBid(StatefulProcessor):
    """Key: ``SPAN`` auction ids.  Keeps the auctions, the best valid bid of each, and bids that came before theirs; emits and forgets at ``expires``.

    A bid without an auction is kept until the watermark passes its time: an auction that comes
    later opens later, so the bid can't be valid.  Bids on closed auctions go the same way.
    Times travel as microseconds.  Rows and state are lists, as each call to the state leaves the Python
    worker: calls for each auction took nearly all of the time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.auctions = handle.getValueState("auctions", _lists(("id", "category", "seller", "reserve", "opened", "expires", "price", "at", "bidder")))
        self.early = handle.getListState("early", _lists(("auction", "price", "at", "bidder")))
        self.alarm = Alarm(handle)

    def _held(self) -> np.ndarray:
        return _columns([self.auctions.get()] if self.auctions.exists() else [], 9)

    def _keep(self, held: np.ndarray) -> None:
        self.auctions.update(tuple(held.tolist()))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new, came = [], []
        for r in rows:
            if r.price is None:
                new.append((r.id, r.category, r.seller, r.reserve, r.at, r.expires))
            else:
                came.append((r.id, r.price, r.at, r.bidder))
        passed = max(0, timerValues.getCurrentWatermarkInMs()) * 1_000
        new, held = _columns(new, 6), self._held()
        new = new[:, np.sort(np.unique(new[0], return_index=True)[1])]  # an id counts once
        new = new[:, ~np.isin(new[0], held[0]) & (new[5] > passed)]
        if new.shape[1]:
            no_bid = np.array([[NONE], [0], [0]]).repeat(new.shape[1], axis=1)
            held = np.concatenate([held, np.concatenate([new, no_bid])], axis=1)
            held = held[:, np.argsort(held[0])]
            self.alarm.earliest(-(-int(new[5].min()) // 1_000))  # never before it
            if self.early.exists():
                came += [tuple(x) for x in self.early.get()]
                self.early.clear()
        bids = _columns(came, 4)
        at = np.searchsorted(held[0], bids[0])
        known = np.zeros(len(at), bool)
        known[at < held.shape[1]] = held[0][at[at < held.shape[1]]] == bids[0][at < held.shape[1]]
        left = bids[:, ~known & (bids[2] >= passed)]
        bids, at = bids[:, known], at[known]
        valid = (bids[1] >= held[3][at]) & (held[4][at] <= bids[2]) & (bids[2] < held[5][at])
        bids, at = bids[1:, valid], at[valid]
        if len(at):
            had = np.flatnonzero(held[6] != NONE)
            bids, at = np.concatenate([bids, held[6:, had]], axis=1), np.r_[at, had]
            order = np.lexsort((bids[2], bids[1], -bids[0], at))
            best = order[np.r_[True, at[order][1:] != at[order][:-1]]]
            held[6:, at[best]] = bids[:, best]
        if new.shape[1] or len(at):
            self._keep(held)
        if left.shape[1]:
            self.early.appendValue(tuple(left.tolist()))
            self.alarm.earliest(int(left[2].max()) // 1_000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Closes all auctions whose time has passed: the first one's timer stands for them."""
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1_000
        self.alarm.rang()
        held = self._held()
        due = held[5] <= now
        if due.any():
            out = held[:, due & (held[6] != NONE)]
            if out.shape[1]:
                yield Row(**dict(zip(CLOSED, out[[0, 1, 2, 5, 8, 6, 7]].tolist())))
            held = held[:, ~due]
            if held.shape[1]:
                self._keep(held)
            else:
                self.auctions.clear()
        rings = [-(-int(held[5].min()) // 1_000)] if held.shape[1] else []
        if self.early.exists():
            early = _columns([tuple(x) for x in self.early.get()], 4)
            early = early[:, early[2] >= now]
            if early.shape[1]:
                self.early.put([tuple(early.tolist())])
                rings.append(int(early[2].max()) // 1_000 + 1)
            else:
                self.early.clear()
        if rings:
            self.alarm.earliest(min(rings))

    def close(self) -> None:
        pass


def winning_bids(auctions: DataFrame, bids: DataFrame) -> DataFrame:
    """Streaming form of ``operators.closing.winning_bids``; both inputs carry watermarks on date_time."""
    at = F.unix_micros("date_time").alias("at")
    a = _listed(auctions.select("id", at, "category", "seller", "reserve", F.unix_micros("expires").alias("expires")), ("id", "at", "reserve", "expires"), category=NONE, seller=NONE)
    b = _listed(bids.select(F.col("auction").alias("id"), at, "price", "bidder"), ("id", "at", "price"), bidder=LAST)
    closed = a.unionByName(b).groupBy("span").transformWithState(statefulProcessor=WinningBid(), outputStructType=_lists(CLOSED), outputMode="Append", timeMode="EventTime")
    row = closed.select(F.explode(F.arrays_zip(*CLOSED)).alias("c")).select("c.*")

    def told(name: str, stand_in: int) -> Column:
        return F.nullif(F.col(name), F.lit(stand_in)).alias(name)

    return row.select("id", told("category", NONE), told("seller", NONE), F.timestamp_micros("expires_us").alias("expires"), told("bidder", LAST), "price", F.timestamp_micros("bid_us").alias("bid_time"))


class LastAverage(StatefulProcessor):
    """Key: bidder.  Keeps the last ``last`` winning prices; emits their average after each closed auction."""

    def __init__(self, last: int = 10):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prices = handle.getListState("prices", "price bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = [x[0] for x in self.prices.get()] if self.prices.exists() else []
        for r in sorted(rows, key=lambda r: (r.expires_us, r.id)):
            kept = [*kept, r.price][-self.last :]
            yield Row(id=r.id, bidder=key[0], expires_us=r.expires_us, average=sum(kept) // len(kept))
        self.prices.put([(p,) for p in kept])

    def close(self) -> None:
        pass


def last_average(closed: DataFrame, last: int = 10) -> DataFrame:
    """Streaming form of ``plans.logical.last_average`` by bidder."""
    narrow = closed.select("id", "bidder", F.unix_micros("expires").alias("expires_us"), "price")
    out = narrow.groupBy("bidder").transformWithState(statefulProcessor=LastAverage(last), outputStructType="id bigint, bidder bigint, expires_us bigint, average bigint", outputMode="Append", timeMode="None")
    return out.select("id", "bidder", F.timestamp_micros("expires_us").alias("expires"), "average")
