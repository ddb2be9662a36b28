"""Hot items from panes: each pane enters the windows it belongs to as a range, not one by one.

Bids are counted once by auction and slide.  Over the starts of windows, an auction's
count is a step function: a pane adds its bids at the first window that holds it and takes
them off behind the last one.  Where it is level, the step competes for all its windows at once:
a range of windows is covered by two ranges of a power of two, and the best of all steps comes
down from the long ranges to the short ones.  So a pane costs two sorted changes and four
entries, however many windows it is in.

Windows are cut into pieces of ``PIECE`` window sizes and auctions are dealt by a hash: a task
has its auctions' panes of a piece, a chunk at a time, and hands on one row a window.
Counting and dealing shuffle panes, never bids more than once; a hot auction has one row a slide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import seconds

PIECE = 60
CHUNK = 200_000
BEST = "start bigint, auction bigint, n bigint"
_ARROW = pa.schema([("start", pa.int64()), ("auction", pa.int64()), ("n", pa.int64())])


def best_of(auction: np.ndarray, pane: np.ndarray, k: np.ndarray, base: int, length: int, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """(auction, bids) of the hottest of each window that starts in slide base to base + length - 1; no bids, where a window has none.

    Whole auctions with their panes (slide numbers) and bids; of equal counts the larger auction.
    """
    ids, number = np.unique(auction, return_inverse=True)
    first, behind = np.maximum(pane - slices + 1, base), np.minimum(pane + 1, base + length)
    fit = first < behind
    number, at = np.tile(number[fit], 2), np.r_[first[fit], behind[fit]]
    change = np.r_[k[fit], -k[fit]]
    order = np.lexsort((at, number))
    number, at, n = number[order], at[order], np.cumsum(change[order])  # an auction's changes sum up to nothing
    last = np.r_[(number[1:] != number[:-1]) | (at[1:] != at[:-1]), True][: len(n)]
    number, at, n = number[last], at[last] - base, n[last]
    step = np.flatnonzero(n > 0)  # ends at the auction's next change
    low, high, value = at[step], at[step + 1], n[step] * len(ids) + number[step]
    level = np.frexp(high - low)[1] - 1 if len(step) else step
    best = np.full((length.bit_length(), length), -1, np.int64)
    np.maximum.at(best, (level, low), value)
    np.maximum.at(best, (level, high - (1 << level)), value)
    for j in range(len(best) - 1, 0, -1):
        half, whole = 1 << (j - 1), length - (1 << j) + 1
        if whole > 0:
            np.maximum(best[j - 1, :whole], best[j, :whole], out=best[j - 1, :whole])
            np.maximum(best[j - 1, half : half + whole], best[j, :whole], out=best[j - 1, half : half + whole])
    found = best[0]
    return np.where(found < 0, 0, ids[found % max(1, len(ids))] if len(ids) else 0), np.where(found < 0, 0, found // max(1, len(ids)))


def _swept(batches: Iterator[pa.RecordBatch], slices: int) -> Iterator[pa.RecordBatch]:
    """Rows (piece, auction, pane, k) sorted by piece, auction; the best of each window of a piece among them."""
    length = slices * PIECE
    piece, auctions, counts = None, None, None

    def result() -> Iterator[pa.RecordBatch]:
        if piece is not None:
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some + piece * length), pa.array(auctions[some]), pa.array(counts[some])], schema=_ARROW)

    def enter(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        nonlocal piece, auctions, counts
        cuts = np.flatnonzero(np.diff(rows[0])) + 1
        for part in zip(*(np.split(x, cuts) for x in rows)):
            if part[0][0] != piece:
                yield from result()
                piece, auctions, counts = int(part[0][0]), np.zeros(length, np.int64), np.zeros(length, np.int64)
            a, n = best_of(*part[1:], piece * length, length, slices)
            more = (n > counts) | ((n == counts) & (a > auctions) & (n > 0))
            auctions, counts = np.where(more, a, auctions), np.where(more, n, counts)

    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= CHUNK:
            rows = [np.concatenate(c) for c in zip(*held)]
            whole = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
            stop = int(whole[-1]) + 1 if len(whole) else 0  # the last auction waits for its end: a piece has few panes of it
            if stop:
                yield from enter([x[:stop] for x in rows])
            held, n = [[x[stop:] for x in rows]], n - stop
    if n:
        yield from enter([np.concatenate(c) for c in zip(*held)])
    yield from result()


def swept_hot_items(bids: DataFrame, slide: float, slices: int) -> DataFrame:
    """window_start, window_end, auction, n: the auction with most bids of each window of ``slices`` slides (static frames)."""
    slide_us, length = int(slide * 1_000_000), slices * PIECE
    panes = bids.where("auction is not null and date_time is not null").groupBy("auction", F.floor(F.unix_micros("date_time") / F.lit(slide_us)).alias("pane")).agg(F.count(F.lit(1)).alias("k"))
    pieces = F.array_distinct(F.array(F.floor((F.col("pane") - (slices - 1)) / F.lit(length)), F.floor(F.col("pane") / F.lit(length))))
    dealt = panes.select(F.explode(pieces).alias("piece"), "auction", "pane", "k").repartition("piece", "auction").sortWithinPartitions("piece", "auction")
    best = dealt.mapInArrow(lambda it: _swept(it, slices), BEST).groupBy("start").agg(F.max(F.struct("n", "auction")).alias("top"))
    start = F.timestamp_micros(F.col("start") * F.lit(slide_us))
    return best.select(start.alias("window_start"), (start + F.expr(f"INTERVAL {seconds(slide * slices)}")).alias("window_end"), F.col("top.auction").alias("auction"), F.col("top.n").alias("n"))
