"""Sliding-window operators: counts in panes, hot items, ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import assign_windows, seconds
from .running import running_sums

RANK_BUCKET = 4_096  # ids that one task ranks at once
FAN = 256  # children of a node in a tree of sums
COPIES = 65_536  # copies of a row made at once
PIECE = 60  # window sizes whose changes one task sums at once


def direct_counts(bids: DataFrame, slide: float, size: float) -> DataFrame:
    """Bids by window and auction; every bid is put into each of its windows."""
    return bids.groupBy(F.window("date_time", seconds(size), seconds(slide)).alias("w"), "auction").agg(F.count(F.lit(1)).alias("n"))


def sliced_counts(bids: DataFrame, slide: float, size: float) -> DataFrame:
    """The same from panes: bids are counted once by slide, and the few counts go into the windows.  Works on streams too."""
    panes = bids.groupBy(F.window("date_time", seconds(slide)).alias("pane"), "auction").agg(F.count(F.lit(1)).alias("k"))
    at = panes.select(F.window_time("pane").alias("date_time"), "auction", "k")
    return at.groupBy(F.window("date_time", seconds(size), seconds(slide)).alias("w"), "auction").agg(F.sum("k").alias("n"))


def incremental_counts(bids: DataFrame, slide: float, size: float) -> DataFrame:
    """The same by additions when a pane enters and deletions when it leaves (static frames).

    Running sums by auction over the changes give the count at each change; it
    holds for the window ends until the next change.  An auction's changes are cut
    into pieces of time, so none of its tasks gets them all; where a pane lives on
    into the next piece, that piece starts with a change of nothing.
    """
    length, step = (F.expr(f"INTERVAL {seconds(x)}") for x in (size, slide))
    piece = int(slide * 1_000_000) * math.ceil(size / slide) * PIECE
    number = F.floor(F.unix_micros("at") / F.lit(piece))
    following = F.timestamp_micros((number + 1) * F.lit(piece))
    panes = bids.groupBy(F.window("date_time", seconds(slide)).end.alias("at"), "auction").agg(F.count(F.lit(1)).alias("k"))
    left = panes.select((F.col("at") + length).alias("at"), "auction", (-F.col("k")).alias("k"))
    held = panes.where(following < F.col("at") + length).select(following.alias("at"), "auction", F.lit(0).cast("bigint").alias("k"))
    changes = panes.unionByName(left).unionByName(held).groupBy("auction", "at").agg(F.sum("k").alias("k"))
    running = running_sums(changes, ["auction"], number, ["at"], {"n": F.col("k")})
    by = Window.partitionBy("auction", number).orderBy("at")
    spans = running.select("auction", "n", "at", F.coalesce(F.lead("at").over(by), following).alias("until")).where("n > 0")
    ends = spans.select("auction", "n", F.explode(F.sequence("at", F.col("until") - step, step)).alias("end"))
    return ends.select(F.struct((F.col("end") - length).alias("start"), "end").alias("w"), "auction", "n")


def hottest(counts: DataFrame) -> DataFrame:
    """The auction with most bids of each window; of equal ones the largest id."""
    top = counts.groupBy("w").agg(F.max(F.struct("n", "auction")).alias("top"))
    return top.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.col("top.auction").alias("auction"), F.col("top.n").alias("n"))


def anchored(hot: DataFrame, bids: DataFrame, slide: float) -> DataFrame:
    """Only windows whose first slide has a bid."""
    first = bids.select(F.window("date_time", seconds(slide)).start.alias("window_start")).distinct()
    return hot.join(first, "window_start", "left_semi")


def window_counts(bids: DataFrame, slide: float, size: float, origin: str | None = None) -> DataFrame:
    """Bids in each window, from panes; works on streams too."""
    panes = bids.groupBy(F.window("date_time", seconds(slide)).alias("pane")).agg(F.count(F.lit(1)).alias("k"))
    out = panes.select(F.window_time("pane").alias("date_time"), "k").groupBy(F.window("date_time", seconds(size), seconds(slide)).alias("w")).agg(F.sum("k").alias("n"))
    out = out.where(F.col("w.start") >= F.lit(origin).cast("timestamp")) if origin else out
    return out.select(F.col("w.end").alias("window_end"), "n")


def repeated(df: DataFrame, n: str) -> DataFrame:
    """Each row ``n`` times, without the column ``n``; two steps, so that no row holds an array of more than ``n / COPIES`` or ``COPIES`` numbers."""
    columns = [c for c in df.columns if c != n]
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / F.lit(COPIES)))))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(COPIES).cast("bigint"), F.col(n) - F.col("_block") * COPIES)))
    return blocks.withColumn("_copy", copies).select(*columns)


def ranks_of(counts: DataFrame) -> DataFrame:
    """RANK by auction of the bids behind ``counts`` (w, auction, n), a row for each bid; whole windows, static.

    A rank is one more than the bids on smaller ids: running sums, in pieces of ids.
    """
    ranked = running_sums(counts, ["w"], F.floor(F.col("auction") / RANK_BUCKET), ["auction"], {"below": F.col("n")}, inclusive=False)
    return repeated(ranked.select(F.col("w.end").alias("window_end"), "auction", (F.col("below") + 1).alias("rank"), "n"), "n")


def window_ranks(bids: DataFrame, slide: float, size: float, origin: str | None = None) -> DataFrame:
    """RANK of every bid by auction in each of its windows (static frames)."""
    rows = assign_windows(bids.select("auction", "date_time"), "date_time", slide, size, origin)
    return ranks_of(rows.groupBy(F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end")).alias("w"), "auction").agg(F.count(F.lit(1)).alias("n")))


def _below(items: str, by: str) -> Column:
    """Each of ``items`` with the sum of n of those with a smaller ``by``."""
    zero = F.lit(0).cast("bigint")
    return F.transform(items, lambda x: F.struct(x.alias("x"), F.aggregate(F.filter(items, lambda y: y[by] < x[by]), zero, lambda s, y: s + y["n"]).alias("below")))


def listed_ranks(bids: DataFrame, slide: float, size: float) -> DataFrame:
    """The same as one plan for streams, where ranking windows are refused: a tree of sums over the auction ids of each window.

    A node has ``FAN`` children in a list: ids under leaves, leaves under inner nodes, these
    under the window's root.  What stands before a node comes down from its parent.
    """
    counts = sliced_counts(bids, slide, size).select("w", F.floor(F.col("auction") / FAN).alias("leaf"), "auction", "n")
    leaves = counts.groupBy("w", "leaf").agg(F.collect_list(F.struct("auction", "n")).alias("items"))
    sums = counts.groupBy("w", "leaf").agg(F.sum("n").alias("n")).withColumn("inner", F.floor(F.col("leaf") / FAN))
    inners = sums.groupBy("w", "inner").agg(F.collect_list(F.struct("leaf", "n")).alias("items"))
    roots = sums.groupBy("w", "inner").agg(F.sum("n").alias("n")).groupBy("w").agg(F.collect_list(F.struct("inner", "n")).alias("items"))
    at_inner = roots.select("w", F.explode(_below("items", "inner")).alias("b")).select("w", F.col("b.x.inner").alias("inner"), F.col("b.below").alias("earlier"))
    at_leaf = inners.join(at_inner, ["w", "inner"]).select("w", "earlier", F.explode(_below("items", "leaf")).alias("b"))
    at_leaf = at_leaf.select("w", F.col("b.x.leaf").alias("leaf"), (F.col("earlier") + F.col("b.below")).alias("earlier"))
    rows = leaves.join(at_leaf, ["w", "leaf"]).select("w", "earlier", F.explode(_below("items", "auction")).alias("a"))
    ranked = rows.select(F.col("w.end").alias("window_end"), F.col("a.x.auction").alias("auction"), (F.col("earlier") + F.col("a.below") + 1).alias("rank"), F.col("a.x.n").alias("n"))
    return repeated(ranked, "n")
