"""Auctions at their close: the winning bid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import dealt_join


def is_valid(price: Column, reserve: Column, bid_time: Column, opened: Column, expires: Column) -> Column:
    return (price >= reserve) & (bid_time >= opened) & (bid_time < expires)


def winning_bids(auctions: DataFrame, bids: DataFrame, most: int | None = None) -> DataFrame:
    """A row for each auction with a valid bid: the highest; of equal ones the earliest, then the lowest bidder.

    The best bid is found by an aggregate with a partial step.  With ``most``, an auction with
    more bids than that is dealt over several tasks of the join, each of which finds its best.
    """
    a = auctions.select("id", "category", "seller", "reserve", F.col("date_time").alias("opened"), "expires")
    b = bids.select("auction", "bidder", "price", F.col("date_time").alias("bid_time"))
    joined = (dealt_join(b, a, "auction", "id", most) if most else a.join(b, F.col("id") == F.col("auction"))).where(is_valid(F.col("price"), F.col("reserve"), F.col("bid_time"), F.col("opened"), F.col("expires")))
    best = F.min(F.struct((-F.col("price")).alias("minus"), "bid_time", "bidder"))
    closed = joined.groupBy("id", "category", "seller", "expires").agg(best.alias("best"))
    return closed.select("id", "category", "seller", "expires", F.col("best.bidder").alias("bidder"), (-F.col("best.minus")).alias("price"), F.col("best.bid_time").alias("bid_time"))
