"""The queries as plans over people, auctions and bids.  Frames may be static; those without ``Window`` may stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import seconds
from ..operators import sliding
from ..operators.panes import swept_hot_items
from ..operators.running import last_sums, running_sums
from ..operators.skew import dealt_join

CATEGORY = 10
STATES = ("OR", "ID", "CA")


def local_items(auctions: DataFrame, people: DataFrame, category: int = CATEGORY, states: tuple[str, ...] = STATES, most: int | None = None) -> DataFrame:
    """Q3: who sells in a category and lives in certain states.  With ``most``, sellers of more auctions than that are dealt over tasks (static frames)."""
    a = auctions.where(F.col("category") == category).select(F.col("id").alias("auction"), "seller")
    p = people.where(F.col("state").isin(*states)).select("id", "name", "city", "state")
    joined = dealt_join(a, p, "seller", "id", most) if most else a.join(p, F.col("seller") == F.col("id"))
    return joined.select("name", "city", "state", "auction")


def category_average(closed: DataFrame) -> DataFrame:
    """Q4: average winning price of each category so far, in whole units."""
    return closed.groupBy("category").agg(F.expr("sum(price) div count(1)").alias("average"))


def category_average_changes(closed: DataFrame) -> DataFrame:
    """Q4 as it runs: the average after each closed auction."""
    by_day = F.floor(F.unix_micros("expires") / F.lit(86_400_000_000))
    ran = running_sums(closed.select("id", "category", "expires", "price"), ["category"], by_day, ["expires", "id"], {"total": F.col("price"), "n": F.lit(1)})
    return ran.select("id", "category", "expires", F.expr("total div n").alias("average"))


def hot_items(bids: DataFrame, slide: float = 1, slices: int = 60, form: str = "sliced") -> DataFrame:
    """Q5: the auction with most bids in each sliding window; ``form`` is direct, sliced, incremental (static frames) or changes (the same by running sums)."""
    if form == "incremental":
        return swept_hot_items(bids, slide, slices)
    counts = {"direct": sliding.direct_counts, "sliced": sliding.sliced_counts, "changes": sliding.incremental_counts}[form]
    return sliding.hottest(counts(bids, slide, slide * slices))


def last_average(closed: DataFrame, key: str = "bidder", last: int = 10) -> DataFrame:
    """Q6: average of the last winning prices of each bidder (or seller), after each closed auction.

    A bidder's auctions are cut into pieces of an hour, each of which gets the last prices
    of the pieces before it, so a bidder with most of the auctions is spread over tasks.
    """
    by_hour = F.floor(F.unix_micros("expires") / F.lit(3_600_000_000))
    rows = last_sums(closed.select("id", key, "expires", "price"), [key], by_hour, ["expires", "id"], "price", last)
    return rows.select("id", key, "expires", F.expr("total div n").alias("average"))


def highest_bid(bids: DataFrame, width: float = 10) -> DataFrame:
    """Q7: the highest price of each tumbling window."""
    return bids.groupBy(F.window("date_time", seconds(width)).alias("w")).agg(F.max("price").alias("price")).select(F.col("w.end").alias("window_end"), "price")


def new_users(people: DataFrame, auctions: DataFrame, width: float = 12 * 3600, most: int | None = None) -> DataFrame:
    """Q8: people who open an auction within ``width`` seconds of registering, once for each auction.  ``most`` as in Q3."""
    p = people.select(F.col("id").alias("person"), F.col("date_time").alias("joined"))
    joined = F.col("date_time") >= F.col("joined"), F.col("date_time") < F.col("joined") + F.expr(f"INTERVAL {seconds(width)}")
    if most:
        found = dealt_join(auctions, p, "seller", "person", most, "left_semi", joined[0] & joined[1])
    else:
        found = auctions.join(p, (F.col("seller") == F.col("person")) & joined[0] & joined[1], "left_semi")
    return found.select(F.col("seller").alias("person"), F.col("id").alias("auction"), F.col("date_time"))
