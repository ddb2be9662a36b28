"""Record types: people, auctions and bids, and the tagged event that carries any of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _struct(fields: str) -> T.StructType:
    """From "name kind" pairs; needs no session, as DDL strings do."""
    kinds = {"bigint": T.LongType(), "string": T.StringType(), "timestamp": T.TimestampType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split() for x in fields.split(", "))])


PERSON = _struct("id bigint, name string, email_address string, credit_card string, city string, state string, date_time timestamp")
AUCTION = _struct("id bigint, item_name string, description string, initial_bid bigint, reserve bigint, date_time timestamp, expires timestamp, seller bigint, category bigint")
BID = _struct("auction bigint, bidder bigint, price bigint, date_time timestamp")
EVENT = T.StructType([T.StructField("type", T.StringType(), False), T.StructField("person", PERSON), T.StructField("auction", AUCTION), T.StructField("bid", BID)])
CARRIER = T.StructType([T.StructField("time", T.LongType()), T.StructField("event", EVENT)])


def demux(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One stream of tagged events as three: people, auctions, bids.  Works on static and streaming frames."""
    return tuple(events.where(F.col("type") == kind).select(f"{kind}.*") for kind in ("person", "auction", "bid"))


def mux(people: DataFrame, auctions: DataFrame, bids: DataFrame) -> DataFrame:
    """The opposite of ``demux``."""

    def tagged(df: DataFrame, kind: str) -> DataFrame:
        parts = {k: F.struct(*s.names) if k == kind else F.lit(None).cast(s) for k, s in (("person", PERSON), ("auction", AUCTION), ("bid", BID))}
        return df.select(F.lit(kind).alias("type"), *(c.alias(k) for k, c in parts.items()))

    return tagged(people, "person").unionByName(tagged(auctions, "auction")).unionByName(tagged(bids, "bid"))


def event_id(event: str = "event") -> Column:
    """Id of a tagged event; a bid's is its auction's."""
    return F.coalesce(F.col(f"{event}.person.id"), F.col(f"{event}.auction.id"), F.col(f"{event}.bid.auction"))


def event_time(event: str = "event") -> Column:
    return F.coalesce(*(F.col(f"{event}.{k}.date_time") for k in ("person", "auction", "bid")))
