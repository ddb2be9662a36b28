"""Synthetic auction events from integer-hash columns: any range of events, on any number of tasks, in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GeneratorConfig
from ..schema import AUCTION, BID, PERSON, mux

_M = (1 << 31) - 1  # a prime, so that products of two draws fit into a bigint


def draw(event: Column, salt: int) -> Column:
    """An integer below 2**31 - 1 that depends on event and salt only; squaring keeps salts independent."""
    x = (event % F.lit(_M) * F.lit(48271) + F.lit(salt * 69621 + 12345)) % F.lit(_M)
    for k in (7919, 104729):
        x = (x * x + F.lit(salt * k + 1)) % F.lit(_M)
    return x


class Events:
    """Columns of the events whose numbers are in column ``n``."""

    def __init__(self, config: GeneratorConfig, n: str = "n"):
        c = self.config = config
        e = F.col(n).cast("bigint") + F.lit(c.first_event_number)
        group = F.lit(c.out_of_order_group_size).cast("bigint")
        self.number = F.floor(e / group) * group + (e * 953) % group if c.out_of_order_group_size > 1 else e
        self.id = self.number + c.first_event_id
        self.slot = self.number % c.denominator
        self.epoch = F.floor(self.id / c.denominator)
        place = self.id % c.denominator
        self.last_person = self.epoch * c.person_proportion + F.least(place, F.lit(c.person_proportion - 1))
        self.last_auction = self.epoch * c.auction_proportion + F.greatest(F.lit(-1), F.least(place - c.person_proportion, F.lit(c.auction_proportion - 1)))
        self.time_ns = self.at(self.number)

    def at(self, number: Column) -> Column:
        """Nanoseconds since the base time."""
        return F.floor(number * F.lit(self.config.delay_ns))

    def below(self, bound: int | Column, salt: int) -> Column:
        return draw(self.number, salt) % (F.lit(bound) if isinstance(bound, int) else bound)

    def price(self, salt: int) -> Column:
        return F.round(F.pow(F.lit(10.0), draw(self.number, salt) / F.lit(float(_M)) * 6) * 100).cast("bigint")

    def kind(self) -> Column:
        c = self.config
        return F.when(self.slot < c.person_proportion, "person").when(self.slot < c.person_proportion + c.auction_proportion, "auction").otherwise("bid")

    def some_person(self, salt: int) -> Column:
        people = self.last_person + 1
        active = F.least(people, F.lit(self.config.active_people))
        return people - active + self.below(active + self.config.person_id_lead, salt)

    def some_auction(self, salt: int) -> Column:
        oldest = F.greatest(self.last_auction - self.config.in_flight_auctions, F.lit(0))
        return oldest + self.below(self.last_auction - oldest + 1 + self.config.auction_id_lead, salt)

    def hot(self, ratio: int, salt: int, hot: Column, other: Column) -> Column:
        return F.when(self.below(ratio, salt) > 0, hot).otherwise(other)

    def person(self) -> list[Column]:
        c = self.config
        one = lambda items, salt: F.element_at(F.array(*map(F.lit, items)), (self.below(len(items), salt) + 1).cast("int"))
        empty = F.lit("")
        return _named(PERSON, self.last_person + c.first_person_id, empty, empty, empty, one(c.us_cities, 1), one(c.us_states, 2), self.timestamp())

    def auction(self) -> list[Column]:
        c = self.config
        first = self.price(3)
        horizon = self.at(self.number + c.in_flight_auctions * c.denominator // c.auction_proportion) - self.time_ns
        expires = self.time_ns + 1 + self.below(F.greatest(horizon * 2, F.lit(1)), 5)
        seller = self.hot(c.hot_seller_ratio, 6, F.floor(self.last_person / c.hot_seller_ratio_2) * c.hot_seller_ratio_2, self.some_person(7))
        empty = F.lit("")
        return _named(AUCTION, self.last_auction + c.first_auction_id, empty, empty, first, first + self.price(4), self.timestamp(), self.timestamp(expires), seller + c.first_person_id, c.first_category_id + self.below(c.num_categories, 8))

    def bid(self) -> list[Column]:
        c = self.config
        auction = self.hot(c.hot_auction_ratio, 9, F.floor(self.last_auction / c.hot_auction_ratio_2) * c.hot_auction_ratio_2, self.some_auction(10))
        bidder = self.hot(c.hot_bidder_ratio, 11, F.floor(self.last_person / c.hot_bidder_ratio_2) * c.hot_bidder_ratio_2 + 1, self.some_person(12))
        return _named(BID, auction + c.first_auction_id, bidder + c.first_person_id, self.price(13), self.timestamp())

    def timestamp(self, ns: Column | None = None) -> Column:
        """Spark's microseconds; the generator's own unit is the nanosecond."""
        base = self.config.base_time
        return F.timestamp_micros(F.lit(base // 1000) + F.floor(((self.time_ns if ns is None else ns) + base % 1000) / 1000))


def _named(schema, *columns: Column) -> list[Column]:
    return [c.cast(f.dataType).alias(f.name) for c, f in zip(columns, schema)]


def _streams(numbers: DataFrame, config: GeneratorConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = Events(config)
    return tuple(numbers.where(e.kind() == kind).select(*columns) for kind, columns in (("person", e.person()), ("auction", e.auction()), ("bid", e.bid())))


def generate(spark: SparkSession, n_events: int, config: GeneratorConfig | None = None, first: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """People, auctions and bids among events ``first`` to ``first + n_events``."""
    return _streams(spark.range(first, first + n_events).withColumnRenamed("id", "n"), config or GeneratorConfig())


def generate_events(spark: SparkSession, n_events: int, config: GeneratorConfig | None = None) -> DataFrame:
    """The same as one frame of tagged events."""
    return mux(*generate(spark, n_events, config))


def stream(spark: SparkSession, config: GeneratorConfig | None = None, rows_per_second: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unbounded people, auctions and bids, paced by Spark's rate source."""
    config = config or GeneratorConfig()
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second or config.events_per_second).load()
    return _streams(rate.withColumnRenamed("value", "n"), config)


def numbers(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """The paced numbers that events are made from, for ``picks``."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("value").alias("n"))


def picks(config: GeneratorConfig) -> dict:
    """What people, auctions and bids take from ``numbers``, static or streaming."""
    return {name: (lambda df, i=i: _streams(df, config)[i]) for i, name in enumerate(("people", "auctions", "bids"))}
