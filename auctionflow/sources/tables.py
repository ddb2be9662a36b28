"""The auction streams over the sample tables (customers, orders, lineitem, events), static or streaming."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tables:
    """Reads tables of ``folder``; ``streaming`` reads files as a stream.  Times become TIMESTAMP, which watermarks need."""

    spark: SparkSession
    folder: str
    streaming: bool = False

    def read(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if not self.streaming:
            return self.spark.read.parquet(path)
        schema = self.spark.read.parquet(path).schema
        # a file source lists folders: a table of one file is picked out of its folder by name
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{{{name}.parquet,part-*}}").option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}.parque[t]")

    def people(self) -> DataFrame:
        """Customers with nation as city and region as state; there is no time."""
        still = Tables(self.spark, self.folder)
        place = still.read("nation").join(still.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        rows = self.read("customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
        return rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("city"), F.col("r_name").alias("state"))

    def auctions(self, reserve: int = 5_000, days: int = 365) -> DataFrame:
        start = F.col("o_orderdate").cast("timestamp")
        return self.read("orders").select(
            F.col("o_orderkey").alias("id"),
            F.lit(reserve).cast("bigint").alias("reserve"),
            start.alias("date_time"),
            (start + F.expr(f"INTERVAL {days} DAYS")).alias("expires"),
            F.col("o_custkey").alias("seller"),
            (F.lit(10) + F.col("o_orderkey") % 5).cast("bigint").alias("category"),
        )

    def closing_bids(self) -> DataFrame:
        """Bids on the orders, from lineitem."""
        price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        return self.read("lineitem").select(F.col("l_orderkey").alias("auction"), F.col("l_suppkey").alias("bidder"), price.alias("price"), F.col("l_shipdate").cast("timestamp").alias("date_time"))

    def bids(self) -> DataFrame:
        """Bids for windows, from events."""
        return self.bids_of(self.read("events"))

    def new_people(self) -> DataFrame:
        return self.people_of(self.read("events"))

    def new_auctions(self) -> DataFrame:
        return self.auctions_of(self.read("events"))

    @staticmethod
    def bids_of(events: DataFrame) -> DataFrame:
        price = F.round(F.col("value") * 100).cast("bigint")
        return events.select(F.col("user_id").alias("auction"), F.col("event_id").alias("bidder"), price.alias("price"), F.col("ts").cast("timestamp").alias("date_time"))

    @staticmethod
    def people_of(events: DataFrame) -> DataFrame:
        return events.where("event_type = 'signup'").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("date_time"))

    @staticmethod
    def auctions_of(events: DataFrame) -> DataFrame:
        return events.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("user_id").alias("seller"), F.col("ts").cast("timestamp").alias("date_time"))
