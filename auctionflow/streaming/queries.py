"""Streaming twins of the queries over the sample tables, run to the end of the input."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sliding, verify
from ..plans import logical
from ..sources.tables import Tables
from . import hot_items as managed
from . import stateful
from .fanout import FanOut, run_finite
from .run import FiniteRun

DAY, HOUR = 86_400, 3_600


def local_items(spark: SparkSession, sf_dir: str, states: tuple[str, ...], backend: str = "rocksdb") -> DataFrame:
    """Stream-stream join without a time bound: both sides stay in state, narrow."""
    t = Tables(spark, sf_dir, streaming=True)
    return FiniteRun(spark, backend).append(logical.local_items(t.auctions(), t.people(), states=states))


def closed_auctions(spark: SparkSession, sf_dir: str, reserve: int = 5_000) -> DataFrame:
    t, run = Tables(spark, sf_dir, streaming=True), FiniteRun(spark)
    return run.append(stateful.winning_bids(run.ending(t.auctions(reserve)), run.ending(t.closing_bids())))


def _closed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed auctions land in a sink that the next query reads as its own stream."""
    run = FiniteRun(spark)
    t = Tables(spark, sf_dir, streaming=True)
    landed = run.append(stateful.winning_bids(run.ending(t.auctions()), run.ending(t.closing_bids())))
    return spark.readStream.schema(landed.schema).parquet(f"{run.folder}/out")


def category_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FiniteRun(spark).complete(logical.category_average(_closed_stream(spark, sf_dir)))


def last_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FiniteRun(spark).append(stateful.last_average(_closed_stream(spark, sf_dir)))


def hot_items(spark: SparkSession, sf_dir: str, slide: float = HOUR, slices: int = 60, form: str = "sliced", backend: str = "rocksdb") -> DataFrame:
    run = FiniteRun(spark, backend)
    return run.append(logical.hot_items(run.ending(Tables(spark, sf_dir, streaming=True).bids()), slide, slices, form))


def _hottest(first: FiniteRun, bids: DataFrame, form: str, slide: float = HOUR, slices: int = 60) -> DataFrame:
    """Parts of the auctions land in a sink; the best of each window's parts is a stream over it."""
    last = FiniteRun(first.spark)
    landed = first.append(managed.part_hottest(first.ending(bids), slide, slices, form))
    parts = first.spark.readStream.schema(landed.schema).parquet(f"{first.folder}/out")
    return last.append(managed.hottest_of_parts(last.ending(parts, "window_end"), slide * slices))


def managed_hot_items(spark: SparkSession, sf_dir: str, form: str, slide: float = HOUR, slices: int = 60) -> DataFrame:
    return _hottest(FiniteRun(spark), Tables(spark, sf_dir, streaming=True).bids(), form, slide, slices)


def highest_bid(spark: SparkSession, sf_dir: str, width: float = DAY, backend: str = "rocksdb") -> DataFrame:
    run = FiniteRun(spark, backend)
    return run.append(logical.highest_bid(run.ending(Tables(spark, sf_dir, streaming=True).bids()), width))


def new_users(spark: SparkSession, sf_dir: str, width: float = 12 * HOUR) -> DataFrame:
    t, run = Tables(spark, sf_dir, streaming=True), FiniteRun(spark)
    return run.append(logical.new_users(run.ending(t.new_people()), run.ending(t.new_auctions()), width))


def window_counts(spark: SparkSession, sf_dir: str, slide: float = HOUR, size: float = 6 * HOUR) -> DataFrame:
    run = FiniteRun(spark)
    return run.append(sliding.window_counts(run.ending(Tables(spark, sf_dir, streaming=True).bids()), slide, size))


def window_ranks(spark: SparkSession, sf_dir: str, slide: float = 6 * HOUR, size: float = DAY) -> DataFrame:
    """A window's counts come in the batch that closes it, all at once, and are ranked there."""
    run = FiniteRun(spark)
    counts = sliding.sliced_counts(run.ending(Tables(spark, sf_dir, streaming=True).bids()), slide, size)
    return run.append_each(counts, sliding.ranks_of)


def unequal_bids(spark: SparkSession, sf_dir: str, altered: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Times at which the stream of bids and an altered one differ, each told when both have passed it."""
    run = FiniteRun(spark)
    bids = lambda: Tables(spark, sf_dir, streaming=True).bids()
    return run.append(verify.unequal_times(run.ending(bids()), run.ending(altered(bids()))))


#: Queries over one reading of the events: Q5, Q7, Q8 and COUNT.
SHARED: dict[str, Callable[[FiniteRun, FanOut], DataFrame]] = {
    "hot_items": lambda run, f: _hottest(run, f.feed("bids"), "indexed"),
    "highest_bid": lambda run, f: run.append(logical.highest_bid(run.ending(f.feed("bids")), DAY)),
    "new_users": lambda run, f: run.append(logical.new_users(run.ending(f.feed("people")), run.ending(f.feed("auctions")), 12 * HOUR)),
    "window_counts": lambda run, f: run.append(sliding.window_counts(run.ending(f.feed("bids")), HOUR, 6 * HOUR)),
}


def _fan(spark: SparkSession, sf_dir: str) -> FanOut:
    t = Tables(spark, sf_dir, streaming=True)
    return FanOut(spark, t.read("events"), {"bids": t.bids_of, "people": t.people_of, "auctions": t.auctions_of})


def _shared(spark: SparkSession, sf_dir: str) -> tuple[FanOut, dict[str, DataFrame]]:
    """All four at once."""
    fan = _fan(spark, sf_dir)
    return fan, run_finite(fan, SHARED)


@functools.lru_cache(maxsize=2)
def _captured_once(application: str, spark: SparkSession, sf_dir: str) -> FanOut:
    fan = _fan(spark, sf_dir)
    fan.read_all()
    return fan


@functools.lru_cache(maxsize=8)
def _shared_once(application: str, spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return SHARED[name](FiniteRun(spark), _captured_once(application, spark, sf_dir))


def shared(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One result over the feeds, which an application captures once for a folder; a query runs when its result is asked for first."""
    return _shared_once(spark.sparkContext.applicationId, spark, sf_dir, name)
