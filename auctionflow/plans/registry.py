"""Query names that a run can select, each a logical query with a variant and a state backend.

Names of one engine with pluggable state carry the backend; the others have a
backend of their own.  A backend is a session setting here, so names that differ
in it alone give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import closing, sliding
from ..streaming import hot_items, stateful
from . import logical


@dataclass(frozen=True)
class Streams:
    """The inputs of all queries; static or streaming frames."""

    people: DataFrame
    auctions: DataFrame
    bids: DataFrame

    def closed(self) -> DataFrame:
        if self.bids.isStreaming:
            return stateful.winning_bids(self.auctions, self.bids)
        return closing.winning_bids(self.auctions, self.bids)


@dataclass(frozen=True)
class Params:
    """``second`` is how long a second of Q5, Q7 and the windows lasts in the events' time."""

    window_slide: float = 1
    window_slice_count: int = 60
    states: tuple[str, ...] = logical.STATES
    second: float = 1

    @property
    def size(self) -> float:
        if self.window_slide <= 0 or self.window_slice_count <= 0:
            raise ValueError("window-slide and window-slice-count have to be over 0")
        return self.window_slide * self.window_slice_count * self.second

    @property
    def slide(self) -> float:
        return self.window_slide * self.second


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Streams, Params], DataFrame]
    backend: str
    mode: str = "append"
    #: what is left to do on each batch of a stream, as a static frame; static plans do it themselves
    finish: Callable[[DataFrame], DataFrame] | None = None


def _q3(s: Streams, p: Params) -> DataFrame:
    return logical.local_items(s.auctions, s.people, states=p.states)


def _q4(s: Streams, p: Params) -> DataFrame:
    return logical.category_average(s.closed())


def _q5(form: str) -> Callable[[Streams, Params], DataFrame]:
    def plan(s: Streams, p: Params) -> DataFrame:
        if s.bids.isStreaming and form == "incremental":
            return hot_items.part_hottest(s.bids, p.second, 60, "running", parts=1)  # with one part its best is the window's best
        return logical.hot_items(s.bids, p.second, 60, form)

    return plan


def _q6(s: Streams, p: Params) -> DataFrame:
    return stateful.last_average(s.closed()) if s.bids.isStreaming else logical.last_average(s.closed())


def _q7(s: Streams, p: Params) -> DataFrame:
    return logical.highest_bid(s.bids, 10 * p.second)


def _q8(width: float) -> Callable[[Streams, Params], DataFrame]:
    def plan(s: Streams, p: Params) -> DataFrame:
        return logical.new_users(s.people, s.auctions, width)

    return plan


def _count(s: Streams, p: Params) -> DataFrame:
    return sliding.window_counts(s.bids, p.slide, p.size)


def _rank(s: Streams, p: Params) -> DataFrame:
    return (sliding.sliced_counts if s.bids.isStreaming else sliding.window_ranks)(s.bids, p.slide, p.size)


def _all() -> dict[str, Query]:
    found = [Query("q4_flex", _q4, "memory", "complete")]
    for backend in ("faster", "rocksdb"):
        found += [
            Query(f"q3_{backend}", _q3, backend),
            Query(f"q4_{backend}", _q4, backend, "complete"),
            Query(f"q5_{backend}", _q5("direct"), backend),
            Query(f"q5_{backend}_index", _q5("sliced"), backend),
            Query(f"q6_{backend}", _q6, backend),
            Query(f"q7_{backend}", _q7, backend),
            Query(f"q8_{backend}", _q8(12 * 3_600), backend),
            Query(f"q8_{backend}_map", _q8(12 * 3_600), backend),
        ]
    for stem, backend in (("window_2_faster", "faster"), ("window_2a_rocksdb", "rocksdb"), ("window_2b_rocksdb", "rocksdb")):
        found += [Query(f"{stem}_count", _count, backend), Query(f"{stem}_rank", _rank, backend, finish=sliding.ranks_of)]
    found += [
        Query("q3", _q3, "rocksdb"),
        Query("q4", _q4, "rocksdb", "complete"),
        Query("q5", _q5("incremental"), "rocksdb"),
        Query("q5_index", _q5("sliced"), "rocksdb"),
        Query("q6", _q6, "rocksdb"),
        Query("q7", _q7, "rocksdb"),
        Query("q8", _q8(720), "rocksdb"),
    ]
    return {q.name: q for q in found}


QUERIES = _all()


def select(names: Iterable[str]) -> list[Query]:
    """The queries of the given names, in order; unknown names are ignored."""
    return [QUERIES[n] for n in dict.fromkeys(names) if n in QUERIES]
