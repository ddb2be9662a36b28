"""Managed state, and hot items held in it."""

import pytest
from pyspark.sql import Row
from test_queries import bids
from test_streaming import as_stream

from auctionflow.operators import verify
from auctionflow.plans import logical
from auctionflow.streaming import hot_items
from auctionflow.streaming.managed import Alarm, ManagedCount, ManagedMap
from auctionflow.streaming.run import FiniteRun


class Handle:
    """State of one grouping key in dictionaries, with the calls counted."""

    def __init__(self):
        self.states, self.timers, self.calls = {}, set(), 0

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, MapState(self))

    def getValueState(self, name, schema):
        return self.states.setdefault(name, ValueState())

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


class MapState(dict):
    def __init__(self, handle):
        self.handle = handle

    def getValue(self, key):
        self.handle.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.handle.calls += 1
        assert isinstance(key, tuple) and isinstance(value, tuple)
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)

    def containsKey(self, key):
        return key in self

    def iterator(self):
        return iter(self.items())

    def exists(self):
        return bool(self)


class ValueState:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_managed_map():
    handle = Handle()
    bare, wide = ManagedMap(handle, "a", "k bigint", "v bigint"), ManagedMap(handle, "b", "k bigint, l bigint", "v bigint, w string")
    bare.insert(1, 5)
    wide.insert((1, 2), (3, "x"))
    assert bare.get(1) == 5 and bare.get(2, 7) == 7 and 1 in bare and 2 not in bare
    assert wide.get((1, 2)) == (3, "x") and list(wide.items()) == [((1, 2), (3, "x"))] and wide.keys() == [(1, 2)]
    assert wide.remove((1, 2)) == (3, "x") and wide.remove((1, 2), "none") == "none" and wide.keys() == []
    assert bare.merge(1, 2, int.__add__) == 7 and bare.merge(9, 2, int.__add__) == 2
    assert bare.merge(9, -2, int.__add__, lambda v: not v) == 0 and 9 not in bare
    before = handle.calls
    bare.merge_all([(4, 1)] * 100 + [(5, 2), (5, -2)], int.__add__, lambda v: not v)
    assert handle.calls - before <= 4 and sorted(bare.items()) == [(1, 7), (4, 100)]
    assert bare.expire(lambda k: k < 4) == [(1, 7)] and bare.keys() == [4]
    bare.clear()
    assert list(bare.items()) == []


def test_managed_count_and_alarm():
    handle = Handle()
    count, alarm = ManagedCount(handle, "n"), Alarm(handle)
    assert count.get() == 0 and count.add(3) == 3 and count.add(-3) == 0 and not handle.states["n"].exists()
    alarm.earliest(50)
    alarm.earliest(70)
    assert handle.timers == {50} and alarm.at() == 50
    alarm.earliest(20)
    assert handle.timers == {20}
    alarm.rang()
    assert alarm.at() is None


@pytest.mark.parametrize("form", ["indexed", "running"])
def test_hot_items_in_batches(spark, tmp_path, form):
    """Bids out of order within the watermark's delay, gaps longer than a window, several batches; no state is left."""
    rows = [(n * n % 7, n, n, n * 3.7 % 61 + (500 if n > 120 else 0)) for n in range(150)]
    b = bids(spark, rows)
    want = logical.hot_items(b, 2, 5).select("window_end", "auction", "n")
    path = f"{tmp_path}/b"
    run = FiniteRun(spark, delay="70 seconds")
    stream = as_stream(spark, b, tmp_path, "b", 3)
    got = run.append(hot_items.part_hottest(run.ending(stream), 2, 5, form, parts=1))
    assert path and want.count() > 30 and verify.same(want, got)
    for name in ("index", "counts", *(["running"] if form == "running" else [])):
        left = spark.read.format("statestore").option("stateVarName", name).load(f"{run.folder}/checkpoint")
        assert left.count() == 0, name


@pytest.mark.parametrize("form", ["indexed", "running"])
def test_parts_and_their_best(spark, tmp_path, form):
    b = bids(spark, [(n * n % 23, n, n, n * 1.3) for n in range(200)])
    first, last = FiniteRun(spark), FiniteRun(spark)
    landed = first.append(hot_items.part_hottest(first.ending(as_stream(spark, b, tmp_path, "b", 2)), 5, 3, form, parts=3))
    parts = spark.readStream.schema(landed.schema).parquet(f"{first.folder}/out")
    # two files of one batch, as times of files tell nothing about those of their bids
    assert verify.same(logical.hot_items(b, 5, 3), last.append(hot_items.hottest_of_parts(last.ending(parts, "window_end"), 15)))


class Times:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


@pytest.mark.parametrize("form", ["indexed", "running"])
def test_calls_to_state_are_few(form, monkeypatch):
    """Calls leave the worker: they grow with slides and pieces, not with auctions.  The results of three batches are those of brute force."""
    monkeypatch.setattr(hot_items, "PIECE", 1_000)
    handle, seen, got = Handle(), {}, []
    work = hot_items.FORMS[form](1_000_000, 3)
    work.init(handle)
    for batch, slides in enumerate(([0, 1, 2], [2, 3], [9, 10])):
        rows = []
        for s in slides:
            auctions = [a for a in range(4_000) if (a + s + batch) % 3]
            k = [(a * 7 + s * 5 + batch) % 11 + 1 for a in auctions]
            rows.append(Row(part=0, slide=s, auctions=auctions, k=k))
            for a, n in zip(auctions, k):
                seen[s, a] = seen.get((s, a), 0) + n
        list(work.handleInputRows((0,), iter(rows), Times(2_000 * batch)))
        ends = 2 * batch + 2 if batch < 2 else 20  # where the watermark stands then
        while handle.timers and (at := min(handle.timers)) <= 1_000 * ends:
            handle.timers.remove(at)
            late = Times(1_000 * ends)
            late.getExpiryTimeInMs = lambda at=at: at
            got += [tuple(r) for r in work.handleExpiredTimer((0,), late, late)]
    want = []
    for end in range(1, 20):
        held = {}
        for (s, a), n in seen.items():
            if end - 3 <= s < end:
                held[a] = held.get(a, 0) + n
        if held:
            n, a = max((n, a) for a, n in held.items())
            want.append((end * 1_000_000, a, n))
    assert got == want and handle.calls < 400
    assert not any(state for state in handle.states.values() if isinstance(state, MapState))
