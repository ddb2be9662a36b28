"""Managed state of a stateful processor: maps with merges, counts, and timers that a key needs only one of.

State calls leave the Python worker, so whatever a batch does to one key of a map
is put together first: ``merge_all`` reads and writes each key once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql.streaming import StatefulProcessorHandle


class ManagedMap:
    """A map within the state of a grouping key.  Keys and values are tuples, or bare values where the schema has one column."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, key: str, value: str):
        self.state = handle.getMapState(name, key, value)
        self.bare_key, self.bare_value = "," not in key, "," not in value

    def _key(self, key) -> tuple:
        return (key,) if self.bare_key else tuple(key)

    def get(self, key, default=None):
        found = self.state.getValue(self._key(key))
        return default if found is None else found[0] if self.bare_value else tuple(found)

    def insert(self, key, value) -> None:
        self.state.updateValue(self._key(key), (value,) if self.bare_value else tuple(value))

    def remove(self, key, default=None):
        """The value that was there, or ``default``."""
        found = self.get(key, default)
        self.state.removeKey(self._key(key))
        return found

    def __contains__(self, key) -> bool:
        return self.state.containsKey(self._key(key))

    def merge(self, key, value, combine: Callable, drop: Callable | None = None):
        """Puts ``combine(old, value)`` (``value`` where there is none) at ``key``, or removes it if ``drop`` says so; the new value."""
        old = self.get(key)
        new = value if old is None else combine(old, value)
        if drop and drop(new):
            if old is not None:
                self.state.removeKey(self._key(key))
        else:
            self.insert(key, new)
        return new

    def merge_all(self, values: Iterable[tuple], combine: Callable, drop: Callable | None = None) -> None:
        """``merge`` of (key, value) pairs, each key once."""
        together: dict = {}
        for key, value in values:
            together[key] = combine(together[key], value) if key in together else value
        for key, value in together.items():
            self.merge(key, value, combine, drop)

    def keys(self) -> list:
        return [k[0] if self.bare_key else tuple(k) for k in self.state.keys()] if self.state.exists() else []

    def items(self) -> Iterator[tuple]:
        if self.state.exists():
            for k, v in self.state.iterator():
                yield (k[0] if self.bare_key else tuple(k)), (v[0] if self.bare_value else tuple(v))

    def expire(self, due: Callable) -> list:
        """Removes the entries whose key is ``due`` and returns them as (key, value), in order."""
        return [(k, self.remove(k)) for k in sorted(k for k in self.keys() if due(k))]

    def clear(self) -> None:
        self.state.clear()


class ManagedCount:
    """A number within the state of a grouping key; zero holds no state."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.state = handle.getValueState(name, "n bigint")

    def get(self) -> int:
        return self.state.get()[0] if self.state.exists() else 0

    def add(self, n: int) -> int:
        new = self.get() + n
        if new:
            self.state.update((new,))
        else:
            self.state.clear()
        return new


class Alarm:
    """The one timer that a grouping key has: the earliest time asked for."""

    def __init__(self, handle: StatefulProcessorHandle, name: str = "alarm"):
        self.handle, self.state = handle, handle.getValueState(name, "at bigint")

    def at(self) -> int | None:
        return self.state.get()[0] if self.state.exists() else None

    def earliest(self, ms: int) -> None:
        """Rings at ``ms`` unless it rings earlier."""
        now = self.at()
        if now is None or ms < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(ms)
            self.state.update((ms,))

    def rang(self) -> None:
        self.state.clear()
