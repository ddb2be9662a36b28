"""Aggregates of one's own in two phases: states are merged before the shuffle and after it.

A ``Merge`` turns rows into states (tables with the keys and what the aggregate needs)
and reduces the states of each key; the reduction has to be associative, as tasks and batches
are put together in any grouping.  A task hands on what is left of its rows, so a
hot key crosses the shuffle with a few rows a task.  Both phases run in Arrow batches, and
hold at most about ``most`` states at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Reduce = Callable[[pa.Table], pa.Table]


@dataclass(frozen=True)
class Merge:
    """``lift`` makes states of rows, ``reduce`` leaves fewer states of each key, ``finish`` makes results of whole states; tables in and out."""

    keys: list[str]
    state: str
    result: str
    lift: Reduce
    reduce: Reduce
    finish: Reduce


def _batches(table: pa.Table, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    yield from table.to_batches(max_chunksize=rows)


def merged(df: DataFrame, merge: Merge, most: int = 200_000) -> DataFrame:
    """One or more rows of ``merge.result`` for each key; rows with equal keys, nulls too, are one key."""
    keys, lift, reduce, finish = merge.keys, merge.lift, merge.reduce, merge.finish

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = kept = 0
        for batch in batches:
            held.append(lift(pa.Table.from_batches([batch])))
            n += held[-1].num_rows
            if n >= max(50_000, 2 * kept):
                held = [reduce(pa.concat_tables(held))]
                n = kept = held[0].num_rows
                if kept >= most:  # many keys: merging on here would save little
                    yield from _batches(held[0])
                    held, n, kept = [], 0, 0
        if held:
            yield from _batches(reduce(pa.concat_tables(held)))

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """States sorted by key."""
        held: list[pa.Table] = []
        n = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n < 50_000:
                continue
            table = reduce(pa.concat_tables(held))
            last = pa.concat_tables(held).slice(n - 1)  # the last key may go on
            open_ = np.ones(table.num_rows, bool)
            for k in keys:
                value = last.column(k)[0]
                own = pc.is_null(table.column(k)) if not value.is_valid else pc.fill_null(pc.equal(table.column(k), value), False)
                open_ &= own.to_numpy(zero_copy_only=False) if isinstance(own, pa.Array) else own.combine_chunks().to_numpy(zero_copy_only=False)
            whole = table.filter(pa.array(~open_))
            if whole.num_rows:
                yield from _batches(finish(whole))
            held = [table.filter(pa.array(open_))]
            n = held[0].num_rows
        if n:
            yield from _batches(finish(reduce(pa.concat_tables(held))))

    states = df.mapInArrow(before, merge.state)
    return states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(after, merge.result)


def top_k(df: DataFrame, keys: list[str], order: list[tuple[str, str]], k: int) -> Merge:
    """The first ``k`` rows of each key along ``order`` ((column, "ascending" or "descending") pairs; they should leave no ties)."""
    schema = StructType([df.schema[c] for c in dict.fromkeys([*keys, *(c for c, _ in order)])])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    names = schema.names

    def reduce(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in keys] + order))
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in keys:
            codes = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        first = np.flatnonzero(new)
        place = np.arange(table.num_rows) - np.repeat(first, np.diff(np.r_[first, table.num_rows]))
        return table.filter(pa.array(place < k))

    return Merge(keys, ddl, ddl, lambda t: t.select(names), reduce, lambda t: t)


def average_of_last(df: DataFrame, key: str, order: list[str], value: str, k: int = 10) -> Merge:
    """(key, n, average): whole-number average of the last ``k`` values of each key along ``order``."""
    last = top_k(df.select(key, *order, value), [key], [(c, "descending") for c in order] + [(value, "descending")], k)

    def finish(table: pa.Table) -> pa.Table:
        sums = table.group_by([key]).aggregate([(value, "count"), (value, "sum")])
        return pa.table({key: sums.column(key), "n": sums.column(f"{value}_count"), "average": pa.array([s // n for s, n in zip(sums.column(f"{value}_sum").to_pylist(), sums.column(f"{value}_count").to_pylist())], pa.int64())})

    kind = df.schema[key].dataType.simpleString()
    return Merge([key], last.state, f"`{key}` {kind}, n bigint, average bigint", last.lift, last.reduce, finish)
