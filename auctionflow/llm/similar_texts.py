"""SimHash near-dedup of texts: all pairs whose sets of word shingles have a Jaccard similarity of at least ``least``.

Fingerprints and BK-trees are those of ``near_duplicates``; here they bring up
candidates, and whole sets decide.  Fingerprints of sets of similarity 0.8
differ in about ten bits, a radius at which shards keyed by bits would hold
everything.  Shards are keyed by shingles instead: with the shingles of all
documents in one order, two sets of similarity t share a shingle among the first
n - ceil(t n) + 1 of each, so every similar pair meets in a shard.  The order puts
shingles that are common in a sample last, which keeps shards small; any order
gives the same result.  A BK-tree of each shard, searched within ``radius``
bits (sets of under ``SMALL`` shingles: within any), tells which members have a candidate.

A member takes its whole set to the ``picks`` of its shards that have most candidate
pairs, and there each candidate pair whose members are not linked yet is compared
exactly.  Members with a candidate that has none of their picks take the shard with most such
pairs too, ``more_picks`` times, and those that still have one all shards in which it is so.  Large
shards are cut into cells, so no task holds a whole one; a task hands on members
and stars, never the pairs of a group.

Equal sets are one node.  Null and empty texts have the empty set and are linked
with each other.  Rows that repeat a doc_id are one document: their texts are
linked.  Rows without doc_id bridge nothing and have no component.  Other
columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb
from .common import spread_join
from .near_duplicates import Forest, cells, components, majority, shingle_hashes

PREFIXES = "doc_id bigint, sig bigint, n int, fp bigint, prefix array<bigint>"
LIVE = "h bigint, rep bigint, sig bigint, n int, fp bigint, picks array<bigint>, found bigint"
FACTS = ["sig", "n", "fp"]
PAIRS = "a bigint, b bigint"
SETS = "doc_id bigint, sig bigint, shingles array<bigint>"
#: Sets of fewer shingles are candidates at any distance: few shingles scatter the bits of a fingerprint.
SMALL = 24
#: Members of a cell of a tree, and shingles of a cell whose sets are compared.
TREE_NODES, CELL_SHINGLES = 1024, 250_000
#: Each portion reads the texts again.
MOST_PORTIONS = 8


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, k))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in parts])], pa.int32()), pa.array(values.view(np.int64)))


def _signature(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 5)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> dict[str, object]:
        sets = [shingle_set(t, k) for t in common.texts(batch)]
        return {"doc_id": batch.column(0), "sig": np.array([_signature(s) for s in sets], np.uint64).view(np.int64), "shingles": _lists(sets)}

    return common.map_text(docs.select("doc_id", "text"), SETS, work)


def common_shingles(docs: DataFrame, k: int, sample: int = 4_000, at_least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles of at least ``at_least`` documents of a sample, with their counts; bounded by the sample's size, used for the order only."""
    part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(max(1, docs.count() // sample))) == 0).where(F.octet_length("text") < 100_000)
    found = shingle_sets(part, k).select(F.explode("shingles").alias("h")).groupBy("h").count().where(F.col("count") >= at_least).collect()
    h = np.array([r["h"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["count"] for r in found], np.int64)[order]


def in_order(shingles: np.ndarray, late: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A set with its shingles in the order of all documents: those seldom seen in the sample first."""
    known, counts = late
    if not len(known) or not len(shingles):
        return shingles
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    return shingles[np.argsort(np.where(known[at] == shingles, counts[at], 0), kind="stable")]


def prefixes(docs: DataFrame, k: int, least: float, late: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    late = docs.sparkSession.sparkContext.broadcast(late)

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        sets = [shingle_set(t, k) for t in common.texts(batch)]
        heads = [in_order(s, late.value)[: len(s) - math.ceil(least * len(s) - 1e-9) + 1] for s in sets]
        sig = np.array([_signature(s) for s in sets], np.uint64).view(np.int64)
        bounds = np.r_[0, np.cumsum([len(s) for s in sets], dtype=np.int64)]
        fp = majority(np.concatenate(sets) if sets else np.zeros(0, np.uint64), bounds).view(np.int64)
        return {"doc_id": batch.column(0), "sig": sig, "n": np.diff(bounds).astype(np.int32), "fp": fp, "prefix": _lists(heads)}

    return common.map_text(docs.select("doc_id", "text"), PREFIXES, work)


def _whole_cells(batches: Iterator[pa.RecordBatch], most: int, weight: str | None = None) -> Iterator[pa.Table]:
    """Rows sorted by (h, i, j) in portions of whole cells, of about ``most`` rows, or ``most`` in the sum of ``weight``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows if weight is None else int(batch.column(batch.schema.get_field_index(weight)).to_numpy().sum())
        if n < most:
            continue
        rows = pa.Table.from_batches(held)
        h, i, j = (rows.column(c).to_numpy() for c in ("h", "i", "j"))
        changed = np.flatnonzero((h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        if len(changed):
            yield rows.slice(0, stop := int(changed[-1]) + 1)
            held = rows.slice(stop).to_batches()
            n = sum(x.num_rows if weight is None else int(x.column(x.schema.get_field_index(weight)).to_numpy().sum()) for x in held)
    if held and (rows := pa.Table.from_batches(held)).num_rows:
        yield rows


def _groups(rows: pa.Table) -> np.ndarray:
    """Number of the cell of each row."""
    h, i, j = (rows.column(c).to_numpy() for c in ("h", "i", "j"))
    return np.cumsum(np.r_[True, (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) - 1


def _candidates(rows: pa.Table, radius: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, row) of a cell whose fingerprints and sizes let them be similar, each once."""
    side, rep, n, fp = (rows.column(c).to_numpy() for c in ("side", "rep", "n", "fp"))
    forest = Forest(fp.view(np.uint64), _groups(rows), side != 1)
    for q, at in forest.search(np.flatnonzero(side != 0), np.where(n < SMALL, 64, radius)):
        # a cell of two parts has each pair once, but its root may be of the searching part if the other has no row
        once = np.where(side[q] == 2, q > at, side[at] == 0)
        fit = once & (rep[q] != rep[at]) & (np.minimum(n[q], n[at]) >= least * np.maximum(n[q], n[at]) - 1e-9)
        yield q[fit], at[fit]


def _live(batches: Iterator[pa.RecordBatch], radius: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows (h, i, j, side, rep, sig, n, fp, picks); those with a candidate they have no pick in common with, and how many such pairs their cell has."""
    schema = common.arrow_schema(LIVE)
    for rows in _whole_cells(batches, 200_000):
        lists, group = rows.column("picks").combine_chunks(), _groups(rows)
        width = np.diff(lists.offsets.to_numpy())
        taken = np.arange(max(1, int(width.max()))) < width[:, None]
        picks = np.zeros(taken.shape, np.int64)
        picks[taken] = lists.flatten().to_numpy()
        keep, found = np.zeros(rows.num_rows, bool), np.zeros(int(group[-1]) + 1, np.int64)
        for q, at in _candidates(rows, radius, least):
            met = np.zeros(len(q), bool)
            for s in range(picks.shape[1]):
                for t in range(picks.shape[1]):
                    met |= (picks[q, s] == picks[at, t]) & taken[q, s] & taken[at, t]
            q, at = q[~met], at[~met]
            keep[q] = keep[at] = True
            found += np.bincount(group[q], minlength=len(found))
        yield common.to_batch({**{c: rows.column(c).to_numpy()[keep] for c in ("h", "rep", "sig", "n", "fp")}, "picks": lists.filter(pa.array(keep)), "found": found[group[keep]]}, schema)


def _compared(batches: Iterator[pa.RecordBatch], radius: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows (h, i, j, side, rep, n, fp, shingles); stars of reps whose sets are similar."""
    schema = common.arrow_schema(PAIRS)
    for rows in _whole_cells(batches, 1_000_000, "n"):
        lists = rows.column("shingles").combine_chunks()
        n, rep = np.diff(lists.offsets.to_numpy()).astype(np.int64), rows.column("rep").to_numpy()
        bounds = np.r_[0, np.cumsum(n)]
        ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        mine = np.zeros(len(ids), bool)
        label = np.arange(len(n))

        def tops(x: np.ndarray) -> np.ndarray:
            while ((up := label[x]) != x).any():
                x = up
            return x

        for q, at in _candidates(rows, radius, least):
            order = np.argsort(q, kind="stable")
            q, at = q[order], at[order]
            cuts = np.flatnonzero(np.r_[True, q[1:] != q[:-1], True]) if len(q) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                x, others = int(q[a]), at[a:b]
                own = int(tops(q[a : a + 1])[0])
                others = others[tops(others) != own]  # those not linked yet
                if not len(others):
                    continue
                mine[set_x := ids[bounds[x] : bounds[x + 1]]] = True
                size = n[others]
                hits = np.r_[0, np.cumsum(mine[ids[tb.ragged(bounds[others], size)]])]
                ends = np.cumsum(size)
                shared = hits[ends] - hits[ends - size]
                mine[set_x] = False
                alike = others[shared >= least * (n[x] + size - shared) - 1e-9]
                if len(alike):
                    joined = np.r_[own, tops(alike)]
                    label[joined] = joined.min()
        top = tops(np.arange(len(n)))
        smallest = np.full(len(n), np.iinfo(np.int64).max)
        np.minimum.at(smallest, top, rep)
        linked = rep != smallest[top]
        yield common.to_batch({"a": rep[linked], "b": smallest[top][linked]}, schema)


def _by_cell(placed: DataFrame) -> DataFrame:
    """Rows with h, i, j and side in the tasks of their cells, tree members first."""
    return placed.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", (F.col("side") == 1).cast("int"), "rep")


def similar_components(docs: DataFrame, k: int = 5, least: float = 0.8, radius: int = 24, picks: int = 2, more_picks: int = 2, broadcast_rows: int = 200_000, broadcast_ids: int = 2_000_000, portion: int = 500_000) -> DataFrame:
    """doc_id, component_id (the smallest doc_id linked, itself included), a row for each document with an id.

    Members of up to ``broadcast_rows`` rows (some tens of MB) are broadcast to the
    scan that reads their texts.  Of more, only the ids go there, up to ``broadcast_ids``, and
    the sets are joined by a shuffle; texts are shuffled beyond that only.

    Sets are compared in portions of about ``portion`` places in cells, each with whole shards, up
    to ``MOST_PORTIONS``: what one shuffles is gone before the next, so the disk holds a part of it.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    heads = common.cut(prefixes(docs, k, least, common_shingles(docs, k)))
    first = F.min(F.struct("doc_id", "n", "fp", "prefix"))
    wide = common.cut(heads.groupBy("sig").agg(first.alias("x"), F.count(F.lit(1)).alias("copies")).select("sig", F.col("x.doc_id").alias("rep"), "x.n", "x.fp", "x.prefix", "copies"))
    ids = common.cut(heads.select("doc_id", "sig"))
    common.discard(heads)
    postings = wide.select(F.explode("prefix").alias("h"), "sig")
    several = common.cut(postings.groupBy("h").count().where("count > 1").select("h"))
    nodes = common.cut(wide.drop("prefix"))
    shared = common.cut(postings.join(several, "h").join(nodes.select("rep", *FACTS), "sig").select("h", "rep", *FACTS))
    common.discard(wide)

    cell = ["h", "i", "j", "side"]
    of_member = Window.partitionBy("rep", *FACTS)
    place = F.row_number().over(of_member.orderBy(F.desc("found"), F.desc("h")))

    def apart(rows: DataFrame, take: int) -> DataFrame:
        """Of members of shards (h, rep, picks), those that have a candidate there and no pick in common with it; ``take`` more of a member's shards are picked.

        All rows of a member go to one task: no more than its prefix has shingles, and each as often as its shard has parts.
        """
        placed = cells(rows, ["h"], F.lit(1), TREE_NODES).select(*cell, "rep", *FACTS, "picks")
        found = _by_cell(placed).mapInArrow(common.released(lambda it: _live(it, radius, least)), LIVE).repartition("rep", *FACTS)
        found = found.groupBy("h", "rep", *FACTS, "picks").agg(F.sum("found").alias("found")).withColumn("taken", place <= take)
        new = F.collect_list(F.when(F.col("taken"), F.col("h"))).over(of_member)
        return common.cut(found.select("h", "rep", *FACTS, F.array_union("picks", new).alias("picks"), "taken"))

    left = shared.withColumn("picks", F.array().cast("array<bigint>"))
    rounds = [left := apart(left, take) for take in (picks, *[1] * more_picks)]
    members = functools.reduce(DataFrame.unionByName, [x.where("taken") for x in rounds] + [apart(left, 0)]).select("h", "rep", *FACTS).distinct()
    where = cells(members, ["h"], F.col("n") + 1, CELL_SHINGLES).groupBy("rep", *FACTS).agg(F.collect_list(F.struct(*cell)).alias("where"))
    where = common.cut(where.withColumnRenamed("rep", "doc_id"))
    total = where.agg(F.sum(F.size("where"))).first()[0] or 0
    again = common.cut(ids.groupBy("doc_id").agg(F.min("sig").alias("x"), F.max("sig").alias("y"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    repeats = again.count()

    def compared(where: DataFrame) -> DataFrame:
        """Stars of the members in the cells that ``where`` has."""
        small = where.count() <= broadcast_rows
        of = where.select("doc_id").distinct()
        few = small or (of := common.cut(of)).count() <= broadcast_ids
        sets = shingle_sets(docs.join(F.broadcast(of) if few else of, "doc_id", "left_semi"), k)
        if repeats:  # rows that occur more than once
            sets = sets.dropDuplicates(["doc_id", "sig"])
        rows = sets.join(F.broadcast(where) if small else where, ["doc_id", "sig"]).select(F.explode("where").alias("c"), F.col("doc_id").alias("rep"), "n", "fp", "shingles")
        return _by_cell(rows.select("c.*", "rep", "n", "fp", "shingles")).mapInArrow(common.released(lambda it: _compared(it, radius, least)), PAIRS)

    portions = max(1, min(MOST_PORTIONS, -(-total // portion)))
    if portions == 1:
        links = compared(where)
    else:
        mine = lambda i: F.filter("where", lambda c: F.pmod(F.xxhash64(c["h"], F.lit(3)), F.lit(portions)) == i)
        parts = (where.withColumn("where", mine(i)).where(F.size("where") > 0) for i in range(portions))
        links = functools.reduce(DataFrame.unionAll, [common.cut(compared(x)) for x in parts])
    if repeats:  # a doc_id with several texts is one document: its sets are linked
        of = again.where("x <> y")
        links = links.unionAll(ids.join(of.select("doc_id"), "doc_id", "left_semi").join(nodes.select("sig", "rep"), "sig").where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = components(links)
    nodes = nodes.join(found, nodes["rep"] == found["a"], "left").select("sig", "copies", F.coalesce("b", "rep").alias("component_id"))
    return spread_join(ids, nodes, ["sig"], "copies", ids.count()).select("doc_id", "component_id")


def keep_first(docs: DataFrame, broadcast_ids: int = 2_000_000, **options) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; rows without an id stay.

    Rows that repeat that doc_id all stay.  The ids that go are broadcast if they are at
    most ``broadcast_ids``, as in near_duplicates.
    """
    others = common.cut(similar_components(docs, **options).where("doc_id <> component_id").select("doc_id").distinct())
    few = others.count() <= broadcast_ids
    return docs.join(F.broadcast(others) if few else others, "doc_id", "left_anti").select(docs.columns)
