"""SimHash near-duplicates: fingerprints, BK-trees, connected components.

Fingerprints take the majority of each bit over the XXH64 of all word shingles,
repeats included.  Equal fingerprints are one node with its smallest doc_id.
Nodes that may differ in at most ``radius`` bits meet in shards: the 64 bits are
cut into ``radius + c`` bands, and a node goes to a shard for each choice of
``c`` bands, whose bits are the key; two nodes within the radius agree on at
least one choice.  ``c`` follows from the number of nodes, so that shards of
unrelated nodes stay small whatever the corpus.

In a shard the nodes form a BK-tree: a child hangs at the Hamming distance from
its parent, and a search follows only edges whose distance is within the radius
of the distance to the parent.  Trees of many shards are built and searched
level by level in numpy.  A shard of over ``tree_nodes`` nodes is dealt into
several trees (``node_links``).  A task hands on stars (node, smallest node
linked in this shard), never pairs.

Components follow by alternating star contraction (each node takes the least of
its neighbours, in turns among the smaller and the larger ones) until nothing
changes; every round is written to the shared folder.  Joins on a node, a
fingerprint or a shard deal the rows of a hot key over many tasks.

Null and empty texts have fingerprint zero and are linked like others.  Rows
that repeat a doc_id are one node of the graph: their texts are linked.  Rows
without doc_id take the component of their fingerprint but bridge nothing, and
have none if no row with an id has that fingerprint.  An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb
from .common import spread_join

PRINTS = "doc_id bigint, fp bigint"
LINKS = "a bigint, b bigint"
#: byte -> eight counters of one byte each
_LANES = np.zeros(256, np.uint64)
for _bit in range(8):
    _LANES |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_bit)) & np.uint64(1)) << np.uint64(8 * _bit)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of k words; of all words if there are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())), np.uint64, len(words) - k + 1)


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A fingerprint for each group hashes[bounds[i]:bounds[i + 1]]: bits set in over half of its hashes."""
    n = np.diff(bounds)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    # counters of a byte overflow beyond 255: add up blocks of at most 255 first
    blocks = -(-n[some] // 255)
    first = np.r_[0, np.cumsum(blocks)]
    starts = np.repeat(bounds[:-1][some], blocks) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], blocks))
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for j in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, j]], starts)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first[:-1], axis=0)
        bits = counts * 2 > n[some][:, None]
        out[some] |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * j)
    return out


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    def work(batch: pa.RecordBatch) -> dict[str, object]:
        parts = [shingle_hashes(t, k) for t in batch.column(1).to_pylist()]
        bounds = np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]
        return {"doc_id": batch.column(0), "fp": majority(np.concatenate(parts) if parts else np.zeros(0, np.uint64), bounds).view(np.int64)}

    return common.map_text(docs.select("doc_id", "text"), PRINTS, work)


def bands(n_nodes: int, radius: int) -> list[int]:
    """Masks of the choices of bands.  More nodes take more bits to a key, so that unrelated nodes seldom meet."""
    c = next((c for c in range(1, 5) if 64 * c / (radius + c) >= np.log2(max(n_nodes, 2)) - 1), 4)
    n = radius + c
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(masks, c)]


class Forest:
    """A BK-tree for each group of consecutive nodes; the first of a group is its root, and ``member`` tells which are in the tree."""

    def __init__(self, codes: np.ndarray, group: np.ndarray, member: np.ndarray):
        self.codes = codes
        first = np.r_[True, group[1:] != group[:-1]]
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1]
        left = np.flatnonzero(member & ~first)
        at = self.root[left]
        keys, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(left):
            key = at * 65 + np.bitwise_count(codes[left] ^ codes[at])
            key, index, inverse = np.unique(key, return_index=True, return_inverse=True)
            child = left[index]
            keys.append(key)
            nodes.append(child)
            at = child[inverse]
            rest = np.ones(len(left), bool)
            rest[index] = False
            left, at = left[rest], at[rest]
        order = np.argsort(keys := np.concatenate(keys))
        self.keys, self.nodes = keys[order], np.concatenate(nodes)[order]

    def search(self, queries: np.ndarray, radius: int | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) within the radius (of each node, if it is an array), in portions."""
        radius = np.broadcast_to(radius, len(self.codes))
        stack = [(queries, self.root[queries])]
        while stack:
            q, at = stack.pop()
            if len(q) > 16_000:  # each may go on to some tens of nodes
                half = len(q) // 2
                stack += [(q[:half], at[:half]), (q[half:], at[half:])]
                continue
            d = np.bitwise_count(self.codes[q] ^ self.codes[at]).astype(np.int64)
            r = radius[q]
            near = (d <= r) & (q != at)
            if near.any():
                yield q[near], at[near]
            low = np.searchsorted(self.keys, at * 65 + np.maximum(d - r, 1))
            n = np.searchsorted(self.keys, at * 65 + np.minimum(d + r, 64), "right") - low
            if n.any():
                stack.append((np.repeat(q, n), self.nodes[tb.ragged(low, n)]))


def least_labels(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], value: np.ndarray) -> np.ndarray:
    """Of each of n nodes, a node of its component with the least value."""
    rank = np.empty(n, np.int64)
    order = np.argsort(value, kind="stable")
    rank[order] = np.arange(n)
    label = np.arange(n)  # by rank
    for q, at in pairs:
        a, b = rank[q], rank[at]
        while True:
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                break
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return order[label[rank]]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (c, key, i, j, side, fp, rep) sorted by shard, tree members first; gives stars of reps."""
    schema = common.arrow_schema(LINKS)

    def portion(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        c, key, i, j, side, fp, rep = (np.concatenate(x) for x in zip(*rows))
        new = np.r_[True, (c[1:] != c[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        group = np.cumsum(new) - 1
        keep = np.bincount(group)[group] > 1
        if not keep.any():
            return
        group, side, fp, rep = group[keep], side[keep], fp[keep].view(np.uint64), rep[keep]
        forest = Forest(fp, group, side != 1)
        label = least_labels(len(fp), forest.search(np.flatnonzero(side != 0), radius), rep)
        linked = rep[label] != rep
        if linked.any():
            yield common.to_batch({"a": rep[linked], "b": rep[label[linked]]}, schema)

    held: list[list[np.ndarray]] = []
    n, enough = 0, 200_000
    for batch in batches:
        held.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
        n += batch.num_rows
        if n >= enough:
            cols = [np.concatenate(x) for x in zip(*held)]
            changed = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]) | (cols[3][1:] != cols[3][:-1]))
            stop = int(changed[-1]) + 1 if len(changed) else 0  # the last shard waits for its end
            if stop:
                yield from portion([[x[:stop] for x in cols]])
            held, n = [[x[stop:] for x in cols]], n - stop
            enough = max(200_000, 2 * n)
    if n:
        yield from portion(held)


def cells(rows: DataFrame, key: list[str], size: Column, most: int) -> DataFrame:
    """``rows`` (with ``rep``) of each key in tasks of at most about two times ``most``: columns i, j and side are added.

    A key with ``size`` (summed over its rows) of over ``most`` is cut into parts,
    and each pair of parts (i <= j) is a cell, so that any two rows of a key meet in one.
    side: 2 in a cell of one part, else 0 for part i and 1 for part j.
    """
    parts = F.ceil(F.col("weight") / most).cast("int")
    large = rows.groupBy(*key).agg(F.sum(size).alias("weight")).where(F.col("weight") > most).select(*key, parts.alias("parts"))
    rows = rows.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # few keys are large
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    of_parts = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least(o, F.col("part")).cast("int").alias("i"), F.greatest(o, F.col("part")).cast("int").alias("j"), F.when(o == F.col("part"), 2).when(o > F.col("part"), 0).otherwise(1).alias("side")),
    )
    return rows.withColumn("part", own).withColumn("cell", F.explode(of_parts)).select(*(c for c in rows.columns if c != "parts"), "cell.i", "cell.j", "cell.side")


def _in_cells(rows: DataFrame, radius: int) -> DataFrame:
    """Stars of the rows (c, key, i, j, side, fp, rep) of each cell."""
    tree_first = (F.col("side") == 1).cast("int")
    placed = rows.select("c", "key", "i", "j", "side", "fp", "rep").repartition("c", "key", "i", "j").sortWithinPartitions("c", "key", "i", "j", tree_first)
    return placed.mapInArrow(common.released(lambda it: _links(it, radius)), LINKS)


def node_links(nodes: DataFrame, radius: int = 4, tree_nodes: int = 4096, rounds: int = 2) -> DataFrame:
    """Stars (a > b) among ``nodes`` (fp, rep) that connect all within the radius.

    A shard of over ``tree_nodes`` nodes is mostly a group of near copies.  It is dealt into
    trees by a hash, ``rounds`` times anew; what these link is put together, and then the largest
    component of each shard is compared with the others of the shard, and the others with
    each other, in cells.  Pairs within that component need no look, so a shard of one
    group costs rows in proportion to its size; the cells of a shard of many
    components grow with the square, and no pair is left out.
    """
    masks = bands(nodes.count(), radius)
    keys = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for c, m in enumerate(masks)))).alias("k")
    shards = nodes.select("fp", "rep", keys).select("k.c", "k.key", "fp", "rep")
    large = common.cut(shards.groupBy("c", "key").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") > tree_nodes))
    none = [F.lit(0).alias(x) for x in ("i", "j")] + [F.lit(2).alias("side")]
    if not large.count():
        return _in_cells(shards.select("*", *none), radius)
    sized = spread_join(shards, large, ["c", "key"], "weight", nodes.count() * len(masks), "left")
    small = sized.where("weight is null").select("c", "key", "fp", "rep", *none)
    sized = sized.where("weight is not null")
    trees = F.ceil(F.col("weight") / tree_nodes)
    again = sized.withColumn("i", F.explode(F.array(*map(F.lit, range(rounds))))).withColumn("j", F.pmod(F.xxhash64("rep", "i"), trees).cast("int")).withColumn("side", F.lit(2))
    first = components(_in_cells(small.unionByName(again.drop("weight")), radius))
    labelled = common.cut(sized.join(first, F.col("rep") == F.col("a"), "left").select("c", "key", "fp", "rep", "weight", F.coalesce("b", "rep").alias("label")))
    giants = labelled.groupBy("c", "key", "label").agg(F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight")).groupBy("c", "key").agg(F.max(F.struct("n", "label")).alias("most"), F.first("weight").alias("weight"))
    mixed = giants.where(F.col("most.n") < F.col("weight")).select("c", "key", "weight", F.col("most.label").alias("giant"), F.ceil(F.col("most.n") / tree_nodes).cast("int").alias("own"), F.ceil((F.col("weight") - F.col("most.n")) / tree_nodes).cast("int").alias("rest"))
    left = spread_join(labelled.drop("weight"), mixed, ["c", "key"], "weight", nodes.count() * len(masks))
    within = F.col("label") == F.col("giant")
    part = F.when(within, F.pmod(F.xxhash64("rep"), F.col("own"))).otherwise(F.col("own") + F.pmod(F.xxhash64("rep"), F.col("rest"))).cast("int")
    others = F.sequence(F.when(within, F.col("own")).otherwise(0), F.col("own") + F.col("rest") - 1)
    left = left.withColumn("part", part).withColumn("o", F.explode(others)).withColumns({"i": F.least("o", "part"), "j": F.greatest("o", "part"), "side": F.when(F.col("o") == F.col("part"), 2).when(F.col("o") > F.col("part"), 0).otherwise(1)})
    return first.unionAll(_in_cells(left, radius))


def components(links: DataFrame) -> DataFrame:
    """(a, b): the smallest member b of the component of each linked a, itself left out."""

    def stars(edges: DataFrame, larger: bool, total: int) -> DataFrame:
        """One contraction; ``larger``: every neighbour above a node goes to the least of its neighbourhood, else those below.

        A hub has a neighbour for each member of its group: neighbours are counted, and those of hubs are dealt over tasks.
        """
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("neighbours")).withColumn("m", F.least("a", "m"))
        joined = spread_join(both, least, ["a"], "neighbours", total)
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if larger else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = common.cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen, now = None, mark(edges)
    while now[0] and now != seen:
        seen = now
        edges = common.cut(stars(stars(edges, True, 2 * now[0]), False, 2 * now[0]))
        now = mark(edges)
    return edges


def near_duplicates(docs: DataFrame, radius: int = 4, k: int = 4, tree_nodes: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id linked, itself included)."""
    prints = common.cut(fingerprints(docs, k))
    nodes = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    linked = node_links(nodes.where("rep is not null").select("fp", "rep"), radius, tree_nodes)
    # a doc_id with several texts is one document: its fingerprints are linked
    several = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y")
    repeated = prints.join(several.select("doc_id"), "doc_id", "left_semi").join(nodes.select("fp", "rep"), "fp").where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(linked.unionAll(repeated))
    nodes = nodes.join(found, nodes["rep"] == found["a"], "left").select("fp", "copies", F.coalesce("b", "rep").alias("component_id"))
    own = spread_join(prints, nodes, ["fp"], "copies", prints.count())
    return own.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, broadcast_ids: int = 2_000_000, **options) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; rows without an id stay.

    The ids that go are broadcast if they are at most ``broadcast_ids`` (some tens
    of MB), so that texts aren't shuffled; more are joined by a shuffle.
    """
    others = common.cut(near_duplicates(docs, **options).where("doc_id <> component_id").select("doc_id").distinct())
    few = others.count() <= broadcast_ids
    return docs.join(F.broadcast(others) if few else others, "doc_id", "left_anti").select(docs.columns)
