"""Near-duplicate embeddings: robust-pruned graphs over overlapping cluster shards, searched by range.

Vectors are brought to length one in double precision, and equal ones are one node.
Centres fitted on a bounded sample (``SAMPLE_BYTES``) deal the nodes out: each goes to the
shards of its ``overlap`` nearest centres, so that near vectors meet in some shard.

* Each shard gets a flat graph: of a node's nearest ones those are kept that no kept one is
  closer to by ``ALPHA`` (robust pruning), plus a few drawn far ones; edges lead both ways.
* A node's lists of neighbours from all of its shards are united.
* Each node is looked for in its shards: a greedy search with a beam starts at the
  shard's medoid; then the range grows from the node and all found within it, through neighbours
  within it or a little beyond (``SLACK``).  Cosines are computed in full, so links are verified.
* A pair that meets in several shards counts in the one of its smallest common centre.  A
  task hands on counts and stars, never pairs.
* Links of up to ``AUDITED`` nodes are compared with brute force over all vectors.  While recall is
  under ``RECALL``, everything is built again with twice the overlap and beam, ``WIDENED`` times at most (then a warning).

A shard of over ``most`` nodes is dealt into parts, and each pair of parts is a cell with a
graph of its own.  The work on a group of m different vectors that all link with each other grows with m * m
(cosines, in numpy; no rows), as each has m links to count; equal vectors cost one node.

Null vectors, those with null or non-finite components and zero vectors link with
nothing, nor do vectors of different lengths with each other, nor rows without vec_id; these are
components of their own and kept.  Rows that repeat a vec_id are vectors of their own.
An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb
from .common import spread_join
from .near_duplicates import cells, components, least_labels

UNIT = "vec_id bigint, vec binary"
PLACED = "rep bigint, vec binary, copies bigint, places array<bigint>"
EDGES = "rep bigint, near array<bigint>"
FOUND = "rep bigint, least bigint, n bigint"
#: Bounds of what the driver gathers: vectors that centres are fitted on, queries of the audit.
SAMPLE_BYTES, AUDITED, AUDITED_BYTES = 16_000_000, 1_000, 4_000_000
RECALL, WIDENED = 0.98, 3
#: Edges of a node, candidates for them, edges drawn at random; the factor of robust pruning.
DEGREE, POOL, DRAWN, ALPHA = 24, 56, 4, 1.2
#: The range grows on through rows at up to so many times the squared distance of a link.
SLACK = 1.5
#: Nodes of a shard on average, repeats by overlap included.
SHARD = 2_000
_DIM = 1 << 24


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a binary column, all of the length of the first."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def unit_vectors(table: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vec): vectors of length one as bytes of doubles; null where there is none."""
    schema = common.arrow_schema(UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            starts, out = np.cumsum(sizes) - sizes, [None] * len(sizes)
            for size in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == size)
                v = flat[starts[at, None] + np.arange(size)]
                largest = np.abs(v).max(1)
                fit = np.isfinite(largest) & (largest > 0)
                v = v[fit] / largest[fit, None]
                v = v / np.sqrt((v * v).sum(1))[:, None] + 0.0  # no negative zeros
                for i, row in zip(at[fit].tolist(), v):
                    out[i] = row.tobytes()
            yield common.to_batch({"vec_id": batch.column(0).cast(pa.int64()), "vec": pa.array(out, pa.binary())}, schema)

    common.small_batches(table.sparkSession)
    return table.select("vec_id", column).mapInArrow(run, UNIT)


def _fit(v: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """k centres of the rows of ``v``: some of them, moved a few times to the mean of their own."""
    rng = np.random.default_rng(k)
    centres = v[rng.choice(len(v), k, replace=False)]
    for _ in range(rounds if k > 1 else 1):
        own = np.concatenate([(v[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(v), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        length = np.sqrt((sums * sums).sum(1))[:, None]
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def centres(nodes: DataFrame, overlap: int, shard: int = SHARD) -> dict[int, np.ndarray]:
    """By the vectors' length: centres fitted on a sample of at most about SAMPLE_BYTES, for shards of about ``shard`` nodes with their overlap."""
    counts = {r["d"]: r["n"] for r in nodes.groupBy((F.octet_length("vec") / 8).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = min(1.0, SAMPLE_BYTES / max(1, sum(8 * d * n for d, n in counts.items())))
    drawn: dict[int, list[bytes]] = {}
    for r in nodes.where(F.pmod(F.xxhash64("vec", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000)).select("vec").collect():
        drawn.setdefault(len(r["vec"]) // 8, []).append(r["vec"])
    out = {}
    for d, rows in drawn.items():
        v = np.frombuffer(b"".join(sorted(rows)), np.float64).reshape(-1, d)
        out[d] = _fit(v, max(1, min(math.ceil(counts[d] * overlap / shard), len(v) // 8)))
    return out


def place(nodes: DataFrame, middle: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """Nodes (rep, vec, copies) with the shards of their nearest centres; a length without centres is one shard."""
    shared, schema = nodes.sparkSession.sparkContext.broadcast(middle), common.arrow_schema(PLACED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                dims = np.array([len(x) // 8 for x in batch.column(1).to_pylist()])
                places: list[list[int]] = [[]] * len(dims)
                for d in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == d)
                    c = shared.value.get(d)
                    if c is None or len(c) == 1:
                        best = np.zeros((len(own), 1), np.int64)
                    else:
                        near = _matrix(batch.column(1).take(pa.array(own))) @ c.T
                        best = np.argpartition(-near, min(overlap, len(c)) - 1, axis=1)[:, :overlap]
                    for i, b in zip(own.tolist(), (np.sort(best, 1) + d * _DIM).tolist()):
                        places[i] = b
                yield common.to_batch({"rep": batch.column(0), "vec": batch.column(1), "copies": batch.column(2), "places": places}, schema)

    return nodes.select("rep", "vec", "copies").mapInArrow(run, PLACED)


def _pruned(v: np.ndarray, at: np.ndarray, pool: np.ndarray, degree: int) -> np.ndarray:
    """For the nodes ``at``, up to ``degree`` of their ``pool`` (nearest first): each is kept that no kept one is nearer to by ALPHA; -1 where there are fewer."""
    w = v[pool]
    own = np.einsum("bkd,bd->bk", w, v[at])
    alive = np.ones(pool.shape, bool)
    out, rows = np.full((len(at), degree), -1, np.int64), np.arange(len(at))
    for r in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, r] = pool[rows, first][some]
        between = np.matmul(w, w[rows, first][:, :, None])[:, :, 0]
        alive &= ALPHA * ALPHA * (1 - between) > 1 - own
        alive[rows, first] = False
    return out


def build(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, neighbour) of the graph over the rows of ``v``, each edge both ways, by row."""
    n = len(v)
    pool = min(POOL, n - 1)
    if pool < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept, block = [], max(16, 2_000_000 // (POOL * v.shape[1]))
    for a in range(0, n, block):
        at = np.arange(a, min(a + block, n))
        near = v[at] @ v.T
        near[np.arange(len(at)), at] = -2
        best = np.argpartition(-near, pool - 1, axis=1)[:, :pool]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable"), 1)
        kept.append(_pruned(v, at, best, DEGREE))
    far = np.random.default_rng(n).integers(0, n, (n, DRAWN))
    lists = np.concatenate([np.concatenate(kept), far], 1)
    u, x = np.repeat(np.arange(n), lists.shape[1]), lists.ravel()
    u, x = u[(x >= 0) & (x != u)], x[(x >= 0) & (x != u)]
    both = np.unique(np.r_[u * n + x, x * n + u])
    return both // n, both % n


def range_search(v: np.ndarray, rows_of: np.ndarray, flat: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row) with a cosine of ``least`` or more, in portions, found for each row by greedy search from the medoid and a growing range.

    The neighbours of row i are ``flat[rows_of[i]:rows_of[i + 1]]``.
    """
    n, width = len(v), 4
    degree = np.diff(rows_of)
    medoid = int((v @ v.mean(0)).argmax())

    def unseen(q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of (query, row) pairs that the query hasn't looked at, each once."""
        q, x = np.repeat(q, degree[at]), flat[tb.ragged(rows_of[at], degree[at])]
        new = ~seen[q, x]
        code = np.unique(q[new] * n + x[new])
        q, x = code // n, code % n
        seen[q, x] = True
        return q, x

    def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(q))
        for a in range(0, len(q), 20_000):
            out[a : a + 20_000] = np.einsum("pd,pd->p", v[first + q[a : a + 20_000]], v[x[a : a + 20_000]])
        return out

    for first in range(0, n, 256):
        m = min(256, n - first)
        rows = np.arange(m)
        seen = np.zeros((m, n), bool)
        seen[:, medoid] = True
        ids, near = np.full((m, beam), -1), np.full((m, beam), -2.0)
        ids[:, 0], near[:, 0] = medoid, cosines(rows, np.full(m, medoid))
        spent = np.zeros((m, beam), bool)
        within = [(rows[hit], np.full(int(hit.sum()), medoid))] if (hit := near[:, 0] >= least).any() else []
        while True:
            order = np.argsort(np.where(spent | (ids < 0), -3.0, near), axis=1)[:, ::-1][:, :width]
            ready = ~np.take_along_axis(spent, order, 1) & (np.take_along_axis(ids, order, 1) >= 0)
            if not ready.any():
                break
            q, column = np.repeat(rows, width)[ready.ravel()], order.ravel()[ready.ravel()]
            spent[q, column] = True
            q, x = unseen(q, ids[q, column])
            c = cosines(q, x)
            within.append((q[c >= least], x[c >= least]))
            place = np.arange(len(q)) - np.searchsorted(q, q)  # q is in order
            more = int(place.max()) + 1 if len(q) else 0
            if not more:
                continue
            new_ids, new_near = np.full((m, more), -1), np.full((m, more), -2.0)
            new_ids[q, place], new_near[q, place] = x, c
            ids, near, spent = np.concatenate([ids, new_ids], 1), np.concatenate([near, new_near], 1), np.concatenate([spent, np.zeros((m, more), bool)], 1)
            top = np.argpartition(-near, beam - 1, axis=1)[:, :beam]
            ids, near, spent = (np.take_along_axis(z, top, 1) for z in (ids, near, spent))
        q, x = (np.concatenate(z) for z in zip(*within)) if within else (rows[:0], rows[:0])
        alone = ~seen[rows, first + rows]  # a row is within its own range
        seen[rows, first + rows] = True
        q, x = np.r_[q, rows[alone]], np.r_[x, first + rows[alone]]
        hit = np.ones(len(q), bool)
        while len(q):
            other = hit & (first + q != x)
            if other.any():
                yield first + q[other], x[other]
            grown = [(rows[:0], rows[:0], hit[:0])]
            for a in range(0, len(q), 50_000):
                qn, xn = unseen(q[a : a + 50_000], x[a : a + 50_000])
                c = cosines(qn, xn)
                near = c >= 1 - SLACK * (1 - least)
                grown.append((qn[near], xn[near], c[near] >= least))
            q, x, hit = (np.concatenate(z) for z in zip(*grown))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (c, i, j), which come one after another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("c", "i", "j")]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, batch.num_rows].tolist()):
            if held and any(held[-1].column(k)[0] != batch.column(k)[a] for k in ("c", "i", "j")):
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, i, j, rep, vec); the neighbours of each in its cell's graph."""
    for rows in _shards(batches):
        rep = rows.column("rep").to_numpy()
        if len(rep) > 1:
            u, x = build(_matrix(rows.column("vec")))
            near = pa.ListArray.from_arrays(pa.array(np.searchsorted(u, np.arange(len(rep) + 1)), pa.int32()), pa.array(rep[x]))
            yield common.to_batch({"rep": rep, "near": near}, common.arrow_schema(EDGES))


def _found(batches: Iterator[pa.RecordBatch], least: float, beam: int) -> Iterator[pa.RecordBatch]:
    """Rows (c, i, j, side, rep, vec, copies, places, near); how many vectors each links with here, and the least node of its group here."""
    for rows in _shards(batches):
        if rows.num_rows < 2:
            continue
        rows = rows.sort_by("rep")
        rep, side, copies = (rows.column(k).to_numpy() for k in ("rep", "side", "copies"))
        c, lists = rows.column("c")[0].as_py(), rows.column("near").combine_chunks()
        width = lists.value_lengths().to_numpy()
        flat = lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(rep, flat), len(rep) - 1)
        here = rep[at] == flat  # neighbours of other shards aren't
        flat, rows_of = at[here], np.r_[0, np.cumsum(here)][np.r_[0, np.cumsum(width)]]
        homes = rows.column("places").combine_chunks()
        homes = homes.flatten().to_numpy().reshape(len(rep), -1)  # all of a shard have as many
        n = np.zeros(len(rep), np.int64)

        def own() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for q, x in range_search(_matrix(rows.column("vec")), rows_of, flat, least, beam):
                ours = (side[q] == 2) | (side[q] != side[x])
                for a in range(homes.shape[1]):
                    ours &= (homes[q, a] >= c) | (homes[q, a, None] != homes[x]).all(1)
                q, x = q[ours], x[ours]
                np.add.at(n, q, copies[x])
                yield q, x

        label = least_labels(len(rep), own(), rep)
        some = (n > 0) | (rep[label] != rep)
        yield common.to_batch({"rep": rep[some], "least": rep[label][some], "n": n[some]}, common.arrow_schema(FOUND))


def _by_cell(placed: DataFrame, most: int, *columns: str) -> DataFrame:
    shards = placed.withColumn("c", F.explode("places"))
    dealt = cells(shards, ["c"], F.lit(1), most).select("c", "i", "j", "side", "rep", *columns)
    return dealt.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j")


def links(nodes: DataFrame, least: float, overlap: int, beam: int, most: int = 4096) -> DataFrame:
    """FOUND rows for ``nodes`` (rep, vec, copies), a row for each node and cell with a link."""
    placed = common.cut(place(nodes, centres(nodes, overlap), overlap))
    edges = _by_cell(placed, most, "vec").mapInArrow(_edges, EDGES)
    united = edges.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    graph = placed.join(united, "rep", "left").withColumn("near", F.coalesce("near", F.array().cast("array<bigint>")))
    return common.cut(_by_cell(graph, most, "vec", "copies", "places", "near").mapInArrow(lambda it: _found(it, least, beam), FOUND))


def audit(nodes: DataFrame, found: DataFrame, least: float) -> tuple[int, int]:
    """(links found, links there are) of up to AUDITED nodes, those of a hash; brute force over all vectors."""
    total, width = nodes.agg(F.count(F.lit(1)), F.max(F.octet_length("vec"))).first()
    if not total:
        return 0, 0
    share = min(AUDITED, AUDITED_BYTES // width + 1) / total
    drawn = nodes.where(F.pmod(F.xxhash64("rep", F.lit(9)), F.lit(1 << 30)) < int(share * (1 << 30))).select("rep", "vec").collect()
    sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r["vec"]) for r in drawn}:
        own = [r for r in drawn if len(r["vec"]) == d]
        sample[d] = np.array([r["rep"] for r in own]), np.frombuffer(b"".join(r["vec"] for r in own), np.float64).reshape(len(own), -1)
    shared = nodes.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                sizes = np.array([len(x) for x in batch.column(1).to_pylist()])
                for d, (ids, v) in shared.value.items():
                    own = np.flatnonzero(sizes == d)
                    if len(own):
                        rep, copies = (batch.column(k).to_numpy()[own] for k in (0, 2))
                        hit = (v @ _matrix(batch.column(1).take(pa.array(own))).T >= least) & (ids[:, None] != rep)
                        for i, k in zip(ids.tolist(), (hit @ copies).tolist()):
                            counts[i] = counts.get(i, 0) + int(k)
        yield common.to_batch({"rep": list(counts), "n": list(counts.values())}, common.arrow_schema("rep bigint, n bigint"))

    true = nodes.select("rep", "vec", "copies").mapInArrow(run, "rep bigint, n bigint").groupBy("rep").agg(F.sum("n").alias("there")).where("there > 0")
    got = found.groupBy("rep").agg(F.sum("n").alias("n"))
    r = F.broadcast(true).join(got, "rep", "left").agg(F.sum(F.least(F.coalesce("n", F.lit(0)), "there")), F.sum("there")).first()  # at most AUDITED rows
    return (r[0] or 0, r[1] or 0)


def linked_vectors(table: DataFrame, least: float = 0.95, overlap: int = 3, beam: int = 32) -> DataFrame:
    """vec_id, n_links (other vectors with a cosine of ``least`` or more), component_id, kept; a row for each vector."""
    vectors = common.cut(unit_vectors(table))
    real = F.col("vec").isNotNull() & F.col("vec_id").isNotNull()
    classes = vectors.where(real).groupBy("vec").agg(F.min("vec_id").alias("smallest"), F.count(F.lit(1)).alias("copies"))
    nodes = common.cut(classes.withColumn("rep", F.monotonically_increasing_id()))  # numbers that stay: the table is written
    total = nodes.count()
    for widening in range(WIDENED + 1):
        found = links(nodes, least, overlap << widening, beam << widening)
        got, there = audit(nodes, found, least)
        if got >= RECALL * there:
            break
    else:
        warnings.warn(f"of {there} audited links {got} were found")
    joined = components(found.where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    own = nodes.select("rep", "smallest").join(joined, F.col("rep") == F.col("a"), "left").select("rep", "smallest", F.coalesce("b", "rep").alias("root"))
    first = own.groupBy("root").agg(F.min("smallest").alias("component_id"), F.count(F.lit(1)).alias("members"))
    labelled = spread_join(own, first, ["root"], "members", total).select("rep", "component_id")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    facts = nodes.join(counts, "rep", "left").join(labelled, "rep").select("vec", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = spread_join(vectors.where(real), facts, ["vec"], "copies", vectors.count()).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~real).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
