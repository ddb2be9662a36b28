"""Benchmark decontamination by winnowing.

Both sides are cut into words.  Of the hashes of every ``k`` consecutive words
the least in each window of ``w`` (the last of equal ones) is kept, so that any
shared span of ``k + w - 1`` words has a kept hash in common.  A hit of a document
fingerprint on a benchmark fingerprint is extended to all windows of ``window`` words
around it; those that the benchmark has too are compared byte for byte.  Each window
of a document is looked at once however often it occurs in the benchmark, so
repeated words cost no more than others.  Items of fewer words are found by the
hash of all their words at every place.

A benchmark of at most ``block_bytes`` of text is broadcast as an index.  Of a larger
one, the fingerprints are joined in a shuffle: each fingerprint of a document comes
with the stretch of words whose windows it is the least hash of, the same on the side of
the benchmark, and the windows of stretches that meet are joined as texts.  A bit
map of ``filter_bits`` (its size is fixed) keeps back nearly all fingerprints that the
benchmark hasn't got.  Both ways give the same rows.

Null and empty documents have no words.  Items without words or without an id
can't be hit; items that share an id count once.  Repeated documents give a row
each.  An empty benchmark hits nothing.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

MOST_BROADCAST = 200_000  # keys of 32 characters
HITS = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, item_ids array<string>, spans string"


class Words:
    """The words of a batch of texts: lower-cased bytes, places and hashes."""

    def __init__(self, column: pa.Array):
        raw, bounds = tb.text_buffers(column)
        self.buf = tb.LOWER[raw]
        self.starts, self.ends, self.bounds = tb.words(self.buf, bounds)
        self.hashes = tb.span_hashes(tb.byte_sums(self.buf), self.starts, self.ends)
        self.text_end = np.repeat(self.bounds[1:], np.diff(self.bounds))  # of each word: the end of its text, in words
        self.text_of = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all words, each with a space after it; where each begins, n + 1 offsets)."""
        size = self.ends - self.starts
        at = np.r_[0, np.cumsum(size + 1)]
        out = np.full(at[-1], 0x20, np.uint8)
        out[tb.ragged(at[:-1], size)] = self.buf[tb.ragged(self.starts, size)]
        return out, at


def same_words(x: Words, p: np.ndarray, y: Words, q: np.ndarray, m: int) -> np.ndarray:
    """Whether the m words of x from each p on are those of y from q on."""
    (a, a_at), (b, b_at) = x.spelled, y.spelled
    size = a_at[p + m] - a_at[p]
    same = size == b_at[q + m] - b_at[q]
    for part in np.array_split(np.flatnonzero(same), -(-len(p) // 50_000) or 1):
        differ = np.flatnonzero(a[tb.ragged(a_at[p[part]], size[part])] != b[tb.ragged(b_at[q[part]], size[part])])
        same[part[np.searchsorted(np.cumsum(size[part]), differ, "right")]] = False
    return same


def minima(grams: np.ndarray, w: int) -> np.ndarray:
    """The place of the least hash in each window of ``w``, the last of equal ones."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = grams[:n].copy()
    for j in range(1, w):
        np.minimum(least, grams[j : j + n], out=least)
    last = np.zeros(n, np.int64)
    for j in range(1, w):
        last[grams[j : j + n] == least] = j
    return np.arange(n) + last


def winnow(grams: np.ndarray, w: int, valid: np.ndarray) -> np.ndarray:
    """Places of the kept hashes; ``valid`` tells which windows (by their first place) count."""
    places = minima(grams, w)
    kept = np.zeros(len(grams), bool)
    kept[places[valid[: len(places)]]] = True
    return np.flatnonzero(kept)


class Windows:
    """The different windows of ``m`` words of some items, with the items that each is in."""

    def __init__(self, words: Words, starts: np.ndarray, m: int):
        self.words, self.m = words, m
        h = tb.sequence_hashes(words.hashes, m)[starts]
        order = np.argsort(h, kind="stable")
        h, starts = h[order], starts[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        number = np.repeat(first, np.diff(np.r_[first, len(h)]))  # of each window: the first one that is equal
        for i in np.flatnonzero(~same_words(words, starts, words, starts[number], m)).tolist():  # equal hashes of different words
            alike = np.flatnonzero((h == h[i]) & (number == np.arange(len(h))))
            alike = alike[same_words(words, np.full(len(alike), starts[i]), words, starts[alike], m)]
            number[i] = alike[0] if len(alike) else i
        kept, group = np.unique(number, return_inverse=True)
        self.keys, self.places = h[kept], starts[kept]
        pairs = np.unique(np.stack([group, words.text_of[starts]], axis=1), axis=0) if len(h) else np.zeros((0, 2), np.int64)
        self.items, self.bounds = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(kept) + 1))

    def found(self, docs: Words, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window number) of the windows that stand at ``places`` of the documents."""
        h = tb.sequence_hashes(docs.hashes, self.m)[places]
        low = np.searchsorted(self.keys, h)
        n = np.searchsorted(self.keys, h, "right") - low  # one, but for windows of equal hash
        p, number = np.repeat(places, n), tb.ragged(low, n)
        same = same_words(docs, p, self.words, self.places[number], self.m)
        return p[same], number[same]


class Index:
    """Fingerprints and windows of a block of benchmark items."""

    def __init__(self, ids: list[str], texts: list[str], window: int, k: int):
        self.window, self.k, self.w, self.ids = window, k, window - k + 1, ids
        words = Words(pa.array(texts, pa.string()))
        counts = np.diff(words.bounds)
        grams = tb.sequence_hashes(words.hashes, k)
        at = np.arange(len(grams))
        self.prints = np.unique(grams[winnow(grams, self.w, at + window <= words.text_end[: len(grams)])])
        whole = np.flatnonzero(np.arange(len(words.hashes)) + window <= words.text_end)
        sizes = sorted({int(c) for c in counts if 0 < c < window})
        self.tables = [Windows(words, words.bounds[:-1][counts == m], m) for m in sizes] + [Windows(words, whole, window)]

    def hits(self, docs: Words) -> Iterator[tuple[np.ndarray, np.ndarray, Windows]]:
        """(first word, window number, table) of each window of the benchmark in the documents."""
        n = len(docs.hashes)
        for table in self.tables:
            if table.m > n or not len(table.keys):
                continue
            if table.m < self.window:
                places = np.arange(n - table.m + 1)
            else:
                grams = tb.sequence_hashes(docs.hashes, self.k)
                kept = winnow(grams, self.w, np.arange(len(grams)) + self.window <= docs.text_end[: len(grams)])
                low = np.searchsorted(self.prints, grams[kept])
                low[low == len(self.prints)] = 0
                kept = kept[self.prints[low] == grams[kept]]
                near = np.zeros(n + 1, bool)  # the windows that hold the fingerprint
                near[np.maximum(kept[:, None] - np.arange(self.w), 0)] = True
                places = np.flatnonzero(near[: n - table.m + 1])
            places = places[places + table.m <= docs.text_end[places]]
            yield *table.found(docs, places), table


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")


def _small(benchmark: DataFrame, window: int, k: int, block_bytes: int) -> Broadcast | None:
    """The index of a benchmark of at most ``block_bytes``; None of a larger one."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        return None
    rows = items.orderBy("item_id", "text").collect()
    return benchmark.sparkSession.sparkContext.broadcast(Index([r["item_id"] for r in rows], [r["text"] for r in rows], window, k))


def _places(prints: np.ndarray, m: int, bits: int) -> np.ndarray:
    """The bit of each fingerprint of windows of ``m`` words."""
    return (tb.mix(prints ^ np.uint64(m)) & np.uint64(bits - 1)).astype(np.int64)


STRETCH = "key string, m int, print bigint, bit bigint, first bigint, n int, stretch string"


def _stretches(keys: pa.Array, words: Words, m: int, prints: np.ndarray, groups: np.ndarray, at: np.ndarray, bits: int) -> dict[str, object]:
    """Columns of ``STRETCH``: the windows of ``m`` words at ``at``, one row for neighbours of one ``group``."""
    new = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
    n, first = np.diff(np.r_[new, len(at)]), at[new]
    spelled, begin = words.spelled
    size = begin[first + n + m - 1] - begin[first] - 1  # without the last space
    text = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(spelled[tb.ragged(begin[first], size)]))
    of = words.text_of[first]
    return {
        "key": keys.take(pa.array(of)), "m": np.full(len(first), m, np.int32), "print": prints[new].view(np.int64), "bit": _places(prints[new], m, bits),
        "first": first - words.bounds[of], "n": n.astype(np.int32), "stretch": text,
    }


def _whole(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, place of the least hash, that hash) of each window of ``window`` words."""
    grams = tb.sequence_hashes(words.hashes, k)
    least = minima(grams, window - k + 1)
    at = np.flatnonzero(np.arange(len(least)) + window <= words.text_end[: len(least)])
    return at, least[at], grams[least[at]]


def _benchmark_stretches(benchmark: DataFrame, window: int, k: int, bits: int) -> DataFrame:
    schema = common.arrow_schema(STRETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tb.slices(batch.column(1), 500_000):
                keys, words = batch.column(0).slice(a, b - a), Words(batch.column(1).slice(a, b - a))
                at, group, prints = _whole(words, window, k)
                yield common.to_batch(_stretches(keys, words, window, prints, group, at, bits), schema)
                counts = np.diff(words.bounds)
                for m in sorted({int(c) for c in counts if 0 < c < window}):
                    at = words.bounds[:-1][counts == m]
                    yield common.to_batch(_stretches(keys, words, m, tb.sequence_hashes(words.hashes, m)[at], at, at, bits), schema)

    common.small_batches(benchmark.sparkSession)
    return _items(benchmark).mapInArrow(run, STRETCH)


def _document_stretches(docs: DataFrame, sizes: list[int], bitmap: Broadcast, window: int, k: int, bits: int) -> DataFrame:
    """Stretches whose fingerprints have their bit set, and a row of m = 0 for each document, with its number of words as ``first``."""
    schema = common.arrow_schema(STRETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bitmap.value
        for batch in batches:
            for a, b in tb.slices(batch.column(1), 500_000):
                keys, words = batch.column(0).slice(a, b - a), Words(batch.column(1).slice(a, b - a))
                n = len(keys)
                zero = np.zeros(n, np.int64)
                yield common.to_batch({"key": keys, "m": zero.astype(np.int32), "print": zero, "bit": zero, "first": np.diff(words.bounds), "n": zero.astype(np.int32), "stretch": [""] * n}, schema)
                for m in sizes:
                    if m == window:
                        at, group, prints = _whole(words, window, k)
                    else:
                        prints = tb.sequence_hashes(words.hashes, m)
                        at = group = np.flatnonzero(np.arange(len(prints)) + m <= words.text_end[: len(prints)])
                        prints = prints[at]
                    bit = _places(prints, m, bits)
                    maybe = (held[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) != 0
                    yield common.to_batch(_stretches(keys, words, m, prints[maybe], group[maybe], at[maybe], bits), schema)

    common.small_batches(docs.sparkSession)
    return docs.mapInArrow(run, STRETCH)


def _windows(stretches: DataFrame) -> DataFrame:
    """(key, m, p, gram) of each window: its first word's place and its words."""
    words = stretches.select("key", "m", "first", F.split("stretch", " ").alias("w"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return words.select("key", "m", (F.col("first") + F.col("i")).alias("p"), F.array_join(F.slice("w", F.col("i") + 1, F.col("m")), " ").alias("gram"))


def _key() -> Column:
    """Equal for rows of equal id and text, which have equal results; other columns play no part."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), F.coalesce("text", F.lit(""))).cast("binary"))


def _set_key(items: Column) -> Column:
    """Equal for equal lists of ids."""
    return F.md5(F.array_join(F.transform(items, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), "").cast("binary"))


def _joined(docs: DataFrame, benchmark: DataFrame, window: int, k: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((key, n_words) of each document, (key, p, m, set) of each benchmark window in them, (set, items)), by a join of fingerprints.

    Fingerprints and windows that many documents share are dealt over tasks.  A window
    of the benchmark is one row with the key of the set of items that it is in; the
    sets are held apart, each once, so that a window of many items costs a document one key.
    """
    spark = docs.sparkSession
    bench = common.cut(_benchmark_stretches(benchmark, window, k, bits))
    sizes = sorted(r["m"] for r in bench.select("m").distinct().collect())  # at most ``window``
    words64 = bench.groupBy(F.expr("bit >> 6").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()  # at most bits / 64 rows
    held = np.zeros(bits >> 6, np.uint64)
    held[words64["at"].to_numpy()] = words64["bits"].to_numpy().view(np.uint64)
    found = common.cut(_document_stretches(docs.select(_key().alias("key"), "text"), sizes, spark.sparkContext.broadcast(held), window, k, bits))
    counts, maybe = found.where("m = 0").select("key", F.col("first").alias("n_words")), found.where("m > 0")
    total = maybe.count()
    prints = bench.select("m", "print").distinct().join(maybe.groupBy("m", "print").agg(F.count(F.lit(1)).alias("size")), ["m", "print"])
    met = common.cut(_windows(common.spread_join(maybe.drop("bit"), prints, ["m", "print"], "size", total)))
    items = _windows(bench).groupBy("m", "gram").agg(F.array_sort(F.collect_set("key")).alias("items"))
    both = common.cut(items.join(met.groupBy("m", "gram").agg(F.count(F.lit(1)).alias("size")), ["m", "gram"]).withColumn("set", _set_key(F.col("items"))))
    sets = both.groupBy("set").agg(F.first("items").alias("items"))
    return counts, common.spread_join(met, both.drop("items"), ["m", "gram"], "size", met.count()).select("key", "p", "m", "set"), sets


def _decontaminate_joined(docs: DataFrame, benchmark: DataFrame, window: int, k: int, bits: int) -> DataFrame:
    counts, hits, sets = _joined(docs, benchmark, window, k, bits)
    hits = common.cut(hits)
    along = Window.partitionBy("key").orderBy("p")  # the hits of one document
    reach = F.max("z").over(along.rowsBetween(Window.unboundedPreceding, -1))
    ranges = hits.groupBy("key", "p").agg(F.max(F.col("p") + F.col("m")).alias("z")).withColumn("new", F.coalesce(F.col("p") > reach, F.lit(True)).cast("int"))
    ranges = ranges.withColumn("island", F.sum("new").over(along)).groupBy("key", "island").agg(F.min("p").alias("a"), F.max("z").alias("z"))
    spans = ranges.groupBy("key").agg(F.sum(F.col("z") - F.col("a")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("a", "z"))).alias("r"))
    spans = spans.select("key", "n_hit", F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["a"].cast("string"), x["z"].cast("string"))), ",").alias("spans"))
    # documents with the same sets have the same items, which are put together once
    held = hits.groupBy("key").agg(F.array_sort(F.collect_set("set")).alias("sets")).withColumn("combination", _set_key(F.col("sets")))
    combinations = common.cut(held.groupBy("combination").agg(F.first("sets").alias("sets"), F.count(F.lit(1)).alias("documents")))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    named = combinations.select("combination", "documents", F.explode("sets").alias("set")).join(sets, "set").groupBy("combination").agg(F.first("documents").alias("documents"), names.alias("item_ids"))
    named = named.select("combination", "documents", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "item_ids")
    items = common.spread_join(held.select("key", "combination"), named, ["combination"], "documents", docs.count()).drop("combination", "documents")
    per_key = counts.distinct().join(spans, "key", "left").join(items, "key", "left")
    names, n_hit = F.coalesce("item_ids", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0)).cast("bigint")
    n_items, nothing = F.coalesce("n_items", F.lit(0).cast("bigint")), F.coalesce("items_sha256", F.lit(common.sha256_hex("")))
    return docs.select("doc_id", _key().alias("key")).join(per_key, "key").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), nothing.alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"), names.alias("item_ids"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, block_bytes: int = 8_000_000, filter_bits: int = 1 << 28) -> DataFrame:
    """A row for each document; ``item_ids`` are the items hit, ``spans`` the hit word ranges (start:end, comma-joined).  ``filter_bits``: a power of 2, 64 at least."""
    small = _small(benchmark, window, k, block_bytes)
    if small is None:
        return _decontaminate_joined(docs, benchmark, window, k, filter_bits)

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        docs, index = Words(batch.column(1)), small.value
        n = len(docs.bounds) - 1
        edge = np.zeros(len(docs.hashes) + 1, np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        for p, number, table in index.hits(docs):
            edge += np.bincount(p, minlength=len(edge)) - np.bincount(p + table.m, minlength=len(edge))
            for d, i in np.unique(np.stack([docs.text_of[p], number], axis=1), axis=0).tolist():
                items[d].update(index.ids[x] for x in table.items[table.bounds[i] : table.bounds[i + 1]])
        hit = np.cumsum(edge[:-1]) > 0
        sums = np.r_[0, np.cumsum(hit)]
        n_hit = sums[docs.bounds[1:]] - sums[docs.bounds[:-1]]
        names = [sorted(items[d]) if d in items else [] for d in range(n)]
        first = np.zeros(len(hit), bool)
        first[docs.bounds[:-1][docs.bounds[:-1] < len(hit)]] = True
        begins = np.flatnonzero(hit & (first | ~np.r_[False, hit[:-1]])) if len(hit) else np.zeros(0, np.int64)
        spans = [""] * n
        for a in begins.tolist():
            d = int(docs.text_of[a])
            rest = hit[a : docs.bounds[d + 1]]
            stop = a + (len(rest) if rest.all() else int(rest.argmin()))
            spans[d] += ("," if spans[d] else "") + f"{a - docs.bounds[d]}:{stop - docs.bounds[d]}"
        return {
            "doc_id": batch.column(0), "n_words": np.diff(docs.bounds), "n_hit": n_hit, "n_items": [len(x) for x in names],
            "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], "contaminated": n_hit > 0, "item_ids": names, "spans": spans,
        }

    return common.map_text(docs.select("doc_id", "text"), HITS, work)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, block_bytes: int = 8_000_000, filter_bits: int = 1 << 28) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; all columns stay."""
    small = _small(benchmark, window, k, block_bytes)
    if small is None:
        _, hits, _ = _joined(docs, benchmark, window, k, filter_bits)
        gone = common.cut(hits.select(F.col("key").alias("_hit")).distinct())
        gone = F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone
        return docs.join(gone, _key() == gone["_hit"], "left_anti")

    def keep(text: pa.Array) -> np.ndarray:
        words = Words(text)
        clean = np.ones(len(text), bool)
        for p, _, _ in small.value.hits(words):
            clean[words.text_of[p]] = False
        return clean

    return common.keep_rows(docs, keep)


def oracle_sql(window: int = 10) -> str:
    """The query's columns in DuckDB's SQL, by joining all windows of both sides."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, m, w[i + 1 : i + m] AS g FROM (SELECT item_id, w, least({window}, len(w)) AS m, unnest(range(0, len(w) - least({window}, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, i, w[i + 1 : i + m] AS g FROM (SELECT doc_id, w, m, unnest(range(0, greatest(0, len(w) - m + 1))) AS i FROM d, (SELECT DISTINCT m FROM bw))),
h AS (SELECT DISTINCT doc_id, m, i, item_id FROM dw JOIN bw USING (m, g)),
p AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h)),
r AS (SELECT doc_id, min(p) AS a, max(p) + 1 AS z FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM p) GROUP BY doc_id, island),
s AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_hit, string_agg(a || ':' || z, ',' ORDER BY a) AS spans FROM r GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)
"""
