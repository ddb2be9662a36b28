"""Hand-written edges of each query, agreement of variants, and the SQL of the catalog."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from auctionflow.functions.windows import assign_windows, from_event_time, to_event_time, tumbling_end, window_starts
from auctionflow.operators import closing, sliding, verify
from auctionflow.operators.running import last_sums, running_sums
from auctionflow.plans import catalog, logical

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def auctions(spark, rows):
    """(id, reserve, opened, expires[, seller, category])"""
    full = [(i, None, None, 0, r, at(a), at(b), *(x or (1, 10))) for i, r, a, b, *x in ((*r[:4], *r[4:]) if len(r) == 4 else r for r in rows) for x in [tuple(x)]]
    return spark.createDataFrame(full, "id bigint, item_name string, description string, initial_bid bigint, reserve bigint, date_time timestamp, expires timestamp, seller bigint, category bigint")


def bids(spark, rows):
    return spark.createDataFrame([(a, b, p, at(t)) for a, b, p, t in rows], "auction bigint, bidder bigint, price bigint, date_time timestamp")


def closed(spark, rows):
    """(id, bidder, price, expires[, category])"""
    return spark.createDataFrame([(i, (x[0] if x else 10), 1, at(e), b, p, at(e)) for i, b, p, e, *x in rows], "id bigint, category bigint, seller bigint, expires timestamp, bidder bigint, price bigint, bid_time timestamp")


def test_winning_bids(spark):
    a = auctions(spark, [(1, 10, 100, 200), (2, 10, 100, 200), (3, 10, 100, 200), (4, 10, 100, 200), (5, 10, 100, 200), (6, 10, 100, 200)])
    b = bids(
        spark,
        [
            (1, 7, 50, 90), (1, 8, 60, 95), (1, 9, 20, 150),  # before the auction opens: not valid
            (2, 7, 5, 110), (2, 8, 10, 100),  # below the reserve; at the reserve and the very start
            (3, 7, 50, 200), (3, 8, 40, 199),  # at expires: too late
            (4, 7, 30, 150), (4, 8, 30, 140), (4, 6, 30, 140),  # equal prices: the earliest, then the lowest bidder
            (5, 7, 9, 150), (99, 1, 1000, 150),
        ],
    )
    got = {r["id"]: (r["bidder"], r["price"]) for r in closing.winning_bids(a, b).collect()}
    assert got == {1: (9, 20), 2: (8, 10), 3: (8, 40), 4: (6, 30)}


def test_local_items(spark):
    a = auctions(spark, [(1, 0, 0, 1, 5, 10), (2, 0, 0, 1, 5, 11), (3, 0, 0, 1, 6, 10), (4, 0, 0, 1, 5, 10), (5, 0, 0, 1, 9, 10)])
    p = spark.createDataFrame([(5, "n5", "c", "OR"), (6, "n6", "c", "WA"), (7, "n7", "c", "CA")], "id bigint, name string, city string, state string")
    assert sorted(r["auction"] for r in logical.local_items(a, p).collect()) == [1, 4]


def test_averages(spark):
    rows = [(i, 1, p, i) for i, p in enumerate([100, 1, 1, 1, 1, 1, 1, 1, 1, 1, 7])]
    last = {r["id"]: r["average"] for r in logical.last_average(closed(spark, rows)).collect()}
    assert last[0] == 100 and last[9] == 109 // 10 and last[10] == 16 // 10  # the eleventh pushes out the first
    changes = {r["id"]: r["average"] for r in logical.category_average_changes(closed(spark, rows)).collect()}
    assert changes[1] == 50 and changes[10] == 116 // 11
    assert logical.category_average(closed(spark, rows)).collect()[0]["average"] == 116 // 11


def test_running_sums(spark):
    df = spark.createDataFrame([(n % 3, n * 7 % 101, n) for n in range(101)], "k int, t int, v int")
    for inclusive in (True, False):
        got = {r["t"]: r["s"] for r in running_sums(df, ["k"], F.floor(F.col("t") / 10), ["t"], {"s": F.col("v")}, inclusive).collect()}
        rows = df.collect()
        assert got == {r["t"]: sum(x["v"] for x in rows if x["k"] == r["k"] and (x["t"] < r["t"] or (inclusive and x["t"] == r["t"]))) for r in rows}


def test_hot_items_ties_and_boundaries(spark):
    b = bids(spark, [(1, 0, 1, 10), (2, 0, 1, 10.5), (1, 0, 1, 13), (3, 0, 1, 20)])
    got = {(r["window_end"] - T0).total_seconds(): (r["auction"], r["n"]) for r in logical.hot_items(b, 1, 4).collect()}
    assert got[11] == (2, 1)  # a tie: the larger id
    assert got[14] == (1, 2)  # 10 to 14
    assert got[15] == (1, 1)  # a bid at exactly 10 has left, the one at 13 not
    assert 18 not in got and got[21] == (3, 1)
    kept = {(r["window_end"] - T0).total_seconds() for r in sliding.anchored(logical.hot_items(b, 1, 4), b, 1).collect()}
    assert kept == {14, 17, 24}


@pytest.mark.parametrize("slide,slices", [(1, 1), (2, 5), (7, 3)])
def test_forms_agree(spark, slide, slices):
    b = bids(spark, [(n * n % 5, n, n, n * 3.7 % 61) for n in range(150)])
    counts = [f(b, slide, slide * slices).select("w.start", "w.end", "auction", "n") for f in (sliding.direct_counts, sliding.sliced_counts, sliding.incremental_counts)]
    assert counts[0].count() and verify.same(counts[0], counts[1]) and verify.same(counts[0], counts[2])
    ranks = sliding.window_ranks(b, slide, slide * slices)
    assert verify.same(ranks, sliding.listed_ranks(b, slide, slide * slices))


def test_hot_auction_in_pieces(spark):
    """One auction over many pieces of time, with gaps and panes that live on from one piece into the next."""
    n = sliding.PIECE * 5 * 4
    b = bids(spark, [(1, t, 1, t) for t in range(n) if t % 97 > 20] + [(700, 0, 1, t) for t in range(0, n, 3)])
    direct = sliding.direct_counts(b, 1, 5).select("w.start", "w.end", "auction", "n")
    assert verify.same(direct, sliding.incremental_counts(b, 1, 5).select("w.start", "w.end", "auction", "n"))
    assert verify.same(sliding.window_ranks(b, 50, 100), sliding.listed_ranks(b, 50, 100))


def test_verify_counts_repeats(spark):
    one, two = spark.createDataFrame([(1,), (1,)], "a int"), spark.createDataFrame([(1,)], "a int")
    assert verify.same(one, one) and not verify.same(one, two) and not verify.same(two, one)


def test_ranks(spark):
    b = bids(spark, [(5, 1, 1, 1), (5, 2, 1, 2), (7, 3, 1, 3)])
    assert sorted((r["auction"], r["rank"]) for r in sliding.window_ranks(b, 10, 10).collect()) == [(5, 1), (5, 1), (7, 3)]


def test_highest_bid(spark):
    b = bids(spark, [(1, 1, 5, 0), (1, 1, 9, 9.9), (1, 1, 0, 10)])
    assert sorted(((r["window_end"] - T0).total_seconds(), r["price"]) for r in logical.highest_bid(b, 10).collect()) == [(10, 9), (20, 0)]


def test_new_users(spark):
    people = spark.createDataFrame([(1, at(100)), (1, at(150)), (2, at(100))], "id bigint, date_time timestamp")
    opened = spark.createDataFrame([(10, 1, at(100)), (11, 1, at(249)), (12, 1, at(250)), (13, 2, at(99)), (14, 2, at(200)), (15, 1, at(160))], "id bigint, seller bigint, date_time timestamp")
    got = sorted(r["auction"] for r in logical.new_users(people, opened, 100).collect())
    assert got == [10, 11, 15]  # at p + width: out; before the person: out; two registrations: once


def test_window_functions(spark):
    one = spark.createDataFrame([(datetime(1970, 1, 1, 0, 0, 3),)], "t timestamp")
    starts = one.select(window_starts("t", 2, 6).alias("w")).collect()[0]["w"]
    assert starts == [datetime(1970, 1, 1, 0, 0, 2), datetime(1970, 1, 1)]  # none before the origin
    assert one.select(tumbling_end(F.lit("1970-01-01 00:00:10").cast("timestamp"), 10)).collect()[0][0] == datetime(1970, 1, 1, 0, 0, 20)
    assert assign_windows(one, "t", 2, 6).count() == 3 and assign_windows(one, "t", 2, 6, origin="1970-01-01").count() == 2
    assert spark.range(1).select(from_event_time(to_event_time(F.lit(7), 3), 3)).collect()[0][0] == 7


@pytest.mark.parametrize("name", [n for n in catalog.SQL if not n.startswith("stream")])
def test_catalog_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in got.select(columns).collect()) == sorted(want) and want


@pytest.mark.parametrize("last,most", [(2, 0), (10, 0), (10, 100), (10, 1_000)])
def test_last_sums(spark, last, most):
    """Pieces of one row, of many, and gaps between them; a key with most of the rows."""
    made = [(0 if n % 10 else 1 + n % 3, n * n * 7919 % 5000, n, n) for n in range(400)]
    df = spark.createDataFrame(made, "k int, t int, id int, v bigint")
    got = {r["id"]: (r["total"], r["n"]) for r in last_sums(df, ["k"], F.floor(F.col("t") / 40), ["t", "id"], "v", last, most).collect()}
    rows = sorted(df.collect(), key=lambda r: (r["t"], r["id"]))
    want = {}
    for r in rows:
        near = [x["v"] for x in rows if x["k"] == r["k"] and (x["t"], x["id"]) <= (r["t"], r["id"])][-last:]
        want[r["id"]] = (sum(near), len(near))
    assert got == want


def test_ranks_of_many_ids_and_bids(spark):
    """100,000 buckets of ids in a window, and an auction with ten million bids."""
    ids = spark.range(100_000).select((F.col("id") * sliding.RANK_BUCKET).alias("auction"), F.lit(1).cast("bigint").alias("n"))
    w = F.struct(F.lit(T0).alias("start"), F.lit(at(10)).alias("end")).alias("w")
    ranks = sliding.ranks_of(ids.select(w, "auction", "n"))
    assert ranks.where(F.col("rank") != F.floor(F.col("auction") / sliding.RANK_BUCKET) + 1).count() == 0 and ranks.count() == 100_000
    b = bids(spark, [(256 * k, 1, 1, 1) for k in range(3_000)])
    assert verify.same(sliding.window_ranks(b, 10, 10), sliding.listed_ranks(b, 10, 10))
    hot = spark.createDataFrame([(1, 3), (5, 10_000_000), (9, 2)], "auction bigint, n bigint")
    got = sliding.ranks_of(hot.select(w, "auction", "n")).groupBy("auction", "rank").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 3), (5, 4, 10_000_000), (9, 10_000_004, 2)]
