"""The registered queries over the sample tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import assign_windows, tumbling_end, window_starts
from ..operators import closing, merging, sliding, verify
from ..schema import demux, mux
from ..sources.tables import Tables
from ..streaming import queries as streams
from . import logical, registry

HOUR, DAY = 3_600, 86_400
REGIONS = ("ASIA", "EUROPE", "AMERICA")  # stand for the states of Q3
BINDING = 5_000_000  # a reserve that turns bids away

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            # DuckDB's timestamps have no zone
            return out.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes))

        QUERIES[key] = run
        if sql:
            SQL[key] = sql
        return f

    return add


# --- SQL parts

_AUCTIONS = "SELECT o_orderkey AS id, {reserve} AS reserve, o_orderdate AS date_time, o_orderdate + INTERVAL 365 DAY AS expires, o_custkey AS seller, CAST(10 + o_orderkey % 5 AS BIGINT) AS category FROM orders"
_CLOSING = "SELECT l_orderkey AS auction, l_suppkey AS bidder, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_shipdate AS date_time FROM lineitem"
_BIDS = "SELECT user_id AS auction, event_id AS bidder, CAST(round(value * 100) AS BIGINT) AS price, ts AS date_time FROM events"


def _closed_sql(reserve: int = 5_000) -> str:
    return f"""a AS ({_AUCTIONS.format(reserve=reserve)}), b AS ({_CLOSING}),
closed AS (
  SELECT id, category, seller, expires, bidder, price, b.date_time AS bid_time
  FROM a JOIN b ON id = auction WHERE price >= reserve AND b.date_time >= a.date_time AND b.date_time < expires
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY price DESC, b.date_time, bidder) = 1
)"""


def _windows_sql(slide: int, count: int) -> str:
    """Bids with each of their windows: w_start, w_end."""
    start = f"to_timestamp((epoch_us(date_time) // 1000000 // {slide} - k) * {slide})::TIMESTAMP"
    return f"b AS ({_BIDS}), w AS (SELECT b.*, {start} AS w_start, {start} + INTERVAL {slide * count} SECOND AS w_end FROM b, range(0, {count}) r(k))"


def _hot_sql(slide: int, count: int, extra: str = "") -> str:
    return f"""WITH {_windows_sql(slide, count)}, c AS (SELECT w_start, w_end, auction, count(*) AS n FROM w GROUP BY ALL)
SELECT w_start AS window_start, w_end AS window_end, auction, n FROM c {extra} QUALIFY row_number() OVER (PARTITION BY w_start ORDER BY n DESC, auction DESC) = 1"""


_Q3 = f"""WITH a AS ({_AUCTIONS.format(reserve=5000)}), p AS (SELECT c_custkey AS id, c_name AS name, n_name AS city, r_name AS state FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT name, city, state, a.id AS auction FROM a JOIN p ON seller = p.id WHERE category = 10 AND state IN {REGIONS}"""
_Q4 = f"WITH {_closed_sql()} SELECT category, CAST(sum(price) // count(*) AS BIGINT) AS average FROM closed GROUP BY 1"
_Q6 = "WITH {closed} SELECT id, {key}, expires, CAST(sum(price) OVER w // count(*) OVER w AS BIGINT) AS average FROM closed WINDOW w AS (PARTITION BY {key} ORDER BY expires, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
_Q7 = f"SELECT time_bucket(INTERVAL 1 DAY, date_time) + INTERVAL 1 DAY AS window_end, max(price) AS price FROM ({_BIDS}) GROUP BY 1"
_Q8 = """WITH p AS (SELECT user_id AS id, ts FROM events WHERE event_type = 'signup'), a AS (SELECT event_id AS id, user_id AS seller, ts FROM events WHERE event_type = 'purchase')
SELECT seller AS person, id AS auction, ts AS date_time FROM a WHERE EXISTS (SELECT 1 FROM p WHERE p.id = a.seller AND a.ts >= p.ts AND a.ts < p.ts + INTERVAL {seconds} SECOND)"""
_COUNT = "WITH {w} SELECT w_end AS window_end, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1"
_RANK = "WITH {w} SELECT w_end AS window_end, auction, CAST(rank() OVER (PARTITION BY w_end ORDER BY auction) AS BIGINT) AS rank FROM w"


# --- static plans


@query(_Q3)
def q3_local_items(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return logical.local_items(t.auctions(), t.people(), states=REGIONS)


def _closed(spark, sf_dir, reserve=5_000):
    t = Tables(spark, sf_dir)
    return closing.winning_bids(t.auctions(reserve), t.closing_bids())


@query(f"WITH {_closed_sql()} SELECT * FROM closed")
def closed_auctions(spark, sf_dir):
    return _closed(spark, sf_dir)


@query(f"WITH {_closed_sql(BINDING)} SELECT * FROM closed")
def closed_auctions_binding_reserve(spark, sf_dir):
    return _closed(spark, sf_dir, BINDING)


@query(_Q4)
def q4_category_average(spark, sf_dir):
    return logical.category_average(_closed(spark, sf_dir))


@query(f"WITH {_closed_sql()} SELECT id, category, expires, CAST(sum(price) OVER w // count(*) OVER w AS BIGINT) AS average FROM closed WINDOW w AS (PARTITION BY category ORDER BY expires, id ROWS UNBOUNDED PRECEDING)")
def q4_category_average_changes(spark, sf_dir):
    return logical.category_average_changes(_closed(spark, sf_dir))


for _form in ("direct", "sliced", "incremental"):
    query(_hot_sql(HOUR, 60), f"q5_hot_items_{_form}")(lambda spark, sf_dir, form=_form: logical.hot_items(Tables(spark, sf_dir).bids(), HOUR, 60, form))


@query(_hot_sql(HOUR, 60, f"WHERE w_start IN (SELECT to_timestamp(epoch_us(date_time) // 1000000 // {HOUR} * {HOUR})::TIMESTAMP FROM b)"))
def q5_hot_items_anchored(spark, sf_dir):
    bids = Tables(spark, sf_dir).bids()
    return sliding.anchored(logical.hot_items(bids, HOUR, 60), bids, HOUR)


@query(_Q6.format(closed=_closed_sql(), key="bidder"))
def q6_bidder_average(spark, sf_dir):
    return logical.last_average(_closed(spark, sf_dir))


@query(_Q6.format(closed=_closed_sql(), key="seller"))
def q6_seller_average(spark, sf_dir):
    return logical.last_average(_closed(spark, sf_dir), "seller")


@query(_Q7)
def q7_highest_bid(spark, sf_dir):
    return logical.highest_bid(Tables(spark, sf_dir).bids(), DAY)


@query(_Q8.format(seconds=12 * HOUR))
def q8_new_users(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return logical.new_users(t.new_people(), t.new_auctions())


@query(_Q8.format(seconds=720))
def q8_new_users_720s(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return logical.new_users(t.new_people(), t.new_auctions(), 720)


@query(_COUNT.format(w=_windows_sql(HOUR, 6)))
def window_count(spark, sf_dir):
    return sliding.window_counts(Tables(spark, sf_dir).bids(), HOUR, 6 * HOUR)


@query(_COUNT.format(w=_windows_sql(HOUR, 6)) + " HAVING min(w_start) >= TIMESTAMP '2024-01-05 00:00:00'")
def window_count_from_origin(spark, sf_dir):
    return sliding.window_counts(Tables(spark, sf_dir).bids(), HOUR, 6 * HOUR, origin="2024-01-05 00:00:00")


@query(_RANK.format(w=_windows_sql(6 * HOUR, 4)))
def window_rank(spark, sf_dir):
    return sliding.window_ranks(Tables(spark, sf_dir).bids(), 6 * HOUR, DAY)


@query(_RANK.format(w=_windows_sql(6 * HOUR, 4)))
def window_rank_listed(spark, sf_dir):
    return sliding.listed_ranks(Tables(spark, sf_dir).bids(), 6 * HOUR, DAY)


@query(f"WITH {_windows_sql(6 * HOUR, 4)} SELECT bidder, w_start AS window_start, w_end AS window_end FROM w")
def assigned_windows(spark, sf_dir):
    return assign_windows(Tables(spark, sf_dir).bids(), "date_time", 6 * HOUR, DAY).select("bidder", "window_start", "window_end")


@query(f"WITH {_windows_sql(6 * HOUR, 4)} SELECT bidder, w_start AS window_start FROM w")
def window_starts_array(spark, sf_dir):
    return Tables(spark, sf_dir).bids().select("bidder", F.explode(window_starts("date_time", 6 * HOUR, DAY)).alias("window_start"))


@query(f"SELECT bidder, time_bucket(INTERVAL 1 HOUR, date_time) + INTERVAL 1 HOUR AS window_end FROM ({_BIDS})")
def tumbling_ends(spark, sf_dir):
    return Tables(spark, sf_dir).bids().select("bidder", tumbling_end("date_time", HOUR).alias("window_end"))


# --- hot keys dealt over tasks, at a bound that the sample tables reach


@query(_Q3)
def q3_local_items_dealt(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return logical.local_items(t.auctions(), t.people(), states=REGIONS, most=3)


@query(f"WITH {_closed_sql()} SELECT * FROM closed")
def closed_auctions_dealt(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return closing.winning_bids(t.auctions(), t.closing_bids(), most=4)


@query(_Q8.format(seconds=12 * HOUR))
def q8_new_users_dealt(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return logical.new_users(t.new_people(), t.new_auctions(), most=5)


# --- aggregates of one's own, merged before and after the shuffle


@query(f"SELECT auction, price, date_time, bidder FROM ({_BIDS}) QUALIFY row_number() OVER (PARTITION BY auction ORDER BY price DESC, date_time, bidder) <= 10")
def top_bids(spark, sf_dir):
    bids = Tables(spark, sf_dir).bids()
    return merging.merged(bids, merging.top_k(bids, ["auction"], [("price", "descending"), ("date_time", "ascending"), ("bidder", "ascending")], 10))


@query(f"SELECT auction, count(*) AS n, CAST(sum(price) // count(*) AS BIGINT) AS average FROM (SELECT * FROM ({_BIDS}) QUALIFY row_number() OVER (PARTITION BY auction ORDER BY date_time DESC, bidder DESC) <= 10) GROUP BY 1")
def last_bids_average(spark, sf_dir):
    bids = Tables(spark, sf_dir).bids()
    return merging.merged(bids, merging.average_of_last(bids, "auction", ["date_time", "bidder"], "price"))


# --- two results that differ at some times


def _altered(bids: DataFrame) -> DataFrame:
    """Some bids gone, some twice, some with another price; at other times the same rows in another order."""
    changed = bids.where("bidder % 89 <> 0").withColumn("price", F.when(F.col("bidder") % 97 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return changed.unionAll(changed.where("bidder % 101 = 0"))


_UNEQUAL = f"""WITH b AS ({_BIDS}), c AS (SELECT auction, bidder, price + CASE WHEN bidder % 97 = 0 THEN 1 ELSE 0 END AS price, date_time FROM b WHERE bidder % 89 <> 0),
o AS (SELECT * FROM c UNION ALL SELECT * FROM c WHERE bidder % 101 = 0), d AS ((SELECT * FROM b EXCEPT ALL SELECT * FROM o) UNION ALL (SELECT * FROM o EXCEPT ALL SELECT * FROM b)),
n AS (SELECT date_time, count(*) AS k FROM b GROUP BY 1), m AS (SELECT date_time, count(*) AS k FROM o GROUP BY 1)
SELECT date_time, CAST(coalesce(n.k, 0) - coalesce(m.k, 0) AS BIGINT) AS more FROM (SELECT DISTINCT date_time FROM d) LEFT JOIN n USING (date_time) LEFT JOIN m USING (date_time)"""


@query(_UNEQUAL)
def unequal_bids(spark, sf_dir):
    bids = Tables(spark, sf_dir).bids()
    return verify.unequal_times(bids, _altered(bids)).withColumn("more", F.col("more").cast("bigint"))


@query(_UNEQUAL)
def stream_unequal_bids(spark, sf_dir):
    return streams.unequal_bids(spark, sf_dir, _altered).withColumn("more", F.col("more").cast("bigint"))


# --- one stream of tagged events, taken apart again


def _tagged(spark, sf_dir):
    t = Tables(spark, sf_dir)
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    people = t.new_people().select("id", *none("string", "name", "email_address", "credit_card", "city", "state"), "date_time")
    auctions = t.auctions().select("id", *none("string", "item_name", "description"), *none("bigint", "initial_bid"), "reserve", "date_time", "expires", "seller", "category")
    return demux(mux(people, auctions, t.bids()))


@query("SELECT user_id AS id, ts AS date_time FROM events WHERE event_type = 'signup'")
def tagged_people(spark, sf_dir):
    return _tagged(spark, sf_dir)[0].select("id", "date_time")


@query(f"SELECT id, reserve, date_time, expires, seller, category FROM ({_AUCTIONS.format(reserve=5000)})")
def tagged_auctions(spark, sf_dir):
    return _tagged(spark, sf_dir)[1].select("id", "reserve", "date_time", "expires", "seller", "category")


@query(_BIDS)
def tagged_bids(spark, sf_dir):
    return _tagged(spark, sf_dir)[2]


# --- the registered names over the tables, an hour for each second; names that differ in backend or form have one SQL

PARAMS = registry.Params(5, 3, REGIONS, HOUR)


def _registered_sql(name: str) -> str:
    if name.startswith("window"):
        return (_COUNT if name.endswith("count") else _RANK).format(w=_windows_sql(5 * HOUR, 3))
    ten = f"to_timestamp((epoch_us(date_time) // 1000000 // {10 * HOUR} + 1) * {10 * HOUR})::TIMESTAMP"
    return {
        "q3": _Q3,
        "q4": _Q4,
        "q5": _hot_sql(HOUR, 60),
        "q6": _Q6.format(closed=_closed_sql(), key="bidder"),
        "q7": f"SELECT {ten} AS window_end, max(price) AS price FROM ({_BIDS}) GROUP BY 1",
        "q8": _Q8.format(seconds=720 if name == "q8" else 12 * HOUR),
    }[name[:2]]


def registered(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        if name.startswith("q8"):
            streams = registry.Streams(t.new_people(), t.new_auctions(), t.bids())
        else:
            streams = registry.Streams(t.people(), t.auctions(), t.closing_bids() if name[:2] in ("q4", "q6") else t.bids())
        return registry.QUERIES[name].plan(streams, PARAMS)

    return run


for _name in registry.QUERIES:
    query(_registered_sql(_name), f"registered_{_name}")(registered(_name))


# --- streaming twins, flushed to the end: the same SQL


@query(_Q3)
def stream_q3(spark, sf_dir):
    return streams.local_items(spark, sf_dir, REGIONS)


@query(f"WITH {_closed_sql()} SELECT * FROM closed")
def stream_closed_auctions(spark, sf_dir):
    return streams.closed_auctions(spark, sf_dir)


@query(_Q4)
def stream_q4(spark, sf_dir):
    return streams.category_average(spark, sf_dir)


@query(_hot_sql(HOUR, 60))
def stream_q5(spark, sf_dir):
    return streams.hot_items(spark, sf_dir)


for _form in ("indexed", "running"):
    query(_hot_sql(HOUR, 60), f"stream_q5_{_form}")(lambda spark, sf_dir, form=_form: streams.managed_hot_items(spark, sf_dir, form))


@query(_Q6.format(closed=_closed_sql(), key="bidder"))
def stream_q6(spark, sf_dir):
    return streams.last_average(spark, sf_dir)


@query(_Q7)
def stream_q7(spark, sf_dir):
    return streams.highest_bid(spark, sf_dir)


@query(_Q8.format(seconds=12 * HOUR))
def stream_q8(spark, sf_dir):
    return streams.new_users(spark, sf_dir)


@query(_COUNT.format(w=_windows_sql(HOUR, 6)))
def stream_window_count(spark, sf_dir):
    return streams.window_counts(spark, sf_dir)


@query(_RANK.format(w=_windows_sql(6 * HOUR, 4)))
def stream_window_rank(spark, sf_dir):
    return streams.window_ranks(spark, sf_dir)


# --- four results over one reading of the events, each run when it is asked for

for _name, _sql in (("hot_items", _hot_sql(HOUR, 60)), ("highest_bid", _Q7), ("new_users", _Q8.format(seconds=12 * HOUR)), ("window_counts", _COUNT.format(w=_windows_sql(HOUR, 6)))):
    query(_sql, f"shared_{_name}")(lambda spark, sf_dir, name=_name: streams.shared(spark, sf_dir, name))
