"""Hot keys: joins dealt by counts, aggregates merged before the shuffle."""

import statistics

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_queries import auctions, bids

from auctionflow.operators import closing, merging, skew, verify
from auctionflow.plans import logical


def hot(spark, n=20_000):
    """A key with nine tenths of the rows."""
    return spark.range(n).select(F.when(F.col("id") % 10 < 9, F.lit(7)).otherwise(F.col("id") % 500).cast("bigint").alias("k"), F.col("id").alias("v"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_dealt_join_is_a_join(spark, how):
    rows = hot(spark, 3_000).unionAll(spark.createDataFrame([(None, 1), (7, 0), (7, 0)], "k bigint, v bigint"))
    other = spark.createDataFrame([(k, x) for k in (7, 3, 3, 8, None, 10**6) for x in (1, 2)], "j bigint, x int")
    want = rows.join(other, F.col("k") == F.col("j"), how)
    assert want.count() and verify.same(want, skew.dealt_join(rows, other, "k", "j", 100, how))
    more = F.col("v") % 3 == F.col("x")
    assert verify.same(rows.join(other, (F.col("k") == F.col("j")) & more, how), skew.dealt_join(rows, other, "k", "j", 100, how, more))


def balanced(spark, make):
    """Rows of each task of a join without broadcasts or AQE; the largest against the median."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", "8")):
            spark.conf.set(k, v)
        counts = [r["count"] for r in make().withColumn("_task", F.spark_partition_id()).groupBy("_task").count().collect()]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    return len(counts) == 8 and max(counts) <= 2 * statistics.median(counts)


def test_no_task_has_the_hot_key(spark):
    rows = hot(spark)
    keys = rows.select(F.col("k").alias("j")).distinct()
    assert balanced(spark, lambda: skew.dealt_join(rows, keys, "k", "j", 100))
    assert not balanced(spark, lambda: rows.join(keys, F.col("k") == F.col("j")))
    opened = rows.select(F.col("v").alias("id"), F.col("k").alias("seller"), F.lit(10).cast("bigint").alias("category"), F.timestamp_seconds(F.col("v") + 1_000).alias("date_time"))
    people = keys.select(F.col("j").alias("id"), F.lit("n").alias("name"), F.lit("c").alias("city"), F.lit("OR").alias("state"), F.timestamp_seconds(F.lit(900)).alias("date_time"))
    assert balanced(spark, lambda: logical.local_items(opened, people, most=100))
    assert balanced(spark, lambda: logical.new_users(people, opened, 10**6, most=100))
    assert verify.same(logical.new_users(people, opened, 5_000), logical.new_users(people, opened, 5_000, most=100))


def test_hot_auction_closes(spark):
    a = auctions(spark, [(i, 5, 0, 5_000) for i in range(40)])
    b = bids(spark, [(7 if n % 10 < 9 else n % 40, n % 97, n * n % 1_009, n) for n in range(4_000)])
    assert verify.same(closing.winning_bids(a, b), closing.winning_bids(a, b, most=50))


def test_merged_sums_and_top_rows(spark):
    rows = hot(spark, 30_000).repartition(6).unionAll(spark.createDataFrame([(None, 1), (None, 5)], "k bigint, v bigint"))
    top = merging.top_k(rows, ["k"], [("v", "descending")], 10)
    got = merging.merged(rows, top)
    want = {}
    for r in rows.collect():
        want.setdefault(r["k"], []).append(r["v"])
    found = {}
    for r in got.collect():
        found.setdefault(r["k"], []).append(r["v"])
    assert {k: sorted(v, reverse=True) for k, v in found.items()} == {k: sorted(v, reverse=True)[:10] for k, v in want.items()}
    last = {r["k"]: (r["n"], r["average"]) for r in merging.merged(rows.withColumn("t", F.col("v")), merging.average_of_last(rows.withColumn("t", F.col("v")), "k", ["t"], "v", 3)).collect()}
    assert last == {k: (len(x), sum(x) // len(x)) for k, v in want.items() for x in [sorted(v)[-3:]]}
    assert merging.merged(rows.where("false"), top).collect() == []


def test_few_states_cross_the_shuffle(spark):
    """A task's 27,000 rows of the hot key become ten before the shuffle; flushing at a small bound changes nothing but that."""
    rows = hot(spark, 30_000).repartition(6).cache()
    top = merging.top_k(rows, ["k"], [("v", "descending")], 10)
    assert top.reduce(top.lift(pa.table({"k": [7] * 27_000, "v": list(range(27_000))}))).num_rows == 10
    results = [sorted(tuple(r) for r in merging.merged(rows, top, most).collect()) for most in (50, 200_000)]
    assert results[0] == results[1]
