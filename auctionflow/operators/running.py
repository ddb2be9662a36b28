"""Running sums over keys that may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, keys: list[str], bucket: Column, order: list[str], sums: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """``df`` with a running sum for each of ``sums`` along ``order`` within ``keys``.

    ``bucket`` rises with ``order`` and cuts a key's rows into pieces.  Sums run
    within the pieces, on as many tasks as there are pieces, and the totals of the
    earlier pieces, one row each, are added; no task gets all rows of a key.
    """
    rows = df.withColumn("_bucket", bucket).withColumns({f"_{n}": c for n, c in sums.items()})
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    outer = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_bucket").agg(*(F.sum(f"_{n}").alias(f"_t_{n}") for n in sums))
    before = totals.select(*keys, "_bucket", *(F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_b_{n}") for n in sums))
    within = rows.withColumns({f"_w_{n}": F.coalesce(F.sum(f"_{n}").over(inner), F.lit(0)) for n in sums})
    joined = within.join(before, [*keys, "_bucket"])
    return joined.select(*df.columns, *((F.col(f"_w_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums))


def last_sums(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, last: int, most: int = 100_000) -> DataFrame:
    """``df`` with ``total`` and ``n``: sum and number of ``value`` over a row and up to ``last - 1`` rows before it along ``order`` within ``keys``.

    A key of over ``most`` rows is cut into pieces by ``bucket``, which rises with ``order``;
    pieces are worked on apart.  A piece gets the last values of the pieces before it,
    ``last - 1`` at most, as its first rows reach back to them.  Each piece has a row at
    least, so the ``last - 1`` pieces before it hold all that it needs.
    """
    piece = [*keys, "_bucket"]
    hot = df.groupBy(*keys).count().where(F.col("count") > most).select(*keys, F.lit(True).alias("_hot"))
    rows = df.join(hot, keys, "left").withColumn("_bucket", F.when(F.col("_hot"), bucket))
    by = Window.partitionBy(*piece).orderBy(*order)
    near = by.rowsBetween(1 - last, 0)
    within = rows.withColumns({"_sum": F.sum(value).over(near), "_n": F.count(F.lit(1)).over(near), "_ends": F.lead(F.lit(1), last - 1).over(by).isNull()})
    ordered = F.sort_array(F.collect_list(F.struct(*order, value)))  # of at most last - 1 rows
    tails = within.where("_ends and _bucket is not null").groupBy(*piece).agg(F.transform(ordered, lambda r: r[value]).alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(1 - last, -1)
    before = tails.select(*piece, F.slice(F.reverse(F.flatten(F.collect_list("_tail").over(earlier))), 1, last - 1).alias("_before"))
    lacking = F.slice("_before", F.lit(1), F.lit(last) - F.col("_n").cast("int"))  # latest first
    joined = within.join(before.where(F.size("_before") > 0), piece, "left").withColumn("_more", F.coalesce(lacking, F.array().cast(df.select(F.array(value)).schema[0].dataType)))
    total = F.col("_sum") + F.aggregate("_more", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return joined.select(*df.columns, total.alias("total"), (F.col("_n") + F.size("_more")).alias("n"))
