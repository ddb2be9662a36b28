"""Joins of rows with hot keys, dealt over tasks by counts.

Spark splits a skewed partition of a join by itself where nothing above the join needs the
rows of a key together.  Where something does, or where the hot side can't be split,
``dealt_join`` does it in the plan: a key of over ``most`` rows gets parts of about
``most``, its rows go to the parts by a hash, and the other side's rows of the key are
repeated for each part.  Keys that aren't hot have one part and move as ever.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt_join(rows: DataFrame, other: DataFrame, key: str, other_key: str, most: int, how: str = "inner", condition: Column | None = None) -> DataFrame:
    """``rows`` joined with ``other`` on ``key = other_key`` (and ``condition``); inner, left, left_semi or left_anti, so that each of ``rows`` is in one part.

    ``most`` bounds the rows of a hot key that a task gets for each of its parts; hot
    keys are a ``most``-th of the rows at the most.  The counts take a scan of the keys,
    summed before the shuffle.
    """
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    hot = counts.select("_key", F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    # rows that are equal in all columns go to parts by chance too
    own = rows.withColumn("_at", F.pmod(F.xxhash64(*rows.columns, F.monotonically_increasing_id()), F.lit(1 << 40)))
    left = own.join(hot, F.col(key) == F.col("_key"), "left").select(*rows.columns, (F.col("_at") % F.coalesce("_parts", F.lit(1))).cast("int").alias("_part"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_copy")
    right = other.join(hot, F.col(other_key) == F.col("_key"), "left").select(*other.columns, copies)
    on = (F.col(key) == F.col(other_key)) & (F.col("_part") == F.col("_copy"))
    joined = left.join(right, on if condition is None else on & condition, how)
    return joined.drop("_part", "_copy")
