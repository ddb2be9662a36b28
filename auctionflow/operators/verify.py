"""Order-insensitive equality of two results, static or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differences(correct: DataFrame, output: DataFrame) -> DataFrame:
    """Rows of one that the other lacks, repeats counted; empty if they are equal."""
    output = output.select(correct.columns)
    return correct.exceptAll(output).unionAll(output.exceptAll(correct))


def same(correct: DataFrame, output: DataFrame) -> bool:
    return differences(correct, output).isEmpty()


def _prints(columns: list[str], seed: int) -> Column:
    """A hash of a row; hashes skip nulls, so which columns are null goes in too."""
    return F.xxhash64(*columns, *(F.col(c).isNull() for c in columns), F.lit(seed)).cast("decimal(38,0)")


def unequal_times(correct: DataFrame, output: DataFrame, ts: str = "date_time") -> DataFrame:
    """(``ts``, more): the times at which two streams have different rows, and how many more ``correct`` has.

    Rows of a time count as a multiset, in any order.  Each time keeps three numbers, whatever
    the rows: their count and the sums of two 64-bit hashes, those of ``output`` taken
    off.  Equal multisets leave zeros; others do so with a chance of 2**-128.  With watermarks on
    ``ts`` a time is reported when both streams have passed it, and forgotten then.
    """
    columns = correct.columns
    side = lambda df, sign: df.select(*columns).select(ts, F.lit(sign).alias("_sign"), *((_prints(columns, k) * sign).alias(f"_print_{k}") for k in (1, 2)))
    both = side(correct, 1).unionAll(side(output, -1))
    sums = both.groupBy(ts).agg(F.sum("_sign").alias("more"), F.sum("_print_1").alias("_print_1"), F.sum("_print_2").alias("_print_2"))
    return sums.where("more <> 0 or _print_1 <> 0 or _print_2 <> 0").select(ts, "more")
