"""Window arithmetic on event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seconds(n: float) -> str:
    """An interval string for ``F.window``."""
    return f"{int(n * 1_000_000)} microseconds"


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def tumbling_end(ts: str | Column, width: float) -> Column:
    """End of the window of ``width`` seconds that holds ``ts``; a time on a boundary belongs to the next window."""
    w = F.lit(int(width * 1_000_000))
    return F.timestamp_micros((F.floor(micros(ts) / w) + 1) * w)


def window_starts(ts: str | Column, slide: float, size: float) -> Column:
    """Array of the starts of all windows that hold ``ts``, latest first; starts before 1970 are left out."""
    s, count = int(slide * 1_000_000), -(-int(size * 1_000_000) // int(slide * 1_000_000))
    t = micros(ts)
    latest = F.floor(t / F.lit(s)) * F.lit(s)
    starts = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: latest - i.cast("bigint") * F.lit(s))
    kept = F.filter(starts, lambda w: (w >= 0) & (t < w + F.lit(int(size * 1_000_000))))
    return F.transform(kept, F.timestamp_micros)


def assign_windows(df: DataFrame, ts: str, slide: float, size: float, origin: str | None = None) -> DataFrame:
    """A row for each window (window_start, window_end) that holds the row; windows that start before ``origin`` are left out."""
    w = F.window(ts, seconds(size), seconds(slide))
    out = df.withColumn("w", w).withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")
    return out.where(F.col("window_start") >= F.lit(origin).cast("timestamp")) if origin else out


def to_event_time(logical: Column, dilation: int = 1) -> Column:
    """Event time of a logical time."""
    return logical * F.lit(dilation)


def from_event_time(event: Column, dilation: int = 1) -> Column:
    return F.floor(event / F.lit(dilation))
