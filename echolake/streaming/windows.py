"""Event-time operators: the same function on a stream or a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, delay: str) -> DataFrame:
    return df.withWatermark(time, delay) if df.isStreaming else df


def _summary(grouped, x: str) -> DataFrame:
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.max(x).alias("most"))
    return out.withColumn("begin", F.col("w.start")).withColumn("end", F.col("w.end")).drop("w")


def windowed(df: DataFrame, keys: Sequence[str], time: str, x: str, length: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """By key and tumbling (or sliding) window: n, mean and most."""
    return _summary(_late(df, time, delay).groupBy(*keys, F.window(time, length, slide).alias("w")), x)


def sessions(df: DataFrame, keys: Sequence[str], time: str, x: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """By key and session, which ends where no row comes for ``gap``."""
    return _summary(_late(df, time, delay).groupBy(*keys, F.session_window(time, gap).alias("w")), x)


def deduplicated(df: DataFrame, keys: Sequence[str], time: str, delay: str = "1 hour") -> DataFrame:
    """One row for each key; a stream forgets keys after the delay."""
    return _late(df, time, delay).dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))
