"""The supplied tables in the roles that the operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of nodes: event_id, node, kind, x, props, ts and t, seconds since the epoch.

    ``ts`` is cast to an instant, as event-time operators ask for one.
    """
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select("event_id", F.col("user_id").alias("node"), F.col("event_type").alias("kind"), F.col("value").alias("x"), "props", ts.alias("ts"), (F.unix_micros(ts) / 1e6).alias("t"))


#: The same as a common table expression.
SAMPLES = "s AS (SELECT event_id, user_id AS node, event_type AS kind, value AS x, props, ts, epoch_us(ts) / 1e6 AS t FROM events)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as frames: one row an order with arrays by line number.

    amplitude (quantity), phase (a wrapped angle of the price) and price.
    """
    li = table(spark, sf_dir, "lineitem")
    angle = F.pmod(F.col("l_extendedprice") / 1000.0, F.lit(6.0)) - 3.0
    tone = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("a"), angle.alias("p"), F.col("l_extendedprice").alias("e"))
    rows = li.groupBy(F.col("l_orderkey").alias("frame")).agg(F.array_sort(F.collect_list(tone)).alias("tones"))
    return rows.select("frame", *[F.col(f"tones.{k}").alias(n) for k, n in (("a", "amplitude"), ("p", "phase"), ("e", "price"))])


FRAMES = """f AS (
  SELECT l_orderkey AS frame,
         list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS amplitude,
         list(l_extendedprice / 1000.0 - 6.0 * floor(l_extendedprice / 6000.0) - 3.0 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS phase,
         list(l_extendedprice ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS price
  FROM lineitem GROUP BY l_orderkey)"""
