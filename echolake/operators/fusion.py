"""Matching and fusing rows of several sensors: cycles, ranges, as-of, voxels, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax_weights(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """``df`` with ``weight``: softmax of the score within the key; weights of a key sum to 1, a null key is one too."""
    w = Window.partitionBy(*keys)
    held = df.withColumn("__el_e", F.exp(F.col(score) - F.max(score).over(w)))
    return held.withColumn("weight", F.col("__el_e") / F.sum("__el_e").over(w)).drop("__el_e")


def entropy(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """By key: n and the entropy of its weights over log n (1 for a single one)."""
    w = F.col(weight)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (-F.sum(F.when(w > 0, w * F.log(w)))).alias("h"))
    return out.select(*keys, "n", F.when(F.col("n") > 1, F.col("h") / F.log(F.col("n").cast("double"))).otherwise(1.0).alias("entropy"))


def fuse_cycle(df: DataFrame, cycle: str, seconds: Column, amplitude: str, weight: str, guard: float) -> DataFrame:
    """By cycle: members, spread in seconds and the weighted mean; null where the spread is above the guard."""
    t = df.withColumn("__el_t", seconds)
    out = t.groupBy(cycle).agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("__el_t") - F.min("__el_t")).alias("spread"),
        (F.sum(F.col(amplitude) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))).alias("fused"),
    )
    return out.withColumn("fused", F.when(F.col("spread") <= guard, F.col("fused")))


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, start: str, width: float) -> DataFrame:
    """Pairs of a left row and a right window of the same key with start <= at < start + width.

    An equi-join on time buckets of the width: a window touches two, a row is in one.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    one = left.withColumn("__el_bucket", bucket(at))
    two = right.withColumn("__el_bucket", F.explode(F.array(bucket(start), bucket(start) + 1)))
    joined = one.join(two, [*keys, "__el_bucket"])
    return joined.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + width)).drop("__el_bucket")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """``left`` with the values of the last right row of its key at or before it; null if there is none.

    A union and a running last value: one shuffle, and no join that multiplies rows.
    """
    marked = right.select(*keys, at, F.struct(*values).alias("__el_v"), F.lit(0).alias("__el_side"))
    both = left.withColumn("__el_side", F.lit(1)).unionByName(marked, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "__el_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("__el_last", F.last("__el_v", ignorenulls=True).over(w)).where("__el_side = 1")
    return filled.select(*left.columns, "__el_last.*")


def voxels(df: DataFrame, position: Sequence[Column], size: float) -> DataFrame:
    """By occupied voxel: points and mean position."""
    names = [f"v{k}" for k in range(len(position))]
    cells = df.select(*[F.floor(p / size).alias(n) for p, n in zip(position, names, strict=True)], *[p.alias(f"p{k}") for k, p in enumerate(position)])
    return cells.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"p{k}").alias(f"mean{k}") for k in range(len(position))])


def correlations(df: DataFrame, series: str, at: Column, x: str) -> DataFrame:
    """Pearson correlation of every two series over the bins that both have: (a, b, n, r).

    Series are few names; the join is on the bin.
    """
    bins = df.groupBy(series, at.alias("bin")).agg(F.avg(x).alias("v"))
    one = bins.select("bin", F.col(series).alias("a"), F.col("v").alias("va"))
    two = bins.select("bin", F.col(series).alias("b"), F.col("v").alias("vb"))
    met = one.join(two, "bin").where("a < b")
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("va", "vb").alias("r"))
