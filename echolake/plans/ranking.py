"""Exact ranks and running totals within groups of any size.

``row_number() over (partition by key)`` sends a hot key to one task.  Here a
group is first cut into hash buckets of about ``rows_per_bucket`` rows; the
bucket counts give every bucket its offset, and only the rows of one bucket
meet in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolake.plans.shared import materialize

BUCKET, OFFSET = "__el_bucket", "__el_offset"


def exact_rank(
    df: DataFrame,
    keys: Sequence[str],
    hashed: Column,
    ties: Sequence[str],
    out: str,
    n_rows: int,
    rows_per_bucket: int = 50_000,
    key_values: DataFrame | None = None,
) -> DataFrame:
    """``df`` with ``out``: the rank from 0 of each row among those of its ``keys``.

    The order is that of (bucket, ``hashed``, ``ties``), the same in every run
    when these tell rows apart; rows equal in all of them may swap ranks.
    ``df`` is read twice, so materialize it first if it is dear.  ``keys`` must
    hold no nulls.  ``key_values`` (one row per key) is joined through the small
    table of bucket counts, so that a hot key costs nothing.
    """
    buckets = max(1, -(-n_rows // rows_per_bucket))
    cut = df.withColumn("__el_hash", hashed).withColumn(BUCKET, F.pmod("__el_hash", F.lit(buckets)).cast("int"))
    inner = [*keys, BUCKET]
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*inner).agg(F.count(F.lit(1)).alias("__el_n"))
    counts = counts.withColumn(OFFSET, F.coalesce(F.sum("__el_n").over(before), F.lit(0))).drop("__el_n")
    if key_values is not None:
        counts = counts.join(key_values, list(keys))
    here = Window.partitionBy(*inner).orderBy("__el_hash", *ties)
    ranked = cut.withColumn(out, F.row_number().over(here).cast("long") - 1).join(counts, inner)
    return ranked.withColumn(out, F.col(out) + F.col(OFFSET)).drop("__el_hash", BUCKET, OFFSET)


def with_running_total(df: DataFrame, keys: Sequence[str], value: str, amount: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``amount`` over its rows of ``keys`` up to ``value``, this row included.

    ``value`` tells the rows of a key apart.  Rows are cut into ranges of value
    and key, whose totals give the offsets, so a hot key is many tasks' work.
    """
    cut = df.repartitionByRange(*keys, value).withColumn("__el_range", F.spark_partition_id())
    cut = materialize(cut, "ranges")  # fixes the ranges
    inner = [*keys, "__el_range"]
    before = Window.partitionBy(*keys).orderBy("__el_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*inner).agg(F.sum(amount).alias("__el_sum"))  # a row a range and key
    offsets = totals.withColumn("__el_offset", F.coalesce(F.sum("__el_sum").over(before), F.lit(0))).drop("__el_sum")
    here = Window.partitionBy(*inner).orderBy(value)
    joined = cut.withColumn(out, F.sum(amount).over(here)).alias("a").join(F.broadcast(offsets).alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in inner])
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col(f"a.`{out}`") + F.col("b.__el_offset")).alias(out))
