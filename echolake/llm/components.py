"""Connected components of a graph held in DataFrames.

Alternating large-star and small-star steps: every step is a grouped minimum
and an equi-join, so a hub is pre-aggregated and never collected.  The edges of
each round are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolake.plans.shared import materialize


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root): for each node of an edge, the smallest node it reaches.

    Loops, repeated edges and either direction are fine; null ends are left out.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    now = materialize(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    before = _digest(now)
    while before[0]:
        least = now.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        # large star: all that points to v points to the least that v points to
        jumped = now.join(least, now["v"] == least["w"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        jumped = materialize(jumped, "edges")
        # small star: what u points to, and u, point to the least of them
        least = jumped.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        others = jumped.join(least, jumped["u"] == least["w"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(others.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        after = _digest(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
