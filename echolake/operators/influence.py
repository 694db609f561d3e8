"""Influence in a weighted graph by power iteration with damping, over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolake.plans.shared import materialize

# Fixed values.
DAMPING = 0.85


def influence(edges: DataFrame, a: str, b: str, weight: str, damping: float = DAMPING, tolerance: float = 1e-10, most: int = 200, nodes: DataFrame | None = None, by: list[str] | None = None) -> tuple[DataFrame, int]:
    """(node, rank) of the graph, ranks of a graph sum to 1, and the rounds taken.

    A node passes its rank on by the weights of its edges from ``a`` to ``b``;
    what nodes without edges hold goes to all nodes alike.  Rounds end when the
    ranks of all graphs together move by less than ``tolerance``.  Weights that are null or not above 0, and
    null ends, are no edges; repeated edges add up.  ``nodes`` (column node)
    may name nodes without edges; ``by`` ranks many graphs at once.  Each
    round's ranks are written, so the plan stays one round long.
    """
    by = by or []
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(weight) > 0)).groupBy(*by, F.col(a).alias("u"), F.col(b).alias("v")).agg(F.sum(weight).alias("w"))
    out = e.groupBy(*by, "u").agg(F.sum("w").alias("out"))
    e = materialize(e.join(out, [*by, "u"]).select(*by, "u", "v", (F.col("w") / F.col("out")).alias("share")), "edges")
    every = e.select(*by, F.col("u").alias("node")).unionByName(e.select(*by, F.col("v").alias("node")))
    every = every.unionByName(nodes.select(*by, "node").where("node IS NOT NULL")) if nodes is not None else every
    every = every.distinct().join(e.select(*by, F.col("u").alias("node"), F.lit(1).alias("gives")).distinct(), [*by, "node"], "left")
    sizes = every.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    joined = every.join(sizes, by) if by else every.crossJoin(F.broadcast(sizes))  # one row
    now = materialize(joined.select(*by, "node", "gives", "n", (1 / F.col("n")).alias("rank")), "ranks")
    rounds = 0
    while rounds < most:
        got = e.join(now.select(*by, F.col("node").alias("u"), "rank"), [*by, "u"]).groupBy(*by, F.col("v").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        idle = now.groupBy(*by).agg(F.sum(F.when(F.col("gives").isNull(), F.col("rank")).otherwise(0.0)).alias("idle"))
        held = now.join(got, [*by, "node"], "left")
        held = held.join(idle, by) if by else held.crossJoin(F.broadcast(idle))  # one row
        rank = (1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("idle") / F.col("n"))
        now = materialize(held.select(*by, "node", "gives", "n", rank.alias("rank"), F.col("rank").alias("was")), "ranks")
        rounds += 1
        if (now.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0) < tolerance:
            break
        now = now.drop("was")
    return now.select(*by, "node", "rank"), rounds
