"""Rules over rooms, times of day, alerts and pose: what a belief means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolake.plans.ranking import with_running_total

#: Alert priorities, the lowest first, and triage classes that can be raised.
PRIORITIES = ("low", "medium", "high", "critical")
UPGRADES = {"minor": "delayed", "delayed": "immediate"}


def in_window(second_of_day: Column, start: int, end: int) -> Column:
    """Whether a time of day is in [start, end), which may pass midnight."""
    if start <= end:
        return (second_of_day >= start) & (second_of_day < end)
    return (second_of_day >= start) | (second_of_day < end)


def zone_changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], zones: str) -> DataFrame:
    """``df`` with ``entered`` and ``left``: what the set of zones gains and loses against the row before."""
    none = F.array().cast("array<string>")
    before = F.coalesce(F.lag(zones).over(Window.partitionBy(*keys).orderBy(*order)), none)
    out = df.withColumn("__el_before", before)
    return out.withColumn("entered", F.array_except(zones, "__el_before")).withColumn("left", F.array_except("__el_before", zones)).drop("__el_before")


def leaves_zone(df: DataFrame, keys: Sequence[str], order: Sequence[str], zone: str, home: str, second_of_day: Column, start: int, end: int) -> DataFrame:
    """Rows at which a key has just left a zone, within a window of the day."""
    before = F.lag(zone).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__el_b", before).where((F.col("__el_b") == home) & (F.col(zone) != home) & in_window(second_of_day, start, end)).drop("__el_b")


def risk_crossings(df: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, level: float) -> DataFrame:
    """Rows at which a score comes up to a level; a key's first row counts if it is there."""
    before = F.coalesce(F.lag(score).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(float("-inf")))
    return df.withColumn("__el_b", before).where((F.col("__el_b") < level) & (F.col(score) >= level)).drop("__el_b")


def escalate(df: DataFrame, pending: Column, age_seconds: Column, limit: int, priority: str) -> DataFrame:
    """Pending alerts older than the limit in whole seconds, one priority up."""
    steps = F.create_map(*[F.lit(x) for a, b in zip(PRIORITIES, [*PRIORITIES[1:], PRIORITIES[-1]], strict=True) for x in (a, b)])
    return df.where(pending & (F.floor(age_seconds) > limit)).withColumn("escalated", steps[F.col(priority)])


def upgraded(status: Column, deteriorating: Column) -> Column:
    """A triage class after a check: raised by one where it can be and the case gets worse."""
    out = status
    for low, high in UPGRADES.items():
        out = F.when(deteriorating & (status == low), high).otherwise(out)
    return out


def joint_distances(pred: Column, truth: Column) -> Column:
    """Distances of 2-D joints, given as flat arrays x, y, x, y, ..."""
    n = F.floor(F.size(pred) / 2).cast("int")
    pairs = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def distance(k: Column) -> Column:
        d = [F.get(pred, 2 * k + j).cast("double") - F.get(truth, 2 * k + j).cast("double") for j in (0, 1)]
        return F.sqrt(d[0] * d[0] + d[1] * d[1])

    return F.transform(pairs, distance)


def mean_of(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(v), F.lit(0))


def percent_correct(distances: Column, threshold: float) -> Column:
    return F.size(F.filter(distances, lambda d: d <= threshold)) / F.nullif(F.size(distances), F.lit(0)).cast("double")


def keypoint_similarity(distances: Column, scale: float, spread: float) -> Column:
    """Mean of exp(-d^2 / (2 scale^2 spread^2))."""
    return mean_of(F.transform(distances, lambda d: F.exp(-d * d / (2 * scale * scale * spread * spread))))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the curve and the leakage 2 |auc - 1/2|; equal scores count half, null ones not at all.

    Scores are counted by value; the values of one bin at a time are summed up in order.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    ranked = with_running_total(counts, [], "s", "n", "__el_n")
    won = F.col("p") * (F.col("__el_n") - F.col("n") / 2)
    value = F.sum(won) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))
    return ranked.agg(value.alias("auc")).withColumn("leakage", 2 * F.abs(F.col("auc") - 0.5))
