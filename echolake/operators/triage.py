"""Triage counts and ladders, and evaluation metrics of binary scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("immediate", "delayed", "minor", "deceased", "unknown")


def counts(df: DataFrame, keys: Sequence[str], status: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in STATUSES])


def _ladder(steps: Sequence[tuple[Column, str]], rest: str) -> Column:
    out = F.lit(rest)
    for holds, name in reversed(steps):
        out = F.when(holds, name).otherwise(out)
    return out


def severity(immediate: str, delayed: str, total: str) -> Column:
    """Thresholds of the number at once in need and of the share in need; none at all is minimal."""
    n = F.col(immediate)
    ratio = F.coalesce((n + F.col(delayed)) / F.nullif(F.col(total), F.lit(0)), F.lit(0.0))
    return _ladder([((n >= a) | (ratio > b), s) for a, b, s in ((10, 0.5, "critical"), (5, 0.3, "major"), (1, 0.1, "moderate"))], "minimal")


def resource_level(immediate: str, delayed: str, minor: str) -> Column:
    """By rescuers in need: 4 for each immediate, 2 for each delayed, one for two minor."""
    need = F.col(immediate) * 4 + F.col(delayed) * 2 + F.floor(F.col(minor) / 2)
    return _ladder([(need >= a, s) for a, s in ((100, "mutual_aid"), (50, "multi_agency"), (20, "enhanced"), (5, "standard"))], "minimal")


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal width."""
    place = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    by = df.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("p"), F.avg(F.col(y).cast("int")).alias("y"))
    return by.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def confusion(df: DataFrame, p: str, y: str, threshold: float) -> DataFrame:
    """Counts, F1 and error rates; rates without cases are 0."""
    yes, real = F.col(p) >= threshold, F.col(y)
    c = df.agg(*[F.count_if(h).alias(n) for n, h in (("tp", yes & real), ("fp", yes & ~real), ("fn", ~yes & real), ("tn", ~yes & ~real))])
    share = lambda a, b: F.round(F.coalesce(F.expr(f"({a}) / nullif({b}, 0)"), F.lit(0.0)), 6)
    return c.select("*", share("2 * tp", "2 * tp + fp + fn").alias("f1"), share("fp", "fp + tn").alias("false_positive_rate"), share("fn", "fn + tp").alias("false_negative_rate"))


def selective(df: DataFrame, p: str, y: str, threshold: float) -> DataFrame:
    """Share of rows scored at the threshold or above, and their share of errors."""
    kept = F.col(p) >= threshold
    return df.agg(F.round(F.avg(kept.cast("int")), 6).alias("coverage"), F.round(F.avg(F.when(kept, (~F.col(y)).cast("int"))), 6).alias("risk"))


def split_leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """By group: rows, and whether it lies in more than one split."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), (F.count_distinct(split) > 1).alias("leaks"))
