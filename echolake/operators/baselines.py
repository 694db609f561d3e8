"""Baselines that are kept between runs: tones of an empty room, days of a person, links of a mesh, voxels.

A baseline is a table of moments that add up, so parts are merged by one
aggregation, a later run joins what an earlier one wrote, and a stream
subtracts a stored table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolake.operators.folds import Kernel, State

# Fixed values.
MOTION_Z, MOTION_DRIFT, STD_FLOOR, LEAST_NORM, LEAST_FRAMES = 2.0, 0.7, 1e-12, 1e-12, 600
READY_DAYS, OFF_SIGMA, HELD_DAYS, RISK_DAYS = 7, 2.0, 3, 7
DIVERGING_SIGMA, DIVERGING_LINKS = 2.0, 3
LOG_ODDS, LEAST_EVIDENCE = 20.0, 5

SUMS = ("n", "total", "squares", "cosines", "sines")


def moments(df: DataFrame, keys: Sequence[str], amplitude: str, phase: str, centre: float = 0.0) -> DataFrame:
    """By key the sums of a baseline: count, amplitudes less ``centre``, their squares, cosines and sines of phases.

    Rows with a null or NaN amplitude or phase do not count.  Every table that
    is to be merged takes the same ``centre``, a number near the amplitudes.
    """
    x = F.col(amplitude).cast("double") - centre
    fine = df.where(F.col(amplitude).isNotNull() & ~F.isnan(F.col(amplitude).cast("double")) & F.col(phase).isNotNull() & ~F.isnan(F.col(phase).cast("double")))
    return fine.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"), F.sum(F.cos(phase)).alias("cosines"), F.sum(F.sin(phase)).alias("sines"))


def merged(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One baseline of several, e.g. of the stored one and a new batch's."""
    return reduce(DataFrame.unionByName, [p.select(*keys, *SUMS) for p in parts]).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def finalized(sums: DataFrame, keys: Sequence[str], centre: float = 0.0, least: int = LEAST_FRAMES) -> DataFrame:
    """By key: n, amp_mean, amp_variance (of a sample), phase_mean and phase_dispersion (0 all alike, 1 all over); keys of fewer rows have none."""
    n = F.col("n")
    variance = F.when(n > 1, F.greatest((F.col("squares") - F.col("total") ** 2 / n) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))).otherwise(0.0)
    length = F.sqrt(F.col("cosines") ** 2 + F.col("sines") ** 2) / n
    return sums.where(n >= least).select(*keys, "n", (centre + F.col("total") / n).alias("amp_mean"), variance.alias("amp_variance"), F.atan2("sines", "cosines").alias("phase_mean"), (1 - length).alias("phase_dispersion"))


def circular_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d > F.pi(), 2 * F.pi() - d).otherwise(d)


def against(df: DataFrame, model: DataFrame, keys: Sequence[str], amplitude: str, phase: str) -> DataFrame:
    """``df`` beside the model of its key with ``z``, ``drift`` and what is ``left`` of the amplitude above the baseline.

    Rows of keys without a model are left out.  Works for a stream against a stored table too.
    """
    met = df.join(model, list(keys))
    x = F.col(amplitude)
    z = (x - F.col("amp_mean")) / F.greatest(F.sqrt("amp_variance"), F.lit(STD_FLOOR))
    left = F.when(x > LEAST_NORM, F.greatest(x - F.col("amp_mean"), F.lit(0.0))).otherwise(x)
    return met.select(*[df[c] for c in df.columns], z.alias("z"), circular_distance(F.col(phase), F.col("phase_mean")).alias("drift"), left.alias("left"))


def deviation(compared: DataFrame, frame: Sequence[str]) -> DataFrame:
    """By frame: medians of |z| and drift over its tones, the largest |z|, and whether that means motion."""
    held = compared.groupBy(*frame).agg(F.sort_array(F.collect_list(F.abs("z"))).alias("zs"), F.sort_array(F.collect_list("drift")).alias("ds"))  # a frame's tones
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    out = held.select(*frame, middle(F.col("zs")).alias("z_median"), F.array_max("zs").alias("z_max"), middle(F.col("ds")).alias("drift_median"))
    return out.withColumn("motion", (F.col("z_median") > MOTION_Z) | (F.col("drift_median") > MOTION_DRIFT))


def personal_days(ready: int = READY_DAYS, sigma: float = OFF_SIGMA, held: int = HELD_DAYS, risk: int = RISK_DAYS) -> Kernel:
    """Value: a person's metric of a day.  Reports of days on end off the baseline: direction, z, mean, deviation, days, level.

    The state is the baseline itself (days, mean, squared deviations, days off),
    so a run that starts from the last one's state goes on with it.
    """

    def step(s: State, v: tuple, t: float):
        n, mean, m2, off = s
        n += 1
        apart = v[0] - mean
        mean += apart / n
        m2 += apart * (v[0] - mean)
        std = (m2 / n) ** 0.5 if n > 1 else 0.0
        z = (v[0] - mean) / std if std > 1e-15 else 0.0
        if n < ready:
            return (n, mean, m2, off), None
        off = off + 1 if abs(z) > sigma else 0
        told = ("increasing" if z > 0 else "decreasing", z, mean, std, off, "risk_correlation" if off >= risk else "drift") if off >= held else None
        return (n, mean, m2, off), told

    return Kernel((0, 0.0, 0.0, 0), step, "direction string, z double, mean double, std double, days int, level string")


def change_points(df: DataFrame, state: DataFrame | None, at: str, link: str, x: str, sigma: float = DIVERGING_SIGMA, least: int = DIVERGING_LINKS) -> tuple[DataFrame, DataFrame]:
    """Windows at which enough links diverge from their own past, and the links' state after them all.

    ``df`` has one row a window and link; a link diverges where its value is off
    the mean of all windows before by ``sigma`` deviations.  ``state`` (link, n,
    total, squares) is what an earlier run returned: two runs over halves tell
    the same as one over all.  Null values and links are left out.
    """
    from pyspark.sql import Window

    rows = df.where(F.col(x).isNotNull() & F.col(link).isNotNull()).select(F.col(at).alias("__el_at"), F.col(link).alias("link"), F.col(x).cast("double").alias("x"))
    none = rows.select("link", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("squares")).limit(0)
    before = (state if state is not None else none).select("link", F.col("n").alias("n0"), F.col("total").alias("t0"), F.col("squares").alias("s0"))
    w = Window.partitionBy("link").orderBy("__el_at").rowsBetween(Window.unboundedPreceding, -1)
    known = rows.join(before, "link", "left")
    past = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("n0", "t0", "s0")}
    n = past["n0"] + F.count("x").over(w)
    total, squares = past["t0"] + F.coalesce(F.sum("x").over(w), F.lit(0.0)), past["s0"] + F.coalesce(F.sum(F.col("x") ** 2).over(w), F.lit(0.0))
    mean = total / F.nullif(n, F.lit(0.0))
    std = F.sqrt(F.greatest(squares / F.nullif(n, F.lit(0.0)) - mean * mean, F.lit(0.0)))
    off = known.select("__el_at", ((n >= 2) & (std > 1e-9) & (F.abs(F.col("x") - mean) > sigma * std)).cast("int").alias("off"))
    found = off.groupBy(F.col("__el_at").alias(at)).agg(F.coalesce(F.sum("off"), F.lit(0)).alias("diverging")).where(F.col("diverging") >= least)
    now = rows.select("link", F.lit(1).cast("long").alias("n"), F.col("x").alias("total"), (F.col("x") ** 2).alias("squares"))
    held = now if state is None else now.unionByName(state.select("link", "n", "total", "squares"))
    return found, held.groupBy("link").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])


def voxel_evidence() -> Kernel:
    """Values occupancy probability and speed (NaN-free; 0 for none is a speed too).  Occupancy and confidence of a voxel after each observation."""
    import math

    def step(s: State, v: tuple, t: float):
        odds, n = s
        p = min(max(v[0], 1e-4), 1 - 1e-4)
        odds, n = min(max(odds + math.log(p / (1 - p)), -LOG_ODDS), LOG_ODDS), n + 1
        return (odds, n), (1 / (1 + math.exp(-odds)), 1 - math.exp(-n / 5), n < LEAST_EVIDENCE, float(v[1]))

    return Kernel((0.0, 0), step, "occupancy double, confidence double, unsure boolean, speed double")


def demoted(voxels: DataFrame, posture: str, bins: int = 10) -> DataFrame:
    """What may leave a node: ``full`` all, ``anonymous`` occupancies only, ``restricted`` a histogram of them (bin, n)."""
    if posture == "full":
        return voxels
    if posture == "anonymous":
        return voxels.withColumns({"speed": F.lit(None).cast("double"), "confidence": F.lit(0.0)})
    if posture != "restricted":
        raise ValueError(f"no posture {posture!r}")
    place = F.least(F.floor(F.col("occupancy") * bins), F.lit(bins - 1)).cast("int")
    return voxels.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
