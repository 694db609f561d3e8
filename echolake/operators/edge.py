"""Detectors of edge devices as windows over rows in order: runs of a condition, latches and pauses.

They count rows, as devices send ``RATE`` of them a second.  A missing reading
(null or NaN) meets no condition, so a missing breathing rate counts as no
breath.  All windows of a detector share one sort by key; a key's order is the
operator, so a key is one task's work, streamed and spilled.  Alerts are rows
(key, row id, alert, value); a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from echolake.operators import folds as K

# Fixed values of the detectors.
RATE = 20.0
BREATH_FLOOR, STILL_MOTION, BODY_VARIANCE = 4.0, 0.02, 0.005
TURBULENT = 0.6
HEART_HIGH, HEART_LOW, BEAT_DROP, RMSSD_RANGE, RMSSD_SCALE = 100.0, 50.0, 0.30, (10.0, 120.0), 17.0
APNEA_BELOW, BREATH_RANGE, TREND_HEART_RANGE = 1.0, (12.0, 25.0), (50.0, 120.0)
NIGHT_FROM, NIGHT_TO, USED = 22, 6, 0.1


def above(c: str | Column, limit: float, reached: bool = False) -> Column:
    """Whether a reading is there and above the limit (or at it, where that counts)."""
    c = F.col(c).cast("double") if isinstance(c, str) else c
    return F.coalesce(((c >= limit) if reached else (c > limit)) & ~F.isnan(c), F.lit(False))


def _upto(key: str, order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def numbered(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """With ``frame``, the number of the row in its key from 1."""
    return df.withColumn("frame", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def runs(df: DataFrame, key: str, order: Sequence[str], **conditions: Column) -> DataFrame:
    """With a column a condition: how many rows on end up to this one meet it.  The order needs no ties."""
    w, place = _upto(key, order), F.row_number().over(Window.partitionBy(key).orderBy(*order))
    df = df.withColumn("__el_place", place)
    broken = {n: F.max(F.when(~c, F.col("__el_place"))).over(w) for n, c in conditions.items()}
    return df.withColumns({n: F.col("__el_place") - F.coalesce(b, F.lit(0)) for n, b in broken.items()}).drop("__el_place")


def latch(key: str, order: Sequence[str], on: Column, off: Column) -> Column:
    """True from a row that turns it on to one that turns it off; off at first."""
    return F.coalesce(F.last(F.when(on, True).when(off, False), ignorenulls=True).over(_upto(key, order)), F.lit(False))


def _alerts(df: DataFrame, key: str, row_id: str, found: dict[str, tuple[Column, Column]], *others: str) -> DataFrame:
    each = [F.when(c, F.struct(F.lit(n).alias("alert"), v.cast("double").alias("value"))) for n, (c, v) in found.items()]
    return df.select(key, row_id, *others, F.inline(F.array_compact(F.array(*each))))


def paused(df: DataFrame, key: str, row_id: str, pauses: dict[str, int]) -> DataFrame:
    """Of candidate alerts with their ``frame``: those at least so many frames after the last one kept of their kind.

    Kinds that ``pauses`` does not name stay.  A key and kind is one task's work.
    """
    named = F.col("alert").isin(*pauses)
    wait = F.element_at(F.create_map(*[F.lit(x) for p in pauses.items() for x in p]), F.col("alert"))
    ask = df.where(named).select(F.struct(key, "alert").alias("own"), row_id, "frame", wait.alias("wait"), "value")
    kept = K.fold(ask, "own", ["frame"], ["wait", "value"], "frame", row_id, K.spaced())
    return df.where(~named).select(key, row_id, "alert", "value").unionByName(kept.select(f"own.{key}", row_id, "own.alert", "value"))


def confined_space(df: DataFrame, key: str, order: Sequence[str], row_id: str, presence: str, breathing: str, motion: str, variance: str, settle: int = 10, breathless: int = 300, immobile: int = 1200, report: int = 100) -> DataFrame:
    """A worker's entry and exit after ``settle`` like rows; alerts once a spell without breath or motion inside."""
    w = Window.partitionBy(key).orderBy(*order)
    there = F.coalesce(F.col(presence), F.lit(False)) & above(variance, BODY_VARIANCE)
    s = runs(numbered(df, key, order), key, order, here=there, gone=~there)
    s = s.withColumn("inside", latch(key, order, F.col("here") >= settle, F.col("gone") >= settle))
    breathes = above(breathing, BREATH_FLOOR, True)
    s = s.withColumn("before", F.lag("inside", 1, False).over(w))
    s = runs(s, key, order, held=F.col("inside") & ~breathes, still=F.col("inside") & ~above(motion, STILL_MOTION))
    return _alerts(s, key, row_id, {
        "entry": (F.col("inside") & ~F.col("before"), F.lit(1)),
        "exit": (~F.col("inside") & F.col("before"), F.lit(1)),
        "breathing": (F.col("inside") & breathes & (F.col("frame") % report == 0), F.col(breathing)),
        "extraction": (F.col("held") == breathless, F.col("held") / RATE),
        "immobile": (F.col("still") == immobile, F.col("still") / RATE),
    })


def clean_room(df: DataFrame, key: str, order: Sequence[str], row_id: str, persons: str, presence: str, motion: str, most: int = 4, crowded: int = 10, turbulent: int = 3, report: int = 600, pauses: tuple[int, int] = (200, 100)) -> DataFrame:
    """Changes of the head count, too many persons, turbulent motion, and the share of occupied rows that comply."""
    w, upto = Window.partitionBy(key).orderBy(*order), _upto(key, order)
    s = numbered(df, key, order).withColumn("heads", F.least(F.greatest(F.coalesce(F.col(persons).cast("int"), F.lit(0)), F.lit(0)), F.lit(255)))
    wild = above(motion, TURBULENT) & F.coalesce(F.col(presence), F.lit(False))
    s = runs(s, key, order, crowd=F.col("heads") > most, wild=wild)
    occupied, fine = (F.sum(c.cast("long")).over(upto) for c in (F.col("heads") > 0, F.col("heads").between(1, most)))
    s = s.withColumns({"former": F.lag("heads", 1, 0).over(w), "share": F.coalesce(F.try_divide(fine, occupied), F.lit(1.0)) * 100})
    found = _alerts(s, key, row_id, {
        "count": (F.col("heads") != F.col("former"), F.col("heads")),
        "violation": (F.col("crowd") >= crowded, F.col("heads")),
        "turbulent": (F.col("wild") >= turbulent, F.col(motion)),
        "compliance": (F.col("frame") % report == 0, F.col("share")),
    }, "frame")
    return paused(found, key, row_id, dict(zip(("violation", "turbulent"), pauses, strict=True)))


def heart_rhythm(df: DataFrame, key: str, order: Sequence[str], row_id: str, heart: str, sustained: int = 10, window: int = 30, pause: int = 30, alpha: float = 0.1) -> DataFrame:
    """Sustained fast or slow hearts, a beat far below the running mean, and too small or large successive differences.

    Rows without a rate of at least 1 take time but are no reading.
    """
    s = numbered(df, key, order).where(above(heart, 1, True)).withColumn("rate", F.col(heart).cast("double"))
    s = K.fold(s, key, ["frame"], ["rate", "frame"], "frame", row_id, K.beside_mean(alpha))
    step = F.col("rate") - F.lag("rate").over(Window.partitionBy(key).orderBy("frame"))
    s = runs(s.withColumn("step", step), key, ["frame"], fast=F.col("rate") > HEART_HIGH, slow=F.col("rate") < HEART_LOW)
    last = Window.partitionBy(key).orderBy("frame").rowsBetween(1 - window, 0)
    full = F.count("step").over(last) == window
    s = s.withColumn("rmssd", F.when(full, F.sqrt(F.avg(F.col("step") * F.col("step")).over(last)) * RMSSD_SCALE))
    found = _alerts(s, key, row_id, {
        "tachycardia": (F.col("fast") >= sustained, F.col("rate")),
        "bradycardia": (F.col("slow") >= sustained, F.col("rate")),
        "missed_beat": ((F.col("mean") - F.col("rate")) / F.col("mean") > BEAT_DROP, F.col("rate")),
        "variability": ((F.col("rmssd") < RMSSD_RANGE[0]) | (F.col("rmssd") > RMSSD_RANGE[1]), F.col("rmssd")),
    }, "frame")
    return paused(found, key, row_id, dict.fromkeys(("tachycardia", "bradycardia", "missed_beat", "variability"), pause))


def vital_trend(df: DataFrame, key: str, order: Sequence[str], row_id: str, breathing: str, heart: str, lasting: int = 5, apnea: int = 20, window: int = 60) -> DataFrame:
    """One row a second: no breath for ``apnea`` rows, rates out of range for ``lasting`` rows, and means each ``window`` rows.

    Alerts repeat while they last.  Means are of the readings that are there.
    """
    b, h = (F.col(c).cast("double") for c in (breathing, heart))
    below = lambda c, limit: F.coalesce((c < limit) & ~F.isnan(c), F.lit(False))
    s = runs(numbered(df, key, order), key, order, breathless=below(b, APNEA_BELOW),
             slow_breath=above(b, 0) & below(b, BREATH_RANGE[0]), fast_breath=above(b, BREATH_RANGE[1]),
             slow_heart=above(h, 0) & below(h, TREND_HEART_RANGE[0]), fast_heart=above(h, TREND_HEART_RANGE[1]))
    last = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - window, 0)
    s = s.withColumns({"breath_mean": F.avg(F.nanvl(b, F.lit(None))).over(last), "heart_mean": F.avg(F.nanvl(h, F.lit(None))).over(last)})
    due = F.col("frame") % window == 0
    return _alerts(s, key, row_id, {
        "apnea": (F.col("breathless") >= apnea, F.col("breathless")),
        "bradypnea": (F.col("slow_breath") >= lasting, b), "tachypnea": (F.col("fast_breath") >= lasting, b),
        "bradycardia": (F.col("slow_heart") >= lasting, h), "tachycardia": (F.col("fast_heart") >= lasting, h),
        "breathing_mean": (due & F.col("breath_mean").isNotNull(), F.col("breath_mean")), "heart_mean": (due & F.col("heart_mean").isNotNull(), F.col("heart_mean")),
    })


def occupancy_schedule(df: DataFrame, key: str, ts: str, presence: str, persons: str) -> DataFrame:
    """By key, day of the week (Sunday 0) and hour: rows, share of occupied ones, mean head count of these, and whether the hour is used."""
    there = F.coalesce(F.col(presence), F.lit(False))
    heads = F.avg(F.when(there, F.greatest(F.col(persons), F.lit(0)).cast("double")))
    out = df.groupBy(key, (F.dayofweek(ts) - 1).alias("day"), F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg(there.cast("double")).alias("occupied"), F.coalesce(heads, F.lit(0.0)).alias("heads"))
    return out.withColumn("used", F.col("occupied") >= USED)


def after_hours(df: DataFrame, key: str, order: Sequence[str], row_id: str, ts: str, presence: str, long: int = 600) -> DataFrame:
    """Rows at which somebody has been there at night for ``long`` rows on end or more, with their hour."""
    hour = F.hour(ts)
    night = (hour >= NIGHT_FROM) | (hour < NIGHT_TO)
    s = runs(df, key, order, late=F.coalesce(F.col(presence) & night, F.lit(False)))
    return s.where(F.col("late") >= long).select(key, row_id, hour.alias("hour"))
