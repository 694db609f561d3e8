"""Per-frame array mathematics as column expressions; null arrays give null."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row; named in a lambda as it is, it would be computed once an element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return total(v) / F.nullif(F.size(v), F.lit(0))


def deviation(v: Column) -> Column:
    """Population deviation in one pass; exactly 0 where all are equal."""

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        now = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), now.alias("mean"), (s["sq"] + (x - now) * (x - s["mean"])).alias("sq"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sq"))
    return F.aggregate(v, start, step, lambda s: F.sqrt(s["sq"] / F.nullif(s["n"], F.lit(0.0))))


def normalize_min_max(v: Column) -> Column:
    """(x - least) / (most - least); zeros where all are equal."""
    ends = F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi"))
    return let(ends, lambda e: F.transform(v, lambda x: F.when(e["hi"] > e["lo"], (x - e["lo"]) / F.nullif(e["hi"] - e["lo"], F.lit(0.0))).otherwise(0.0)))


def normalize_zscore(v: Column) -> Column:
    """Distance from the mean in population deviations; zeros where all are equal."""
    moments = F.struct(mean(v).alias("m"), deviation(v).alias("sd"))
    return let(moments, lambda s: F.transform(v, lambda x: F.when(s["sd"] > 0, (x - s["m"]) / F.nullif(s["sd"], F.lit(0.0))).otherwise(0.0)))


def remove_noise(v: Column, threshold_db: float) -> Column:
    """Amplitudes at or below the threshold in decibels become 0."""
    return F.transform(v, lambda x: F.when(20 * F.log10(x + 1e-12) <= threshold_db, 0.0).otherwise(x))


def unwrap_phase(v: Column) -> Column:
    """Phases without jumps of more than half a turn between neighbours."""
    start = F.struct(F.get(v, F.lit(0)).alias("raw"), F.lit(0.0).alias("shift"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        d = x - s["raw"]
        shift = s["shift"] + F.when(d > math.pi, -TAU).when(d < -math.pi, TAU).otherwise(0.0)
        return F.struct(x.alias("raw"), shift.alias("shift"), F.array_append(s["out"], x + shift).alias("out"))

    return F.aggregate(v, start, step, lambda s: s["out"])


def detrend(v: Column) -> Column:
    """What is left of the least-squares line over the positions."""

    def about(v: Column, s: Column) -> Column:
        n, centre, m = s["n"], (s["n"] - 1) / 2, s["m"]
        moment = total(F.transform(v, lambda x, i: (i - centre) * (x - m)))
        slope = F.coalesce(moment / F.nullif(n * (n * n - 1) / 12, F.lit(0.0)), F.lit(0.0))
        return let(slope, lambda slope: F.transform(v, lambda x, i: x - m - slope * (i - centre)))

    return let(v, lambda v: let(F.struct(F.size(v).cast("double").alias("n"), mean(v).alias("m")), lambda s: about(v, s)))


def sanitize_phase(v: Column) -> Column:
    return detrend(unwrap_phase(v))


def resample(v: Column, tones: int) -> Column:
    """Linear interpolation to so many tones, ends on ends; one tone is repeated."""
    n = F.size(v)

    def at(j: Column) -> Column:
        place = j * (n - 1) / F.lit(max(1, tones - 1)).cast("double")
        low = F.floor(place).cast("int")
        w = place - low
        return F.get(v, low) * (1 - w) + F.get(v, F.least(low + 1, n - 1)) * w

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(tones - 1)), at))


def coherence(z: Column) -> Column:
    """Mean of exp(-z^2 / 2) over standardised deviations."""
    return let(F.transform(z, lambda x: F.exp(-x * x / 2)), mean)


def rssi_to_amplitude(dbm: Column) -> Column:
    return F.pow(F.lit(10.0), (dbm + 100) / 20)


def percent_to_dbm(percent: Column) -> Column:
    return percent / 2 - 100


def band(channel: Column) -> Column:
    """The band of a channel number; null for one in none."""
    return F.when(channel.between(1, 14), "2.4GHz").when(channel.between(36, 177), "5GHz").when(channel > 177, "6GHz")


def to_complex(amplitude: Column, phase: Column) -> Column:
    """Array of (re, im)."""
    return F.zip_with(amplitude, phase, lambda a, p: F.struct((a * F.cos(p)).alias("re"), (a * F.sin(p)).alias("im")))


def from_complex(z: Column) -> Column:
    """Array of (amplitude, phase)."""
    return F.transform(z, lambda c: F.struct(F.hypot(c["re"], c["im"]).alias("amplitude"), F.atan2(c["im"], c["re"]).alias("phase")))


def conjugate_product(a: Column, b: Column) -> Column:
    """a times the conjugate of b, tone by tone."""
    re = lambda x, y: x["re"] * y["re"] + x["im"] * y["im"]
    im = lambda x, y: x["im"] * y["re"] - x["re"] * y["im"]
    return F.zip_with(a, b, lambda x, y: F.struct(re(x, y).alias("re"), im(x, y).alias("im")))


def hamming(v: Column) -> Column:
    """The array under a Hamming window; one tone stays as it is."""
    return let(F.size(v), lambda n: F.transform(v, lambda x, i: F.when(n > 1, x * (0.54 - 0.46 * F.cos(F.lit(TAU) * i / F.nullif(n - 1, F.lit(0))))).otherwise(x)))


def scale_by_deviation(v: Column) -> Column:
    """Divided by the population deviation."""
    return let(v, lambda v: let(deviation(v), lambda sd: F.transform(v, lambda x: x / (sd + 1e-12))))


def preprocess(v: Column, threshold_db: float) -> Column:
    """Noise removal, window, scaling."""
    return scale_by_deviation(hamming(remove_noise(v, threshold_db)))


def hardware(v: Column) -> Column:
    n = F.size(v)
    return F.when(n == 64, "esp32").when(n == 30, "intel5300").when(n == 56, "atheros").otherwise("generic")


def resample_cubic(v: Column, tones: int) -> Column:
    """Catmull-Rom interpolation to so many tones; ends are repeated."""
    n = F.size(v)

    def at(j: Column) -> Column:
        place = j * (n - 1) / F.lit(max(1, tones - 1)).cast("double")
        low = F.floor(place).cast("int")
        t = place - low
        p = [F.get(v, F.greatest(F.least(low + k, n - 1), F.lit(0))) for k in (-1, 0, 1, 2)]
        a = -0.5 * p[0] + 1.5 * p[1] - 1.5 * p[2] + 0.5 * p[3]
        b = p[0] - 2.5 * p[1] + 2.0 * p[2] - 0.5 * p[3]
        c = -0.5 * p[0] + 0.5 * p[2]
        return ((a * t + b) * t + c) * t + p[1]

    return F.when(n == tones, v).when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(tones - 1)), at))


def reference_z(v: Column, reference: Column, variance: Column) -> Column:
    """Distances from a reference profile in its deviations, tone by tone."""
    apart = F.zip_with(v, reference, lambda x, r: F.abs(x - r))
    return F.zip_with(apart, variance, lambda d, s: d / F.sqrt(F.greatest(s, F.lit(1e-6))))


def outlier_tones(z: Column, threshold: float) -> Column:
    """Positions whose z is above the threshold."""
    return F.filter(F.transform(z, lambda x, i: F.when(x > threshold, i)), lambda i: i.isNotNull())


def weighted_coherence(z: Column, variance: Column) -> Column:
    """Mean of exp(-z^2 / 2), weighted by the inverse variance."""
    weights = F.transform(variance, lambda s: 1 / (F.greatest(s, F.lit(1e-6))))
    return total(F.zip_with(z, weights, lambda x, w: F.exp(-x * x / 2) * w)) / F.nullif(total(weights), F.lit(0.0))
