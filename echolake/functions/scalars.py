"""Scalar formulas of radio sensing as column expressions; null inputs give null unless stated."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPEED_OF_LIGHT = 299_792_458.0

# Fixed values of the rules.
MOTION_LEVELS = ((0.05, "none"), (0.20, "minimal"), (0.60, "moderate"))
GATE_ACTIONS = ((0.5, "accept"), (0.7, "predict_only"), (0.9, "reject"))
PERSON_WEIGHTS = ((300.0, 0.40), (30.0, 0.20), (250.0, 0.25), (500.0, 0.15))
#: material: attenuation in decibels a metre, uncertainty in metres
MATERIALS = {
    "snow": (0.5, 0.1), "wood": (1.5, 0.15), "light_concrete": (3.0, 0.2), "soil": (4.0, 0.3),
    "mixed": (4.5, 0.4), "heavy_concrete": (6.0, 0.2), "metal": (20.0, 0.5),
}
MOISTURE = {"dry": 1.0, "damp": 1.3, "wet": 1.8, "saturated": 2.5}
MAX_DEPTH, LEAST_ATTENUATION, LOSS_AT_1M = 10.0, 3.0, 47.0
CELL_X, CELL_Z = 0.6, 0.5


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def distance(p: Sequence[Column], q: Sequence[Column]) -> Column:
    """Euclidean distance in as many dimensions as there are columns."""
    total = F.lit(0.0)
    for a, b in zip(p, q, strict=True):
        total = total + (a - b) * (a - b)
    return F.sqrt(total)


def snr_db(signal: Column, noise: Column, least: float = 1e-10) -> Column:
    """Decibels between the mean powers of two arrays; infinite over no noise or a power below ``least``."""
    power = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / F.size(v)
    p = power(noise)
    return F.when((p == 0) | (p < least), F.lit(float("inf"))).otherwise(10 * F.log10(power(signal) / F.nullif(p, F.lit(0.0))))


def pseudo_phase(channel: Column) -> Column:
    return channel / 48 * F.pi()


def ladder(score: Column, steps: Sequence[tuple[float, str]], top: str) -> Column:
    """The first step whose upper edge the score is below; ``top`` from the last edge on."""
    out = F.lit(top)
    for edge, name in reversed(steps):
        out = F.when(score < edge, name).otherwise(out)
    return out


def motion_level(score: Column) -> Column:
    return ladder(score, MOTION_LEVELS, "high")


def unit(v: Column) -> Column:
    """From 0 to 1; NaN is 0."""
    return F.when(F.isnan(v), 0.0).otherwise(clamp(v, 0.0, 1.0))


def identity_risk(separability: Column, stability: Column, consistency: Column, confidence: Column) -> Column:
    return unit(unit(separability) * unit(stability) * unit(consistency) * unit(confidence))


def gate_action(score: Column) -> Column:
    """Edges belong to the upper step; NaN is accepted."""
    return F.when(F.isnan(score), "accept").otherwise(ladder(score, GATE_ACTIONS, "recalibrate"))


def person_score(variance: Column, change_points: Column, motion_power: Column, spectral_power: Column) -> Column:
    out = F.lit(0.0)
    for v, (scale, weight) in zip((variance, change_points, motion_power, spectral_power), PERSON_WEIGHTS, strict=True):
        out = out + clamp(v / scale, 0.0, 1.0) * weight
    return out


def noise_multiplier(coherence: Column, accept: float, reject: float, most: float) -> Column:
    """1 from ``accept`` on, ``most`` up to ``reject``, a line between."""
    line = 1 + (accept - coherence) / max(accept - reject, 1e-6) * (most - 1)
    return F.when(coherence >= accept, 1.0).when(coherence <= reject, most).otherwise(line)


def motion_score(power: Column) -> Column:
    return clamp(power, 0.0, 100.0)


def cell_to_world(ix: Column, iz: Column, nx: int, nz: int) -> tuple[Column, Column]:
    return (ix - nx / 2) * CELL_X, (iz - nz / 2) * CELL_Z


def fresnel_radius(n: int, wavelength: float, d1: Column, d2: Column) -> Column:
    return F.sqrt(F.lit(float(n)) * wavelength * d1 * d2 / (d1 + d2))


def phase_change(displacement: Column, wavelength: float) -> Column:
    return displacement * (4 * math.pi / wavelength)


def amplitude_variation(displacement: Column, wavelength: float) -> Column:
    return F.abs(F.sin(phase_change(displacement, wavelength) / 2))


def breathing_confidence(observed: Column, wavelength: float, least: float, most: float) -> Column:
    """1 inside the variation that displacements from ``least`` to ``most`` can make, less outside."""
    a, b = (abs(math.sin(2 * math.pi * d / wavelength)) for d in (least, most))
    low, high = min(a, b), max(a, b)
    return F.when(observed.between(low, high), 1.0).when(observed < low, clamp(observed / low, 0.0, 1.0)).otherwise(clamp(F.lit(high) / observed, 0.0, 1.0))


def rssi_to_distance(rssi: Column, reference: float, exponent: float, at: float = 1.0) -> Column:
    """Log-distance path loss, solved for the distance."""
    return F.lit(at) * F.pow(F.lit(10.0), (reference - rssi) / (10 * exponent))


def time_of_flight_distance(nanoseconds: Column) -> Column:
    """Half of a round trip."""
    return nanoseconds * (1e-9 * SPEED_OF_LIGHT / 2)


def free_space_loss(metres: Column) -> Column:
    return F.when(metres <= 0, 0.0).otherwise(20 * F.log10(metres) + LOSS_AT_1M)


def attenuation_factor(coefficient: Column, moisture: Column, voids: Column) -> Column:
    return coefficient * moisture * (1 - voids * 0.3)


def depth_estimate(attenuation: Column, metres: Column, per_metre: Column, spread: Column) -> Column:
    """Struct (depth, uncertainty, confidence); null where the debris lets all through or the depth is out of range."""
    depth = F.greatest(attenuation - free_space_loss(metres), F.lit(0.0)) / F.nullif(per_metre, F.lit(0.0))
    made = lambda d, u, c: F.struct(d.alias("depth"), u.alias("uncertainty"), c.alias("confidence"))
    buried = F.when((per_metre >= 0.1) & (depth <= MAX_DEPTH), made(depth, 0.3 + depth * 0.15 + spread, F.greatest(1 - depth / MAX_DEPTH, F.lit(0.3))))
    return F.when(attenuation < LEAST_ATTENUATION, made(F.lit(0.0), F.lit(0.5), F.lit(0.9))).otherwise(buried)


def combined_error(a: Column, b: Column) -> Column:
    """Inverse-variance combination of two errors."""
    return F.sqrt(1 / (1 / (a * a) + 1 / (b * b)))


def combined_confidence(a: Column, b: Column) -> Column:
    return F.least((a * a + b * b) / (a + b), F.lit(0.99))


def range_resolution(bandwidth: Column) -> Column:
    return F.lit(SPEED_OF_LIGHT) / (2 * bandwidth)


def cross_range_resolution(frequency: Column, aperture: Column, metres: Column) -> Column:
    return F.lit(SPEED_OF_LIGHT) / frequency * metres / (2 * aperture)


def coherent_pose_error(frequency: Column) -> Column:
    """An eighth of a wavelength."""
    return F.lit(SPEED_OF_LIGHT) / frequency / 8


def aged_uncertainty(age_seconds: Column, growth: Column) -> Column:
    return F.least(F.greatest(age_seconds, F.lit(0.0)) * growth, F.lit(1.0))


def refresh_priority(uncertainty: Column, change_rate: Column, criticality: Column, cost: Column) -> Column:
    return uncertainty * change_rate * criticality / F.greatest(cost, F.lit(1e-9))


def mahalanobis_sq(point: Sequence[Column], centre: Sequence[float], inverse: Sequence[Sequence[float]]) -> Column:
    d = [p - F.lit(float(c)) for p, c in zip(point, centre, strict=True)]
    total = F.lit(0.0)
    for i, row in enumerate(inverse):
        for j, v in enumerate(row):
            total = total + d[i] * F.lit(float(v)) * d[j]
    return total


def density(mahalanobis: Column) -> Column:
    return F.exp(mahalanobis * -0.5)


def polygon_area(vertices: Sequence[tuple[float, float]]) -> float:
    """Shoelace formula; fewer than three corners have no area."""
    if len(vertices) < 3:
        return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(vertices, [*vertices[1:], vertices[0]], strict=True))) / 2


def in_polygon(x: Column, y: Column, vertices: Sequence[tuple[float, float]]) -> Column:
    """By the number of edges that a ray to the right passes."""
    crossed = F.lit(0)
    for (xi, yi), (xj, yj) in zip(vertices, [vertices[-1], *vertices[:-1]], strict=True):
        if yi != yj:
            passes = (F.lit(yi) > y) != (F.lit(yj) > y)
            crossed = crossed + (passes & (x < (xj - xi) * (y - yi) / (yj - yi) + xi)).cast("int")
    return (crossed % 2 == 1) if len(vertices) > 2 else F.lit(False)


def in_rectangle(x: Column, y: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    return x.between(x1, x2) & y.between(y1, y2)


def in_circle(x: Column, y: Column, cx: float, cy: float, radius: float) -> Column:
    return distance((x, y), (F.lit(cx), F.lit(cy))) <= radius
