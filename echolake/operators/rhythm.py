"""Breathing and heart rates of frames: tones fused to one signal, band-passed, and its rhythm found.

Breathing counts sign changes in a window that is forgotten when its rate leaves
the band.  The heart rate is the lag of the largest autocorrelation: sums of
lagged products over sliding windows, many windows of a key at once in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolake.functions.arrays import let
from echolake.operators.folds import Kernel, State, resonator

# Fixed values of the extractors.
BREATH_BAND, HEART_BAND = (0.1, 0.5), (0.8, 2.0)
PLAUSIBLE_BPM = (40.0, 180.0)
LEAST_TONES = 4
#: Windows taken together.
WINDOWS = 2048


def coherent_signal(residuals: Column, phases: Column) -> Column:
    """Mean of the residuals, each weighted by how near its phase is to its neighbour's; a missing phase counts as near.

    Null or empty residuals give null.
    """

    def fused(r: Column, p: Column, n: Column) -> Column:
        near = lambda i: F.when(i + 1 < n, i + 1).otherwise(i - 1)
        weight = lambda i: F.coalesce(F.exp(-F.abs(F.get(p, near(i)) - F.get(p, i))), F.lit(1.0))
        total = lambda parts, f: F.aggregate(parts, F.lit(0.0), lambda s, p: s + p[f])
        parts = F.transform(F.transform(r, lambda x, i: F.struct(x.alias("x"), weight(i).alias("w"))), lambda q: F.struct((q["x"] * q["w"]).alias("x"), q["w"].alias("w")))
        return F.when(n == 1, r[0]).when(n > 1, let(parts, lambda parts: total(parts, "x") / total(parts, "w")))

    all_ = F.struct(residuals.alias("r"), phases.alias("p"), F.size(residuals).alias("n"))
    return let(all_, lambda a: fused(a["r"], a["p"], a["n"]))


def weighted_signal(residuals: Column, weights: Column) -> Column:
    """Mean of the residuals by weight; tones without a weight have an even share."""
    n = F.size(residuals)
    parts = F.transform(residuals, lambda r, i: F.struct((r * F.coalesce(F.get(weights, i), 1.0 / n)).alias("x"), F.coalesce(F.get(weights, i), 1.0 / n).alias("w")))
    total = lambda f: F.aggregate(parts, F.lit(0.0), lambda s, p: s + p[f])
    return F.when(n > 0, F.coalesce(total("x") / F.nullif(total("w"), F.lit(0.0)), F.lit(0.0)))


def status(confidence: Column, valid: float, degraded: float, enough: Column | None = None) -> Column:
    fine = confidence >= valid if enough is None else (confidence >= valid) & enough
    return F.when(fine, "valid").when(confidence >= degraded, "degraded").otherwise("unreliable")


def breathing(rate: float = 1.0, band: tuple[float, float] = BREATH_BAND, seconds: float = 30.0, least: float = 10.0) -> Kernel:
    """Value: the fused signal.  Breaths a minute and the confidence, from sign changes of the filtered window.

    A rate outside the band gives nothing and empties window and filter, so an
    old rhythm never mixes with a new one.
    """
    low, high = band
    filtered = resonator(low, high, rate)
    most, fewest = int(rate * seconds), int(rate * least)

    def step(s: State, v: tuple, t: float):
        held, (y,) = filtered.step(s[:4], v, t)
        ring = (*s[4], y)[-most:]
        if len(ring) < fewest:
            return (*held, ring), None
        hertz = sum(a * b < 0 for a, b in zip(ring[:-1], ring[1:], strict=True)) / (2 * len(ring) / rate)
        if not low <= hertz <= high:
            return (*filtered.start, ()), None
        mean = sum(ring) / len(ring)
        spread = math.sqrt(sum((a - mean) ** 2 for a in ring) / len(ring))
        confidence = 0.0 if spread < 1e-7 else min(max(map(abs, ring)) / spread / 5, 1.0)
        return (*held, ring), (hertz * 60, confidence)

    return Kernel((*filtered.start, ()), step, "bpm double, confidence double")


def strongest(values: np.ndarray, before: np.ndarray, rows: int, fewest: int, lags: range) -> tuple[np.ndarray, np.ndarray]:
    """For each value the largest autocorrelation of the last ``rows`` values and its lag; NaN where there is none.

    ``before`` holds the values before the first one, ``rows`` - 1 at most.
    """
    held = np.concatenate([np.zeros(rows - 1 - len(before)), before, values])
    there = np.concatenate([np.zeros(rows - 1 - len(before)), np.ones(len(before) + len(values))])
    acf, lag = np.full(len(values), np.nan), np.zeros(len(values), np.int32)
    for k in range(0, len(values), WINDOWS):
        w, known = (np.lib.stride_tricks.sliding_window_view(x[k : min(k + WINDOWS, len(values)) + rows - 1], rows) for x in (held, there))
        n = known.sum(axis=1)
        mean = w.sum(axis=1) / n
        base = np.einsum("ij,ij->i", w, w) - n * mean * mean
        ready = (n >= fewest) & (base >= 1e-15) & (n // 2 > lags[0])
        c = (w - mean[:, None]) * known
        sums = np.stack([np.einsum("ij,ij->i", c[:, : max(0, rows - q)], c[:, q:]) for q in lags], axis=1)
        sums = np.where(np.array(lags) <= (n // 2)[:, None], sums / np.where(ready, base, 1.0)[:, None], -np.inf)
        best = sums.argmax(axis=1)  # the first of equals: the shorter lag
        acf[k : k + len(w)] = np.where(ready, sums[np.arange(len(w)), best], np.nan)
        lag[k : k + len(w)] = np.array(lags)[best]
    return acf, lag


def heart_rate(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, tones: str, rate: float, seconds: float = 15.0, least: float = 5.0, band: tuple[float, float] = HEART_BAND) -> DataFrame:
    """``df`` with ``bpm``, ``confidence`` and ``status`` from the autocorrelation of the last ``seconds`` of the filtered signal ``x``.

    Rows with ``least`` seconds behind them whose largest autocorrelation in the
    band is positive and whose rate is plausible; ties go to the shorter lag.
    Rows with a null signal are left out.  A row's lags reach back half the
    window at most.  Ordered rows of a key stream through one task, which holds
    one window of it.
    """
    rows, fewest = int(rate * seconds), int(rate * least)
    lags = range(math.floor(rate / band[1]), math.ceil(rate / band[0]) + 1)
    given = df.where(F.col(x).isNotNull())
    schema = given.select(*[F.col(f"`{c}`") for c in df.columns], F.lit(0.0).alias("__el_acf"), F.lit(0).alias("__el_lag")).schema
    names = [*df.columns, "__el_acf", "__el_lag"]
    at, places = names.index(x), [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, before = object(), np.zeros(0)  # the values that the next rows' windows reach back to
        for b in batches:
            own = list(zip(*[b.column(k).to_pylist() for k in places], strict=True)) or [()] * b.num_rows
            values = b.column(at).cast(pa.float64()).to_numpy(zero_copy_only=False)
            starts = [k for k in range(b.num_rows) if k == 0 or own[k] != own[k - 1]]
            acf, lag = np.full(b.num_rows, np.nan), np.zeros(b.num_rows, np.int32)
            for begin, end in zip(starts, [*starts[1:], b.num_rows], strict=True):
                if own[begin] != key:
                    key, before = own[begin], np.zeros(0)
                acf[begin:end], lag[begin:end] = strongest(values[begin:end], before, rows, fewest, lags)
                before = np.concatenate([before, values[begin:end]])[1 - rows :] if rows > 1 else before
            found = np.flatnonzero(acf > 0)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(found)) for c in b.columns], pa.array(acf[found]), pa.array(lag[found])], names=names)

    best = given.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
    strength, bpm = F.col("__el_acf"), 60.0 * rate / F.nullif(F.col("__el_lag"), F.lit(0))
    confidence = F.least(F.greatest(strength * F.least(F.col(tones) / LEAST_TONES, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    found = best.where(bpm.between(*PLAUSIBLE_BPM)).withColumn("bpm", bpm).withColumn("confidence", confidence)
    return found.withColumn("status", status(F.col("confidence"), 0.6, 0.3, F.col(tones) >= LEAST_TONES)).select(*df.columns, "bpm", "confidence", "status")
