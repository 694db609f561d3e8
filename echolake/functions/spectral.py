"""Spectra of array columns: numpy in Arrow batches, row by row, so no shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def power_spectrum(x: np.ndarray, size: int) -> np.ndarray:
    """|FFT|^2 / size of the values cut or padded with zeros to ``size``."""
    return np.abs(np.fft.fft(np.asarray(x, float)[:size], size)) ** 2 / size


def psd_summary(v: Column, size: int, bandwidth: float) -> Column:
    """Struct (total_power, peak_power, peak_frequency, centroid, spread) of the positive half."""

    @F.pandas_udf("total_power double, peak_power double, peak_frequency double, centroid double, spread double")
    def run(frames: pd.Series) -> pd.DataFrame:
        frequency = np.arange(size // 2) * bandwidth / size
        p = np.array([power_spectrum(x if x is not None else [], size)[: size // 2] for x in frames]).reshape(len(frames), size // 2)
        power = p.sum(axis=1)
        safe = np.where(power > 1e-10, power, 1.0)
        centroid = np.where(power > 1e-10, p @ frequency / safe, 0.0)
        spread = np.sqrt(np.where(power > 1e-10, (p * (frequency - centroid[:, None]) ** 2).sum(axis=1) / safe, 0.0))
        peak = p.shape[1] - 1 - np.argmax(p[:, ::-1], axis=1) if len(p) else np.zeros(0, int)  # the last of equals
        return pd.DataFrame({"total_power": power, "peak_power": p.max(axis=1, initial=0.0), "peak_frequency": frequency[peak], "centroid": centroid, "spread": spread})

    return run(v)


def stft(v: Column, width: int, hop: int) -> Column:
    """Magnitudes of a short-time Fourier transform with a Hann window: an array of frames."""

    @F.pandas_udf("array<array<double>>")
    def run(frames: pd.Series) -> pd.Series:
        window = np.hanning(width)
        return pd.Series([[np.abs(np.fft.rfft(np.asarray(x[k : k + width], float) * window)).tolist() for k in range(0, len(x) - width + 1, hop)] if x is not None else None for x in frames])

    return run(v)


def band_power(v: Column, rate: float, low: float, high: float) -> Column:
    """Share of a signal's power, without its mean, at frequencies from ``low`` to ``high``."""

    @F.pandas_udf("double")
    def run(frames: pd.Series) -> pd.Series:
        def share(x) -> float | None:
            if x is None or len(x) < 2:
                return None
            p = np.abs(np.fft.rfft(np.asarray(x, float) - np.mean(x))) ** 2
            f = np.fft.rfftfreq(len(x), 1 / rate)
            whole = p[1:].sum()
            return float(p[(f >= low) & (f <= high)].sum() / whole) if whole > 0 else 0.0

        return pd.Series([share(x) for x in frames], dtype="float64")

    return run(v)
