"""Spectra against numpy, datagrams by round trip, array functions on awkward arrays."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolake.functions import arrays as A
from echolake.functions import spectral as P
from echolake.sources import datagrams as D


def one(spark, values, f):
    return spark.createDataFrame([(values,)], "v array<double>").select(f(F.col("v"))).first()[0]


def test_planted_tone_has_its_peak(spark):
    x = [math.sin(2 * math.pi * 5 * k / 64) for k in range(64)]
    got = one(spark, x, lambda v: P.psd_summary(v, 64, 64.0))
    assert got["peak_frequency"] == 5 and got["centroid"] == pytest.approx(5) and got["total_power"] == pytest.approx((np.abs(np.fft.fft(x)) ** 2 / 64)[:32].sum())
    assert one(spark, x, lambda v: P.band_power(v, 64.0, 4, 6)) == pytest.approx(1)
    assert np.allclose(one(spark, x, lambda v: P.stft(v, 16, 8)), [np.abs(np.fft.rfft(np.array(x[k : k + 16]) * np.hanning(16))) for k in range(0, 49, 8)])


@pytest.mark.parametrize("values", [None, []])
def test_spectra_of_nothing(spark, values):
    assert one(spark, values, lambda v: P.psd_summary(v, 8, 8.0))["total_power"] == 0
    assert one(spark, values, lambda v: P.band_power(v, 8.0, 1, 2)) is None


def test_unwrap_and_detrend(spark):
    line = [0.9 * k for k in range(30)]
    wrapped = [(x + math.pi) % (2 * math.pi) - math.pi for x in line]
    assert one(spark, wrapped, A.unwrap_phase) == pytest.approx(np.unwrap(wrapped).tolist())
    assert one(spark, wrapped, A.sanitize_phase) == pytest.approx([0] * 30, abs=1e-9)


@pytest.mark.parametrize("f", [A.normalize_min_max, A.normalize_zscore, A.unwrap_phase, A.detrend])
def test_edges(spark, f):
    assert one(spark, [], f) == [] and one(spark, None, f) is None
    assert one(spark, [4.0], f) in ([0.0], [4.0])


def test_datagrams(spark):
    iq = np.arange(-8, 8, dtype=np.int8)
    frame = D.FRAME_HEADER.pack(D.FRAME_MAGIC, 7, 2, 4, 5180, 99, -40, -90, 1, 5) + iq.tobytes()
    vitals = struct.pack("<IBBHIbB2xffI", D.VITALS_MAGIC, 3, 5, 1650, 720_000, -33, 2, 0.5, 0.75, 123456).ljust(32, b"\0")
    bad = [frame[:-1], frame[:10], b"\0" * 40, None, vitals, b""]
    rows = spark.createDataFrame([(bytearray(x) if x is not None else None,) for x in (frame, *bad)], "content binary")
    got = D.frames_of(rows).collect()
    assert (got[0]["node_id"], got[0]["sequence"], got[0]["rssi"], got[0]["freq_mhz"], got[0]["error"]) == (7, 99, -40, 5180, None)
    pairs = iq.astype(float).reshape(8, 2)
    assert got[0]["amplitude"] == pytest.approx(np.hypot(*pairs.T).tolist()) and got[0]["phase"] == pytest.approx(np.arctan2(pairs[:, 1], pairs[:, 0]).tolist())
    assert [r["error"] is not None for r in got[1:]] == [True] * 6
    v = D.vitals_of(spark.createDataFrame([(bytearray(vitals),), (bytearray(frame),)], "content binary")).collect()
    assert (v[0]["presence"], v[0]["fall_detected"], v[0]["motion"], v[0]["breathing_rate_bpm"], v[0]["heartrate_bpm"], v[0]["timestamp_ms"]) == (True, False, True, 16.5, 72.0, 123456)
    assert v[1]["error"] == "wrong magic"


@pytest.mark.parametrize("f", [A.normalize_zscore, A.sanitize_phase, A.hamming, lambda v: A.preprocess(v, 20), lambda v: F.array(A.coherence(A.normalize_zscore(v)))], ids=["zscore", "sanitize", "hamming", "preprocess", "coherence"])
def test_long_frames_cost_no_more_an_element(spark, f):
    from time import perf_counter

    df = spark.createDataFrame([([math.sin(k * 0.7) * 3 for k in range(n)],) for n in (1, 2, 1500)], "v array<double>")
    one(spark, [1.0, 2.0], f)
    began = perf_counter()
    assert [r[0] for r in df.select(F.size(f(F.col("v")))).collect()][0] == 1
    assert perf_counter() - began < 10  # minutes while sums were taken anew for every element
