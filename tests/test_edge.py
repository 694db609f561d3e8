"""Edge detectors on planted and awkward rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from echolake.operators import edge as E
from echolake.operators import folds as K

BIG = 9_007_199_254_740_993  # no double holds it


@pytest.fixture(scope="module")
def room(spark):
    def make(rows: list[tuple]):
        cells = [(BIG, k, *r) for k, r in enumerate(rows)]
        return spark.createDataFrame(cells, "k long, i long, there boolean, breath double, motion double, var double, n int, heart double")

    return make


def alerts(df):
    return sorted((r["i"], r["alert"], round(r["value"], 6)) for r in df.collect())


def test_confined_space(room):
    here, gone = (True, 12.0, 0.5, 1.0, 1, 70.0), (False, 12.0, 0.5, 1.0, 0, 70.0)
    breathless = (True, None, float("nan"), 1.0, 1, 70.0)
    s = room([here] * 3 + [breathless] * 4 + [here] + [breathless] * 3 + [gone] * 3)
    got = E.confined_space(s, "k", ["i"], "i", "there", "breath", "motion", "var", settle=2, breathless=3, immobile=3, report=100)
    assert alerts(got) == [(1, "entry", 1), (5, "extraction", 0.15), (5, "immobile", 0.15), (10, "extraction", 0.15), (10, "immobile", 0.15), (12, "exit", 1)]
    assert {r["k"] for r in got.collect()} == {BIG}
    assert E.confined_space(s.limit(0), "k", ["i"], "i", "there", "breath", "motion", "var").count() == 0


def test_clean_room_pauses(room):
    s = room([(True, 12.0, 0.9, 1.0, 6, 70.0)] * 9 + [(None, 12.0, 0.9, 1.0, None, 70.0)] * 2)
    got = E.clean_room(s, "k", ["i"], "i", "n", "there", "motion", crowded=2, turbulent=3, report=10, pauses=(4, 5))
    assert alerts(got) == [(0, "count", 6), (1, "violation", 6), (2, "turbulent", 0.9), (5, "violation", 6), (7, "turbulent", 0.9), (9, "compliance", 0), (9, "count", 0)]


def test_heart_rhythm_skips_missing_rates(room):
    rates = [70.0, 120.0, None, 120.0, float("nan"), 120.0, 0.0, 30.0, 30.0, 30.0]
    got = alerts(E.heart_rhythm(room([(True, 12.0, 0.5, 1.0, 1, h) for h in rates]), "k", ["i"], "i", "heart", sustained=3, window=4, pause=30))
    mean, want, steps, last, fast, slow = None, [], [], None, 0, 0
    for i, h in enumerate(rates):
        if h is None or not h >= 1:
            continue
        mean = h if mean is None else mean + 0.1 * (h - mean)
        steps += [] if last is None else [h - last]
        last, fast, slow = h, fast + 1 if h > 100 else 0, slow + 1 if h < 50 else 0
        want += [(i, "tachycardia", h)] * (fast >= 3) + [(i, "bradycardia", h)] * (slow >= 3) + [(i, "missed_beat", h)] * ((mean - h) / mean > 0.3)
        if len(steps) >= 4:
            rmssd = (sum(d * d for d in steps[-4:]) / 4) ** 0.5 * 17
            want += [(i, "variability", round(rmssd, 6))] * (not 10 <= rmssd <= 120)
    first = {}
    for w in want:
        first.setdefault(w[1], w)  # the pause is longer than the series
    assert got == sorted(first.values()) and len(got) == 4


def test_vital_trend(room):
    rows = [(True, 0.5, 0.5, 1.0, 1, 130.0)] * 3 + [(True, None, 0.5, 1.0, 1, float("nan"))] + [(True, 30.0, 0.5, 1.0, 1, 40.0)] * 2
    got = alerts(E.vital_trend(room(rows), "k", ["i"], "i", "breath", "heart", lasting=2, apnea=3, window=6))
    assert got == [(1, "bradypnea", 0.5), (1, "tachycardia", 130), (2, "apnea", 3), (2, "bradypnea", 0.5), (2, "tachycardia", 130), (5, "bradycardia", 40), (5, "breathing_mean", 12.3), (5, "heart_mean", 94), (5, "tachypnea", 30)]


def test_loitering_and_zone_ignore_missing_rows(room):
    there, away = (True, 12.0, 0.1, 1.0, 1, 70.0), (False, 12.0, 0.1, 1.0, 1, 70.0)
    s = room([there] * 6 + [(None, 12.0, 0.1, 1.0, 1, 70.0)] + [there, away, away, there])
    got = K.fold(s, "k", ["i"], ["there", "motion"], "i", "i", K.loitering(confirm=2, dwell=3, leave=2, report=2, pause=2)).orderBy("i").collect()
    assert [(r["i"], r["alert"], r["seconds"]) for r in got] == [(4, "start", 0.15), (7, "ongoing", 0.25), (9, "end", 0.25)]
    zone = K.fold(s.withColumn("score", F.col("there").cast("double")), "k", ["i"], ["score", "motion"], "i", "i", K.occupied_zone(arrive=3, leave=3, every=3)).orderBy("i").collect()
    assert [(r["i"], r["occupied"]) for r in zone] == [(2, True), (5, True), (9, True)]
    assert zone[2]["countdown"] == pytest.approx(1 / 3)
