"""Warping against the whole matrix, bounds that hold, rhythms that were planted, rotated sketches against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolake.operators import folds as K
from echolake.operators import rhythm as H
from echolake.operators import sketches as S
from echolake.operators import vectors as V
from echolake.operators import warping as D


def whole(a: np.ndarray, b: np.ndarray, band: int) -> float:
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0.0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if abs(i - j) <= band:
                d[i, j] = np.linalg.norm(a[i - 1] - b[j - 1]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d[-1, -1]


@pytest.mark.parametrize("n,m,band", [(10, 10, 5), (12, 9, 3), (12, 9, 2), (1, 1, 0), (8, 8, 0), (5, 0, 5)])
def test_banded_equals_whole_matrix_and_bounds_hold(n, m, band):
    rng = np.random.default_rng(n + m)
    a, b = rng.normal(size=(7, n, 2)), rng.normal(size=(m, 2))
    got = D.banded(a, np.broadcast_to(b, (7, m, 2)), band)
    want = [whole(x, b, band) if m else np.inf for x in a]
    assert np.allclose(got, want)
    if m:
        assert (D.lower_bounds(a, b, band) <= np.array(want) + 1e-9).all()


def test_pruning_loses_nothing_and_saves_pairs():
    rng = np.random.default_rng(8)
    templates = [np.cumsum(rng.normal(size=(15, 1)), axis=0) + 6 * k for k in range(9)]
    windows = np.stack([templates[k % 9] + rng.normal(0, 0.3, (15, 1)) for k in range(40)])
    which, first, second, warped = D.two_best(windows, templates, 5)
    for k, w in enumerate(windows):
        d = [whole(w, t, 5) for t in templates]
        order = np.argsort(d, kind="stable")
        assert which[k] == order[0] and np.isclose(first[k], d[order[0]]) and np.isclose(second[k], d[order[1]])
    assert warped.sum() < 0.6 * 40 * 9


def test_gestures_and_awkward_windows(spark):
    up = [[float(k)] for k in range(10)]
    rows = [(1, up), (2, [[9.0 - k] for k in range(10)]), (3, None), (4, up[:5]), (5, [[1.0, 2.0]] + up[1:]), (6, [[None]] + up[1:]), (7, [[1e6]] * 10), (8, [[0.0], *up])]
    t = spark.createDataFrame([("up", up), ("zz up", up), ("flat", [[0.0]] * 10), ("short", up[:3])], "name string, sequence array<array<double>>")
    got = {r["k"]: r for r in D.classify(spark.createDataFrame(rows, "k long, s array<array<double>>"), ["k"], "s", t).collect()}
    assert set(got) == {1, 2, 7, 8}
    assert (got[1]["template"], got[1]["distance"], got[1]["confidence"]) == ("up", 0.0, 1.0)
    assert not got[7]["recognized"] and got[7]["template"] is None and got[7]["confidence"] == 0.0
    assert got[8]["template"] == "up" and got[8]["distance"] == 0.0  # one more row is warped away
    assert D.classify(spark.createDataFrame(rows, "k long, s array<array<double>>"), ["k"], "s", t.limit(0)).where("recognized").count() == 0


@pytest.mark.parametrize("hertz", [1.0, 1.25, 5 / 3])
def test_planted_heart_rate(spark, hertz):
    rows = [(n, k, math.sin(2 * math.pi * hertz * k / 10) + n * 0.01 * math.sin(k * k)) for n in (1, 2) for k in range(300)]
    s = spark.createDataFrame(rows, "n long, k long, x double").withColumn("t", F.col("k") / 10.0).withColumn("tones", F.lit(8))
    y = K.fold(s, "n", ["k"], ["x", "tones"], "t", "k", K.carrying(K.resonator(*H.HEART_BAND, 10.0), "tones int"))
    got = H.heart_rate(y, ["n"], ["k"], "filtered", "tones", 10.0).collect()
    assert len(got) == 2 * 251
    late = [r for r in got if r["k"] > 150]
    assert all(abs(r["bpm"] - 600 / round(10 / hertz)) < 1e-9 and r["status"] == "valid" for r in late)


def test_flat_signals_have_no_heart_rate(spark):
    s = spark.createDataFrame([(1, k, None if k % 7 == 0 else 1.0) for k in range(200)], "n long, k long, x double").withColumn("tones", F.lit(1))
    assert H.heart_rate(s, ["n"], ["k"], "x", "tones", 10.0).count() == 0


def test_breathing_forgets_when_the_rate_leaves_the_band():
    kernel = H.breathing(10.0, seconds=30.0)
    state, got = kernel.start, []
    for k in range(900):
        t = k / 10
        x = math.sin(2 * math.pi * 0.3 * t) if k < 400 or k > 600 else math.sin(2 * math.pi * 2.5 * t)
        state, out = kernel.step(state, (x,), t)
        got.append(out and out[0])
    assert abs(got[399] - 18) < 1.5
    gone = next(k for k in range(400, 600) if got[k] is None)
    assert all(g is None for g in got[gone : gone + 99]) and abs(got[899] - 18) < 2.5


def test_fused_signals(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0], [0.0, 0.5], [1.0]), ([3.0], [], []), ([], [], []), (None, None, None)], "r array<double>, p array<double>, w array<double>")
    got = df.select(H.coherent_signal(F.col("r"), F.col("p")).alias("c"), H.weighted_signal(F.col("r"), F.col("w")).alias("w")).collect()
    e = math.exp(-0.5)
    assert math.isclose(got[0]["c"], (e + 2 + 4) / (e + 2)) and math.isclose(got[0]["w"], (1 + 2 / 3 + 4 / 3) / (5 / 3))
    assert got[1]["c"] == 3.0 and got[2]["c"] is None and got[3]["c"] is None


def test_rotation_keeps_lengths_and_the_estimate_is_unbiased():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(20, 50))
    x = S.rotated(m)
    assert x.shape == (20, 64) and np.allclose((x**2).sum(1), (m**2).sum(1)) and np.allclose(x @ x.T, m @ m.T)
    assert set(S.signs(7, 100).tolist()) == {1.0, -1.0} and (S.signs(7, 100) == S.signs(7, 100)).all()
    a, b = m[0] / np.linalg.norm(m[0]), m[1] / np.linalg.norm(m[1])
    found = []
    for seed in range(400):
        p, q = S.rotated(a[None], seed)[0], S.rotated(b[None], seed)[0]
        s = np.where(p >= 0, 1, -1) / 8
        found.append((s @ q) / (s @ p))
    assert abs(np.mean(found) - a @ b) < 0.02


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 128)) + 2.0  # off the origin, where plain signs say little
    x = np.repeat(centres, 40, axis=0) + 0.6 * rng.normal(size=(480, 128))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 128), (None, x[0].tolist()), (903, [None] + x[0].tolist()[1:]), (904, [1.0, 2.0]), (905, [2.0, 4.0])]
    return x, spark.createDataFrame(rows, "k long, v array<double>")


@pytest.mark.parametrize("by", ["cosine", "l2"])
def test_search_by_estimate_reaches_the_exact_result(spark, vectors, by):
    x, df = vectors
    asked = F.col("k") % 20 == 0
    exact = {(r["query"], r["k"]) for r in S.search(df, "k", asked, "v", 5, 60, by, exact=True).collect() if r["query"] < 480}
    found = {(r["query"], r["k"]) for r in S.search(df, "k", asked, "v", 5, 60, by).collect() if r["query"] < 480}
    assert len(exact) == 24 * 5 and len(exact & found) >= 0.95 * len(exact)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 480, 20):
        d = 1 - u @ u[q] if by == "cosine" else ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        assert {k for a, k in exact if a == q} == set(np.argsort(d)[:5].tolist())


def test_rotated_codes_cover_more_than_plain_signs(spark, vectors):
    x, df = vectors
    asked = df.where("k % 20 = 0 AND k < 480").select(F.col("k").alias("query"), F.col("v").alias("vector"))
    exact = {(r["query"], r["k"]) for r in V.nearest(df, "k", F.col("k") % 20 == 0, "v", "cosine", 8).collect() if r["query"] < 480}
    plain = df.withColumn("s", V.sign_sketch(F.col("v")))
    share = {"plain": {(r["query"], r["k"]) for r in V.nearest(plain, "k", F.col("k") % 20 == 0, "s", "hamming", 24).collect()}}
    coded = S.codes(df, "k", "v")
    for by in ("hamming", "cosine"):
        share[by] = {(r["query"], r["key"]) for r in S.candidates(coded, asked, 24, by).collect()}
    share = {by: len(exact & found) / len(exact) for by, found in share.items()}
    assert min(share["cosine"], share["hamming"]) > share["plain"] + 0.1


def test_search_in_several_blocks_and_nearest_centres(spark, vectors, monkeypatch):
    x, df = vectors
    whole_ = {tuple(r) for r in V.nearest(df, "k", F.col("k") % 3 == 0, "v", "l2", 4).collect()}
    monkeypatch.setattr(V, "QUERIES_PER_BLOCK", 30)
    monkeypatch.setattr(V, "CENTRES_PER_BLOCK", 3)
    assert {tuple(r) for r in V.nearest(df, "k", F.col("k") % 3 == 0, "v", "l2", 4).collect()} == whole_
    centres = df.where("k IN (0, 40, 80, 120, 160, 200, 240)")
    got = {r["k"]: r["nearest"] for r in V.nearest_of(centres, df, "k", "v", "l2").collect()}
    for k in range(480):
        d = [((x[k] - x[c]) ** 2).sum() for c in range(0, 241, 40)]
        assert got[k] == 40 * int(np.argmin(d))
    assert 900 not in got and 904 not in got
