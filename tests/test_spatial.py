"""Maps, cuts, influence, volumes and baselines against plain loops and numpy."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolake.operators import baselines as B
from echolake.operators import folds as K
from echolake.operators import gaussian as G
from echolake.operators import influence as I
from echolake.operators import partition as P
from echolake.operators import tomography as R

SPOTS = "id long, x double, y double, z double, sx double, sy double, sz double, occupancy double"


def away(p, a, b):
    p, a, b = map(np.array, (p, a, b))
    d = b - a
    t = 0.0 if d @ d < 1e-18 else float(np.clip((p - a) @ d / (d @ d), 0, 1))
    return float(np.linalg.norm(p - a - t * d))


def test_corridors_and_gains_are_those_of_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    spots = [(k, *map(float, rng.uniform(-6, 6, 3)), *map(float, rng.uniform(0.2, 1.5, 3)), float(rng.uniform(0, 1))) for k in range(120)] + [(200, None, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0)]
    ways = [(k, *map(float, rng.uniform(-6, 6, 6))) for k in range(12)] + [(50, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (51, None, 0.0, 0.0, 1.0, 1.0, 1.0), (52, 90.0, 90.0, 90.0, 91.0, 90.0, 90.0)]
    g, w = spark.createDataFrame(spots, SPOTS), spark.createDataFrame(ways, "way long, ax double, ay double, az double, bx double, by double, bz double")
    want = {(v[0], s[0]) for v in ways for s in spots if None not in v and None not in s and away(s[1:4], v[1:4], v[4:]) <= 2.0}
    for cell in (0.7, 2.0, 50.0):
        assert {(r["way"], r["id"]) for r in G.corridor(g, w, 2.0, cell).collect()} == want
    gains = {r["way"]: r for r in G.channel_gain(g, w, "way", 2.4e9).collect()}
    assert set(gains) == {v[0] for v in ways if None not in v} and (gains[50]["gain_db"], gains[50]["phase"]) == (0.0, 0.0)
    for v in ways[:12]:
        a, b = np.array(v[1:4]), np.array(v[4:])
        length, depth = float(np.linalg.norm(b - a)), 0.0
        for s in spots[:120]:
            if away(s[1:4], a, b) <= 3.0:
                t = np.linspace(0, 1, 4001)[:, None]
                bell = np.exp(-0.5 * (((a + t * (b - a) - np.array(s[1:4])) / np.array(s[4:7])) ** 2).sum(1))
                depth += s[7] * float(((bell[1:] + bell[:-1]) / 2).sum()) * length / 4000
        assert gains[v[0]]["depth"] == pytest.approx(depth, abs=2e-5)
        assert gains[v[0]]["gain_db"] == pytest.approx(20 * math.log10(G.LIGHT / 2.4e9 / (4 * math.pi * length) * math.exp(-depth)), abs=1e-3)
    assert gains[52]["n"] == 0 and gains[52]["gain_db"] == pytest.approx(20 * math.log10(G.LIGHT / 2.4e9 / (4 * math.pi)))


def test_observations_fuse_and_fade(spark):
    spot = lambda x, c, kind="a": (x, 0.0, 0.0, 0.5, 0.5, 0.5, 1.0, c, kind)
    rows = [(1, k, float(k), *s) for k, s in enumerate([spot(0.0, 0.5), spot(0.4, 0.5), spot(0.4, 0.5, "b"), spot(9.0, 0.9), spot(1.6, 0.2), spot(None, 0.9)])]
    s = spark.createDataFrame(rows, "room long, id long, t double, x double, y double, z double, sx double, sy double, sz double, occupancy double, confidence double, kind string")
    values = ["x", "y", "z", "sx", "sy", "sz", "occupancy", "confidence", "kind"]
    out = K.fold(s, "room", ["id"], values, "t", "id", G.fuse())
    got = {r["id"]: r for r in out.collect()}
    assert [(got[k]["primitive"], got[k]["merged"]) for k in range(5)] == [(0, False), (0, True), (1, False), (2, False), (0, True)] and 5 not in got
    assert (got[1]["x"], got[1]["confidence"], got[1]["first"], got[1]["last"]) == (0.2, 0.75, 0.0, 1.0)
    assert got[4]["x"] == pytest.approx((0.75 * 0.2 + 0.2 * 1.6) / 0.95)
    kept = G.latest(out, ["room"], ["id"])
    assert {r["primitive"]: r["n"] for r in kept.collect()} == {0: 3, 1: 1, 2: 1}
    later = {r["primitive"]: r["confidence"] for r in G.faded(kept, F.lit(14.0), F.lit(4.0)).collect()}
    assert later[0] == pytest.approx(0.8 * math.exp(-10 / (4 * (1 + math.log(2))))) and later[2] == pytest.approx(0.9 * math.exp(-11 / 4))
    assert set(later) == {0, 1, 2} and {r[0] for r in G.faded(kept, F.lit(25.0), F.lit(4.0)).select("primitive").collect()} == {0}


def brute_cut(w):
    n = len(w)
    return min(sum(w[i, j] for i in s for j in range(n) if j not in s) for k in range(1, n) for s in combinations(range(n), k))


def test_minimum_cuts_against_all_subsets(spark):
    rng = np.random.default_rng(2)
    for n in (2, 3, 5, 7):
        for _ in range(12):
            w = rng.integers(0, 5, (n, n)) * (rng.random((n, n)) < 0.7)
            w = (np.triu(w, 1) + np.triu(w, 1).T).astype(float)
            cut, side = P.min_cut(w)
            assert cut == brute_cut(w) and 0 in side and len(side) < n or n < 2
            assert sum(w[i, j] for i in side for j in range(n) if j not in side) == cut
    rows = [(1, [0.1, 0.2, 5.0, 5.1]), (2, None), (3, [1.0, None, 2.0, 3.0]), (4, [1.0, 2.0]), (5, []), (6, [0.0, 9.0, 18.0, 27.0]), (7, [1.0, 1.0, 1.2, 4.0, 3.9])]
    got = {r["k"]: r for r in P.partition_tones(spark.createDataFrame(rows, "k long, s array<double>"), "k", F.col("s")).collect()}
    assert (got[1]["cut"], got[1]["sensitive"]) == (0.0, [2, 3]) and got[2]["sensitive"] == got[3]["sensitive"] == got[5]["sensitive"] == []
    assert got[4]["sensitive"] == [0, 1] and got[6]["cut"] is None and got[7]["sensitive"] == [3, 4]


def test_many_cuts_at_once_equal_single_ones():
    rng = np.random.default_rng(8)
    for n in range(2, 9):
        w = rng.integers(0, 4, (60, n, n)) * (rng.random((60, n, n)) < 0.5) * rng.choice([1.0, 0.3], (60, 1, 1))  # also graphs of several parts, and ties
        w = w + w.transpose(0, 2, 1)
        cuts, sides = P.min_cuts(w)
        assert [(c, np.flatnonzero(s).tolist()) for c, s in zip(cuts.tolist(), sides, strict=True)] == [P.min_cut(x) for x in w]


def test_meshes_at_risk(spark):
    ring = [(1, k, (k + 1) % 4, 0.5 if k in (0, 3) else 0.75) for k in range(4)]  # vertex 0 is tied least
    rows = ring + [(2, 0, 1, 0.9), (2, 1, 2, 1e-6), (2, 2, 1, -4.0), (3, 5, 6, 0.1), (4, 1, 1, 9.0), (4, None, 1, 9.0), (5, 1, 2, None), (5, 2, 3, 0.5)]
    got = {r["c"]: tuple(r)[1:] for r in P.mesh_risk(spark.createDataFrame(rows, "c long, a long, b long, w double"), ["c"], "a", "b", "w").collect()}
    assert got == {1: (4, 1.0, [0], False), 2: (3, 1 / 64, [0, 1], True), 3: (2, 6 / 64, [5], False), 5: (3, 0.0, [1], True)}


def test_influence_against_numpy(spark):
    rng = np.random.default_rng(4)
    n = 14
    w = rng.random((n, n)) * (rng.random((n, n)) < 0.25)
    w[[3, 9]] = 0  # they give nothing on
    edges = [(i, j, float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]] + [(0, 1, None), (None, 2, 1.0), (2, 3, -1.0)]
    out = w.sum(1)
    r = np.full(n, 1 / n)
    for _ in range(300):
        r = 0.15 / n + 0.85 * ((w / np.where(out, out, 1)[:, None]).T @ r + r[out == 0].sum() / n)
    df = spark.createDataFrame(edges, "a long, b long, w double")
    ranks, rounds = I.influence(df, "a", "b", "w", nodes=spark.range(n).select(F.col("id").alias("node")), tolerance=1e-6)
    got = {x["node"]: x["rank"] for x in ranks.collect()}
    assert len(got) == n and sum(got.values()) == pytest.approx(1) and all(got[k] == pytest.approx(r[k], abs=1e-6) for k in range(n)) and rounds < 90
    assert I.influence(df.limit(0), "a", "b", "w")[0].count() == 0


def test_tomography_finds_a_planted_body(spark):
    grid = R.Grid()
    edge = [(x, y, z) for z in (0.6, 1.6) for x, y in [(k * 0.75, 0.0) for k in range(9)] + [(k * 0.75, 6.0) for k in range(9)] + [(0.0, k * 0.75) for k in range(1, 8)] + [(6.0, k * 0.75) for k in range(1, 8)]]
    rows = [(k, *map(float, a + b)) for k, (a, b) in enumerate((a, b) for i, a in enumerate(edge) for b in edge[i + 1 :] if a[2] == b[2] and sum((p - q) ** 2 for p, q in zip(a, b, strict=True)) > 9)]
    links = spark.createDataFrame(rows, "link long, tx double, ty double, tz double, rx double, ry double, rz double")
    weights = R.link_weights(links, grid).persist()
    where = 2 * 64 + 5 * 8 + 2  # iz 2, iy 5, ix 2
    through = weights.where(F.col("voxel") == where).select("link", F.col("weight").alias("attenuation"))
    measured = links.select("link").join(through, "link", "left").fillna(0.0).unionByName(spark.createDataFrame([(-1, None)], "link long, attenuation double"))
    found = R.reconstruct(weights, measured, grid, penalty=0.01, most=60)
    assert int(np.argmax(found.densities)) == where and found.rounds <= 60 and (found.densities >= 0).all()
    top = R.voxels(spark, found, grid).orderBy(F.desc("density")).first()
    assert (top["voxel"], round(top["x"], 3), round(top["y"], 3), round(top["z"], 3)) == (where, 1.875, 4.125, 1.875)
    with pytest.raises(ValueError):
        R.reconstruct(weights, measured.limit(3), grid)


def test_links_of_one_way_are_taken_together(spark):
    rng = np.random.default_rng(3)
    grid = R.Grid(4, 4, 2)
    ends = [tuple(map(float, rng.uniform(0, 3, 6))) for _ in range(6)]
    rows = [(k, *ends[k % 6], float(rng.random())) for k in range(40)] + [(40, *ends[0], None)]
    links = spark.createDataFrame(rows, "link long, tx double, ty double, tz double, rx double, ry double, rz double, attenuation double")
    w, y, x = np.zeros((40, grid.voxels)), np.array([r[-1] for r in rows[:40]]), np.zeros(grid.voxels)
    for r in R.link_weights(links.where("link < 40"), grid).collect():
        w[r["link"], r["voxel"]] = r["weight"]
    for _ in range(5):
        step, off = 1 / (w**2).sum(), w @ x - y
        x = np.maximum(x - step * (w.T @ off) - 0.1 * step, 0)
    own, measured = R.ways(links)
    assert own.count() == 6
    found = R.reconstruct(R.link_weights(own, grid), measured, grid, most=5)
    assert found.densities == pytest.approx(x, abs=1e-12) and found.residual == pytest.approx(np.sqrt((off**2).mean()))


def test_merged_baselines_equal_the_whole(spark):
    rng = np.random.default_rng(6)
    rows = [(k % 3, float(a), float(p)) for k, (a, p) in enumerate(zip(rng.normal(20, 3, 90), rng.vonmises(3, 4, 90), strict=True))] + [(0, None, 1.0), (1, 2.0, None), (2, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "tone long, a double, p double")
    halves = [B.moments(df.where(c), ["tone"], "a", "p", 20.0) for c in ("a > 20", "NOT a > 20 OR a IS NULL")]
    got = {r["tone"]: r for r in B.finalized(B.merged(halves, ["tone"]), ["tone"], 20.0, 10).collect()}
    for k in range(3):
        a, p = (np.array([r[c] for r in rows[:90] if r[0] == k]) for c in (1, 2))
        turn = np.exp(1j * p).mean()
        assert got[k]["n"] == 30 and got[k]["amp_mean"] == pytest.approx(a.mean()) and got[k]["amp_variance"] == pytest.approx(a.var(ddof=1))
        assert got[k]["phase_mean"] == pytest.approx(np.angle(turn)) and got[k]["phase_dispersion"] == pytest.approx(1 - abs(turn))


def test_a_stream_subtracts_a_stored_baseline(spark, tmp_path):
    rows = [(k, k % 2, 10.0 + (5 if k >= 40 else 0) + k % 3, 0.1) for k in range(44)]
    df = spark.createDataFrame(rows, "id long, tone long, a double, p double")
    B.finalized(B.moments(df.where("id < 40"), ["tone"], "a", "p"), ["tone"], least=10).write.parquet(f"{tmp_path}/model")
    df.where("id >= 40").write.parquet(f"{tmp_path}/in")
    model = spark.read.parquet(f"{tmp_path}/model")
    stream = B.against(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), model, ["tone"], "a", "p")
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda d: sorted(map(tuple, d.select("id", "z", "left").collect()))
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(B.against(df.where("id >= 40"), model, ["tone"], "a", "p"))


def test_change_points_by_halves_and_personal_days(spark):
    rng = np.random.default_rng(9)
    rows = [(t, k, float(rng.normal(0, 1) + (12 if t == 30 and k < 4 else 0))) for t in range(40) for k in range(5)] + [(31, None, 5.0), (31, 1, None)]
    df = spark.createDataFrame(rows, "t long, link long, x double")
    whole = {tuple(r) for r in B.change_points(df, None, "t", "link", "x")[0].collect()}
    first, state = B.change_points(df.where("t < 25"), None, "t", "link", "x")
    later, _ = B.change_points(df.where("t >= 25"), state, "t", "link", "x")
    assert {tuple(r) for r in first.unionByName(later).collect()} == whole and any(t == 30 and n >= 3 for t, n in whole)
    kernel, state, told = B.personal_days(), B.personal_days().start, []
    for day in range(30):
        state, got = kernel.step(state, (50.0 + day % 2 + (40 if day >= 20 else 0),), float(day))
        told += [(day, got)] if got else []
    assert told[0][0] == 22 and told[0][1][0] == "increasing" and told[0][1][-1] == "drift"


def test_what_may_leave_a_node(spark):
    v = spark.createDataFrame([(1, 0.05, 0.9, 2.0), (2, 1.0, 0.8, None), (3, 0.06, 0.7, 1.0)], "voxel long, occupancy double, confidence double, speed double")
    assert B.demoted(v, "full").collect() == v.collect()
    hidden = B.demoted(v, "anonymous").collect()
    assert all(r["speed"] is None and r["confidence"] == 0 for r in hidden)
    assert {tuple(r) for r in B.demoted(v, "restricted").collect()} == {(0, 2), (9, 1)}
    with pytest.raises(ValueError):
        B.demoted(v, "open")
