"""Folds against plain loops, and streams against tables."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from echolake.operators import folds as K
from echolake.operators import vitals as V
from echolake.sources.tables import samples
from echolake.streaming import windows as W

SMALL = "/root/testdata/sf0.001"
KERNELS = {"ema": K.ema(), "cusum": K.cusum(20, 2, 60), "gate": K.predictive_gate(0.2, 15), "rate": K.rate_limit(3600), "motion": K.smoothed_motion(), "action": K.action_gate()}


def loop(rows, kernel):
    state, out = defaultdict(lambda: kernel.start), Counter()
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        state[r["node"]], got = kernel.step(state[r["node"]], (r["x"],), r["t"])
        if got is not None:
            out[r["node"], r["event_id"], *got] += 1
    return out


@pytest.mark.parametrize("name", KERNELS)
def test_fold_equals_loop(spark, name):
    s = samples(spark, SMALL)
    found = K.fold(s, "node", ["ts", "event_id"], "x", "t", "event_id", KERNELS[name]).collect()
    assert found and Counter(map(tuple, found)) == loop(s.collect(), KERNELS[name])


def states(kernel, rows):
    """Outputs of rows (time, values...)."""
    s, out = kernel.start, []
    for t, *v in rows:
        s, got = kernel.step(s, tuple(v), t)
        out.append(got)
    return out


def test_steps():
    assert [a[2] for a in states(K.cusum(0, 0, 5), enumerate_values([3, 3, 3, -3, -3]))] == [0, 1, 0, 0, -1]
    assert states(K.rate_limit(2), enumerate_values([0] * 5)) == [(0,), None, (2,), None, (4,)]
    gate = states(K.action_gate(), [(0, 0.54), (1, 0.56), (3, 0.56), (6, 0.56), (7, 0.46), (8, 0.44), (12, 0.44), (13, 0.44), (20, 2.0), (24.9, 2.0), (25, 2.0)])
    assert [g[0] for g in gate] == ["accept"] * 3 + ["predict_only"] * 4 + ["accept"] * 3 + ["recalibrate"]


def enumerate_values(xs):
    return [(t, x) for t, x in enumerate(xs)]


def test_sleep_needs_its_dwell_and_ends_at_once_without_presence():
    calm = (True, 0.01, 12.0, 0.9)
    assert states(K.sleeping(), [(10, *calm), (60, *calm), (359, *calm), (360, *calm)]) == [None, None, None, (True,)]
    asleep = [(60, *calm), (360, *calm)]
    assert states(K.sleeping(), [*asleep, (361, False, 0.0, 12.0, 0.9)])[-1] == (False,)
    assert states(K.sleeping(), [*asleep, (370, True, 0.2, 12.0, 0.9), (399, True, 0.2, 12.0, 0.9), (400, True, 0.2, 12.0, 0.9)])[2:] == [None, None, (False,)]
    assert states(K.sleeping(), [(60, *calm), (200, True, 0.01, 21.0, 0.9), (360, *calm), (660, *calm)]) == [None, None, None, (True,)]


def test_distress_waits_after_its_end():
    calm, bad = (60.0, 0.9, 0.05, False), (100.0, 0.9, 0.5, False)
    rows = [(0, *calm), (70, *bad), (129, *bad), (130, *bad), (140, *calm), (200, *bad), (439, *bad), (440, *bad), (499, *bad), (500, *bad)]
    assert states(K.distress(), rows) == [None, None, None, (True,), (False,), None, None, None, None, (True,)]
    assert states(K.distress(), [(0, *calm), (70, 100.0, 0.9, 0.5, True), (140, 100.0, 0.9, 0.5, True)]) == [None] * 3


def test_nulls_leave_the_state_and_keys_stay_exact(spark):
    big = 9007199254740993
    rows = [(big, 1, 1.0, 5.0), (big, 2, 2.0, None), (big, 3, 3.0, float("nan")), (big, 4, None, 7.0), (big, 5, 5.0, 9.0), (None, 6, 1.0, 2.0), (None, 7, 2.0, 4.0), (7, 8, 1.0, None)]
    s = spark.createDataFrame(rows, "node long, event_id long, t double, x double")
    found = {(r[0], r[1]): r[2] for r in K.fold(s, "node", ["event_id"], "x", "t", "event_id", K.ema(0.5)).collect()}
    assert found == {(big, 1): 5.0, (big, 5): 7.0, (None, 6): 2.0, (None, 7): 3.0}


def test_changed_chains_are_found(spark):
    rows = [(k, i, float(i), f"record {i}") for k in range(5) for i in range(6)]
    s = spark.createDataFrame(rows, "k long, i long, t double, body string")
    chain = K.fold(s, "k", ["i"], "body", "t", "i", K.hash_links()).join(s.select("k", "i", "body"), ["k", "i"])
    body = F.when(F.expr("k = 1 and i = 3"), "changed").otherwise(F.col("body"))
    link = F.when(F.expr("k = 2 and i = 4"), F.sha2(F.lit("other"), 256)).otherwise(F.col("link"))
    prev = F.when(F.expr("k = 4 and i = 2"), F.sha2(F.lit("other"), 256)).otherwise(F.col("prev"))
    changed = chain.select("k", "seq", prev.alias("prev"), link.alias("link"), body.alias("body")).where("not (k = 3 and seq = 1)")
    found = {r[0]: tuple(r)[1:] for r in V.chain_faults(changed, "k", "seq", "prev", "link", "body").collect()}
    assert found == {0: (6, None, None), 1: (6, 3, "hash_mismatch"), 2: (6, 4, "hash_mismatch"), 3: (5, 1, "seq_gap"), 4: (6, 2, "prev_mismatch")}


def test_breathing_of_a_planted_sinusoid(spark):
    """A quarter of a hertz at ten samples a second is fifteen breaths a minute."""
    rows = [(1, k, k / 10, math.sin(2 * math.pi * 0.25 * k / 10) + 0.02 * math.sin(2 * math.pi * 3 * k / 10)) for k in range(600)]
    s = spark.createDataFrame(rows, "node long, event_id long, t double, x double")
    y = K.fold(s, "node", ["event_id"], "x", "t", "event_id", K.resonator(0.1, 0.5, 10.0))
    last = V.rate_by_crossings(y, ["node"], ["event_id"], "filtered", 300, 100, 10.0, 0.1, 0.5).orderBy(F.desc("event_id")).first()
    assert last["bpm"] == pytest.approx(15, abs=1) and last["confidence"] > 0.25


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    """The samples in three files by time, and a far later row that closes all windows."""
    d = str(tmp_path_factory.mktemp("stream"))
    s = samples(spark, SMALL).select("event_id", "node", "kind", "x", "t", "ts")
    cut = s.selectExpr("percentile_approx(t, array(0.33, 0.66))").first()[0]
    last = s.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).withColumn("event_id", F.lit(-1).cast("long"))
    for lo, hi in ((0, cut[0]), (cut[0], cut[1]), (cut[1], 1e12)):
        s.where((F.col("t") >= lo) & (F.col("t") < hi)).coalesce(1).write.mode("append").parquet(d)
    last.coalesce(1).write.mode("append").parquet(d)
    return spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(d), s


def drain(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_tumbling_stream_equals_table(spark, stream, tmp_path):
    live, table = stream
    f = lambda d: W.windowed(d, ["kind"], "ts", "x", "1 hour")
    got = drain(spark, f(live), "tumbling", tmp_path).where("begin < '2029-01-01'")
    assert Counter(map(tuple, got.select("kind", "n", "most", "begin").collect())) == Counter(map(tuple, f(table).select("kind", "n", "most", "begin").collect()))


def test_fold_stream_equals_batch(spark, stream, tmp_path):
    live, table = stream
    kernel = K.cusum(20, 2, 60)
    args = ("node", ["ts", "event_id"], "x", "t", "event_id", kernel)
    got = drain(spark, K.fold_stream(live.where("event_id >= 0"), *args), "folded", tmp_path)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, K.fold(table, *args).collect()))


def test_sleepers_without_a_breathing_rate_wake(spark):
    from echolake.operators import fusion as J

    calm = [(1, k, 100.0 * k, True, 0.01, 12.0, 0.9) for k in range(1, 6)]
    rows = [*calm, (1, 6, 600.0, True, 0.01, None, None), (1, 7, 700.0, False, 0.01, None, None)]
    rows += [(2, k, 100.0 * k, True, 0.01, None if k == 3 else 12.0, 0.9) for k in range(1, 6)]  # without a rate the dwell starts anew
    rows += [(3, *r[1:]) for r in calm] + [(3, 6, 600.0, None, 0.01, 12.0, 0.9)]
    s = spark.createDataFrame(rows, "node long, id long, t double, presence boolean, motion double, rate double, confidence double")
    got = K.fold(s, "node", ["id"], ["presence", "motion", "rate", "confidence"], "t", "id", K.sleeping()).collect()
    assert sorted(map(tuple, got)) == [(1, 4, True), (1, 7, False), (3, 4, True)]
    w = J.softmax_weights(spark.createDataFrame([(None, 1.0), (None, 1.0), (1, 3.0)], "k long, s double"), ["k"], "s").collect()
    assert sorted(r["weight"] for r in w) == [0.5, 0.5, 1.0]
