"""Stored baselines: empty rooms, persons, meshes, voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.operators import baselines as B
from echolake.operators import folds as K
from echolake.plans.shared import materialize
from echolake.plans.temporal import _recursion
from echolake.registry import query
from echolake.sources.tables import FRAMES, SAMPLES, frames, samples

_TONES = f"{FRAMES}, e AS (SELECT frame, unnest(range(len(amplitude))) AS tone, unnest(amplitude) AS a, unnest(phase) AS p FROM f)"


def _tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select("frame", F.posexplode(F.arrays_zip("amplitude", "phase")).alias("tone", "v"))
    return f.select("frame", "tone", F.col("v.amplitude").alias("a"), F.col("v.phase").alias("p"))


@query(f"""WITH {_TONES}, m AS (SELECT tone, avg(a) AS mean, sqrt(var_samp(a)) AS std, atan2(sum(sin(p)), sum(cos(p))) AS angle FROM e GROUP BY tone HAVING count(*) >= 100),
d AS (SELECT frame, abs(a - mean) / std AS z, CASE WHEN abs(p - angle) > pi() THEN 2 * pi() - abs(p - angle) ELSE abs(p - angle) END AS drift FROM e JOIN m USING (tone)),
q AS (SELECT frame, quantile_cont(z, 0.5) AS z_median, max(z) AS z_max, quantile_cont(drift, 0.5) AS drift_median FROM d GROUP BY frame)
SELECT frame, round(z_median, 6) AS z_median, round(z_max, 6) AS z_max, round(drift_median, 6) AS drift_median, z_median > 2 OR drift_median > 0.7 AS motion FROM q""")
def baseline_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame against the baseline of its tones, which is made of two halves and stored."""
    tones = _tones(spark, sf_dir)
    halves = [B.moments(tones.where(F.col("frame") % 2 == k), ["tone"], "a", "p", 25.0) for k in (0, 1)]
    model = materialize(B.finalized(B.merged(halves, ["tone"]), ["tone"], 25.0, 100), "baseline")
    out = B.deviation(B.against(tones, model, ["tone"], "a", "p"), ["frame"])
    return out.select("frame", *[F.round(c, 6).alias(c) for c in ("z_median", "z_max", "drift_median")], "motion")


@query(f"""WITH {SAMPLES}, h AS (SELECT floor(t / 10800) AS turn, node % 20 AS link, avg(x) AS x FROM s GROUP BY 1, 2),
b AS (SELECT turn, x, count(*) OVER w AS n, avg(x) OVER w AS mean, stddev_pop(x) OVER w AS std FROM h WINDOW w AS (PARTITION BY link ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT turn::BIGINT AS turn, count(*) AS diverging FROM b WHERE n >= 2 AND std > 1e-9 AND abs(x - mean) > 2 * std GROUP BY turn HAVING count(*) >= 3""")
def link_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three hours at which links leave their past together, told by two runs over halves of the time."""
    s = samples(spark, sf_dir)
    held = materialize(s.groupBy(F.floor(F.col("t") / 10800).alias("turn"), (F.col("node") % 20).alias("link")).agg(F.avg("x").alias("x")), "windows")
    half = held.agg(F.percentile_approx("turn", 0.5)).first()[0]
    first, state = B.change_points(held.where(F.col("turn") < half), None, "turn", "link", "x")
    later, _ = B.change_points(held.where(F.col("turn") >= half), materialize(state, "links"), "turn", "link", "x")
    return first.unionByName(later)





@query(_recursion(
    {"n": "0", "mean": "0.0::DOUBLE", "m2": "0.0::DOUBLE", "off": "0"},
    [
        {"next_n": "n + 1", "apart": "x - mean"},
        {"next_mean": "mean + apart / next_n"},
        {"next_m2": "m2 + apart * (x - next_mean)"},
        {"std": "CASE WHEN next_n > 1 THEN sqrt(next_m2 / next_n) ELSE 0 END"},
        {"z_": "CASE WHEN std > 1e-15 THEN (x - next_mean) / std ELSE 0 END"},
        {"next_off": "CASE WHEN next_n < 7 THEN off WHEN abs(z_) > 1 THEN off + 1 ELSE 0 END"},
    ],
    {"direction VARCHAR": "CASE WHEN z_ > 0 THEN 'increasing' ELSE 'decreasing' END", "z DOUBLE": "round(z_, 6)", "days INTEGER": "next_off", "level VARCHAR": "CASE WHEN next_off >= 3 THEN 'risk_correlation' ELSE 'drift' END"},
    "next_n >= 7 AND next_off >= 2", given=f"{SAMPLES.replace('s AS', 's0 AS')}, s AS (SELECT node, min(event_id) AS event_id, min(ts) AS ts, floor(t / 86400) AS t, avg(x) / pi() AS x FROM s0 GROUP BY node, floor(t / 86400))",
))
def personal_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on end on which a node's mean is off all its days so far; levels scaled to a month of data."""
    s = samples(spark, sf_dir).groupBy("node", F.floor(F.col("t") / 86400).alias("t"))
    days = s.agg(F.min("event_id").alias("event_id"), F.min("ts").alias("ts"), (F.avg("x") / F.pi()).alias("x"))
    out = K.fold(days, "node", ["ts", "event_id"], "x", "t", "event_id", B.personal_days(sigma=1.0, held=2, risk=3))
    return out.select("node", "event_id", "direction", F.round("z", 6).alias("z"), "days", "level")


@query(_recursion(
    {"odds": "0.0::DOUBLE", "n": "0"},
    [{"p1": "least(greatest(least(x / 100, 1), 1e-4), 1 - 1e-4)", "next_n": "n + 1"}, {"next_odds": "greatest(least(odds + ln(p1 / (1 - p1)), 20), -20)"}],
    {"occupancy DOUBLE": "round(1 / (1 + exp(-next_odds)), 6)", "confidence DOUBLE": "round(1 - exp(-next_n / 5), 6)", "unsure BOOLEAN": "next_n < 5"},
))
def voxel_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy of each node's voxel as evidence comes in."""
    s = samples(spark, sf_dir).withColumn("p", F.least(F.col("x") / 100, F.lit(1.0))).withColumn("speed", F.col("x") / 500)
    out = K.fold(s, "node", ["ts", "event_id"], ["p", "speed"], "t", "event_id", B.voxel_evidence())
    return out.select("node", "event_id", F.round("occupancy", 6).alias("occupancy"), F.round("confidence", 6).alias("confidence"), "unsure")
