"""Queries over node samples: features, filters, baselines, triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolake.operators import signal as S
from echolake.registry import query
from echolake.sources.tables import FRAMES, SAMPLES, frames, samples

_KEY, _ORDER = ["node"], ["ts", "event_id"]
_W = "PARTITION BY node ORDER BY ts, event_id"

_FEATURES = """SELECT node, count(x) AS n, avg(x) AS mean, var_samp(x) AS variance, skewness(x) AS skewness, kurtosis(x) AS kurtosis, min(x) AS least, max(x) AS most,
 max(x) - min(x) AS span, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM s GROUP BY node"""
_MOMENTS = ("mean", "variance", "skewness", "kurtosis", "span", "iqr")


@query(f"WITH {SAMPLES}, f AS ({_FEATURES}) SELECT node, n, least, most, {', '.join(f'round({c}, 4) AS {c}' for c in _MOMENTS)} FROM f WHERE n >= 4")
def rssi_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.features(samples(spark, sf_dir), _KEY, "x").where("n >= 4")
    return f.select("node", "n", "least", "most", *[F.round(c, 4).alias(c) for c in _MOMENTS])


@query(f"""WITH {SAMPLES}, f AS ({_FEATURES}), c AS (SELECT node, n, round(variance / (variance + mean * mean), 4) AS score FROM f WHERE n >= 4)
SELECT node, n, score, CASE WHEN score > 0.25 THEN 'active' WHEN score > 0.12 THEN 'present_moving' WHEN score > 0.04 THEN 'present_still' ELSE 'absent' END AS class FROM c""")
def presence_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion class by node from the share of variance in a node's energy."""
    f = S.features(samples(spark, sf_dir), _KEY, "x").where("n >= 4")
    score = F.round(F.col("variance") / (F.col("variance") + F.col("mean") * F.col("mean")), 4)
    return f.select("node", "n", score.alias("score"), S.motion_class(score).alias("class"))


@query(f"""WITH {SAMPLES}, w AS (SELECT event_id, x, list(x) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS l FROM s),
m AS (SELECT *, list_median(l) AS median FROM w), d AS (SELECT *, 1.4826 * list_median(list_transform(l, lambda v: abs(v - median))) AS mad FROM m)
SELECT event_id, round(median, 6) AS median, abs(x - median) > 3.0 * mad AS outlier, round(CASE WHEN abs(x - median) > 3.0 * mad THEN median ELSE x END, 6) AS filtered FROM d""")
def hampel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.hampel(samples(spark, sf_dir), _KEY, _ORDER, "x")
    return out.select("event_id", F.round("median", 6).alias("median"), "outlier", F.round("filtered", 6).alias("filtered"))


@query(f"WITH {SAMPLES} SELECT event_id, round(avg(x) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean FROM s")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("event_id", F.round(F.avg("x").over(S.centred(_KEY, _ORDER, 2)), 6).alias("mean"))


@query(f"WITH {SAMPLES}, m AS (SELECT node, avg(x) AS mean, stddev_pop(x) AS sd FROM s GROUP BY node) SELECT event_id, round((x - mean) / sd, 5) AS z FROM s JOIN m USING (node) WHERE sd > 0")
def zscore_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    m = s.groupBy("node").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).where("sd > 0")
    return s.join(m, "node").select("event_id", F.round((F.col("x") - F.col("mean")) / F.col("sd"), 5).alias("z"))


@query(f"WITH {SAMPLES}, m AS (SELECT node, min(x) AS lo, max(x) AS hi FROM s GROUP BY node) SELECT event_id, round((x - lo) / (hi - lo), 6) AS scaled FROM s JOIN m USING (node) WHERE hi > lo")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    m = s.groupBy("node").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("hi > lo")
    return s.join(m, "node").select("event_id", F.round((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("scaled"))


@query(f"WITH {SAMPLES}, w AS (SELECT event_id, list(x) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM s) SELECT event_id, round(list_reduce(l, lambda a, v: a * 0.85 + v * 0.15) / pi(), 6) AS ema_over_pi FROM w")
def ema_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In units of pi, as decimal inputs would give values on rounding ties."""
    return S.ema(samples(spark, sf_dir), _KEY, _ORDER, "x", 0.15, 20).select("event_id", F.round(F.col("ema") / F.pi(), 6).alias("ema_over_pi"))


_ALL = f"({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_Z = f"z AS (SELECT event_id, node, CASE WHEN count(x) OVER {_ALL} >= 10 THEN (x - avg(x) OVER {_ALL}) / nullif(stddev_samp(x) OVER {_ALL}, 0) END AS z FROM s)"


@query(f"WITH {SAMPLES}, {_Z} SELECT event_id, round(z, 5) AS z FROM z WHERE z IS NOT NULL")
def welford_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.running_z(samples(spark, sf_dir), _KEY, _ORDER, "x").where("z is not null").select("event_id", F.round("z", 5).alias("z"))


@query(f"WITH {SAMPLES}, {_Z} SELECT event_id, node, round(z, 4) AS z FROM z WHERE abs(z) > 2.5")
def vital_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.running_z(samples(spark, sf_dir), _KEY, _ORDER, "x").where("abs(z) > 2.5").select("event_id", "node", F.round("z", 4).alias("z"))


_LAST = f"({_W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"


@query(f"WITH {SAMPLES}, c AS (SELECT *, x / 100 AS score FROM s) SELECT event_id, CASE WHEN count(score) OVER {_LAST} >= 10 THEN round(least(greatest(avg(score) OVER {_LAST} + stddev_pop(score) OVER {_LAST}, 0.3), 0.95), 5) END AS threshold FROM c")
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = samples(spark, sf_dir).withColumn("score", F.col("x") / 100)
    return S.adaptive_threshold(scored, _KEY, _ORDER, "score").select("event_id", F.round("threshold", 5).alias("threshold"))


@query(f"WITH {SAMPLES}, y AS (SELECT node, ts, event_id, x - 20.0 AS y FROM s), p AS (SELECT node, y * lag(y) OVER ({_W}) AS p FROM y) SELECT node, count(*) FILTER (WHERE p < 0) AS crossings FROM p GROUP BY node")
def zero_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.zero_crossings(samples(spark, sf_dir).withColumn("centre", F.lit(20.0)), _KEY, _ORDER, "x", "centre")


@query(f"WITH {SAMPLES}, w AS (SELECT *, lag(x) OVER ({_W}) AS b FROM s) SELECT event_id, node, x FROM w WHERE b <= 40 AND x > 40")
def numeric_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rising(samples(spark, sf_dir), _KEY, _ORDER, "x", 40).select("event_id", "node", "x")


@query(f"WITH {SAMPLES}, w AS (SELECT *, lag(kind) OVER ({_W}) AS b FROM s) SELECT event_id, node FROM w WHERE b = 'click' AND kind = 'error'")
def state_transition_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.transition(samples(spark, sf_dir), _KEY, _ORDER, "kind", "click", "error").select("event_id", "node")


@query(f"""WITH {SAMPLES}, h AS (SELECT *, x < 15 AS h FROM s), n AS (SELECT *, CASE WHEN h AND NOT coalesce(lag(h) OVER ({_W}), false) THEN 1 ELSE 0 END AS first FROM h),
i AS (SELECT *, sum(first) OVER ({_W}) AS island FROM n) SELECT node, round(min(t), 3) AS begin_at, round(max(t), 3) AS end_at, count(*) AS n FROM i WHERE h GROUP BY node, island HAVING max(t) - min(t) >= 1800""")
def dwell_no_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.dwell(samples(spark, sf_dir), _KEY, _ORDER, "t", F.col("x") < 15, 1800)
    return out.select("node", F.round("begin", 3).alias("begin_at"), F.round("end", 3).alias("end_at"), "n")


@query(f"WITH {SAMPLES}, l AS (SELECT *, CAST(floor(t) AS BIGINT) AS sec FROM s) SELECT event_id, count(*) FILTER (WHERE x > 40) OVER (PARTITION BY node ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent FROM l")
def fall_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.recent_count(samples(spark, sf_dir), _KEY, "t", F.col("x") > 40, 86_400).select("event_id", "recent")


@query(f"WITH {SAMPLES}, w AS (SELECT node, event_id, event_id - lag(event_id) OVER (PARTITION BY node ORDER BY event_id) - 1 AS dropped FROM s) SELECT node, count(*) AS gaps, CAST(sum(dropped) AS BIGINT) AS dropped FROM w WHERE dropped > 0 GROUP BY node")
def sequence_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("event_id").over(Window.partitionBy("node").orderBy("event_id"))
    gaps = samples(spark, sf_dir).select("node", (F.col("event_id") - before - 1).alias("dropped")).where("dropped > 0")
    return gaps.groupBy("node").agg(F.count(F.lit(1)).alias("gaps"), F.sum("dropped").alias("dropped"))


@query(f"WITH {SAMPLES} SELECT event_id, CASE WHEN kind = 'purchase' THEN NULL ELSE node END AS node, CASE WHEN kind = 'purchase' THEN NULL ELSE round(x, 0) END AS x FROM s")
def privacy_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = F.col("kind") != "purchase"
    return samples(spark, sf_dir).select("event_id", F.when(open_, F.col("node")).alias("node"), F.when(open_, F.round("x", 0)).alias("x"))


@query(f"""WITH {FRAMES}, e AS (SELECT frame, list_sort(amplitude) AS v, len(amplitude) AS n, list_sum(amplitude) AS total FROM f)
SELECT frame, round(list_sum(list_transform(v, lambda x, i: (2 * i - n - 1) * x)) / (n * total), 6) AS gini FROM e WHERE total > 0""")
def gini_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("frame", F.round(S.gini(F.col("amplitude")), 6).alias("gini")).where("gini is not null")
