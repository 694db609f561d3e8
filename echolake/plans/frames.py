"""Queries over frames: array mathematics and spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.functions import arrays as A
from echolake.functions import spectral as P
from echolake.registry import query
from echolake.sources.tables import FRAMES, SAMPLES, frames, samples


def _sql(column: str, value: str, source: str = "t") -> str:
    return f"""WITH {FRAMES}, t AS (SELECT frame, unnest({column}) AS v, unnest(range(len({column}))) AS i FROM f) SELECT frame, CAST(i AS INTEGER) AS i, round({value}, 5) AS v FROM {source}"""


def _each(df: DataFrame, value: Column) -> DataFrame:
    return df.select("frame", F.posexplode(value).alias("i", "v")).withColumn("v", F.round("v", 5))


@query(_sql("amplitude", "coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0)", "t WINDOW w AS (PARTITION BY frame)"))
def frame_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(frames(spark, sf_dir), A.normalize_min_max(F.col("amplitude")))


@query(_sql("amplitude", "coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0)", "t WINDOW w AS (PARTITION BY frame)"))
def frame_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(frames(spark, sf_dir), A.normalize_zscore(F.col("amplitude")))


@query(_sql("amplitude", "CASE WHEN 20 * log10(v + 1e-12) <= 20 THEN 0 ELSE v END"))
def frame_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(frames(spark, sf_dir), A.remove_noise(F.col("amplitude"), 20))


_UNWRAP = """(SELECT frame, i, v + sum(CASE WHEN d > pi() THEN -2 * pi() WHEN d < -pi() THEN 2 * pi() ELSE 0 END) OVER (PARTITION BY frame ORDER BY i) AS v
 FROM (SELECT *, v - lag(v) OVER (PARTITION BY frame ORDER BY i) AS d FROM t)) AS u"""


@query(_sql("phase", "v", _UNWRAP))
def frame_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(frames(spark, sf_dir), A.unwrap_phase(F.col("phase")))


@query(_sql("phase", "(v - avg(v) OVER w - coalesce(covar_pop(v, i) OVER w / nullif(var_pop(i) OVER w, 0), 0) * (i - avg(i) OVER w)) / pi()", f"{_UNWRAP} WINDOW w AS (PARTITION BY frame)"))
def frame_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In half turns."""
    return _each(frames(spark, sf_dir), F.transform(A.sanitize_phase(F.col("phase")), lambda v: v / F.pi()))


@query(f"""WITH {FRAMES}, j AS (SELECT frame, amplitude AS a, len(amplitude) AS n, unnest(range(4)) AS i FROM f), p AS (SELECT *, i * (n - 1) / 3.0::DOUBLE AS place FROM j), q AS (SELECT *, CAST(floor(place) AS BIGINT) AS k FROM p)
SELECT frame, CAST(i AS INTEGER) AS i, round(a[k + 1] * (1 - (place - k)) + a[least(k + 1, n - 1) + 1] * (place - k), 5) AS v FROM q""")
def frame_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(frames(spark, sf_dir), A.resample(F.col("amplitude"), 4))


@query(f"""WITH {FRAMES}, t AS (SELECT frame, unnest(amplitude) AS v FROM f), z AS (SELECT frame, coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0) AS z FROM t WINDOW w AS (PARTITION BY frame))
SELECT frame, round(avg(exp(-z * z / 2)), 5) AS coherence FROM z GROUP BY frame""")
def frame_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("frame", F.round(A.coherence(A.normalize_zscore(F.col("amplitude"))), 5).alias("coherence"))


@query(f"WITH {SAMPLES} SELECT event_id, round(power(10, (x / 2 - 100 + 100) / 20), 6) AS amplitude, CASE WHEN floor(x) BETWEEN 1 AND 14 THEN '2.4GHz' WHEN floor(x) BETWEEN 36 AND 177 THEN '5GHz' WHEN floor(x) > 177 THEN '6GHz' END AS band FROM s")
def rssi_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    dbm = A.percent_to_dbm(F.col("x"))
    return samples(spark, sf_dir).select("event_id", F.round(A.rssi_to_amplitude(dbm), 6).alias("amplitude"), A.band(F.floor("x")).alias("band"))


@query()
def frame_psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frames(spark, sf_dir).select("frame", P.psd_summary(F.col("price"), 16, 20e6).alias("p"))
    return p.select("frame", "p.*")


@query()
def frame_stft(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = frames(spark, sf_dir).where(F.size("amplitude") >= 4)
    return long.select("frame", F.posexplode(P.stft(F.col("amplitude"), 4, 1)).alias("at", "magnitudes"))
