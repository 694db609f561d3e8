"""Queries that match and fuse rows, search vectors, triage and score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.operators import fusion as J
from echolake.operators import triage as T
from echolake.operators import vectors as V
from echolake.registry import query
from echolake.sources.tables import SAMPLES, samples, table

_SCORED = "w AS (SELECT l_orderkey, l_linenumber, exp(l_quantity / 10 - max(l_quantity / 10) OVER (PARTITION BY l_orderkey)) AS e FROM lineitem), a AS (SELECT l_orderkey, l_linenumber, e / sum(e) OVER (PARTITION BY l_orderkey) AS weight FROM w)"


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("score"))
    return J.softmax_weights(li, ["l_orderkey"], "score")


@query(f"WITH {_SCORED} SELECT l_orderkey, l_linenumber, round(weight, 6) AS weight FROM a")
def attention_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round("weight", 6).alias("weight"))


@query(f"WITH {_SCORED} SELECT l_orderkey, count(*) AS n, round(CASE WHEN count(*) > 1 THEN -sum(CASE WHEN weight > 0 THEN weight * ln(weight) END) / ln(count(*)) ELSE 1.0 END, 5) AS entropy FROM a GROUP BY l_orderkey")
def weight_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.entropy(_weights(spark, sf_dir), ["l_orderkey"], "weight").withColumn("entropy", F.round("entropy", 5))


@query("""WITH c AS (SELECT l_orderkey, count(*) AS n, (max(epoch_us(l_shipdate)) - min(epoch_us(l_shipdate))) / 1000000.0 AS spread,
  sum(l_quantity * l_extendedprice) / nullif(sum(l_extendedprice), 0) AS fused FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, n, spread, CASE WHEN spread <= 5184000 THEN round(fused, 5) END AS fused FROM c""")
def cycle_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a cycle, its lines as nodes; a guard of 60 days."""
    seconds = F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6
    return J.fuse_cycle(table(spark, sf_dir, "lineitem"), "l_orderkey", seconds, "l_quantity", "l_extendedprice", 5_184_000.0).withColumn("fused", F.round("fused", 5))


@query(f"WITH {SAMPLES} SELECT w.event_id AS window_id, count(*) AS n, round(avg(s.x), 5) AS mean FROM s JOIN s AS w ON s.node = w.node AND w.kind = 'error' AND s.t >= w.t AND s.t < w.t + 7200 GROUP BY w.event_id")
def range_join_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the two hours that begin at each error of the same node."""
    s = samples(spark, sf_dir)
    windows = s.where("kind = 'error'").select("node", F.col("event_id").alias("window_id"), F.col("t").alias("start"))
    met = J.range_join(s.select("node", "t", "x"), windows, ["node"], "t", "start", 7200.0)
    return met.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 5).alias("mean"))


@query(f"WITH {SAMPLES}, l AS (SELECT * FROM s WHERE kind = 'click'), r AS (SELECT node, t, max(x) AS x FROM s WHERE kind = 'error' GROUP BY node, t) SELECT l.event_id, r.t AS synced_at, r.x AS synced_x FROM l ASOF LEFT JOIN r ON l.node = r.node AND l.t >= r.t")
def asof_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last error of the node at or before each click."""
    s = samples(spark, sf_dir)
    errors = s.where("kind = 'error'").groupBy("node", "t").agg(F.max("x").alias("synced_x")).withColumn("synced_at", F.col("t"))
    return J.as_of(s.where("kind = 'click'").select("event_id", "node", "t"), errors, ["node"], "t", ["synced_at", "synced_x"]).select("event_id", "synced_at", "synced_x")


_POINT = ", ".join(f"embedding[{k + 1}]::DOUBLE AS p{k}" for k in range(3))


@query(f"WITH p AS (SELECT {_POINT} FROM embeddings) SELECT {', '.join(f'CAST(floor(p{k} / 0.1) AS BIGINT) AS v{k}' for k in range(3))}, count(*) AS n, {', '.join(f'round(avg(p{k}), 5) AS mean{k}' for k in range(3))} FROM p GROUP BY v0, v1, v2")
def voxel_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.voxels(table(spark, sf_dir, "embeddings"), [F.get("embedding", F.lit(k)).cast("double") for k in range(3)], 0.1)
    return out.select("v0", "v1", "v2", "n", *[F.round(f"mean{k}", 5).alias(f"mean{k}") for k in range(3)])


@query(f"WITH {SAMPLES}, b AS (SELECT kind, CAST(floor(t / 86400) AS BIGINT) AS bin, avg(x) AS v FROM s GROUP BY ALL) SELECT a.kind AS a, b.kind AS b, count(*) AS n, round(corr(a.v, b.v), 5) AS r FROM b AS a JOIN b ON a.bin = b.bin AND a.kind < b.kind GROUP BY a.kind, b.kind")
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.correlations(samples(spark, sf_dir), "kind", F.floor(F.col("t") / 86400), "x").withColumn("r", F.round("r", 5))


def _nearest_sql(distance: str) -> str:
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT q.vec_id AS query, v.vec_id, {distance} AS distance FROM v JOIN v AS q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS r FROM d) SELECT query, vec_id, round(distance, 6) AS distance FROM r WHERE r <= 5"""


@query(_nearest_sql("1 - list_cosine_similarity(v.e, q.e)"))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.nearest(table(spark, sf_dir, "embeddings"), "vec_id", F.col("vec_id") % 50 == 0, "embedding", "cosine", 5)
    return out.withColumn("distance", F.round("distance", 6))


@query(_nearest_sql("list_sum(list_transform(list_zip(v.e, q.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"))
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.nearest(table(spark, sf_dir, "embeddings"), "vec_id", F.col("vec_id") % 50 == 0, "embedding", "l2", 5)
    return out.withColumn("distance", F.round("distance", 6))


@query(_nearest_sql("list_sum(list_transform(list_zip(v.e, q.e), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END))").replace("round(distance, 6)", "CAST(distance AS INTEGER)"))
def sketch_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.sign_sketch(F.col("embedding")).alias("sketch"))
    return V.nearest(e, "vec_id", F.col("vec_id") % 50 == 0, "sketch", "hamming", 5).withColumn("distance", F.col("distance").cast("int"))


_TRIAGE = "t AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'immediate' WHEN o_orderpriority = '2-HIGH' THEN 'delayed' WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'minor' ELSE 'unknown' END AS status, o_custkey % 16 AS zone FROM orders)"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in T.STATUSES)


def _triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    status = F.when(p == "1-URGENT", "immediate").when(p == "2-HIGH", "delayed").when(p.isin("3-MEDIUM", "4-NOT SPECIFIED"), "minor").otherwise("unknown")
    return table(spark, sf_dir, "orders").select(status.alias("status"), (F.col("o_custkey") % 16).alias("zone"))


@query(f"WITH {_TRIAGE} SELECT zone, count(*) AS total, {_COUNTS} FROM t GROUP BY zone")
def triage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.counts(_triage(spark, sf_dir), ["zone"], "status")


@query(f"""WITH {_TRIAGE}, c AS (SELECT zone, count(*) AS total, {_COUNTS} FROM t GROUP BY zone), r AS (SELECT *, (immediate + delayed) / total AS ratio, immediate * 4 + delayed * 2 + minor // 2 AS need FROM c)
SELECT zone, CASE WHEN immediate >= 10 OR ratio > 0.5 THEN 'critical' WHEN immediate >= 5 OR ratio > 0.3 THEN 'major' WHEN immediate >= 1 OR ratio > 0.1 THEN 'moderate' ELSE 'minimal' END AS severity,
CASE WHEN need >= 100 THEN 'mutual_aid' WHEN need >= 50 THEN 'multi_agency' WHEN need >= 20 THEN 'enhanced' WHEN need >= 5 THEN 'standard' ELSE 'minimal' END AS resources FROM r""")
def mass_casualty(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.counts(_triage(spark, sf_dir), ["zone"], "status")
    return c.select("zone", T.severity("immediate", "delayed", "total").alias("severity"), T.resource_level("immediate", "delayed", "minor").alias("resources"))


_BINARY = "b AS (SELECT least(x / 80, 1.0) AS p, kind = 'error' AS y FROM s)"


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select(F.least(F.col("x") / 80, F.lit(1.0)).alias("p"), (F.col("kind") == "error").alias("y"))


@query(f"WITH {SAMPLES}, {_BINARY}, g AS (SELECT least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(p) AS p, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS y FROM b GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 5) AS ece FROM g")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.calibration_error(_binary(spark, sf_dir), "p", "y").withColumn("ece", F.round("ece", 5))


@query(f"""WITH {SAMPLES}, {_BINARY}, c AS (SELECT count(*) FILTER (WHERE p >= 0.5 AND y) AS tp, count(*) FILTER (WHERE p >= 0.5 AND NOT y) AS fp, count(*) FILTER (WHERE p < 0.5 AND y) AS fn, count(*) FILTER (WHERE p < 0.5 AND NOT y) AS tn FROM b)
SELECT tp, fp, fn, tn, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS false_positive_rate, round(coalesce(fn / nullif(fn + tp, 0), 0), 6) AS false_negative_rate FROM c""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.confusion(_binary(spark, sf_dir), "p", "y", 0.5)


@query(f"WITH {SAMPLES}, {_BINARY} SELECT round(avg(CASE WHEN p >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(CASE WHEN NOT y THEN 1.0 ELSE 0.0 END) FILTER (WHERE p >= 0.7), 6) AS risk FROM b")
def selective_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.selective(_binary(spark, sf_dir), "p", "y", 0.7)


@query("SELECT l_partkey, round(var_samp(l_quantity), 6) AS variance FROM lineitem GROUP BY l_partkey HAVING count(*) > 1 ORDER BY round(var_samp(l_quantity), 6) DESC, l_partkey LIMIT 56")
def top_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.var_samp("l_quantity"), 6).alias("variance"))
    return v.where("variance is not null").orderBy(F.desc("variance"), "l_partkey").limit(56)


@query("WITH s AS (SELECT doc_id, source, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM documents) SELECT source, count(*) AS n, count(DISTINCT split) > 1 AS leaks FROM s GROUP BY source")
def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test").alias("split"))
    return T.split_leaks(d, "source", "split")
