"""Queries of rules, places and pose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolake.operators import fusion as J
from echolake.operators import semantic as R
from echolake.operators import signal as S
from echolake.operators import spatial as G
from echolake.registry import query
from echolake.sources.tables import SAMPLES, samples, table

_W = "PARTITION BY node ORDER BY ts, event_id"
_ORDER = ["ts", "event_id"]


@query(f"WITH {SAMPLES}, l AS (SELECT *, lag(kind) OVER ({_W}) AS b, CAST(floor(t) AS BIGINT) % 86400 AS sec FROM s) SELECT event_id, node FROM l WHERE b = 'view' AND kind <> 'view' AND (sec >= 79200 OR sec < 21600)")
def bed_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node leaves its bed zone between 22:00 and 06:00."""
    second = F.floor("t") % 86_400
    return R.leaves_zone(samples(spark, sf_dir), ["node"], _ORDER, "kind", "view", second, 79_200, 21_600).select("event_id", "node")


_RISK = f"""q AS (SELECT *, CAST(floor(t) AS BIGINT) AS sec FROM s), r AS (SELECT event_id, node, ts, least(100.0, 30.0 * count(*) FILTER (WHERE x > 40) OVER (PARTITION BY node ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)
 + 50 * coalesce(var_pop(x / 400) OVER (PARTITION BY node ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW), 0)) AS score FROM q)"""


@query(f"WITH {SAMPLES}, {_RISK}, c AS (SELECT *, lag(score) OVER ({_W}) AS b FROM (SELECT event_id, node, ts, round(score, 4) AS score FROM r)) SELECT event_id, node FROM c WHERE score >= 70 AND (b IS NULL OR b < 70)")
def elderly_fall_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Falls of a day and variance of an hour as a score of at most 100; its upward crossings."""
    s = samples(spark, sf_dir)
    falls = S.recent_count(s, ["node"], "t", F.col("x") > 40, 86_400)
    hour = Window.partitionBy("node").orderBy(F.col("t").cast("long")).rangeBetween(-3600, 0)
    score = F.round(F.least(F.lit(100.0), F.col("recent") * 30.0 + F.coalesce(F.var_pop(F.col("x") / 400).over(hour), F.lit(0.0)) * 50), 4)
    return R.risk_crossings(falls.withColumn("score", score), ["node"], _ORDER, "score", 70).select("event_id", "node")


_ZONES = "z AS (SELECT node, CAST(floor(t / 21600) AS BIGINT) AS slot, list_sort(list(DISTINCT kind)) AS zones FROM s GROUP BY ALL), b AS (SELECT *, coalesce(lag(zones) OVER (PARTITION BY node ORDER BY slot), []) AS was FROM z)"


@query(f"WITH {SAMPLES}, {_ZONES} SELECT node, slot, array_to_string(list_filter(zones, lambda k: NOT list_contains(was, k)), ',') AS entered, array_to_string(list_filter(was, lambda k: NOT list_contains(zones, k)), ',') AS left_zones FROM b")
def multi_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = samples(spark, sf_dir).groupBy("node", F.floor(F.col("t") / 21_600).alias("slot")).agg(F.array_sort(F.collect_set("kind")).alias("zones"))
    out = R.zone_changes(zones, ["node"], ["slot"], "zones")
    return out.select("node", "slot", F.array_join("entered", ",").alias("entered"), F.array_join("left", ",").alias("left_zones"))


@query(f"WITH {SAMPLES} SELECT e.event_id AS entry_id, x.event_id AS exit_id FROM s AS e JOIN s AS x ON e.node = x.node AND x.kind = 'view' AND e.kind <> 'view' AND e.t >= x.t AND e.t < x.t + 600")
def interval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of entries within ten minutes of an exit of the same node."""
    s = samples(spark, sf_dir)
    exits = s.where("kind = 'view'").select("node", F.col("event_id").alias("exit_id"), F.col("t").alias("start"))
    entries = s.where("kind <> 'view'").select("node", F.col("event_id").alias("entry_id"), "t")
    return J.range_join(entries, exits, ["node"], "t", "start", 600.0).select("entry_id", "exit_id")


_AGE = "epoch_us(TIMESTAMP '2000-01-01') / 1e6 - epoch_us(o_orderdate) / 1e6"
_LEVEL = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'critical' WHEN o_orderpriority = '2-HIGH' THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END"


@query(f"""WITH a AS (SELECT o_orderkey, {_LEVEL} AS priority FROM orders WHERE o_orderstatus = 'O' AND floor({_AGE}) > 86400 * 365)
SELECT o_orderkey, priority, CASE priority WHEN 'low' THEN 'medium' WHEN 'medium' THEN 'high' ELSE 'critical' END AS escalated FROM a""")
def escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    o = table(spark, sf_dir, "orders").withColumn("priority", F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").otherwise("low"))
    age = F.unix_micros(F.lit("2000-01-01").cast("timestamp")) / 1e6 - F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6
    return R.escalate(o, F.col("o_orderstatus") == "O", age, 86_400 * 365, "priority").select("o_orderkey", "priority", "escalated")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'F' THEN 'delayed' WHEN o_totalprice > 300000 AND o_orderstatus = 'O' THEN 'immediate' WHEN o_orderstatus = 'F' THEN 'minor' WHEN o_orderstatus = 'O' THEN 'delayed' ELSE 'unknown' END AS status FROM orders")
def triage_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "minor").when(s == "O", "delayed").otherwise("unknown")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.upgraded(status, F.col("o_totalprice") > 300_000).alias("status"))


_PLACED = "p AS (SELECT c_custkey, c_nationkey, c_acctbal / 1000 AS x, (c_custkey % 97) / 10.0::DOUBLE AS y FROM customer)"
_CENTRES = ((0, 2.05, 3.07), (1, 7.01, 5.03), (2, -0.49, 8.88))
_SEGMENTS = ((0, 0.0, 0.0, 9.0, 9.0), (1, 5.0, 0.0, 5.0, 9.0))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") / 1000).alias("x"), ((F.col("c_custkey") % 97) / 10.0).alias("y"))


@query(f"WITH {_PLACED}, c(centre, cx, cy) AS (VALUES {', '.join(map(str, _CENTRES))}) SELECT centre, c_custkey FROM p JOIN c ON (x - cx::DOUBLE) ** 2 + (y - cy::DOUBLE) ** 2 <= 4")
def query_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = spark.createDataFrame(_CENTRES, "centre int, cx double, cy double")
    return G.within_radius(_placed(spark, sf_dir), "x", "y", centres, 2.0).select("centre", "c_custkey")


@query(f"""WITH {_PLACED}, g(segment, x1, y1, x2, y2) AS (VALUES {', '.join(map(str, _SEGMENTS))}), t AS (SELECT *, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1))::DOUBLE / ((x2 - x1) ** 2 + (y2 - y1) ** 2)::DOUBLE)) AS t FROM p, g),
d AS (SELECT segment, c_custkey, sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) AS distance FROM t) SELECT segment, c_custkey, round(distance, 6) AS distance FROM d WHERE distance <= 0.5""")
def query_near_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.near_segments(_placed(spark, sf_dir), "x", "y", _SEGMENTS, 0.5).select("segment", "c_custkey", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_PLACED}, d AS (SELECT *, sqrt((x - 4) ** 2 + (y - 3) ** 2) + (c_custkey % 7) / 50.0::DOUBLE AS d FROM p), r AS (SELECT c_nationkey, arg_min(x, c_custkey) AS x0, arg_min(y, c_custkey) AS y0, arg_min(d, c_custkey) AS d0 FROM d GROUP BY 1),
e AS (SELECT c_nationkey, x - x0 AS a, y - y0 AS b, (d0 ** 2 - d ** 2 + x ** 2 - x0 ** 2 + y ** 2 - y0 ** 2) / 2 AS c FROM d JOIN r USING (c_nationkey)),
m AS (SELECT c_nationkey, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * c) AS ac, sum(b * c) AS bc FROM e GROUP BY 1)
SELECT c_nationkey, n, round((ac * bb - bc * ab) / (aa * bb - ab * ab), 5) AS px, round((aa * bc - ab * ac) / (aa * bb - ab * ab), 5) AS py FROM m WHERE n >= 4""")
def sensor_join_trilaterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _placed(spark, sf_dir).withColumn("d", F.sqrt((F.col("x") - 4) ** 2 + (F.col("y") - 3) ** 2) + (F.col("c_custkey") % 7) / 50.0)
    out = G.trilaterate(p, "c_nationkey", "c_custkey", "x", "y", "d").where("n >= 4")
    return out.select("c_nationkey", "n", F.round("px", 5).alias("px"), F.round("py", 5).alias("py"))


_POSE = """t AS (SELECT label, arg_min(embedding, vec_id) AS truth FROM embeddings GROUP BY label), j AS (SELECT vec_id, unnest(range(32)) AS k, embedding::DOUBLE[] AS e, truth::DOUBLE[] AS g FROM embeddings JOIN t USING (label)),
d AS (SELECT vec_id, sqrt((e[2 * k + 1] - g[2 * k + 1]) ** 2 + (e[2 * k + 2] - g[2 * k + 2]) ** 2) AS d FROM j)"""


@query(f"WITH {_POSE} SELECT vec_id, round(avg(d), 5) AS mpjpe, round(avg(CASE WHEN d <= 0.2 THEN 1.0 ELSE 0.0 END), 5) AS pck, round(avg(exp(-d * d / (2 * 0.5 * 0.5 * 0.3 * 0.3))), 5) AS oks FROM d GROUP BY vec_id")
def pose_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 32 joints, each label's first vector as the truth."""
    e = table(spark, sf_dir, "embeddings")
    truth = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("truth"))
    d = e.join(truth, "label").select("vec_id", R.joint_distances(F.col("embedding"), F.col("truth")).alias("d"))
    d = d.select("vec_id", R.mean_of(F.col("d")).alias("mpjpe"), R.percent_correct(F.col("d"), 0.2).alias("pck"), R.keypoint_similarity(F.col("d"), 0.5, 0.3).alias("oks"))
    return d.select("vec_id", *[F.round(c, 5).alias(c) for c in ("mpjpe", "pck", "oks")])


@query(f"""WITH {SAMPLES}, b AS (SELECT least(x / 80, 1.0) AS p, kind = 'error' AS y FROM s), c AS (SELECT p, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM b GROUP BY p),
w AS (SELECT pos, neg, pos * (coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS won FROM c), a AS (SELECT sum(won) / (sum(pos) * sum(neg)) AS auc FROM w) SELECT round(auc, 6) AS auc, round(2 * abs(auc - 0.5), 6) AS leakage FROM a""")
def auc_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = samples(spark, sf_dir).select(F.least(F.col("x") / 80, F.lit(1.0)).alias("p"), (F.col("kind") == "error").alias("y"))
    return R.auc(b, "p", "y").select(F.round("auc", 6).alias("auc"), F.round("leakage", 6).alias("leakage"))


@query(f"WITH {SAMPLES} SELECT node, count(*) AS n, round(avg(x), 5) AS mean, min(x) AS least, max(x) AS most, round(avg(CASE WHEN x BETWEEN 6 AND 30 THEN 1.0 ELSE 0.0 END), 5) AS valid FROM s GROUP BY node")
def vital_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).groupBy("node")
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 5).alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"), F.round(F.avg(F.col("x").between(6, 30).cast("int")), 5).alias("valid"))


@query("SELECT l_orderkey, round(atan2(sum(l_quantity * sin(l_extendedprice / 1000)), sum(l_quantity * cos(l_extendedprice / 1000))), 5) AS phase FROM lineitem GROUP BY l_orderkey")
def circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circular mean of phases, weighted by quantity."""
    q, a = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.atan2(F.sum(q * F.sin(a)), F.sum(q * F.cos(a))), 5).alias("phase"))
