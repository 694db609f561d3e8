"""Queries over the state store: history, retention, monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.operators import store as S
from echolake.registry import query
from echolake.sources.tables import SAMPLES, samples, table

_START, _END = "2024-01-05 00:00:00", "2024-01-12 00:00:00"
_NODES = (1, 2, 3, 5, 8, 13, 21)


@query(f"WITH {SAMPLES} SELECT event_id, node, kind, x FROM s WHERE node IN {_NODES} AND ts BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{_END}'")
def history_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.history(samples(spark, sf_dir), "node", _NODES, "ts", _START, _END).select("event_id", "node", "kind", "x")


@query(f"WITH {SAMPLES} SELECT event_id, node, kind FROM (SELECT *, lag(kind) OVER (PARTITION BY node ORDER BY ts, event_id) AS b FROM s) WHERE b IS NULL OR b <> kind")
def history_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.significant(samples(spark, sf_dir), "node", "kind", ["ts", "event_id"]).select("event_id", "node", "kind")


@query(f"WITH {SAMPLES} SELECT event_id, node FROM (SELECT *, row_number() OVER (ORDER BY node, ts, event_id) AS r FROM s) WHERE r <= 2000")
def history_row_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.row_budget(samples(spark, sf_dir), "node", ["ts", "event_id"], 2000).select("event_id", "node")


@query(f"WITH {SAMPLES} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at_text, node, kind AS state, event_id FROM s WHERE ts BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{_END}' ORDER BY at_text, node")
def logbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.between(samples(spark, sf_dir), "ts", _START, _END)
    return rows.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at_text"), "node", F.col("kind").alias("state"), "event_id").orderBy("at_text", "node")


@query(f"WITH {SAMPLES} SELECT node, kind, x, event_id FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts DESC, event_id DESC) AS r FROM s) WHERE r = 1")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest(samples(spark, sf_dir), "node", ["ts", "event_id"], ["kind", "x", "event_id"])


@query(f"WITH {SAMPLES}, e AS (SELECT *, kind || '.' || node AS entity_id FROM s) SELECT entity_id, split_part(entity_id, '.', 1) AS domain, count(*) AS n FROM e WHERE split_part(entity_id, '.', 1) = 'click' GROUP BY ALL")
def states_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = samples(spark, sf_dir).withColumn("entity_id", F.concat_ws(".", "kind", "node"))
    domain = F.substring_index("entity_id", ".", 1)
    return e.where(domain == "click").groupBy("entity_id", domain.alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, TRY_CAST(props ->> '$.k' AS DOUBLE) AS k FROM events WHERE TRY_CAST(props ->> '$.k' AS DOUBLE) > 50")
def attr_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("double")
    return samples(spark, sf_dir).select("event_id", k.alias("k")).where("k > 50")


@query("SELECT md5(props) AS attributes_id, props, count(*) AS n_states FROM events GROUP BY ALL")
def state_attr_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, attributes = S.dedup_attributes(samples(spark, sf_dir), "props")
    uses = states.groupBy("attributes_id").agg(F.count(F.lit(1)).alias("n_states"))
    return uses.join(attributes, "attributes_id").select("attributes_id", "props", "n_states")


@query(f"WITH {SAMPLES}, w AS (SELECT *, lag(kind) OVER o AS k, lag(props) OVER o AS p, row_number() OVER o AS r FROM s WINDOW o AS (PARTITION BY node ORDER BY ts, event_id)) SELECT event_id, (r = 1 OR k <> kind) AS state_changed FROM w WHERE NOT (r > 1 AND k = kind AND p = props)")
def state_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.upsert_events(samples(spark, sf_dir), "node", "kind", "props", ["ts", "event_id"]).select("event_id", "state_changed")


_CUTOFF = "1996-01-01 00:00:00"


@query(f"SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '{_CUTOFF}'")
def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.retention(table(spark, sf_dir, "orders"), "o_orderdate", _CUTOFF)[0].select("o_orderkey", "o_orderstatus")


@query(f"SELECT count(*) FILTER (WHERE o_orderdate < TIMESTAMP '{_CUTOFF}') AS deleted FROM orders")
def retention_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.retention(table(spark, sf_dir, "orders"), "o_orderdate", _CUTOFF)[1]


@query("""SELECT c_custkey, c_mktsegment FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '2000-01-01')
  AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey AND e.event_type = 'error' AND e.value > 40)""")
def orphaned_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp"))
    faults = samples(spark, sf_dir).where("kind = 'error' AND x > 40")
    return S.without_matches(table(spark, sf_dir, "customer"), [(recent, "o_custkey"), (faults, "node")], "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity <= 1 OR l_discount NOT BETWEEN 0 AND 0.095 OR l_extendedprice < 1000 OR l_quantity IS NULL")
def invalid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("l_quantity") <= 1) | ~F.col("l_discount").between(0, 0.095) | (F.col("l_extendedprice") < 1000) | F.col("l_quantity").isNull()
    return table(spark, sf_dir, "lineitem").where(bad).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


_TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.counts_by_table({t: table(spark, sf_dir, t) for t in _TABLES})


@query(f"WITH {SAMPLES} SELECT kind, CAST(floor(t / 3600) AS BIGINT) AS hour, count(*) AS n, count(DISTINCT node) AS nodes FROM s GROUP BY ALL")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("kind", F.floor(F.col("t") / 3600).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("node").alias("nodes"))


_SORTED = "list_sort(list(x))"


@query(f"""WITH {SAMPLES}, g AS (SELECT kind, {_SORTED} AS v, count(x) AS n, round(sum(x), 4) AS total, min(x) AS least, max(x) AS most, round(avg(x), 6) AS mean FROM s GROUP BY kind)
SELECT kind, n, total, least, most, mean, {', '.join(f"v[least(CAST(floor(n * {p}) AS BIGINT), n - 1) + 1] AS p{round(100 * p)}" for p in (0.5, 0.9, 0.95, 0.99))} FROM g""")
def metric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.floor_percentiles(samples(spark, sf_dir), ["kind"], "x", [0.5, 0.9, 0.95, 0.99])
    return out.withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 6))


@query(f"WITH {SAMPLES}, g AS (SELECT kind, {_SORTED} AS v, count(x) AS n FROM s GROUP BY kind) SELECT kind, v[CAST(ceil(n * 0.5) AS BIGINT)] AS p50, v[CAST(ceil(n * 0.95) AS BIGINT)] AS p95 FROM g")
def latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nearest_rank(samples(spark, sf_dir), ["kind"], "x", [0.5, 0.95])


@query(f"WITH {SAMPLES} SELECT node % 4 AS zone, CAST(floor(t / 300) * 300 AS BIGINT) AS bin, count(*) AS n, round(avg(x), 6) AS mean, max(x) AS most FROM s GROUP BY ALL")
def historical_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    zoned = samples(spark, sf_dir).withColumn("zone", F.col("node") % 4)
    return S.time_bins(zoned, ["zone"], "t", 300).groupBy("zone", "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.max("x").alias("most"))


@query(f"WITH {SAMPLES} SELECT CAST(isodow(ts) AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, round(avg(CASE WHEN x > 25 THEN 1.0 ELSE 0.0 END), 6) AS used FROM s GROUP BY ALL")
def hour_of_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    dow = F.weekday("ts") + 1
    return samples(spark, sf_dir).groupBy(dow.alias("dow"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("x") > 25, 1.0).otherwise(0.0)), 6).alias("used"))


@query(f"WITH {SAMPLES} SELECT event_id, node, x FROM s WHERE node = 7 AND ts >= TIMESTAMP '{_START}' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 5")
def query_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.between(samples(spark, sf_dir).where("node = 7"), "ts", _START, None)
    return rows.orderBy(F.desc("ts"), "event_id").offset(5).limit(20).select("event_id", "node", "x")


@query(f"""WITH {SAMPLES}, l AS (SELECT *, max(t) OVER () AS last FROM s)
SELECT count(*) AS requests, round(avg(x), 6) AS mean, max(x) AS most,
       round(100.0 * count(*) FILTER (WHERE kind = 'error') / greatest(count(*), 1), 6) AS error_percent
FROM l WHERE t >= last - 3600 * 24""")
def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    recent = s.crossJoin(F.broadcast(s.agg(F.max("t").alias("last")))).where(F.col("t") >= F.col("last") - 3600 * 24)
    errors = F.count_if(F.col("kind") == "error") * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1))
    return recent.agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg("x"), 6).alias("mean"), F.max("x").alias("most"), F.round(errors, 6).alias("error_percent"))


@query("""SELECT 'orders_' || lower(o_orderstatus) AS metric, count(*) AS value FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'orders_total', count(*) FROM orders UNION ALL SELECT 'orders_urgent', count(*) FILTER (WHERE o_orderpriority = '1-URGENT') FROM orders""")
def application_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    by_status = o.groupBy(F.concat(F.lit("orders_"), F.lower("o_orderstatus")).alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    whole = o.agg(F.count(F.lit(1)).alias("orders_total"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("orders_urgent"))
    return by_status.unionByName(whole.unpivot([], ["orders_total", "orders_urgent"], "metric", "value"))
