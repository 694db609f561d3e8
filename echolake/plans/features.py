"""Queries of feature families, detectors over runs of rows, and searches judged by sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.operators import features as M
from echolake.operators import vectors as V
from echolake.registry import query
from echolake.sources.tables import SAMPLES, samples, table

_ANTENNAS = """a AS (SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS antenna, [l_quantity, l_extendedprice / 1000, l_discount * 100, l_tax * 100] AS v FROM lineitem)"""


def _antennas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as antennas with four tones each."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    v = F.array("l_quantity", F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.row_number().over(order).alias("antenna"), v.alias("v"))


@query(f"""WITH {_ANTENNAS} SELECT frame, {', '.join(f'round(avg(v[{j + 1}]) / pi(), 5) AS mean{j}, round(var_pop(v[{j + 1}]) / pi(), 4) AS variance{j}' for j in range(4))},
max(list_max(v)) AS peak, round((max(list_max(v)) - min(list_min(v))) / pi(), 5) AS range_over_pi, round(sqrt(sum(list_sum(list_transform(v, lambda x: x * x))) / sum(len(v))) / pi(), 5) AS rms_over_pi FROM a GROUP BY frame""")
def amplitude_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.amplitude_features(_antennas(spark, sf_dir), "frame", "v", 4)
    tones = [F.round(F.get(c, F.lit(j)) / F.pi(), digits).alias(f"{c}{j}") for j in range(4) for c, digits in (("mean", 5), ("variance", 4))]
    return f.select("frame", *tones, "peak", F.round(F.col("dynamic_range") / F.pi(), 5).alias("range_over_pi"), F.round(F.col("rms") / F.pi(), 5).alias("rms_over_pi"))


@query(f"""WITH {_ANTENNAS}, d AS (SELECT frame, avg(v[2] - v[1]) AS d0, avg(v[3] - v[2]) AS d1, avg(v[4] - v[3]) AS d2 FROM a GROUP BY frame)
SELECT frame, {', '.join(f'round(d{j} / pi(), 5) AS difference{j}' for j in range(3))}, round((d1 - d0) / pi(), 5) AS gradient0, round((d2 - d1) / pi(), 5) AS gradient1 FROM d""")
def phase_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.phase_features(_antennas(spark, sf_dir), "frame", "v", 4)
    return f.select("frame", *[F.round(F.get(c, F.lit(j)) / F.pi(), 5).alias(f"{c}{j}") for c, n in (("difference", 3), ("gradient", 2)) for j in range(n)])


@query(f"""WITH {_ANTENNAS}, c AS (SELECT frame, antenna, list_transform(v, lambda x: x - list_avg(v)) AS c FROM a), n AS (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS norm FROM c),
r AS (SELECT x.frame, list_dot_product(x.c, y.c) / (x.norm * y.norm) AS r FROM n x JOIN n y ON x.frame = y.frame AND x.antenna < y.antenna WHERE x.norm > 1e-10 AND y.norm > 1e-10)
SELECT frame, count(*) AS n_pairs, round(avg(r), 5) AS mean_r, round(max(r), 5) AS most_r, round(stddev_pop(r), 5) AS spread_r FROM r GROUP BY frame""")
def correlation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.antenna_correlations(_antennas(spark, sf_dir), "frame", "antenna", "v")
    return f.select("frame", "n_pairs", *[F.round(c, 5).alias(c) for c in ("mean_r", "most_r", "spread_r")])


@query(f"""WITH {SAMPLES}, p AS (SELECT node, ts, event_id, CAST(floor(x / 20) AS BIGINT) AS persons, row_number() OVER w AS r, CAST(floor(x / 20) AS BIGINT) - coalesce(lag(CAST(floor(x / 20) AS BIGINT)) OVER w, 0) AS d FROM s WINDOW w AS (PARTITION BY node ORDER BY ts, event_id))
SELECT node, CAST(floor((r - 1) / 12) AS BIGINT) AS "window", count(*) AS n, CAST(sum(greatest(d, 0)) AS BIGINT) AS arrivals, CAST(sum(greatest(-d, 0)) AS BIGINT) AS departures, arg_max(persons, r) AS length FROM p GROUP BY ALL""")
def queue_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("persons", F.floor(F.col("x") / 20).cast("long"))
    return M.queue_rates(s, ["node"], ["ts", "event_id"], "persons", 12)


@query(f"""WITH {SAMPLES}, p AS (SELECT node, ts, event_id, kind <> 'error' AS p, kind <> 'error' AND x < 30 AS l FROM s), r AS (SELECT *, sum(CASE WHEN l THEN 0 ELSE 1 END) OVER (PARTITION BY node ORDER BY ts, event_id) AS run FROM p),
g AS (SELECT node, run, count(*) FILTER (WHERE l) AS n, count(*) FILTER (WHERE p) AS m FROM r GROUP BY node, run) SELECT node, CAST(sum(m) AS BIGINT) AS monitored, count(*) FILTER (WHERE n >= 3) AS episodes FROM g GROUP BY node""")
def apnea_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pauses of breathing of three samples in a row while somebody is there."""
    return M.episodes(samples(spark, sf_dir), ["node"], ["ts", "event_id"], F.col("kind") != "error", F.col("x") < 30, 3)


@query(f"""WITH {SAMPLES}, d AS (SELECT node, kind, coalesce(least(lead(t) OVER w - t, 7200), 0) AS stay, CASE WHEN coalesce(lag(kind) OVER w <> kind, true) THEN 1 ELSE 0 END AS entered FROM s WINDOW w AS (PARTITION BY node ORDER BY ts, event_id))
SELECT node, kind, CAST(sum(entered) AS BIGINT) AS visits, round(sum(stay), 2) AS seconds FROM d GROUP BY node, kind""")
def dwell_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dwell_by_zone(samples(spark, sf_dir), ["node"], ["ts", "event_id"], "t", "kind", 7200.0).withColumn("seconds", F.round("seconds", 2))


@query(f"""WITH {SAMPLES}, d AS (SELECT kind, CAST(floor(t / 86400) AS BIGINT) AS day, avg(x) AS x FROM s GROUP BY ALL), z AS (SELECT *, count(x) OVER w AS n, (x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) AS z FROM d WINDOW w AS (PARTITION BY kind ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, sum(CASE WHEN n >= 3 AND abs(z) > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY kind ORDER BY day ROWS 1 PRECEDING) AS held FROM z) SELECT kind, day, round(z, 5) AS z FROM h WHERE held = 2""")
def drift_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = samples(spark, sf_dir).groupBy("kind", F.floor(F.col("t") / 86_400).alias("day")).agg(F.avg("x").alias("x"))
    return M.drift_runs(d, ["kind"], "day", "x", 0.5, 2, 3).select("kind", "day", F.round("z", 5).alias("z"))


@query(f"""WITH {SAMPLES}, e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN upper(kind) || '.' || node WHEN event_id % 5 = 0 THEN kind ELSE kind || '.node_' || node END AS e, ts FROM s), v AS (SELECT *, regexp_matches(e, '^[a-z0-9_]+\\.[a-z0-9_]+$') AS valid FROM e)
SELECT event_id, valid, CASE WHEN valid THEN split_part(e, '.', 1) END AS domain, CASE WHEN valid THEN split_part(e, '.', 2) END AS name, regexp_matches(e, '^[A-Za-z0-9_-]{{1,64}}$') AS safe, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM v""")
def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_id") % 7 == 0, F.concat_ws(".", F.upper("kind"), "node")).when(F.col("event_id") % 5 == 0, F.col("kind")).otherwise(F.concat(F.col("kind"), F.lit(".node_"), F.col("node").cast("string")))
    s = samples(spark, sf_dir).select("event_id", name.alias("e"), F.floor(F.col("t") / 86_400).alias("day"))
    return s.select("event_id", M.entity_parts(F.col("e")).alias("p"), M.safe_id(F.col("e")).alias("safe"), "day").select("event_id", "p.*", "safe", "day")


_BITS = "list_sum(list_transform(list_zip(v.e, q.e), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END))"
_PAIRS = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT q.vec_id AS query, v.vec_id, {0} AS bits, len(q.e) AS n, 1 - list_cosine_similarity(v.e, q.e) AS distance FROM v JOIN v AS q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)".format(_BITS)


@query(f"WITH {_PAIRS} SELECT query, round(min(bits / n::DOUBLE), 6) AS novelty FROM d GROUP BY query")
def sketch_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the nearest sketch is, as a share of its bits."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.sign_sketch(F.col("embedding")).alias("sketch"), F.size("embedding").alias("bits"))
    found = V.nearest(e, "vec_id", F.col("vec_id") % 50 == 0, "sketch", "hamming", 1)
    return found.join(e.select(F.col("vec_id").alias("query"), "bits"), "query").groupBy("query").agg(F.round(F.min(F.col("distance") / F.col("bits")), 6).alias("novelty"))


@query(f"""WITH {_PAIRS}, r AS (SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY bits, vec_id) AS a, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS b FROM d)
SELECT query, count(*) FILTER (WHERE a <= 24 AND b <= 8) / 8.0::DOUBLE AS coverage FROM r GROUP BY query""")
def sketch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the 8 nearest by cosine that are among the 24 nearest by sketch."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", V.sign_sketch(F.col("embedding")).alias("sketch"))
    asked = F.col("vec_id") % 50 == 0
    rough = V.nearest(e, "vec_id", asked, "sketch", "hamming", 24).select("query", "vec_id", F.lit(1).alias("hit"))
    exact = V.nearest(e, "vec_id", asked, "embedding", "cosine", 8).select("query", "vec_id")
    return exact.join(rough, ["query", "vec_id"], "left").groupBy("query").agg((F.count("hit") / 8).alias("coverage"))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label),
d AS (SELECT vec_id, c.label, list_cosine_similarity(embedding::DOUBLE[], c) AS score FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, label) AS r FROM d) SELECT vec_id, label AS matched, round(score, 6) AS score FROM r WHERE r = 1""")
def fingerprint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label whose mean vector is nearest by cosine; the labels' means are broadcast."""
    e = table(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centre"))  # one vector a label
    both = centres.select((-F.col("label") - 1).cast("long").alias("key"), F.col("centre").alias("v")).unionByName(e.select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("v")))
    found = V.nearest_of(both.where("key < 0"), both.where("key >= 0"), "key", "v", "cosine", digits=9)
    return found.select(F.col("key").alias("vec_id"), (-F.col("nearest") - 1).cast("int").alias("matched"), F.round(1 - F.col("distance"), 6).alias("score"))
