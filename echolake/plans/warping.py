"""Windows of samples against templates by dynamic time warping; searches by rotated sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.operators import sketches as S
from echolake.operators import vectors as V
from echolake.operators import warping as D
from echolake.registry import query
from echolake.sources.tables import SAMPLES, samples, table

ROWS = 12

# Templates are the first windows of three nodes; the recursion goes over anti-diagonals of the cost matrix.
_DTW = f"""WITH RECURSIVE {SAMPLES}, o AS (SELECT node, x / pi() AS x, row_number() OVER (PARTITION BY node ORDER BY ts, event_id) - 1 AS r FROM s WHERE x IS NOT NULL),
w AS (SELECT node, r // {ROWS} AS turn, list(x ORDER BY r) AS a FROM o GROUP BY node, r // {ROWS} HAVING count(*) = {ROWS}),
q AS (SELECT w.node, w.turn, t.node AS template, w.a, t.a AS b FROM w, w AS t WHERE t.turn = 0 AND t.node IN (1, 2, 3)),
p AS (SELECT node, turn, template, a, b, 0 AS s, [CASE WHEN i = 0 THEN 0.0 ELSE 'inf'::DOUBLE END FOR i IN range({ROWS + 1})] AS one, ['inf'::DOUBLE FOR i IN range({ROWS + 1})] AS two FROM q
UNION ALL SELECT node, turn, template, a, b, s + 1, list_transform(range({ROWS + 1}), lambda i: CASE WHEN i < 1 OR s + 1 - i < 1 OR s + 1 - i > {ROWS} OR abs(2 * i - s - 1) > 5 THEN 'inf'::DOUBLE
  ELSE abs(a[i] - b[s + 1 - i]) + least(one[i], one[i + 1], two[i]) END), one FROM p WHERE s < {2 * ROWS}),
d AS (SELECT node, turn, template, one[{ROWS + 1}] AS d FROM p WHERE s = {2 * ROWS}),
r AS (SELECT *, row_number() OVER (PARTITION BY node, turn ORDER BY d, template) AS r, lead(d) OVER (PARTITION BY node, turn ORDER BY d, template) AS next FROM d)
SELECT node, turn, CASE WHEN d <= 50 THEN 'node_' || template END AS template, round(d, 6) AS distance, d <= 50 AS recognized, round(CASE WHEN d > 50 THEN 0.0 WHEN next > 1e-10 THEN greatest(1 - d / next, 0.0) ELSE greatest(1 - d / 50, 0.0) END, 6) AS confidence FROM r WHERE r = 1"""


def gesture_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("x", F.col("x") / F.pi())
    held = D.windows(s, ["node"], ["ts", "event_id"], ["x"], ROWS)
    templates = held.where("turn = 0 AND node IN (1, 2, 3)").select(F.concat(F.lit("node_"), F.col("node").cast("string")).alias("name"), "sequence")
    return D.classify(held, ["node", "turn"], "sequence", templates)


@query(_DTW)
def dtw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of a node with the nearest template, its warping distance and the confidence."""
    out = gesture_matches(spark, sf_dir)
    return out.select("node", "turn", "template", F.round("distance", 6).alias("distance"), "recognized", F.round("confidence", 6).alias("confidence"))


@query()
def dtw_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of window and template, and how many of them were warped."""
    return gesture_matches(spark, sf_dir).agg((F.count(F.lit(1)) * 3).alias("pairs"), F.sum("pairs_warped").alias("warped"))


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@query()
def sketch_coverage_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the 8 nearest by cosine among 24 candidates: by bits of the rotated vector, and by the estimate from them."""
    e, asked = _asked(spark, sf_dir)
    coded = S.codes(e, "vec_id", "embedding")
    exact = V.nearest(e, "vec_id", F.col("vec_id") % 50 == 0, "embedding", "cosine", 8).select("query", F.col("vec_id").alias("key"))
    hits = exact
    for by, name in (("hamming", "bits"), ("cosine", "estimate")):
        hits = hits.join(S.candidates(coded, asked, 24, by).select("query", "key", F.lit(1).alias(name)), ["query", "key"], "left")
    return hits.groupBy("query").agg((F.count("bits") / 8).alias("by_bits"), (F.count("estimate") / 8).alias("by_estimate"))


@query()
def knn_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest by squared distance among 64 candidates by estimate."""
    out = S.search(table(spark, sf_dir, "embeddings"), "vec_id", F.col("vec_id") % 50 == 0, "embedding", 5, 64, "l2")
    return out.select("query", "vec_id", F.round("distance", 6).alias("distance"))
