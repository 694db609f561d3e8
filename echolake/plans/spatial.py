"""Maps, graphs and volumes over the supplied tables: Gaussian maps, minimum cuts, influence, tomography."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.operators import folds as K
from echolake.operators import gaussian as G
from echolake.operators import influence as I
from echolake.operators import partition as P
from echolake.operators import tomography as R
from echolake.registry import query
from echolake.sources.tables import FRAMES, SAMPLES, frames, samples, table

# One primitive a node: its place on a grid of 30 by 50 m, wide by its number, dense by what it measures.
_NODES = f"""{SAMPLES}, g AS (SELECT node, node % 30 + 0.25 AS x, node // 30 % 50 + 0.5 AS y, node % 3 + 0.5 AS z, 0.3 + 0.1 * (node % 4) AS sx, 0.3 + 0.1 * (node % 5) AS sy, 0.4::DOUBLE AS sz,
  avg(x) / 500 AS occupancy, 0.05 + 0.1 * (node % 9) AS confidence, min(t) AS first, max(t) AS last FROM s GROUP BY node)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("node")
    own = samples(spark, sf_dir).groupBy("node").agg((F.avg("x") / 500).alias("occupancy"), F.min("t").alias("first"), F.max("t").alias("last"))
    return own.select(
        "node", (n % 30 + 0.25).alias("x"), (F.floor(n / 30) % 50 + 0.5).alias("y"), (n % 3 + 0.5).alias("z"), (0.3 + 0.1 * (n % 4)).alias("sx"), (0.3 + 0.1 * (n % 5)).alias("sy"), F.lit(0.4).alias("sz"),
        "occupancy", (0.05 + 0.1 * (n % 9)).alias("confidence"), "first", "last",
    )


@query()
def gaussian_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of every room of 25 nodes after all observations: primitives by kind of event."""
    s, n = samples(spark, sf_dir), F.col("node")
    seen = s.select(
        "event_id", "ts", "t", F.floor(n / 25).alias("room"), "kind", (1.5 * (n % 5) + F.col("x") / 120).alias("x"), (1.5 * (F.floor(n / 5) % 5) + F.col("x") / 150).alias("y"), (F.col("x") / 300).alias("z"),
        F.lit(0.3).alias("sx"), F.lit(0.3).alias("sy"), F.lit(0.4).alias("sz"), (F.col("x") / 500).alias("occupancy"), (0.1 + 0.05 * (F.col("event_id") % 10)).alias("confidence"),
    )
    values = ["x", "y", "z", "sx", "sy", "sz", "occupancy", "confidence", "kind"]
    out = K.fold(seen, "room", ["ts", "event_id"], values, "t", "event_id", G.fuse())
    kept = G.latest(out.join(s.select("event_id", "ts"), "event_id"), ["room"], ["ts", "event_id"])
    return kept.select("room", "primitive", "n", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "occupancy", "confidence")])


@query(f"""WITH {_NODES}, d AS (SELECT node, confidence * exp(-greatest(1706700000 - last, 0) / (tau * (1 + ln(1 + (last - first) / tau)))) AS confidence FROM (SELECT *, 3600.0 * (1 + node % 24) AS tau FROM g))
SELECT node, round(confidence, 8) AS confidence FROM d WHERE confidence >= 0.02""")
def gaussian_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences of the nodes' primitives at a later time; the faded ones are gone."""
    out = G.faded(_nodes(spark, sf_dir), F.lit(1_706_700_000.0), 3600.0 * (1 + F.col("node") % 24))
    return out.select("node", F.round("confidence", 8).alias("confidence"))


def _erf(x: str) -> str:
    p, *c = G.ERF
    t = f"(1 / (1 + {p} * abs({x})))"
    poly = "0.0"
    for k in reversed(c):
        poly = f"(({poly} + {k}) * {t})"
    return f"(sign({x}) * (1 - {poly} * exp(-({x}) * ({x}))))"


@query(f"""WITH {_NODES}, w AS (SELECT node AS way, x AS ax, y AS ay, z AS az, x + 2 + node % 7 AS bx, y + node % 4 AS b_y, 1.0 AS bz FROM g),
m AS (SELECT way, occupancy, sqrt((bx - ax) ** 2 + (b_y - ay) ** 2 + (bz - az) ** 2) AS l, bx - ax AS dx, b_y - ay AS dy, bz - az AS dz, x - ax AS mx, y - ay AS my, z - az AS mz, sx, sy, sz FROM w, g),
h AS (SELECT *, greatest(0, least(1, (mx * dx + my * dy + mz * dz) / (l * l))) AS h FROM m), near AS (SELECT * FROM h WHERE sqrt((mx - h * dx) ** 2 + (my - h * dy) ** 2 + (mz - h * dz) ** 2) <= 3),
q AS (SELECT *, (dx / l / sx) ** 2 + (dy / l / sy) ** 2 + (dz / l / sz) ** 2 AS a, dx / l * mx / sx ** 2 + dy / l * my / sy ** 2 + dz / l * mz / sz ** 2 AS b, (mx / sx) ** 2 + (my / sy) ** 2 + (mz / sz) ** 2 AS c FROM near),
i AS (SELECT way, occupancy, exp(-(c - b * b / a) / 2) * sqrt(pi() / (2 * a)) * ({_erf("(sqrt(a / 2) * (l - b / a))")} + {_erf("(sqrt(a / 2) * b / a)")}) AS i FROM q),
t AS (SELECT way, count(*) AS n, sum(occupancy * i) AS depth FROM i WHERE i > 1e-12 GROUP BY way)
SELECT way, coalesce(n, 0) AS n, round(coalesce(depth, 0), 6) AS depth, round(20 * log10(299792458 / 2.437e9 / (4 * pi() * sqrt((bx - ax) ** 2 + (b_y - ay) ** 2 + (bz - az) ** 2)) * exp(-coalesce(depth, 0))), 5) AS gain_db FROM w LEFT JOIN t USING (way)""")
def line_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of a link from each node through the primitives near its line."""
    g, n = _nodes(spark, sf_dir), F.col("node")
    ways = g.select(n.alias("way"), *[F.col(c).alias(f"a{c}") for c in "xyz"], (F.col("x") + 2 + n % 7).alias("bx"), (F.col("y") + n % 4).alias("by"), F.lit(1.0).alias("bz"))
    out = G.channel_gain(g, ways, "way", 2.437e9)
    return out.select("way", "n", F.round("depth", 6).alias("depth"), F.round("gain_db", 5).alias("gain_db"))


# A frame has some tones only, so SQL tries all sides that hold the first one.
@query(f"""WITH {FRAMES}, a AS (SELECT frame, list_transform(amplitude, lambda v: v / 10.0) AS s, len(amplitude) AS n FROM f),
e AS (SELECT frame, n, i, j, CASE WHEN abs(s[i] - s[j]) <= 1e-9 THEN 1e6 ELSE 1 / abs(s[i] - s[j]) END AS w FROM a, range(1, 21) AS x(i), range(1, 21) AS y(j) WHERE i < j AND j <= n AND n >= 4),
l AS (SELECT * FROM e WHERE w > 0.5), m AS (SELECT frame, n, unnest(range(1, (1 << n) - 1, 2)) AS side FROM (SELECT DISTINCT frame, n FROM l)),
c AS (SELECT m.frame, m.side, coalesce(sum(w) FILTER (WHERE (side >> (i - 1)) & 1 <> (side >> (j - 1)) & 1), 0) AS cut FROM m JOIN l USING (frame) GROUP BY m.frame, m.side),
b AS (SELECT frame, min(cut) AS cut FROM c GROUP BY frame) SELECT frame, n, round(cut, 6) AS cut FROM a LEFT JOIN b USING (frame)""")
def min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight at which the tones of a frame part most easily; null where they are too few or nothing joins them."""
    f = frames(spark, sf_dir).select(F.struct("frame", F.size("amplitude").cast("long").alias("n")).alias("of"), F.transform("amplitude", lambda v: v / 10.0).alias("s"))
    return P.partition_tones(f, "of", F.col("s")).select("of.frame", "of.n", F.round("cut", 6).alias("cut"))


# Eight nodes a mesh: SQL tries all sides, as bits.
@query(f"""WITH {SAMPLES}, r AS (SELECT floor(t / 21600) AS cycle, node % 8 AS a, event_id // 3 % 8 AS b, x / 400 AS coupling FROM s),
u AS (SELECT cycle, least(a, b) AS a, greatest(a, b) AS b, max(greatest(floor(greatest(coupling, 0) * 64), (coupling > 0)::INT)) / 64 AS w FROM r WHERE a <> b GROUP BY 1, 2, 3),
p AS (SELECT cycle, bit_or((1 << a::INT) | (1 << b::INT)) AS present FROM u GROUP BY cycle), m AS (SELECT cycle, present, range AS side FROM p, range(1, 255) WHERE range & present = range AND range <> present),
c AS (SELECT m.cycle, m.present, m.side, coalesce(sum(w) FILTER (WHERE (side >> a::INT) & 1 <> (side >> b::INT) & 1), 0) AS cut FROM m JOIN u USING (cycle) GROUP BY m.cycle, m.present, m.side)
SELECT cycle::BIGINT AS cycle, bit_count(present)::INT AS n, min(cut)::DOUBLE AS cut, bit_count(present) >= 3 AND min(cut) <= 0.25 AS at_risk FROM c GROUP BY cycle, present""")
def mesh_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weakest cut of the mesh of every six hours, and whether it is about to fall apart."""
    s = samples(spark, sf_dir)
    edges = s.select(F.floor(F.col("t") / 21600).alias("cycle"), (F.col("node") % 8).alias("a"), (F.floor(F.col("event_id") / 3) % 8).alias("b"), (F.col("x") / 400).alias("coupling"))
    return P.mesh_risk(edges, ["cycle"], "a", "b", "coupling").select("cycle", "n", "cut", "at_risk")


@query("""WITH RECURSIVE e AS (SELECT s_nationkey AS u, c_nationkey AS v, sum(l_extendedprice) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
i AS (SELECT DISTINCT u AS node FROM e UNION SELECT v FROM e), o AS (SELECT u, sum(w) AS out FROM e GROUP BY u),
m AS (SELECT a.node AS v, list(coalesce(e.w / o.out, 0) ORDER BY b.node) AS shares FROM i AS a CROSS JOIN i AS b LEFT JOIN e ON e.v = a.node AND e.u = b.node LEFT JOIN o ON o.u = b.node GROUP BY a.node),
k AS (SELECT list(shares ORDER BY v) AS m, count(*)::DOUBLE AS n FROM m), z AS (SELECT list(CASE WHEN out IS NULL THEN 1.0 ELSE 0.0 END ORDER BY node) AS idle FROM i LEFT JOIN o ON u = node),
r AS (SELECT 0 AS round, list_transform(idle, lambda x: 1 / n) AS r FROM k, z
UNION ALL SELECT round + 1, list_transform(m, lambda row: 0.15 / n + 0.85 * (list_dot_product(row, r) + list_dot_product(idle, r) / n)) FROM r, k, z WHERE round < 200)
SELECT node, round(rank, 8) AS rank FROM (SELECT unnest((SELECT list(node ORDER BY node) FROM i)) AS node, unnest(r) AS rank FROM r WHERE round = 200)""")
def nation_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by the goods that flow to them from others."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    flows = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    ranks, _ = I.influence(flows, "s_nationkey", "c_nationkey", "l_extendedprice")
    return ranks.select("node", F.round("rank", 8).alias("rank"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links across a room by node and kind of event, and the mean of what they measure as their attenuation."""
    own = samples(spark, sf_dir).groupBy("node", "kind").agg((F.avg("x") / 40).alias("attenuation"))
    n, k = F.col("node"), F.length("kind")
    side = n % 2 == 0
    at = {
        "link": n * 16 + k, "tx": F.when(side, 0.0).otherwise((n % 13) * 0.5), "ty": F.when(side, (n % 13) * 0.5).otherwise(0.0), "tz": 0.5 + (n % 5) * 0.5,
        "rx": F.when(side, 6.0).otherwise((n % 11 + k) % 13 * 0.5), "ry": F.when(side, (n % 11 + k) % 13 * 0.5).otherwise(6.0), "rz": 0.5 + (n % 3) * 0.5,
    }
    return own.select(*[e.cast("long" if c == "link" else "double").alias(c) for c, e in at.items()], "attenuation")


_VOXELS = f"""{SAMPLES}, k AS (SELECT node, length(kind) AS k FROM s GROUP BY node, kind),
l AS (SELECT node * 16 + k AS link, CASE WHEN node % 2 = 0 THEN 0 ELSE (node % 13) * 0.5 END::DOUBLE AS tx, CASE WHEN node % 2 = 0 THEN (node % 13) * 0.5 ELSE 0 END::DOUBLE AS ty, 0.5::DOUBLE + (node % 5) * 0.5 AS tz,
  CASE WHEN node % 2 = 0 THEN 6 ELSE (node % 11 + k) % 13 * 0.5 END::DOUBLE AS rx, CASE WHEN node % 2 = 0 THEN (node % 11 + k) % 13 * 0.5 ELSE 6 END::DOUBLE AS ry, 0.5::DOUBLE + (node % 3) * 0.5 AS rz FROM k),
v AS (SELECT iz * 64 + iy * 8 + ix AS voxel, (ix + 0.5::DOUBLE) * 0.75 AS vx, (iy + 0.5::DOUBLE) * 0.75 AS vy, (iz + 0.5::DOUBLE) * 0.75 AS vz FROM range(8) AS a(ix), range(8) AS b(iy), range(4) AS c(iz)),
p AS (SELECT *, (rx - tx) ** 2 + (ry - ty) ** 2 + (rz - tz) ** 2 AS q, (vx - tx) * (rx - tx) + (vy - ty) * (ry - ty) + (vz - tz) * (rz - tz) AS d FROM l, v),
h AS (SELECT *, greatest(0, least(1, d / q)) AS h, greatest(sqrt(0.06::DOUBLE * sqrt(q) / 4), 0.75) AS radius FROM p),
w AS (SELECT link, voxel, 1 - sqrt((vx - tx - h * (rx - tx)) ** 2 + (vy - ty - h * (ry - ty)) ** 2 + (vz - tz - h * (rz - tz)) ** 2) / radius AS weight FROM h)"""


@query(f"WITH {_VOXELS} SELECT link, count(*) AS voxels, round(sum(weight), 6) AS weight FROM w WHERE weight > 1e-9 GROUP BY link")
def tomography_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many voxels lie in a link's zone, and how much of it they are."""
    w = R.link_weights(_links(spark, sf_dir), R.Grid()).where("weight > 1e-9")
    return w.groupBy("link").agg(F.count(F.lit(1)).alias("voxels"), F.round(F.sum("weight"), 6).alias("weight"))


@query()
def tomography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The occupied voxels of the room after the links' attenuations."""
    grid = R.Grid()
    links, measured = R.ways(_links(spark, sf_dir))
    found = R.reconstruct(R.link_weights(links, grid), measured, grid)
    return R.voxels(spark, found, grid).select("voxel", "x", "y", "z", F.round("density", 6).alias("density"))
