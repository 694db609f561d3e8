"""Queries over scalar formulas and frame arrays."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.functions import arrays as A
from echolake.functions import scalars as C
from echolake.registry import query
from echolake.sources.tables import FRAMES, SAMPLES, frames, samples

def _case(column: str, steps, top: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} < {edge} THEN '{name}'" for edge, name in steps) + f" ELSE '{top}' END"


@query(f"""WITH {SAMPLES} SELECT event_id, round(sin(radians(x)), 6) AS sine, round(degrees(x / 100), 5) AS degrees, greatest(least(x, 100.0), 10.0) AS clamped, round(x + (node - x) * 0.3 / pi(), 6) AS between_,
round(sqrt((x - 3) ** 2 + (node - 4) ** 2), 6) AS flat, round(sqrt((x - 3) ** 2 + (node - 4) ** 2 + (x / 7 - 5) ** 2), 6) AS solid, round(floor(x) / 48 * pi(), 6) AS pseudo_phase FROM s""")
def scalar_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.col("node").cast("double")
    return samples(spark, sf_dir).select(
        "event_id", F.round(F.sin(F.radians(F.col("x"))), 6).alias("sine"), F.round(F.degrees(F.col("x") / 100), 5).alias("degrees"), C.clamp(F.col("x"), 10.0, 100.0).alias("clamped"),
        F.round(C.lerp(F.col("x"), node, 0.3 / F.pi()), 6).alias("between_"), F.round(C.distance((F.col("x"), node), (F.lit(3.0), F.lit(4.0))), 6).alias("flat"),
        F.round(C.distance((F.col("x"), node, F.col("x") / 7), (F.lit(3.0), F.lit(4.0), F.lit(5.0))), 6).alias("solid"), F.round(C.pseudo_phase(F.floor(F.col("x"))), 6).alias("pseudo_phase"),
    )


@query(f"""WITH {SAMPLES}, c AS (SELECT event_id, x, least(greatest(x / 300, 0), 1) * 0.40 + least(greatest(floor(x / 10) / 30, 0), 1) * 0.20 + least(x * 2 / 250, 1) * 0.25 + least(x * 3 / 500, 1) * 0.15 AS persons FROM s)
SELECT event_id, {_case('x / 400', C.MOTION_LEVELS, 'high')} AS level, {_case('x / 350', C.GATE_ACTIONS, 'recalibrate')} AS action, round(persons / pi(), 6) AS persons_over_pi,
round(least(x / 50, 1) * least(x / 90, 1) * 0.9 * least(x / 110, 1) / pi(), 6) AS risk_over_pi,
round(CASE WHEN x / 100 >= 0.85 THEN 1.0 WHEN x / 100 <= 0.5 THEN 3.0 ELSE 1 + (0.85 - x / 100) / 0.35 * 2 END / pi(), 6) AS noise_over_pi, least(x, 100.0) AS motion_score FROM c""")
def scalar_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ladders and clamped scores; in units of pi where decimals would give rounding ties."""
    pi = F.pi()
    return samples(spark, sf_dir).select(
        "event_id", C.motion_level(F.col("x") / 400).alias("level"), C.gate_action(F.col("x") / 350).alias("action"),
        F.round(C.person_score(F.col("x"), F.floor(F.col("x") / 10), F.col("x") * 2, F.col("x") * 3) / pi, 6).alias("persons_over_pi"),
        F.round(C.identity_risk(F.col("x") / 50, F.col("x") / 90, F.lit(0.9), F.col("x") / 110) / pi, 6).alias("risk_over_pi"),
        F.round(C.noise_multiplier(F.col("x") / 100, 0.85, 0.5, 3.0) / pi, 6).alias("noise_over_pi"), C.motion_score(F.col("x")).alias("motion_score"),
    )


_LOW, _HIGH = (abs(math.sin(2 * math.pi * d / 0.06)) for d in (0.004, 0.012))


@query(f"""WITH {SAMPLES} SELECT event_id, round(sqrt(2 * 0.06::DOUBLE * (1 + x / 100) * 2.5 / (3.5 + x / 100)), 6) AS radius, round(x / 10000 * 4 * pi() / 0.06::DOUBLE, 6) AS phase, round(abs(sin(x / 10000 * 2 * pi() / 0.06::DOUBLE)), 6) AS variation,
round(CASE WHEN x / 200 BETWEEN {min(_LOW, _HIGH)!r}::DOUBLE AND {max(_LOW, _HIGH)!r}::DOUBLE THEN 1.0 WHEN x / 200 < {min(_LOW, _HIGH)!r}::DOUBLE THEN x / 200 / {min(_LOW, _HIGH)!r}::DOUBLE ELSE {max(_LOW, _HIGH)!r}::DOUBLE / (x / 200) END, 6) AS confidence FROM s""")
def fresnel_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    move = F.col("x") / 10_000
    return samples(spark, sf_dir).select(
        "event_id", F.round(C.fresnel_radius(2, 0.06, 1 + F.col("x") / 100, F.lit(2.5)), 6).alias("radius"), F.round(C.phase_change(move, 0.06), 6).alias("phase"),
        F.round(C.amplitude_variation(move, 0.06), 6).alias("variation"), F.round(C.breathing_confidence(F.col("x") / 200, 0.06, 0.004, 0.012), 6).alias("confidence"),
    )


@query(f"""WITH {SAMPLES} SELECT event_id, round(power(10, (-40 - (-50 - x / 8)) / 30), 5) AS metres, round(x * 1e-9 * 299792458 / 2, 6) AS flight, round(299792458 / (2 * (x + 20) * 1e6), 6) AS range_resolution,
round(299792458 / 5.8e9 * (1 + x / 50) / (2 * 1.5), 6) AS cross_range, round(299792458 / ((2 + x / 100) * 1e9) / 8, 8) AS pose_error FROM s""")
def ranging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select(
        "event_id", F.round(C.rssi_to_distance(-50 - F.col("x") / 8, -40.0, 3.0), 5).alias("metres"), F.round(C.time_of_flight_distance(F.col("x")), 6).alias("flight"),
        F.round(C.range_resolution((F.col("x") + 20) * 1e6), 6).alias("range_resolution"), F.round(C.cross_range_resolution(F.lit(5.8e9), F.lit(1.5), 1 + F.col("x") / 50), 6).alias("cross_range"),
        F.round(C.coherent_pose_error((2 + F.col("x") / 100) * 1e9), 8).alias("pose_error"),
    )


_DEBRIS = {"view": ("snow", "dry"), "click": ("wood", "damp"), "error": ("mixed", "wet"), "purchase": ("soil", "saturated"), "signup": ("metal", "dry")}
_DEBRIS_SQL = ", ".join(f"('{k}', {C.MATERIALS[m][0]}::DOUBLE, {C.MATERIALS[m][1]}::DOUBLE, {C.MOISTURE[w]}::DOUBLE)" for k, (m, w) in _DEBRIS.items())


@query(f"""WITH {SAMPLES}, d(kind, coefficient, spread, moisture) AS (VALUES {_DEBRIS_SQL}), f AS (SELECT event_id, x / 2 AS a, 47 + 20 * log10(1 + x / 500) AS loss, coefficient * moisture * 0.91 AS per_metre, spread FROM s JOIN d USING (kind)),
e AS (SELECT *, greatest(a - loss, 0) / per_metre AS depth FROM f) SELECT event_id, round(CASE WHEN a < 3 THEN 0 ELSE depth END, 5) AS depth, round(CASE WHEN a < 3 THEN 0.5 ELSE 0.3 + depth * 0.15 + spread END, 5) AS uncertainty,
round(CASE WHEN a < 3 THEN 0.9 ELSE greatest(1 - depth / 10, 0.3) END, 5) AS confidence, round(sqrt(1 / (1 / (1 + a / 9) ** 2 + 0.25)), 6) AS combined FROM e WHERE a < 3 OR depth <= 10""")
def debris_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths below debris of known materials, a broadcast table of five rows."""
    rows = [(k, *C.MATERIALS[m], C.MOISTURE[w]) for k, (m, w) in _DEBRIS.items()]
    debris = spark.createDataFrame(rows, "kind string, coefficient double, spread double, moisture double")
    s = samples(spark, sf_dir).join(F.broadcast(debris), "kind")
    found = C.depth_estimate(F.col("x") / 2, 1 + F.col("x") / 500, C.attenuation_factor(F.col("coefficient"), F.col("moisture"), F.lit(0.3)), F.col("spread"))
    s = s.select("event_id", found.alias("e"), F.round(C.combined_error(1 + F.col("x") / 18, F.lit(2.0)), 6).alias("combined")).where("e is not null")
    return s.select("event_id", *[F.round(f"e.{c}", 5).alias(c) for c in ("depth", "uncertainty", "confidence")], "combined")


_CORNERS = ((0.0, 0.0), (30.0, 5.0), (22.0, 40.0), (9.0, 18.0))


@query(f"""WITH {SAMPLES}, p AS (SELECT event_id, x / 10 AS x, (event_id % 97) / 2.03::DOUBLE AS y FROM s), g(xi, yi, xj, yj) AS (VALUES {', '.join(str((*a, *b)) for a, b in zip(_CORNERS, [_CORNERS[-1], *_CORNERS[:-1]], strict=True))}),
c AS (SELECT event_id, count(*) FILTER (WHERE (yi > y) <> (yj > y) AND x < (xj - xi) * (y - yi) / (yj - yi) + xi) AS n FROM p, g GROUP BY event_id)
SELECT 'rectangle' AS zone, 140.0::DOUBLE AS area, 10.0::DOUBLE AS cx, 12.0::DOUBLE AS cy, count(*) FILTER (WHERE x BETWEEN 3 AND 17 AND y BETWEEN 7 AND 17) AS n_inside FROM p
UNION ALL SELECT 'circle', round(pi() * 36, 6), 8.0::DOUBLE, 20.0::DOUBLE, count(*) FILTER (WHERE sqrt((x - 8) ** 2 + (y - 20) ** 2) <= 6) FROM p
UNION ALL SELECT 'polygon', (SELECT abs(sum(xi * yj - xj * yi)) / 2 FROM g), (SELECT avg(xi) FROM g), (SELECT avg(yi) FROM g), count(*) FILTER (WHERE n % 2 = 1) FROM c""")
def zone_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, centre and samples inside of a rectangle, a circle and a polygon."""
    p = samples(spark, sf_dir).select((F.col("x") / 10).alias("x"), (F.col("event_id") % 97 / 2.03).alias("y"))
    x, y = F.col("x"), F.col("y")
    centre = [sum(v) / len(_CORNERS) for v in zip(*_CORNERS, strict=True)]
    zones = {
        "rectangle": (14.0 * 10.0, 10.0, 12.0, C.in_rectangle(x, y, 3, 7, 17, 17)),
        "circle": (round(math.pi * 36, 6), 8.0, 20.0, C.in_circle(x, y, 8.0, 20.0, 6.0)),
        "polygon": (C.polygon_area(_CORNERS), *centre, C.in_polygon(x, y, _CORNERS)),
    }
    counts = p.agg(*[F.count_if(z[3]).alias(n) for n, z in zones.items()])
    rows = [F.struct(F.lit(n).alias("zone"), *[F.lit(v).alias(c) for c, v in zip(("area", "cx", "cy"), z, strict=False)], F.col(n).alias("n_inside")) for n, z in zones.items()]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query(f"""WITH {SAMPLES}, l AS (SELECT node, max(t) AS last, avg(x) AS rate FROM s GROUP BY node), u AS (SELECT node, rate, least(greatest(1.7e9 + 10000000 - last, 0) * 1e-8 * node, 1) AS uncertainty FROM l)
SELECT node, round(uncertainty / pi(), 6) AS uncertainty_over_pi, round(uncertainty * rate * 2 / (1 + node % 7) / pi(), 4) AS priority_over_pi FROM u""")
def sensing_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by the age of what is known of them and what it costs to sense them."""
    last = samples(spark, sf_dir).groupBy("node").agg(F.max("t").alias("last"), F.avg("x").alias("rate"))
    u = C.aged_uncertainty(F.lit(1.7e9 + 10_000_000) - F.col("last"), F.col("node") * 1e-8)
    p = C.refresh_priority(u, F.col("rate"), F.lit(2.0), 1 + F.col("node") % 7)
    return last.select("node", F.round(u / F.pi(), 6).alias("uncertainty_over_pi"), F.round(p / F.pi(), 4).alias("priority_over_pi"))


_INVERSE = ((0.02, 0.004, 0.0), (0.004, 0.03, 0.001), (0.0, 0.001, 0.05))


@query(f"""WITH {SAMPLES}, d AS (SELECT event_id, x / 10 - 5 AS a, (event_id % 31) - 14.5 AS b, (node % 17) - 8 AS c FROM s), m AS (SELECT event_id, (0.02::DOUBLE * a * a + 0.03::DOUBLE * b * b + 0.05::DOUBLE * c * c + 2 * 0.004::DOUBLE * a * b + 2 * 0.001::DOUBLE * b * c) / pi() AS m FROM d)
SELECT event_id, round(m, 6) AS m_over_pi, round(exp(-0.5 * m * pi()), 8) AS density FROM m""")
def gaussian_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = (F.col("x") / 10, (F.col("event_id") % 31).cast("double"), (F.col("node") % 17).cast("double"))
    m = C.mahalanobis_sq(point, (5.0, 14.5, 8.0), _INVERSE)
    return samples(spark, sf_dir).select("event_id", F.round(m / F.pi(), 6).alias("m_over_pi"), F.round(C.density(m), 8).alias("density"))


_TONES = f"WITH {FRAMES}, t AS (SELECT frame, unnest(amplitude) AS a, unnest(phase) AS p, unnest(range(len(amplitude))) AS i, len(amplitude) AS n FROM f)"


@query(f"""{_TONES}, z AS (SELECT frame, i, a * cos(p) AS re, a * sin(p) AS im FROM t), r AS (SELECT u.frame, u.i, v.i AS j, u.re * v.re + u.im * v.im AS re, u.im * v.re - u.re * v.im AS im FROM z u JOIN z v ON u.frame = v.frame AND u.i < v.i)
SELECT frame, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sqrt(re * re + im * im) / pi(), 5) AS amplitude_over_pi, round(re, 5) AS re, round(im, 5) AS im FROM r""")
def tone_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjugate products of all pairs of an order's lines, which are an array's antennas."""
    z = frames(spark, sf_dir).select("frame", F.posexplode(A.to_complex(F.col("amplitude"), F.col("phase"))).alias("i", "z"), A.to_complex(F.col("amplitude"), F.col("phase")).alias("all"))
    later = z.select("frame", "i", "z", F.expr("slice(all, i + 2, size(all))").alias("rest")).where(F.size("rest") > 0)
    r = later.select("frame", "i", F.posexplode(A.conjugate_product(F.transform("rest", lambda x: F.col("z")), F.col("rest"))).alias("k", "r"))
    polar = F.element_at(A.from_complex(F.array("r")), 1)
    return r.select("frame", "i", (F.col("i") + F.col("k") + 1).alias("j"), F.round(polar["amplitude"] / F.pi(), 5).alias("amplitude_over_pi"), F.round("r.re", 5).alias("re"), F.round("r.im", 5).alias("im"))


@query(f"""{_TONES}, q AS (SELECT frame, i, CASE WHEN 20 * log10(a + 1e-12) <= 20 THEN 0 ELSE a END AS a, n FROM t), w AS (SELECT frame, i, CASE WHEN n > 1 THEN a * (0.54 - 0.46 * cos(2 * pi() * i / (n - 1))) ELSE a END AS a FROM q)
SELECT frame, CAST(i AS INTEGER) AS i, round(a / (stddev_pop(a) OVER (PARTITION BY frame) + 1e-12), 4) AS v FROM w WHERE frame IN (SELECT frame FROM w GROUP BY frame HAVING stddev_pop(a) > 1e-6)""")
def frame_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise removal, Hamming window and scaling of frames that are not flat after the window."""
    spread = A.deviation(A.hamming(A.remove_noise(F.col("amplitude"), 20)))
    v = frames(spark, sf_dir).where(spread > 1e-6).select("frame", A.preprocess(F.col("amplitude"), 20).alias("v"))
    return v.select("frame", F.posexplode("v").alias("i", "v")).withColumn("v", F.round("v", 4))


@query(f"""WITH {FRAMES}, j AS (SELECT frame, amplitude AS s, len(amplitude) AS n, unnest(range(5)) AS i FROM f), p AS (SELECT *, i * (n - 1) / 4.0::DOUBLE AS place FROM j), k AS (SELECT *, CAST(floor(place) AS BIGINT) AS k, place - floor(place) AS u FROM p),
q AS (SELECT *, s[greatest(least(k - 1, n - 1), 0) + 1] AS p0, s[greatest(least(k, n - 1), 0) + 1] AS p1, s[greatest(least(k + 1, n - 1), 0) + 1] AS p2, s[greatest(least(k + 2, n - 1), 0) + 1] AS p3 FROM k)
SELECT frame, CAST(i AS INTEGER) AS i, CASE n WHEN 64 THEN 'esp32' WHEN 30 THEN 'intel5300' WHEN 56 THEN 'atheros' ELSE 'generic' END AS hardware,
round((((-0.5 * p0 + 1.5 * p1 - 1.5 * p2 + 0.5 * p3) * u + (p0 - 2.5 * p1 + 2.0 * p2 - 0.5 * p3)) * u + (-0.5 * p0 + 0.5 * p2)) * u / pi() + p1 / pi(), 5) AS v FROM q""")
def frame_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select("frame", A.hardware(F.col("amplitude")).alias("hardware"), F.posexplode(A.resample_cubic(F.col("amplitude"), 5)).alias("i", "v"))
    return f.select("frame", "i", "hardware", F.round(F.col("v") / F.pi(), 5).alias("v"))


@query(f"""{_TONES}, r AS (SELECT i, avg(a) AS m, var_pop(a) AS s FROM t GROUP BY i), z AS (SELECT frame, i, abs(a - m) / sqrt(greatest(s, 1e-6)) AS z, 1 / greatest(s, 1e-6) AS w FROM t JOIN r USING (i))
SELECT frame, round(sum(exp(-z * z / 2) * w) / sum(w), 5) AS coherence, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (WHERE z > 1.6), '') AS outliers, round(max(z), 4) AS most FROM z GROUP BY frame""")
def frame_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames against the mean and variance of each tone, a broadcast row: a frame has few tones."""
    f = frames(spark, sf_dir)
    tones = f.select(F.posexplode("amplitude").alias("i", "a")).groupBy("i").agg(F.avg("a").alias("m"), F.var_pop("a").alias("s"))
    profile = tones.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("profile"))
    met = f.crossJoin(F.broadcast(profile))
    reference, variance = (F.slice(F.col(f"profile.{c}"), F.lit(1), F.size("amplitude")) for c in ("m", "s"))
    met = met.withColumn("z", A.reference_z(F.col("amplitude"), reference, variance)).withColumn("variance", variance)
    out = F.array_join(F.transform(A.outlier_tones(F.col("z"), 1.6), lambda i: i.cast("string")), ",")
    return met.select("frame", F.round(A.weighted_coherence(F.col("z"), F.col("variance")), 5).alias("coherence"), out.alias("outliers"), F.round(F.array_max("z"), 4).alias("most"))


@query(f"WITH {FRAMES} SELECT frame, round(10 * log10(list_sum(list_transform(amplitude, lambda v: v * v)) / list_sum(list_transform(phase, lambda v: v * v))), 5) AS snr FROM f")
def frame_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("frame", F.round(C.snr_db(F.col("amplitude"), F.col("phase"), least=0.0), 5).alias("snr"))
