"""Edge detectors over snapshots of rooms; counts of rows are scaled down, as a room has some dozens of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.operators import edge as E
from echolake.operators import folds as K
from echolake.plans.temporal import _ROOM, _recursion, _room
from echolake.registry import query
from echolake.sources.tables import SAMPLES

_ORDER = ["ts", "event_id"]
_VIEW = f"{SAMPLES}, o AS (SELECT node, event_id, ts, kind, {_ROOM}, row_number() OVER (PARTITION BY node ORDER BY ts, event_id) AS r FROM s)"


def _runs(of: str, conditions: dict[str, str], place: str = "r") -> str:
    """Columns of how many rows on end meet each condition."""
    w = f"OVER (PARTITION BY node ORDER BY {place})"
    return f"SELECT *, {', '.join(f'{place} - coalesce(max(CASE WHEN NOT ({c}) THEN {place} END) {w}, 0) AS {n}' for n, c in conditions.items())} FROM {of}"


def _picked(candidates: str, pauses: dict[str, int]) -> str:
    """Tables of the candidates (node, event_id, r, alert, value) that keep their pause."""
    wait = f"CASE alert {' '.join(f'WHEN {k!r} THEN {n}' for k, n in pauses.items())} END"
    return f"""c AS ({candidates}), n AS (SELECT c.*, (SELECT min(d.r) FROM c d WHERE d.node = c.node AND d.alert = c.alert AND d.r >= c.r + {wait.replace('alert', 'c.alert', 1)}) AS following FROM c WHERE {wait} IS NOT NULL),
k AS (SELECT * FROM n WHERE r = (SELECT min(m.r) FROM n m WHERE m.node = n.node AND m.alert = n.alert) UNION ALL SELECT n.* FROM k JOIN n ON n.node = k.node AND n.alert = k.alert AND n.r = k.following)
SELECT node, event_id, alert, round(value / pi(), 6) AS value_over_pi FROM k UNION ALL SELECT node, event_id, alert, round(value / pi(), 6) FROM c WHERE {wait} IS NULL"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("node", "event_id", "alert", F.round(F.col("value") / F.pi(), 6).alias("value_over_pi"))


@query(f"""WITH {_VIEW}, a AS ({_runs('o', {'here': "presence AND motion / 10 > 0.005", 'gone': "NOT (presence AND motion / 10 > 0.005)"})}),
b AS (SELECT *, coalesce(last_value(CASE WHEN here >= 2 THEN true WHEN gone >= 2 THEN false END IGNORE NULLS) OVER (PARTITION BY node ORDER BY r), false) AS inside FROM a),
d AS (SELECT *, lag(inside, 1, false) OVER (PARTITION BY node ORDER BY r) AS before FROM b),
e AS ({_runs('d', {'held': "inside AND NOT breathing >= 9", 'still': "inside AND NOT motion / 4 > 0.02"})}),
f AS (SELECT node, event_id, unnest([
  CASE WHEN inside AND NOT before THEN {{'alert': 'entry', 'value': 1.0::DOUBLE}} END, CASE WHEN NOT inside AND before THEN {{'alert': 'exit', 'value': 1.0::DOUBLE}} END,
  CASE WHEN inside AND breathing >= 9 AND r % 7 = 0 THEN {{'alert': 'breathing', 'value': (breathing - 5)::DOUBLE}} END, CASE WHEN held = 3 THEN {{'alert': 'extraction', 'value': held / 20.0::DOUBLE}} END,
  CASE WHEN still = 4 THEN {{'alert': 'immobile', 'value': still / 20.0::DOUBLE}} END]) AS z FROM e)
SELECT node, event_id, z.alert AS alert, round(z.value / pi(), 6) AS value_over_pi FROM f WHERE z IS NOT NULL""")
def confined_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _room(spark, sf_dir).withColumns({"breathing": F.col("breathing") - 5, "variance": F.col("motion") / 10, "motion": F.col("motion") / 4})
    return _shown(E.confined_space(s, "node", _ORDER, "event_id", "presence", "breathing", "motion", "variance", settle=2, breathless=3, immobile=4, report=7))


@query(f"""WITH RECURSIVE {_VIEW}, h AS (SELECT *, least(greatest(persons, 0), 255) AS heads FROM o),
a AS ({_runs('h', {'crowd': 'heads > 2', 'wild': 'motion * 4 > 0.6 AND presence'})}),
b AS (SELECT *, lag(heads, 1, 0) OVER (PARTITION BY node ORDER BY r) AS former, count(*) FILTER (heads BETWEEN 1 AND 2) OVER (PARTITION BY node ORDER BY r) AS fine, count(*) FILTER (heads > 0) OVER (PARTITION BY node ORDER BY r) AS taken FROM a),
{_picked("SELECT node, event_id, r, 'count' AS alert, heads::DOUBLE AS value FROM b WHERE heads <> former UNION ALL SELECT node, event_id, r, 'violation', heads FROM b WHERE crowd >= 2 UNION ALL SELECT node, event_id, r, 'turbulent', motion * 4 FROM b WHERE wild >= 2 UNION ALL SELECT node, event_id, r, 'compliance', CASE WHEN taken = 0 THEN 100.0 ELSE fine * 100.0 / taken END FROM b WHERE r % 10 = 0", {'violation': 6, 'turbulent': 5})}""")
def clean_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _room(spark, sf_dir).withColumn("motion", F.col("motion") * 4)
    return _shown(E.clean_room(s, "node", _ORDER, "event_id", "persons", "presence", "motion", most=2, crowded=2, turbulent=2, report=10, pauses=(6, 5)))


@query(f"""WITH RECURSIVE {_VIEW}, v AS (SELECT *, heart * 1.1 - 25 AS rate, row_number() OVER (PARTITION BY node ORDER BY r) AS place FROM o WHERE presence),
m AS (SELECT node, place, rate AS mean FROM v WHERE place = 1 UNION ALL SELECT v.node, v.place, m.mean + 0.1 * (v.rate - m.mean) FROM m JOIN v ON v.node = m.node AND v.place = m.place + 1),
d AS (SELECT v.*, m.mean, v.rate - lag(v.rate) OVER (PARTITION BY v.node ORDER BY v.place) AS step FROM v JOIN m ON v.node = m.node AND v.place = m.place),
a AS ({_runs('d', {'fast': 'rate > 100', 'slow': 'rate < 50'}, 'place')}),
b AS (SELECT *, CASE WHEN count(step) OVER w = 8 THEN sqrt(avg(step * step) OVER w) * 17 END AS rmssd FROM a WINDOW w AS (PARTITION BY node ORDER BY place ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
{_picked("SELECT node, event_id, r, 'tachycardia' AS alert, rate AS value FROM b WHERE fast >= 2 UNION ALL SELECT node, event_id, r, 'bradycardia', rate FROM b WHERE slow >= 2 UNION ALL SELECT node, event_id, r, 'missed_beat', rate FROM b WHERE (mean - rate) / mean > 0.3 UNION ALL SELECT node, event_id, r, 'variability', rmssd FROM b WHERE rmssd < 10 OR rmssd > 120", dict.fromkeys(('tachycardia', 'bradycardia', 'missed_beat', 'variability'), 6))}""")
def heart_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent persons have no heart rate."""
    s = _room(spark, sf_dir).withColumn("heart", F.when(F.col("presence"), F.col("heart") * 1.1 - 25))
    return _shown(E.heart_rhythm(s, "node", _ORDER, "event_id", "heart", sustained=2, window=8, pause=6))


@query(f"""WITH {_VIEW}, v AS (SELECT *, (breathing - 6) * 3 AS b, heart * 1.5 - 40 AS h FROM o),
a AS ({_runs('v', {'none': 'b < 1', 'sb': 'b > 0 AND b < 12', 'fb': 'b > 25', 'sh': 'h > 0 AND h < 50', 'fh': 'h > 120'})}),
m AS (SELECT *, avg(b) OVER w AS bm, avg(h) OVER w AS hm FROM a WINDOW w AS (PARTITION BY node ORDER BY r ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
u AS (SELECT node, event_id, 'apnea' AS alert, none::DOUBLE AS value FROM m WHERE none >= 2 UNION ALL SELECT node, event_id, 'bradypnea', b FROM m WHERE sb >= 3 UNION ALL SELECT node, event_id, 'tachypnea', b FROM m WHERE fb >= 3
  UNION ALL SELECT node, event_id, 'bradycardia', h FROM m WHERE sh >= 3 UNION ALL SELECT node, event_id, 'tachycardia', h FROM m WHERE fh >= 3 UNION ALL SELECT node, event_id, 'breathing_mean', bm FROM m WHERE r % 10 = 0 UNION ALL SELECT node, event_id, 'heart_mean', hm FROM m WHERE r % 10 = 0)
SELECT node, event_id, alert, round(value / pi(), 6) AS value_over_pi FROM u""")
def vital_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _room(spark, sf_dir).withColumns({"breathing": (F.col("breathing") - 6) * 3, "heart": F.col("heart") * 1.5 - 40})
    return _shown(E.vital_trend(s, "node", _ORDER, "event_id", "breathing", "heart", lasting=3, apnea=2, window=10))


@query(f"WITH {_VIEW} SELECT node, dayofweek(ts) AS day, hour(ts) AS hour, count(*) AS n, round(avg(presence::INT), 6) AS occupied, round(coalesce(avg(greatest(persons, 0)) FILTER (presence), 0.0), 6) AS heads, avg(presence::INT) >= 0.1 AS used FROM o GROUP BY ALL")
def occupancy_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.occupancy_schedule(_room(spark, sf_dir), "node", "ts", "presence", "persons")
    return out.select("node", "day", F.col("hour").cast("long").alias("hour"), "n", F.round("occupied", 6).alias("occupied"), F.round("heads", 6).alias("heads"), "used").withColumn("day", F.col("day").cast("long"))


@query(f"WITH {_VIEW}, a AS ({_runs('o', {'late': 'presence AND (hour(ts) >= 22 OR hour(ts) < 6)'})}) SELECT node, event_id, hour(ts) AS hour FROM a WHERE late >= 2")
def after_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.after_hours(_room(spark, sf_dir), "node", _ORDER, "event_id", "ts", "presence", long=2).withColumn("hour", F.col("hour").cast("long"))


@query(_recursion(
    {"n": "0", "occ": "false", "against": "0", "mean": "0.0::DOUBLE"},
    [{"next_n": "n + 1", "next_mean": "mean * 0.9 + v * 0.1", "seen": "CASE WHEN presence <> occ THEN against + 1 ELSE 0 END"}, {"turn": "seen >= CASE WHEN occ THEN 2 ELSE 3 END"}, {"next_occ": "occ <> turn", "next_against": "CASE WHEN turn THEN 0 ELSE seen END"}],
    {"occupied BOOLEAN": "next_occ", "activity_over_pi DOUBLE": "round(CASE WHEN next_mean > 0.3 THEN 1.0 ELSE next_mean END / pi(), 6)", "countdown DOUBLE": "CASE WHEN next_occ AND next_against > 0 THEN 1 - next_against / 2.0 END"}, "next_n % 3 = 0", "kind <> 'error' AS presence, x / 150 AS v",
))
def hvac_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _room(spark, sf_dir).withColumns({"score": F.col("presence").cast("double"), "motion": F.col("motion") * 400 / 150})
    out = K.fold(s, "node", _ORDER, ["score", "motion"], "u", "event_id", K.occupied_zone(arrive=3, leave=2, every=3))
    return out.select("node", "event_id", "occupied", F.round(F.col("activity") / F.pi(), 6).alias("activity_over_pi"), "countdown")


@query(_recursion(
    {"phase": "0", "cnt": "0", "stayed": "0", "told": "0", "rest": "0"},
    [
        {"less": "greatest(rest - 1, 0)", "up": "stayed + CASE WHEN presence AND (phase = 3 OR (phase = 2 AND x / 100 < 0.5)) THEN 1 ELSE 0 END", "missed": "CASE WHEN presence THEN 0 ELSE cnt + 1 END"},
        {
            "ev": "CASE WHEN phase = 2 AND presence AND up >= 4 THEN 'start' WHEN phase = 3 AND presence AND told + 1 = 3 THEN 'ongoing' WHEN phase = 3 AND missed >= 2 THEN 'end' END",
            "next_phase": "CASE phase WHEN 0 THEN CASE WHEN presence AND less = 0 THEN 1 ELSE 0 END WHEN 1 THEN CASE WHEN NOT presence THEN 0 WHEN cnt + 1 >= 2 THEN 2 ELSE 1 END WHEN 2 THEN CASE WHEN presence THEN CASE WHEN up >= 4 THEN 3 ELSE 2 END WHEN missed >= 1 THEN 0 ELSE 2 END ELSE CASE WHEN missed >= 2 THEN 0 ELSE 3 END END",
        },
        {
            "next_stayed": "CASE WHEN next_phase >= 2 AND phase >= 2 THEN up ELSE 0 END",
            "next_cnt": "CASE WHEN next_phase = 1 THEN CASE WHEN phase = 1 THEN cnt + 1 ELSE 1 END WHEN next_phase >= 2 AND phase >= 2 THEN missed ELSE 0 END",
            "next_told": "CASE WHEN phase = 3 AND next_phase = 3 THEN CASE WHEN NOT presence THEN told WHEN ev = 'ongoing' THEN 0 ELSE told + 1 END ELSE 0 END",
            "next_rest": "CASE WHEN ev = 'end' THEN 3 ELSE less END",
        },
    ],
    {"alert VARCHAR": "ev", "seconds DOUBLE": "up / 20.0"}, "ev IS NOT NULL", "kind <> 'error' AS presence, x",
))
def loitering(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _room(spark, sf_dir).withColumn("motion", F.col("motion") * 4)
    return K.fold(s, "node", _ORDER, ["presence", "motion"], "u", "event_id", K.loitering(confirm=2, dwell=4, leave=2, report=3, pause=3))
