"""Ordered folds and event-time windows over node samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.operators import folds as K
from echolake.operators import rhythm as H
from echolake.operators import vitals as V
from echolake.registry import query
from echolake.sources.tables import FRAMES, SAMPLES, frames, samples
from echolake.streaming import windows as W


def _fold(spark: SparkSession, sf_dir: str, kernel: K.Kernel) -> DataFrame:
    return K.fold(samples(spark, sf_dir), "node", ["ts", "event_id"], "x", "t", "event_id", kernel)


def _recursion(state: dict[str, str], levels: list[dict[str, str]], out: dict[str, str], where: str = "true", source: str = "x", given: str = SAMPLES) -> str:
    """SQL of a fold: state columns with their first values, what each row computes in turn, and the outputs (name type).

    A level may set a state column ``s`` by naming it ``next_s``.
    """
    inner = f"SELECT o.node AS own, o.r AS row, o.event_id AS id, o.*, {', '.join(f'p.{s}' for s in state)} FROM p JOIN o ON o.node = p.node AND o.r = p.r + 1"
    for level in levels:
        inner = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in level.items())} FROM ({inner})"
    names = [n for level in levels for n in level]
    kept = ", ".join(f"{f'next_{s}' if f'next_{s}' in names else s} AS {s}" for s in state)
    first = ", ".join(f"{e} AS {s}" for s, e in state.items())
    shown = ", ".join(f"{e} AS {n.split()[0]}" for n, e in out.items())
    none = ", ".join("NULL::{1} AS {0}".format(*n.split()) for n in out)
    return f"""WITH RECURSIVE {given}, o AS (SELECT node, event_id, t, {source}, row_number() OVER (PARTITION BY node ORDER BY ts, event_id) AS r FROM s),
p AS (SELECT DISTINCT node, 0::BIGINT AS r, NULL::BIGINT AS event_id, {first}, {none}, false AS given FROM o
UNION ALL SELECT own, row, id, {kept}, {shown}, {where} FROM ({inner}))
SELECT node, event_id, {', '.join(n.split()[0] for n in out)} FROM p WHERE given"""


@query(f"WITH {SAMPLES}, w AS (SELECT node, event_id, list(x) OVER (PARTITION BY node ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS l FROM s) SELECT node, event_id, round(list_reduce(l, lambda a, v: a * 0.85 + v * 0.15) / pi(), 6) AS ema_over_pi FROM w")
def ema_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In units of pi, as decimal inputs would give values on rounding ties."""
    return _fold(spark, sf_dir, K.ema()).select("node", "event_id", F.round(F.col("ema") / F.pi(), 6).alias("ema_over_pi"))


@query(f"""WITH RECURSIVE {SAMPLES}, o AS (SELECT node, event_id, t, row_number() OVER (PARTITION BY node ORDER BY ts, event_id) AS r FROM s),
p AS (SELECT node, event_id, t, r, t AS last, true AS passed FROM o WHERE r = 1
UNION ALL SELECT o.node, o.event_id, o.t, o.r, CASE WHEN o.t - p.last >= 3600 THEN o.t ELSE p.last END, o.t - p.last >= 3600 FROM o JOIN p ON o.node = p.node AND o.r = p.r + 1)
SELECT node, event_id, round(t, 3) AS passed_at FROM p WHERE passed""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir, K.rate_limit(3600)).withColumn("passed_at", F.round("passed_at", 3))


@query(_recursion(
    {"a": "0.0::DOUBLE", "b": "0.0::DOUBLE"},
    [{"u": "greatest(0.0, a + x - 20 - 2)", "d": "greatest(0.0, b - x + 20 - 2)"}, {"f": "CASE WHEN u > 60 THEN 1 WHEN d > 60 THEN -1 ELSE 0 END"}, {"next_a": "CASE WHEN f = 0 THEN u ELSE 0.0 END", "next_b": "CASE WHEN f = 0 THEN d ELSE 0.0 END"}],
    {"up_over_pi DOUBLE": "round(u / pi(), 5)", "down_over_pi DOUBLE": "round(d / pi(), 5)", "alarm INTEGER": "f"}, "f <> 0",
))
def cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _fold(spark, sf_dir, K.cusum(20, 2, 60)).where("alarm <> 0")
    return out.select("node", "event_id", F.round(F.col("up") / F.pi(), 5).alias("up_over_pi"), F.round(F.col("down") / F.pi(), 5).alias("down_over_pi"), "alarm")


@query(_recursion({"m": "NULL::DOUBLE"}, [{"next_m": "CASE WHEN m IS NULL THEN x ELSE m * 0.8 + x * 0.2 END"}], {"passed DOUBLE": "x"}, "m IS NULL OR abs(x - m) > 15"))
def predictive_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir, K.predictive_gate(0.2, 15))


_MOTION = "x / 150 AS v"


@query(_recursion(
    {"n": "0", "base": "0.0::DOUBLE", "sm": "0.0::DOUBLE", "lev": "0", "want": "0", "held": "0"},
    [
        {"next_n": "n + 1", "next_base": "CASE WHEN n + 1 < 50 THEN base * 0.9 + v * 0.1 WHEN v < sm + 0.05 THEN base * 0.997 + v * 0.003 ELSE base END"},
        {"next_sm": "sm * 0.85 + greatest(v - next_base * 0.7, 0.0) * 0.15"},
        {"now": "(next_sm > 0.04)::INT + (next_sm > 0.12)::INT + (next_sm > 0.25)::INT"},
        {"up": "now <> lev AND now = want AND held + 1 >= 4"},
        {"next_lev": "CASE WHEN up THEN now ELSE lev END", "next_want": "now", "next_held": "CASE WHEN now = lev OR up THEN 0 WHEN now = want THEN held + 1 ELSE 1 END"},
    ],
    {"smooth_over_pi DOUBLE": "round(next_sm / pi(), 6)", "level VARCHAR": "['absent', 'present_still', 'present_moving', 'active'][next_lev + 1]", "presence BOOLEAN": "next_sm > 0.03"}, source=_MOTION,
))
def debounce_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("v", F.col("x") / 150)
    out = K.fold(s, "node", ["ts", "event_id"], "v", "t", "event_id", K.smoothed_motion())
    return out.select("node", "event_id", F.round(F.col("smooth") / F.pi(), 6).alias("smooth_over_pi"), "level", "presence")


_EDGE = "[0.5, 0.7, 0.9]"


@query(_recursion(
    {"act": "0", "want": "-1", "since": "0.0::DOUBLE"},
    [
        {"raw": "(v >= 0.5)::INT + (v >= 0.7)::INT + (v >= 0.9)::INT"},
        {"goal": f"CASE WHEN raw > act AND v >= {_EDGE}[act + 1] + 0.05 THEN raw WHEN raw < act AND v < {_EDGE}[act] - 0.05 THEN raw ELSE act END"},
        {"go": "goal <> act AND want = goal AND t - since >= 36000"},
        {"next_act": "CASE WHEN go THEN goal ELSE act END", "next_want": "CASE WHEN goal = act OR go THEN -1 ELSE goal END", "next_since": "CASE WHEN goal = act OR go THEN 0.0 WHEN want = goal THEN since ELSE t END"},
    ],
    {"action VARCHAR": "['accept', 'predict_only', 'reject', 'recalibrate'][next_act + 1]"}, source="(x / 70)::DOUBLE AS v",
))
def coherence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions by risk, debounced over ten hours, as rows are hours apart."""
    s = samples(spark, sf_dir).withColumn("v", F.col("x") / 70)
    return K.fold(s, "node", ["ts", "event_id"], "v", "t", "event_id", K.action_gate(debounce=36_000.0))


# Snapshots of a room: times in units of 5 minutes of the table's, so that dwells of minutes span some rows.
_ROOM = """(t - min(t) OVER (PARTITION BY node)) / 300 AS u, kind <> 'error' AS presence, x / 400 AS motion, 6 + x / 10 AS breathing, 55 + x / 2 AS heart, 0.45 + (event_id % 10) / 20.0::DOUBLE AS confidence, CAST(floor(x / 20) AS INTEGER) AS persons, kind = 'signup' AS fallen"""


def _room(spark: SparkSession, sf_dir: str, still: float = 400.0) -> DataFrame:
    """``still``: what x is divided by for the motion, in one step, as a threshold meets its very value."""
    s = samples(spark, sf_dir)
    first = s.groupBy("node").agg(F.min("t").alias("first"))
    x = F.col("x")
    return s.join(first, "node").select(
        "node", "event_id", "ts", "kind", ((F.col("t") - F.col("first")) / 300).alias("u"), (F.col("kind") != "error").alias("presence"), (x / still).alias("motion"), (6 + x / 10).alias("breathing"),
        (55 + x / 2).alias("heart"), (0.45 + F.col("event_id") % 10 / 20.0).alias("confidence"), F.floor(x / 20).cast("int").alias("persons"), (F.col("kind") == "signup").alias("fallen"),
    )


def _room_fold(spark: SparkSession, sf_dir: str, values: list[str], kernel: K.Kernel) -> DataFrame:
    return K.fold(_room(spark, sf_dir), "node", ["ts", "event_id"], values, "u", "event_id", kernel)


_ON = {"act": "false", "since": "NULL::DOUBLE"}


def _dwell(enter: str, leave: str, dwell: str, last: str, at_once: str = "false") -> list[dict[str, str]]:
    """Levels of a state that is entered and left after conditions have held for some time."""
    return [
        {"warm": "u >= 60", "hold": f"CASE WHEN act THEN {leave} ELSE {enter} END"},
        {"begun": "CASE WHEN NOT warm THEN since WHEN NOT hold THEN NULL ELSE coalesce(since, u) END"},
        {"turn": f"warm AND hold AND ((act AND {at_once}) OR u - begun >= CASE WHEN act THEN {last} ELSE {dwell} END)"},
        {"next_act": "act <> turn", "next_since": "CASE WHEN turn THEN NULL ELSE begun END"},
    ]


@query(_recursion(_ON, _dwell("presence AND motion < 0.05 AND breathing BETWEEN 8 AND 20 AND confidence >= 0.5", "NOT presence OR motion > 0.15", "300", "30", "NOT presence"), {"asleep BOOLEAN": "next_act"}, "turn", _ROOM.replace("x / 400 AS motion", "x / 2400 AS motion")))
def sleeping_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _room(spark, sf_dir, still=2400.0)
    return K.fold(s, "node", ["ts", "event_id"], ["presence", "motion", "breathing", "confidence"], "u", "event_id", K.sleeping())


@query(_recursion(_ON, _dwell("persons >= 2 AND motion >= 0.01 AND motion < 0.2", "persons < 2", "150", "30"), {"meeting BOOLEAN": "next_act"}, "turn", _ROOM))
def meeting_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _room_fold(spark, sf_dir, ["persons", "motion"], K.meeting(dwell=150.0, leave=30.0))


@query(_recursion(
    {"act": "false", "last": "NULL::DOUBLE"},
    [{"next_last": "CASE WHEN u >= 60 AND presence AND motion >= 0.1 THEN u ELSE last END"}, {"on_": "u >= 60 AND NOT act AND presence AND coalesce(u - next_last < 30, false)", "off_": "u >= 60 AND act AND (NOT presence OR coalesce(u - next_last >= 600, true))"}, {"next_act": "(act OR on_) AND NOT off_"}],
    {"active BOOLEAN": "next_act"}, "on_ OR off_", _ROOM,
))
def room_active_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _room_fold(spark, sf_dir, ["presence", "motion"], K.room_active())


@query(_recursion(
    {"act": "false", "longest": "40.0::DOUBLE", "since": "NULL::DOUBLE", "fired": "NULL::DOUBLE"},
    [
        {"warm": "u >= 60", "still": "presence AND motion < 0.02"},
        {"begun": "CASE WHEN NOT warm THEN since WHEN still THEN coalesce(since, u) END", "next_longest": "CASE WHEN warm AND NOT still AND since IS NOT NULL THEN greatest(longest, u - since) ELSE longest END"},
        {"on_": "warm AND still AND NOT act AND u - begun >= longest * 1.5 AND (fired IS NULL OR u - fired >= 1000)", "off_": "warm AND NOT still AND act"},
        {"next_act": "(act OR on_) AND NOT off_", "next_since": "begun", "next_fired": "CASE WHEN on_ THEN u ELSE fired END"},
    ],
    {"anomaly BOOLEAN": "next_act"}, "on_ OR off_", _ROOM.replace("x / 400 AS motion", "x / 2000 AS motion"),
))
def elderly_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _room(spark, sf_dir, still=2000.0)
    return K.fold(s, "node", ["ts", "event_id"], ["presence", "motion"], "u", "event_id", K.inactivity(1.5, 40.0, 1000.0))


@query(_recursion(
    {"act": "false", "base": "NULL::DOUBLE", "since": "NULL::DOUBLE", "left_": "NULL::DOUBLE"},
    [
        {"sure": "confidence >= 0.5", "near": "CASE WHEN base IS NULL THEN heart ELSE 0.01 * heart + 0.99 * base END", "first_": "u < 60 OR base IS NULL"},
        {"live": "sure AND NOT first_", "high": "heart / base >= 1.2", "off_": "act AND motion < 0.10 AND heart / base < 1.2"},
        {"held": "live AND NOT act AND (left_ IS NULL OR u - left_ >= 300)", "bad": "high AND motion > 0.20 AND NOT fallen"},
        {"begun": "CASE WHEN held AND bad THEN coalesce(since, u) WHEN held THEN NULL ELSE since END"},
        {"on_": "held AND bad AND u - begun >= 20", "quit": "live AND off_"},
        {"next_act": "(act OR on_) AND NOT quit", "next_since": "CASE WHEN quit THEN NULL ELSE begun END", "next_left_": "CASE WHEN quit THEN u ELSE left_ END",
         "next_base": "CASE WHEN sure AND first_ THEN near WHEN live AND NOT act AND motion <= 0.20 AND NOT high THEN near ELSE base END"},
    ],
    {"distress BOOLEAN": "next_act"}, "on_ OR quit", _ROOM,
))
def distress_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _room_fold(spark, sf_dir, ["heart", "confidence", "motion", "fallen"], K.distress(multiple=1.2, dwell=20.0))


@query(_recursion({"seq": "0::BIGINT", "link": f"'{'0' * 64}'"}, [{"next_seq": "seq + 1", "next_link": "sha256(link || '|' || seq || '|' || body)"}], {"number BIGINT": "seq", "prev VARCHAR": "link", "hash VARCHAR": "next_link"}, source="concat_ws('|', event_id, kind, node) AS body"))
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Witness chain: each link is the hash of the link before, the record's number and its text."""
    s = samples(spark, sf_dir).withColumn("body", F.concat_ws("|", "event_id", "kind", "node"))
    out = K.fold(s, "node", ["ts", "event_id"], "body", "t", "event_id", K.hash_links())
    return out.select("node", "event_id", F.col("seq").alias("number"), "prev", F.col("link").alias("hash"))


@query(f"""WITH {SAMPLES}, c AS (SELECT node, count(*) AS n, CASE node % 5 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 END AS spot, CASE node % 5 WHEN 1 THEN 'hash_mismatch' WHEN 2 THEN 'seq_gap' WHEN 3 THEN 'prev_mismatch' END AS fault FROM s GROUP BY node)
SELECT node, n, CASE WHEN n > spot THEN spot END::BIGINT AS broken_at, CASE WHEN n > spot THEN fault END AS fault FROM c""")
def hash_chain_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of every node, checked link by link; records, numbers and links of some nodes were changed after they were chained."""
    s = samples(spark, sf_dir).withColumn("body", F.concat_ws("|", "event_id", "kind", "node")).withColumn("record", F.col("body"))
    chain = K.fold(s, "node", ["ts", "event_id"], ["body", "record"], "t", "event_id", K.carrying(K.hash_links(), "record string"))
    way, number = F.col("node") % 5, F.col("seq")
    changed = chain.select(
        "node", F.when((way == 2) & (number >= 3), number + 1).otherwise(number).alias("number"), F.when((way == 3) & (number == 4), F.repeat(F.lit("f"), F.lit(64))).otherwise(F.col("prev")).alias("prev"), F.col("link").alias("hash"),
        F.when((way == 1) & (number == 2), F.concat("record", F.lit("!"))).otherwise(F.col("record")).alias("body"),
    )
    return V.chain_faults(changed, "node", "number", "prev", "hash", "body")


_POLE = "0.37168146928204138::DOUBLE"


@query(_recursion(
    {"x1": "0.0::DOUBLE", "x2": "0.0::DOUBLE", "y1": "0.0::DOUBLE", "y2": "0.0::DOUBLE", "ring": "[]::DOUBLE[]"},
    [
        {"y": f"(1 - {_POLE}) * (x - x2) + 2 * {_POLE} * cos(0.3 * 2 * pi()) * y1 - {_POLE} * {_POLE} * y2"},
        {"held": "list_append(ring, y)[-30:]"},
        {"n": "len(held)", "hertz": "list_sum(list_transform(list_zip(held[1:len(held) - 1], held[2:]), lambda z: CASE WHEN z[1] * z[2] < 0 THEN 1 ELSE 0 END)) / (2.0 * len(held))"},
        {"gone": "n >= 10 AND hertz NOT BETWEEN 0.2 AND 0.4", "mean": "list_avg(held)"},
        {"spread": "sqrt(list_sum(list_transform(held, lambda v: (v - mean) * (v - mean))) / n)"},
        {"sure": "CASE WHEN spread < 1e-7 THEN 0.0 ELSE least(list_max(list_transform(held, lambda v: abs(v))) / spread / 5, 1.0) END"},
        {"next_x1": "CASE WHEN gone THEN 0.0 ELSE x END", "next_x2": "CASE WHEN gone THEN 0.0 ELSE x1 END", "next_y1": "CASE WHEN gone THEN 0.0 ELSE y END", "next_y2": "CASE WHEN gone THEN 0.0 ELSE y1 END", "next_ring": "CASE WHEN gone THEN []::DOUBLE[] ELSE held END"},
    ],
    {"bpm DOUBLE": "round(hertz * 60, 5)", "confidence DOUBLE": "round(sure, 5)", "status VARCHAR": "CASE WHEN sure >= 0.7 THEN 'valid' WHEN sure >= 0.4 THEN 'degraded' ELSE 'unreliable' END"}, "n >= 10 AND NOT gone",
    source="x / pi() AS x",
))
def breathing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breathing from a band-passed signal, one sample a second: sign changes over a window that a rate out of the band empties."""
    s = samples(spark, sf_dir).withColumn("x", F.col("x") / F.pi())
    out = K.fold(s, "node", ["ts", "event_id"], "x", "t", "event_id", H.breathing(1.0, (0.2, 0.4)))
    return out.select("node", "event_id", F.round("bpm", 5).alias("bpm"), F.round("confidence", 5).alias("confidence"), H.status(F.col("confidence"), 0.7, 0.4).alias("status"))


# Frames in turn at 20 nodes, ten a second.
_HEART = f"""WITH RECURSIVE {FRAMES}, w AS (SELECT frame % 20 AS node, frame, amplitude, phase, len(amplitude) AS tones, list_transform(range(1, len(amplitude) + 1), lambda i: coalesce(exp(-abs(phase[CASE WHEN i < len(phase) THEN i + 1 ELSE i - 1 END] - phase[i])), 1.0)) AS c FROM f),
g AS (SELECT node, frame, tones, row_number() OVER (PARTITION BY node ORDER BY frame) AS r, CASE WHEN tones = 1 THEN amplitude[1]::DOUBLE ELSE list_sum(list_transform(list_zip(amplitude, c), lambda z: z[1]::DOUBLE * z[2])) / list_sum(c) END AS x FROM w),
k AS (SELECT 1 - 2 * pi() * 1.2 / 10 / 2 AS a, cos(2 * pi() * 2.8 / 10 / 2) AS b),
p AS (SELECT DISTINCT node, 0::BIGINT AS r, NULL::BIGINT AS frame, 0::BIGINT AS tones, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS y1, 0.0::DOUBLE AS y2 FROM g
UNION ALL SELECT g.node, g.r, g.frame, g.tones, g.x, p.x1, (1 - a) * (g.x - p.x2) + 2 * a * b * p.y1 - a * a * p.y2, p.y1 FROM p JOIN g ON g.node = p.node AND g.r = p.r + 1, k),
s AS (SELECT node, frame, tones, list(y1) OVER (PARTITION BY node ORDER BY r ROWS 149 PRECEDING) AS h FROM p WHERE r > 0),
m AS (SELECT *, len(h) AS n, list_avg(h) AS mean, list_sum(list_transform(h, lambda v: v * v)) - len(h) * list_avg(h) * list_avg(h) AS base FROM s WHERE len(h) >= 50),
l AS (SELECT *, unnest(range(5, 14)) AS lag FROM m), a AS (SELECT *, list_sum(list_transform(list_zip(h[1:n - lag], h[lag + 1:]), lambda z: (z[1] - mean) * (z[2] - mean))) / base AS acf FROM l WHERE lag <= n // 2 AND base >= 1e-15),
t AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY acf DESC, lag) AS best FROM a), u AS (SELECT node, frame, 600.0 / lag AS bpm, least(greatest(acf * least(tones / 4.0, 1.0), 0.0), 1.0) AS sure, tones FROM t WHERE best = 1 AND acf > 0 AND 600.0 / lag BETWEEN 40 AND 180)
SELECT node, frame, round(bpm, 5)::DOUBLE AS bpm, round(sure, 5) AS confidence, CASE WHEN sure >= 0.6 AND tones >= 4 THEN 'valid' WHEN sure >= 0.3 THEN 'degraded' ELSE 'unreliable' END AS status FROM u"""


@query(_HEART)
def heart_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heart rate of frames by autocorrelation of their coherent signal."""
    f = frames(spark, sf_dir).withColumn("node", F.col("frame") % 20).withColumn("tones", F.size("amplitude"))
    f = f.select("node", "frame", "tones", F.col("frame").cast("double").alias("t"), H.coherent_signal(F.transform("amplitude", lambda a: a.cast("double")), F.transform("phase", lambda a: a.cast("double"))).alias("x"))
    y = K.fold(f, "node", ["frame"], ["x", "tones"], "t", "frame", K.carrying(K.resonator(*H.HEART_BAND, 10.0), "tones int"))
    out = H.heart_rate(y, ["node"], ["frame"], "filtered", "tones", 10.0)
    return out.select("node", "frame", F.round("bpm", 5).alias("bpm"), F.round("confidence", 5).alias("confidence"), "status")


@query(f"""WITH {SAMPLES}, v AS (SELECT node, event_id, ts, x / 6 AS rr, 40 + x AS hr, 0.25 + (event_id % 5) / 10.0::DOUBLE AS confidence FROM s),
z AS (SELECT *, count(*) OVER w AS n, coalesce((rr - avg(rr) OVER w) / nullif(stddev_samp(rr) OVER w, 0), 0) AS rz, coalesce((hr - avg(hr) OVER w) / nullif(stddev_samp(hr) OVER w, 0), 0) AS hz FROM v WINDOW w AS (PARTITION BY node ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
a AS (SELECT event_id, 'respiratory' AS vital, CASE WHEN rr < 4 THEN 'apnea' WHEN rr > 30 THEN 'tachypnea' WHEN rr < 8 THEN 'bradypnea' END AS alert,
CASE WHEN rr < 4 THEN 0.9 WHEN rr > 30 THEN greatest(least((rr - 30) / 20, 1.0), 0.3) WHEN rr < 8 THEN greatest(least((8 - rr) / 8, 0.8), 0.3) END AS severity, confidence FROM z WHERE n >= 5
UNION ALL SELECT event_id, 'cardiac', CASE WHEN hr > 100 THEN 'tachycardia' WHEN hr < 50 THEN 'bradycardia' END, CASE WHEN hr > 100 THEN greatest(least((hr - 100) / 80, 1.0), 0.3) WHEN hr < 50 THEN greatest(least((50 - hr) / 30, 1.0), 0.3) END, confidence FROM z WHERE n >= 5
UNION ALL SELECT event_id, 'respiratory', CASE WHEN abs(rz) > 2.5 THEN 'sudden_change' END, greatest(least(abs(rz) / 5, 1.0), 0.2), 1 FROM z WHERE n >= 5
UNION ALL SELECT event_id, 'cardiac', CASE WHEN abs(hz) > 2.5 THEN 'sudden_change' END, greatest(least(abs(hz) / 5, 1.0), 0.2), 1 FROM z WHERE n >= 5)
SELECT event_id, vital, alert, round(severity / pi(), 5) AS severity_over_pi FROM a WHERE alert IS NOT NULL AND confidence > 0.3""")
def clinical_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("node", "event_id", "ts", (F.col("x") / 6).alias("rr"), (F.col("x") + 40).alias("hr"), (0.25 + F.col("event_id") % 5 / 10.0).alias("confidence"))
    return V.clinical_alerts(s, ["node"], ["ts", "event_id"], "rr", "hr", "confidence").select("event_id", "vital", "alert", F.round(F.col("severity") / F.pi(), 5).alias("severity_over_pi"))


_AGG = "count(*) AS n, round(avg(x), 5) AS mean, max(x) AS most"


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.unix_seconds("begin").alias("begin_s"), "n", F.round("mean", 5).alias("mean"), "most")


@query(f"WITH {SAMPLES} SELECT kind, CAST(floor(t / 3600) * 3600 AS BIGINT) AS begin_s, {_AGG} FROM s GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(W.windowed(samples(spark, sf_dir), ["kind"], "ts", "x", "1 hour"), "kind")


@query(f"WITH {SAMPLES}, d AS (SELECT kind, x, unnest([floor(t / 3600), floor(t / 3600) - 1]) * 3600 AS b FROM s) SELECT kind, CAST(b AS BIGINT) AS begin_s, {_AGG} FROM d GROUP BY ALL")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(W.windowed(samples(spark, sf_dir), ["kind"], "ts", "x", "2 hours", "1 hour"), "kind")


@query(f"""WITH {SAMPLES}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY node ORDER BY ts, event_id) < 1800 THEN 0 ELSE 1 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY node ORDER BY ts, event_id) AS id FROM g) SELECT node, CAST(floor(min(t)) AS BIGINT) AS begin_s, {_AGG} FROM i GROUP BY node, id""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(W.sessions(samples(spark, sf_dir), ["node"], "ts", "x", "30 minutes"), "node")


@query(f"WITH {SAMPLES} SELECT DISTINCT node, kind FROM s")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.deduplicated(samples(spark, sf_dir).select("node", "kind", "ts"), ["node", "kind"], "ts").select("node", "kind")
