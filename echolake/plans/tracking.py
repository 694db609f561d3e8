"""Tracking over node samples: filters, tracks by room, matches across rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.operators import folds as K
from echolake.operators import tracking as T
from echolake.plans.temporal import _recursion
from echolake.registry import query
from echolake.sources.tables import SAMPLES, samples, table

# Positions of nodes: a place of their own on a grid of 6 m, off it by what they measure.
_PLACE = "6 * (node % 5) + x / 40 AS ox, 6 * (floor(node / 5) % 5) + x / 60 AS oy, x / 50 AS oz, t / 3600 AS h"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, node = F.col("x"), F.col("node")
    return samples(spark, sf_dir).select(
        "event_id", "node", "ts", "kind", (6 * (node % 5) + x / 40).alias("ox"), (6 * (F.floor(node / 5) % 5) + x / 60).alias("oy"), (x / 50).alias("oz"), (F.col("t") / 3600).alias("h"), "x"
    )


_AXES = "xyz"
_KALMAN_SQL = _recursion(
    {"l": "NULL::DOUBLE", **{f"p{a}": "0.0::DOUBLE" for a in _AXES}, **{f"v{a}": "0.0::DOUBLE" for a in _AXES}, "pp": "10.0::DOUBLE", "pv": "0.0::DOUBLE", "vv": "10.0::DOUBLE"},
    [
        {"dt": "CASE WHEN l IS NULL THEN 0.0 ELSE h - l END", "one": "l IS NULL", "next_l": "h"},
        {**{f"q{a}": f"p{a} + dt * v{a}" for a in _AXES}, "ap": "pp + 2 * dt * pv + dt * dt * vv + 0.01 * dt ** 4 / 4", "av": "pv + dt * vv + 0.01 * dt ** 3 / 2", "aa": "vv + 0.01 * dt * dt"},
        {"off": "((ox - qx) ** 2 + (oy - qy) ** 2 + (oz - qz) ** 2) / (ap + 2.25)", "ka": "ap / (ap + 2.25)", "kb": "av / (ap + 2.25)"},
        {"ok": "off < 9"},
        {
            **{f"next_p{a}": f"CASE WHEN one THEN o{a} WHEN ok THEN q{a} + ka * (o{a} - q{a}) ELSE q{a} END" for a in _AXES},
            **{f"next_v{a}": f"CASE WHEN one THEN 0.0 WHEN ok THEN v{a} + kb * (o{a} - q{a}) ELSE v{a} END" for a in _AXES},
            "next_pp": "CASE WHEN one THEN 10.0 WHEN ok THEN (1 - ka) * ap ELSE ap END", "next_pv": "CASE WHEN one THEN 0.0 WHEN ok THEN (1 - ka) * av ELSE av END", "next_vv": "CASE WHEN one THEN 10.0 WHEN ok THEN aa - kb * av ELSE aa END",
        },
    ],
    {**{f"p{a}_ DOUBLE": f"round(next_p{a}, 6)" for a in _AXES}, **{f"v{a}_ DOUBLE": f"round(next_v{a}, 6)" for a in _AXES}, "uncertainty DOUBLE": "round(3 * next_pp, 6)", "off_ DOUBLE": "round(CASE WHEN one THEN 0.0 ELSE off END, 6)", "used BOOLEAN": "one OR ok"},
    source=_PLACE,
)


@query(_KALMAN_SQL)
def kalman_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position and speed of every node by a gated constant-velocity filter; time in hours."""
    out = K.fold(_places(spark, sf_dir), "node", ["ts", "event_id"], ["ox", "oy", "oz"], "h", "event_id", T.kalman(gate=T.GATE))
    names = {**{f"p{a}": f"p{a}_" for a in _AXES}, **{f"v{a}": f"v{a}_" for a in _AXES}, "uncertainty": "uncertainty", "off": "off_"}
    return out.select("node", "event_id", *[F.round(c, 6).alias(n) for c, n in names.items()], "used")


def track_events(spark: SparkSession, sf_dir: str, seconds: float = 7200.0) -> DataFrame:
    """Cycles of two hours of rooms of 25 nodes, seconds scaled to them."""
    s = _places(spark, sf_dir).withColumn("room", F.floor(F.col("node") / 25).cast("long"))
    known = F.col("kind") != "error"
    s = s.select(
        "room", (F.col("h") * 3600).alias("t"), "ts", "event_id", *[F.when(known, F.col(f"o{a}")).alias(a) for a in _AXES],
        (10 + F.col("node") % 7).alias("breathing"), (F.col("node") % 10 / 10.0).alias("amplitude"), F.when(F.col("node") % 3 > 0, 60 + F.col("node") % 40).alias("heart"), (F.col("node") % 5).alias("zone"),
    )
    held = T.cycles(s, "room", "t", seconds, [F.col("ts"), F.col("event_id")]).withColumn("at", F.col("cycle") * 1.0)
    return K.fold(held, "room", ["cycle"], ["seen"], "at", "cycle", T.tracker(accel=0.01, lost=10.0))


@query()
def track_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the tracks of every room: born, matched, missed, lost, reidentified, terminated."""
    out = track_events(spark, sf_dir).select("room", "cycle", F.explode("events").alias("e"))
    return out.select("room", "cycle", "e.track", "e.event", "e.observation", *[F.round(f"e.{c}", 6).alias(c) for c in ("x", "y", "z", "uncertainty")])


@query()
def cross_room_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views leave a room and clicks enter one; a person's embedding is that of the row's number among the embeddings."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.transform("embedding", lambda c: c.cast("double")).alias("embedding"))
    s = samples(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("node") % 7).alias("room"), "t", "kind", (F.col("event_id") % 400).alias("v"))
    met = s.join(vectors, "v").select("id", "room", "t", "kind", "embedding")
    return T.cross_room(met.where("kind = 'view'"), met.where("kind = 'click'"), 14_400.0, 0.1).select("entry_id", "exit_id", F.round("similarity", 6).alias("similarity"), F.round("gap", 3).alias("gap"))
