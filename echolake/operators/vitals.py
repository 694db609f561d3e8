"""Vital signs from filtered signals, clinical alerts, and checks of witness chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolake.functions.scalars import clamp


def rate_by_crossings(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, rows: int, least: int, hertz: float, low: float, high: float) -> DataFrame:
    """``df`` with ``bpm``, ``confidence`` and ``status`` from sign changes in the last ``rows`` samples.

    Only rows with ``least`` samples and a rate inside the band; a flat window has confidence 0.
    """
    every = Window.partitionBy(*keys).orderBy(*order)
    window, inner = every.rowsBetween(1 - rows, 0), every.rowsBetween(2 - rows, 0)
    marked = df.withColumn("__el_cross", (F.lag(x).over(every) * F.col(x) < 0).cast("int"))
    spread = F.stddev_pop(x).over(window)
    out = (
        marked.withColumn("__el_n", F.count(x).over(window))
        .withColumn("__el_hertz", F.coalesce(F.sum("__el_cross").over(inner), F.lit(0)) / (2 * F.col("__el_n") / hertz))
        .withColumn("confidence", F.coalesce(F.least(F.max(F.abs(x)).over(window) / F.nullif(spread, F.lit(0.0)) / 5, F.lit(1.0)), F.lit(0.0)))
        .where((F.col("__el_n") >= least) & F.col("__el_hertz").between(low, high))
    )
    status = F.when(F.col("confidence") >= 0.7, "valid").when(F.col("confidence") >= 0.4, "degraded").otherwise("unreliable")
    return out.withColumn("bpm", F.col("__el_hertz") * 60).withColumn("status", status).drop("__el_cross", "__el_n", "__el_hertz")


def clinical_alerts(df: DataFrame, keys: Sequence[str], order: Sequence[str], rr: str, hr: str, confidence: str, limit: float = 2.5, least: int = 5) -> DataFrame:
    """Rows of ``df`` by alert: ``vital``, ``alert``, ``severity``.

    Ladders of breathing and heart rate where the confidence is above 0.3, and
    values far from the mean so far.  The first ``least`` - 1 rows of a key give none.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    z = lambda c: F.coalesce((F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0)), F.lit(0.0))
    known = df.withColumn("__el_n", F.count(F.lit(1)).over(w)).withColumn("__el_rz", F.abs(z(rr))).withColumn("__el_hz", F.abs(z(hr))).where(F.col("__el_n") >= least)
    r, h = F.col(rr), F.col(hr)

    def alert(vital: str, name: str, severity: Column) -> Column:
        return F.struct(F.lit(vital).alias("vital"), F.lit(name).alias("alert"), severity.cast("double").alias("severity"))

    breathing = (
        F.when(r < 4, alert("respiratory", "apnea", F.lit(0.9)))
        .when(r > 30, alert("respiratory", "tachypnea", clamp((r - 30) / 20, 0.3, 1.0)))
        .when(r < 8, alert("respiratory", "bradypnea", clamp((8 - r) / 8, 0.3, 0.8)))
    )
    heart = F.when(h > 100, alert("cardiac", "tachycardia", clamp((h - 100) / 80, 0.3, 1.0))).when(h < 50, alert("cardiac", "bradycardia", clamp((50 - h) / 30, 0.3, 1.0)))
    sudden = [F.when(F.col(c) > limit, alert(v, "sudden_change", clamp(F.col(c) / (2 * limit), 0.2, 1.0))) for v, c in (("respiratory", "__el_rz"), ("cardiac", "__el_hz"))]
    sure = F.col(confidence) > 0.3
    found = F.array_compact(F.array(F.when(sure, breathing), F.when(sure, heart), *sudden))
    return known.withColumn("__el_alert", F.explode(found)).select(*df.columns, "__el_alert.*")


def chain_faults(df: DataFrame, key: str, seq: str, prev: str, link: str, body: str, genesis: str = "0" * 64) -> DataFrame:
    """By key: ``n`` and the first ``broken_at`` with its ``fault``, null for a sound chain.

    A link must carry on the numbers from 0 (``seq_gap``), hold the link before
    (``prev_mismatch``) and be the hash of its own record (``hash_mismatch``).
    """
    w = Window.partitionBy(key).orderBy(seq)
    at = F.row_number().over(w) - 1
    marked = df.withColumn("__el_at", at.cast("long")).withColumn("__el_before", F.coalesce(F.lag(link).over(w), F.lit(genesis)))
    own = F.sha2(F.concat_ws("|", prev, F.col(seq).cast("string"), body), 256)
    fault = F.when(F.col(seq) != F.col("__el_at"), "seq_gap").when(F.col(prev) != F.col("__el_before"), "prev_mismatch").when(F.col(link) != own, "hash_mismatch")
    marked = marked.withColumn("__el_fault", fault)
    first = F.min(F.when(F.col("__el_fault").isNotNull(), F.struct(F.col("__el_at").alias("at"), F.col("__el_fault").alias("fault"))))
    return marked.groupBy(key).agg(F.count(F.lit(1)).alias("n"), first.alias("f")).select(key, "n", F.col("f.at").alias("broken_at"), F.col("f.fault").alias("fault"))
