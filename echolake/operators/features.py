"""Feature families of channel matrices, rates of a queue, episodes and drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def amplitude_features(df: DataFrame, frame: str, v: str, tones: int) -> DataFrame:
    """By frame, over antennas (rows with an array ``v``): mean and variance of each tone, peak, range and root mean square."""
    tone = lambda j: F.get(v, F.lit(j))
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    out = df.groupBy(frame).agg(
        F.array(*[F.avg(tone(j)) for j in range(tones)]).alias("mean"), F.array(*[F.var_pop(tone(j)) for j in range(tones)]).alias("variance"),
        F.max(F.array_max(v)).alias("peak"), F.min(F.array_min(v)).alias("__el_least"), F.sqrt(F.sum(squares) / F.sum(F.size(v))).alias("rms"),
    )
    return out.withColumn("dynamic_range", F.col("peak") - F.col("__el_least")).drop("__el_least")


def phase_features(df: DataFrame, frame: str, v: str, tones: int) -> DataFrame:
    """By frame: mean difference of neighbouring tones over antennas, and the gradient of these."""
    apart = [F.avg(F.get(v, F.lit(j + 1)) - F.get(v, F.lit(j))) for j in range(tones - 1)]
    out = df.groupBy(frame).agg(F.array(*apart).alias("difference"))
    return out.withColumn("gradient", F.expr(f"transform(sequence(0, {tones - 3}), j -> difference[j + 1] - difference[j])") if tones > 2 else F.array(F.lit(0.0)))


def antenna_correlations(df: DataFrame, frame: str, antenna: str, v: str) -> DataFrame:
    """By frame, over pairs of its antennas: n pairs, mean, largest and spread of their correlation; flat antennas have none.

    A frame's antennas are a few rows by nature, so pairs of them stay few.
    """
    n = F.size(v).cast("double")
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    centred = df.select(frame, antenna, F.transform(v, lambda x: x - mean).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    centred = centred.withColumn("norm", norm).where("norm > 1e-10")
    a, b = centred.alias("a"), centred.alias("b")
    pairs = a.join(b, (F.col(f"a.{frame}") == F.col(f"b.{frame}")) & (F.col(f"a.{antenna}") < F.col(f"b.{antenna}")))
    product = F.aggregate(F.zip_with("a.c", "b.c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    r = pairs.select(F.col(f"a.{frame}").alias(frame), (product / (F.col("a.norm") * F.col("b.norm"))).alias("r"))
    return r.groupBy(frame).agg(F.count("r").alias("n_pairs"), F.avg("r").alias("mean_r"), F.max("r").alias("most_r"), F.stddev_pop("r").alias("spread_r"))


def queue_rates(df: DataFrame, keys: Sequence[str], order: Sequence[str], persons: str, rows: int) -> DataFrame:
    """By key and run of ``rows`` rows: arrivals and departures, as the number of persons goes up and down from 0 at first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.col(persons) - F.coalesce(F.lag(persons).over(w), F.lit(0))
    marked = df.withColumn("window", F.floor((F.row_number().over(w) - 1) / rows)).withColumn("__el_d", change)
    return marked.groupBy(*keys, "window").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.greatest("__el_d", F.lit(0))).alias("arrivals"), F.sum(F.greatest(-F.col("__el_d"), F.lit(0))).alias("departures"), F.max_by(persons, F.struct(*order)).alias("length")
    )


def episodes(df: DataFrame, keys: Sequence[str], order: Sequence[str], present: Column, low: Column, least: int) -> DataFrame:
    """By key: ``monitored`` rows with presence, and ``episodes`` of ``least`` neighbouring rows that are present and low.

    A row whose ``low`` is null neither ends nor lengthens an episode.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    known = df.withColumn("__el_p", present).withColumn("__el_l", F.col("__el_p") & low).where(~F.col("__el_p") | low.isNotNull())
    marked = known.withColumn("__el_run", F.sum((~F.col("__el_l")).cast("int")).over(w))
    runs = marked.groupBy(*keys, "__el_run").agg(F.count_if("__el_l").alias("__el_n"), F.count_if("__el_p").alias("__el_m"))
    return runs.groupBy(*keys).agg(F.sum("__el_m").alias("monitored"), F.count_if(F.col("__el_n") >= least).alias("episodes"))


def dwell_by_zone(df: DataFrame, keys: Sequence[str], order: Sequence[str], seconds: str, zone: str, most: float) -> DataFrame:
    """By key and zone: visits and seconds until the next row of the key, ``most`` at most a row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    stay = F.least(F.lead(seconds).over(w) - F.col(seconds), F.lit(most))
    entered = F.coalesce(F.lag(zone).over(w) != F.col(zone), F.lit(True)).cast("int")
    marked = df.withColumn("__el_stay", F.coalesce(stay, F.lit(0.0))).withColumn("__el_in", entered)
    return marked.groupBy(*keys, zone).agg(F.sum("__el_in").alias("visits"), F.sum("__el_stay").alias("seconds"))


def drift_runs(df: DataFrame, keys: Sequence[str], day: str, x: str, limit: float, days: int, least: int) -> DataFrame:
    """Days at which a key's value has been off the mean of the days before by ``limit`` deviations for ``days`` days in a row."""
    w = Window.partitionBy(*keys).orderBy(day)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    z = (F.col(x) - F.avg(x).over(past)) / F.nullif(F.stddev_samp(x).over(past), F.lit(0.0))
    marked = df.withColumn("z", F.when(F.count(x).over(past) >= least, z)).withColumn("__el_off", F.coalesce(F.abs("z") > limit, F.lit(False)).cast("int"))
    held = F.sum("__el_off").over(w.rowsBetween(1 - days, 0))
    return marked.withColumn("__el_held", held).where(F.col("__el_held") == days).drop("__el_off", "__el_held")


def entity_parts(entity: Column) -> Column:
    """Struct (valid, domain, name) of ``domain.name``; both parts are of small letters, digits and underscores."""
    valid = F.coalesce(entity.rlike(r"^[a-z0-9_]+\.[a-z0-9_]+$"), F.lit(False))
    part = lambda k: F.when(valid, F.split_part(entity, F.lit("."), F.lit(k)))
    return F.struct(valid.alias("valid"), part(1).alias("domain"), part(2).alias("name"))


def safe_id(text: Column, most: int = 64) -> Column:
    """Whether a text can be part of a path: letters, digits, ``-`` and ``_`` only, of a bounded length."""
    return F.coalesce(text.rlike(rf"^[A-Za-z0-9_-]{{1,{most}}}$"), F.lit(False))
