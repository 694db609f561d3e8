"""Per-node signal operators: statistics, filters, baselines, triggers and dwell.

Each takes the key columns and an order that tells rows apart.  Windows of a
fixed number of rows or seconds are Spark's; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Scales a median absolute deviation to a standard deviation.
MAD_SCALE = 1.4826
#: (least score above, class) of the motion ladder.
MOTION_LADDER = ((0.25, "active"), (0.12, "present_moving"), (0.04, "present_still"))


def trailing(keys: Sequence[str], order: Sequence[str], rows: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)


def centred(keys: Sequence[str], order: Sequence[str], half: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)


def features(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Count, mean, sample moments (bias-corrected), range and interquartile range by key."""
    n = F.count(x).cast("double")
    skew = F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    kurt = ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    quartiles = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
    out = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), skew.alias("skewness"), kurt.alias("kurtosis"),
        F.min(x).alias("least"), F.max(x).alias("most"), quartiles.alias("q"),
    )
    return out.withColumn("span", F.col("most") - F.col("least")).withColumn("iqr", F.col("q")[1] - F.col("q")[0]).drop("q")


def motion_class(score: Column) -> Column:
    out = F.lit("absent")
    for least, name in reversed(MOTION_LADDER):
        out = F.when(score > least, name).otherwise(out)
    return out


def _median(values: Column) -> Column:
    v = F.array_sort(values)
    n = F.size(v)
    return (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2


def hampel(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, half: int = 3, limit: float = 3.0) -> DataFrame:
    """``df`` with ``median``, ``outlier`` and ``filtered``; frames are cut at the ends.

    With a deviation of 0 in the frame, any other value is an outlier.
    """
    near = F.collect_list(x).over(centred(keys, order, half))
    out = df.withColumn("__el_near", near).withColumn("median", _median(F.col("__el_near")))
    mad = _median(F.transform("__el_near", lambda v: F.abs(v - F.col("median"))))
    out = out.withColumn("__el_mad", mad * MAD_SCALE)
    outlier = F.abs(F.col(x) - F.col("median")) > F.lit(limit) * F.col("__el_mad")
    out = out.withColumn("outlier", outlier).withColumn("filtered", F.when(outlier, F.col("median")).otherwise(F.col(x)))
    return out.drop("__el_near", "__el_mad")


def ema(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, alpha: float, rows: int) -> DataFrame:
    """``df`` with ``ema`` over the last ``rows`` rows, started at the first of them."""
    seen = F.collect_list(x).over(trailing(keys, order, rows))
    folded = F.aggregate(F.slice(seen, 2, rows), F.get(seen, F.lit(0)), lambda acc, v: acc * (1 - alpha) + v * alpha)
    return df.withColumn("ema", folded)


def running_z(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, least: int = 10) -> DataFrame:
    """``df`` with ``z`` against all rows up to this one; null below ``least`` rows or without spread."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spread = F.nullif(F.stddev_samp(x).over(w), F.lit(0.0))
    return df.withColumn("z", F.when(F.count(x).over(w) >= least, (F.col(x) - F.avg(x).over(w)) / spread))


def adaptive_threshold(df: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, rows: int = 100, least: int = 10) -> DataFrame:
    """``df`` with ``threshold``: mean plus one deviation of the last scores, from 0.3 to 0.95."""
    w = trailing(keys, order, rows)
    level = F.least(F.greatest(F.avg(score).over(w) + F.stddev_pop(score).over(w), F.lit(0.3)), F.lit(0.95))
    return df.withColumn("threshold", F.when(F.count(score).over(w) >= least, level))


def zero_crossings(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, centre: str) -> DataFrame:
    """By key, how often ``x`` passes its centre: products of neighbours strictly below 0."""
    y = F.col(x) - F.col(centre)
    crossed = df.withColumn("__el_y", y).withColumn("__el_p", F.lag("__el_y").over(Window.partitionBy(*keys).orderBy(*order)) * F.col("__el_y"))
    return crossed.groupBy(*keys).agg(F.count_if(F.col("__el_p") < 0).alias("crossings"))


def rising(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, above: float) -> DataFrame:
    """Rows at which ``x`` comes to be above a level; a key's first row never is one."""
    before = F.lag(x).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__el_b", before).where((F.col("__el_b") <= above) & (F.col(x) > above)).drop("__el_b")


def transition(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, source: str, target: str) -> DataFrame:
    """Rows at which the state changes from ``source`` to ``target``."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__el_b", before).where((F.col("__el_b") == source) & (F.col(state) == target)).drop("__el_b")


def dwell(df: DataFrame, keys: Sequence[str], order: Sequence[str], seconds: str, holds: Column, least: float) -> DataFrame:
    """Stretches of neighbouring rows that hold, of at least so many seconds: begin, end, n."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__el_h", holds).withColumn("__el_new", (F.col("__el_h") & ~F.coalesce(F.lag("__el_h").over(w), F.lit(False))).cast("int"))
    islands = marked.withColumn("island", F.sum("__el_new").over(w)).where("__el_h")
    out = islands.groupBy(*keys, "island").agg(F.min(seconds).alias("begin"), F.max(seconds).alias("end"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("end") - F.col("begin") >= least)


def recent_count(df: DataFrame, keys: Sequence[str], seconds: str, holds: Column, span: int) -> DataFrame:
    """``df`` with ``recent``: rows of the last ``span`` seconds that hold, this one included."""
    w = Window.partitionBy(*keys).orderBy(F.col(seconds).cast("long")).rangeBetween(-span, 0)
    return df.withColumn("recent", F.count_if(holds).over(w))


def gini(values: Column) -> Column:
    """Gini coefficient of an array of energies; null if empty or of sum 0."""
    v = F.array_sort(values)
    n = F.size(v)
    ranks = F.zip_with(v, F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda x, i: (2 * i - n - 1) * x)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(ranks, F.lit(0.0), lambda a, x: a + x) / F.nullif(n * total, F.lit(0.0))
