"""Positions: radius and corridor search on a hash grid, least-squares location."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SHAPES = 1024


def within_radius(points: DataFrame, x: str, y: str, centres: DataFrame, radius: float) -> DataFrame:
    """Pairs of a centre (cx, cy and its other columns) and a point at most so far.

    An equi-join on grid cells as wide as the radius: a centre looks into nine.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    near = [F.explode(F.sequence(cell(c) - 1, cell(c) + 1)) for c in ("cx", "cy")]
    asked = centres.withColumn("__el_i", near[0]).withColumn("__el_j", near[1])
    placed = points.withColumn("__el_i", cell(x)).withColumn("__el_j", cell(y))
    met = placed.join(asked, ["__el_i", "__el_j"]).drop("__el_i", "__el_j")
    return met.where((F.col(x) - F.col("cx")) ** 2 + (F.col(y) - F.col("cy")) ** 2 <= radius * radius)


def near_segments(points: DataFrame, x: str, y: str, segments: Sequence[tuple[int, float, float, float, float]], width: float) -> DataFrame:
    """Pairs of a stated segment (id, x1, y1, x2, y2) and a point at most ``width`` from it, with ``distance``."""
    if len(segments) > MAX_SHAPES:
        raise ValueError(f"at most {MAX_SHAPES} segments")
    shapes = F.array(*[F.struct(F.lit(i).alias("segment"), *[F.lit(float(v)).alias(n) for v, n in zip(s, ("x1", "y1", "x2", "y2"), strict=True)]) for i, *s in segments])
    met = points.withColumn("__el_s", F.explode(shapes)).select("*", "__el_s.*").drop("__el_s")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = ((F.col(x) - F.col("x1")) * dx + (F.col(y) - F.col("y1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    px, py = F.col(x) - F.col("x1") - t * dx, F.col(y) - F.col("y1") - t * dy
    return met.withColumn("distance", F.sqrt(px * px + py * py)).where(F.col("distance") <= width).drop("x1", "y1", "x2", "y2")


def trilaterate(df: DataFrame, key: str, order: str, x: str, y: str, distance: str) -> DataFrame:
    """By key: the least-squares position from distances to sensors, linear against the first one.

    Null where sensors stand on one line.  Sums only, so partial aggregation does the work.
    """
    first = df.groupBy(key).agg(F.min_by(F.struct(F.col(x).alias("x0"), F.col(y).alias("y0"), F.col(distance).alias("d0")), order).alias("r"))
    rows = df.join(first, key)
    a, b = F.col(x) - F.col("r.x0"), F.col(y) - F.col("r.y0")
    c = (F.col("r.d0") ** 2 - F.col(distance) ** 2 + F.col(x) ** 2 - F.col("r.x0") ** 2 + F.col(y) ** 2 - F.col("r.y0") ** 2) / 2
    s = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"), F.sum(b * b).alias("bb"), F.sum(a * c).alias("ac"), F.sum(b * c).alias("bc"))
    det = F.nullif(F.when(F.abs(F.expr("aa * bb - ab * ab")) > 1e-9, F.expr("aa * bb - ab * ab")), F.lit(0.0))
    return s.select(key, "n", (F.expr("ac * bb - bc * ab") / det).alias("px"), (F.expr("aa * bc - ab * ac") / det).alias("py"))
