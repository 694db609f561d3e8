"""Radio tomography: densities of voxels from attenuations of links, by iterative soft thresholding.

Weights of links and voxels are made by explode and filter, packed into blocks
of links and written, links of equal weights as one; each round is one job over
the blocks with the densities broadcast, whose tasks' vectors are added up by
tasks, so that one vector as long as the grid reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolake.plans.shared import materialize

# Fixed values.
WAVELENGTH, OCCUPIED = 0.06, 0.01
#: Voxels of a grid, at most: each round broadcasts and returns a vector of so many numbers.
MAX_VOXELS = 1 << 20
#: Tasks' vectors are added in parts of so many numbers.
PART = 1 << 14


@dataclass(frozen=True)
class Grid:
    """Voxels of a box, numbered z, y, x."""

    nx: int = 8
    ny: int = 8
    nz: int = 4
    low: tuple[float, float, float] = (0.0, 0.0, 0.0)
    high: tuple[float, float, float] = (6.0, 6.0, 3.0)

    @property
    def counts(self) -> tuple[int, int, int]:
        return self.nx, self.ny, self.nz

    @property
    def size(self) -> tuple[float, ...]:
        return tuple((b - a) / n for a, b, n in zip(self.low, self.high, self.counts, strict=True))

    @property
    def voxels(self) -> int:
        return self.nx * self.ny * self.nz


def ways(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct ways of links, each a link of its own, and (link, attenuation) of all links: links of one way have its weights."""
    ends = [f"{e}{a}" for e in "tr" for a in "xyz"]
    own = links.withColumn("link", F.struct(*ends))
    return own.select("link", *ends).distinct(), own.select("link", "attenuation")


def link_weights(links: DataFrame, grid: Grid) -> DataFrame:
    """(link, voxel, weight): how much of a link's zone a voxel is in, 1 on the line and 0 at its edge.

    ``links`` has link, tx, ty, tz, rx, ry, rz.  Only voxels of the box around a link are looked at.
    """
    axes, size = "xyz", grid.size
    d = {a: F.col(f"r{a}") - F.col(f"t{a}") for a in axes}
    length = F.sqrt(d["x"] ** 2 + d["y"] ** 2 + d["z"] ** 2)
    tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, but each becomes a box of voxels
    near = links.repartition(tasks, "link").withColumn("radius", F.greatest(F.sqrt(WAVELENGTH * length / 4), F.lit(max(size[:2]))))
    for a, low, s, n in zip(axes, grid.low, size, grid.counts, strict=True):
        first = F.floor((F.least(f"t{a}", f"r{a}") - F.col("radius") - low) / s).cast("int")
        last = F.floor((F.greatest(f"t{a}", f"r{a}") + F.col("radius") - low) / s).cast("int")
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(n - 1))
        near = near.where(first <= last).withColumn(f"i{a}", F.explode(F.sequence(first, last)))
    off = {a: low + (F.col(f"i{a}") + 0.5) * s - F.col(f"t{a}") for a, low, s in zip(axes, grid.low, size, strict=True)}
    along = F.coalesce((off["x"] * d["x"] + off["y"] * d["y"] + off["z"] * d["z"]) / F.nullif(length * length, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    distance = F.sqrt(sum(((off[a] - t * d[a]) ** 2 for a in axes), F.lit(0.0)))
    voxel = F.col("iz") * (grid.ny * grid.nx) + F.col("iy") * grid.nx + F.col("ix")
    out = near.select("link", voxel.cast("int").alias("voxel"), (1 - distance / F.col("radius")).alias("weight"))
    return out.where("weight > 0")


@dataclass(frozen=True)
class Volume:
    """Densities by voxel, the residual of the last round, and the rounds."""

    densities: np.ndarray
    residual: float
    rounds: int


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of sorted parts (at, part, g, s) by ``at``, in the order of the parts."""
    names, at, total, square = ["at", "g", "s"], None, None, 0.0
    one = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([square])], names=names)
    for b in batches:
        for k, _, g, s in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if k != at:
                if at is not None:
                    yield one()
                at, total, square = k, np.zeros(len(g) // 8), 0.0
            total += np.frombuffer(g)
            square += s
    if at is not None:
        yield one()


def reconstruct(weights: DataFrame, measured: DataFrame, grid: Grid, penalty: float = 0.1, most: float = 100, tolerance: float = 1e-4, least_links: int = 8) -> Volume:
    """Densities from 0 up that explain the attenuations (link, attenuation), few of them, within ``most`` rounds.

    Stops when no density moves by ``tolerance``.  Links of null attenuation or
    without a voxel take no part; fewer than ``least_links`` raise ValueError.
    """
    if grid.voxels > MAX_VOXELS:
        raise ValueError(f"{grid.voxels} voxels are more than {MAX_VOXELS}")
    rows = weights.groupBy("link").agg(F.sort_array(F.collect_list(F.struct("voxel", "weight"))).alias("w"))  # a link's voxels: at most the grid
    met = measured.where("attenuation IS NOT NULL").join(rows, "link").withColumn("y", F.col("attenuation").cast("double"))
    met = met.groupBy("w").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    held = materialize(met.select(F.col("w.voxel").alias("voxel"), F.col("w.weight").alias("weight"), "n", "y", "yy"), "links")
    n, norm = held.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.sum(F.col("n") * F.aggregate("weight", F.lit(0.0), lambda s, w: s + w * w))).first()
    if n < least_links:
        raise ValueError(f"{n:.0f} links are fewer than {least_links}")
    step = 1 / max(norm, 1e-10)
    context, x, residual = held.sparkSession.sparkContext, np.zeros(grid.voxels), 0.0
    rounds = 0
    while rounds < most:
        shared = context.broadcast(x)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            gradient, square = np.zeros(len(shared.value)), 0.0
            for b in batches:
                sizes = np.asarray(b.column(0).value_lengths())
                voxel, w = np.asarray(b.column(0).flatten()), np.asarray(b.column(1).flatten())
                link = np.repeat(np.arange(len(sizes)), sizes)
                count, y, yy = (np.asarray(b.column(k)) for k in (2, 3, 4))
                told = np.bincount(link, w * shared.value[voxel], minlength=len(sizes))
                square += float((count * told**2 - 2 * told * y + yy).sum())
                gradient += np.bincount(voxel, w * (count * told - y)[link], minlength=len(gradient))
            part, at = TaskContext.get().partitionId(), range(0, len(gradient), PART)
            columns = [pa.array(at, pa.int64()), pa.array([part] * len(at), pa.int32()), pa.array([gradient[k : k + PART].tobytes() for k in at], pa.binary()), pa.array([0.0 if k else square for k in at])]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "part", "g", "s"])

        parts = held.mapInArrow(run, "at long, part int, g binary, s double").repartition("at").sortWithinPartitions("at", "part").mapInArrow(_added, "at long, g binary, s double")
        gradient, square = np.zeros(grid.voxels), 0.0
        for p in parts.collect():  # as long as the grid, all in all
            gradient[p["at"] : p["at"] + PART] = np.frombuffer(p["g"])
            square += p["s"]
        shared.destroy()
        residual = float(np.sqrt(max(square, 0.0) / n))
        now = np.maximum(x - step * gradient - penalty * step, 0.0)
        moved = float(np.abs(now - x).max())
        x, rounds = now, rounds + 1
        if moved < tolerance:
            break
    return Volume(x, residual, rounds)


def voxels(spark, volume: Volume, grid: Grid, above: float = OCCUPIED) -> DataFrame:
    """(voxel, x, y, z, density) of the occupied voxels, at their centres."""
    at = np.flatnonzero(volume.densities > above)
    iz, iy, ix = np.unravel_index(at, (grid.nz, grid.ny, grid.nx))
    places = [low + (i + 0.5) * s for low, i, s in zip(grid.low, (ix, iy, iz), grid.size, strict=True)]
    rows = [tuple(map(float, r)) for r in zip(*places, volume.densities[at], strict=True)]
    return spark.createDataFrame([(int(v), *r) for v, r in zip(at, rows, strict=True)], "voxel int, x double, y double, z double, density double")
