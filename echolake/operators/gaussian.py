"""A map of weighted Gaussian primitives: fusing observations, fading, corridors and channel gains.

A primitive is a row: place x, y, z, scales sx, sy, sz along the room's axes,
occupancy, confidence, and the seconds it was first and last seen.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolake.operators.folds import Kernel, State

# Fixed values.
PRUNE, GATE, MARGIN, LIGHT, LEAST_INTEGRAL = 0.02, 9.0, 3.0, 299_792_458.0, 1e-12
ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def fuse(cell: float = 1.0, gate: float = GATE) -> Kernel:
    """Values x, y, z, sx, sy, sz, occupancy, confidence, kind.  The primitive that took up each observation, as it is then.

    An observation goes into the nearest primitive of its kind in the 27 cells
    around it whose squared distance in scales is below ``gate``, weighted by
    confidence; ties go to the older one.  Otherwise it starts a primitive.
    The state is the key's map, in a hash of cells: as large as its primitives,
    not its observations.
    """
    place = lambda p: tuple(math.floor(c / cell) for c in p)

    def step(s: State, v: tuple, t: float):
        known, cells = s if s else ([], {})
        at, kind = v[:3], v[8]
        home = place(at)
        near = sorted(i for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) for i in cells.get((home[0] + a, home[1] + b, home[2] + c), ()))
        best, off = None, gate
        for i in near:
            if known[i]["kind"] == kind:
                d = sum(((p - q) / w) ** 2 for p, q, w in zip(at, known[i]["values"][:3], known[i]["values"][3:6], strict=True))
                if d < off:
                    best, off = i, d
        if best is None:
            best = len(known)
            known.append({"kind": kind, "values": list(v[:7]), "confidence": v[7], "first": t, "last": t})
            cells.setdefault(home, set()).add(best)
            merged = False
        else:
            own, w, more = known[best], known[best]["confidence"], v[7]
            was, total = place(own["values"][:3]), max(w + more, 1e-12)
            own["values"] = [(w * a + more * b) / total for a, b in zip(own["values"], v[:7], strict=True)]
            own |= {"confidence": min(max(w + more - w * more, 0.0), 1.0), "first": min(own["first"], t), "last": max(own["last"], t)}
            cells[was].discard(best)
            cells.setdefault(place(own["values"][:3]), set()).add(best)
            merged = True
        g = known[best]
        return (known, cells), (best, merged, *g["values"], g["confidence"], g["first"], g["last"])

    out = ", ".join(f"{c} double" for c in ("x", "y", "z", "sx", "sy", "sz", "occupancy", "confidence", "first", "last"))
    return Kernel((), step, f"primitive int, merged boolean, {out}")


def latest(reports: DataFrame, keys: Sequence[str], row: Sequence[str]) -> DataFrame:
    """The map after all reports of ``fuse``: each primitive's last one by ``row``."""
    rest = [c for c in reports.columns if c not in {*keys, *row, "primitive", "merged"}]
    held = reports.groupBy(*keys, "primitive").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct(*rest), F.struct(*row)).alias("g"))
    return held.select(*keys, "primitive", "n", "g.*")


def faded(primitives: DataFrame, now: Column, tau: Column, prune: float = PRUNE) -> DataFrame:
    """Confidences at ``now``; those that were known for long fade more slowly, and those below ``prune`` go."""
    since = F.greatest(now - F.col("last"), F.lit(0.0))
    life = F.greatest(F.col("last") - F.col("first"), F.lit(0.0))
    base = F.greatest(tau, F.lit(1e-6))
    slow = base * (1 + F.log(1 + life / base))
    return primitives.withColumn("confidence", F.col("confidence") * F.exp(-since / slow)).where(F.col("confidence") >= prune)


def _along(p: Sequence[Column], a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Distance of a point from a segment."""
    d = [y - x for x, y in zip(a, b, strict=True)]
    dot = sum(((q - x) * w for q, x, w in zip(p, a, d, strict=True)), F.lit(0.0))
    square = sum((w * w for w in d), F.lit(0.0))
    t = F.when(square < 1e-18, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / square)))
    return F.sqrt(sum(((q - x - t * w) ** 2 for q, x, w in zip(p, a, d, strict=True)), F.lit(0.0)))


def corridor(primitives: DataFrame, segments: DataFrame, margin: float = MARGIN, cell: float = 2.0) -> DataFrame:
    """Pairs of a segment (ax ... bz and its other columns) and a primitive at most ``margin`` from it.

    An equi-join on cells: a segment looks into those whose centre is near enough
    for a primitive in them to be in reach.  Null places meet nothing.
    """
    axes = "xyz"
    asked = segments
    for c in axes:
        low, high = F.least(f"a{c}", f"b{c}") - margin, F.greatest(f"a{c}", f"b{c}") + margin
        asked = asked.where(F.col(f"a{c}").isNotNull() & F.col(f"b{c}").isNotNull()).withColumn(f"__el_{c}", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))
    a, b = [F.col(f"a{c}") for c in axes], [F.col(f"b{c}") for c in axes]
    asked = asked.where(_along([(F.col(f"__el_{c}") + 0.5) * cell for c in axes], a, b) <= margin + math.sqrt(3) / 2 * cell + 1e-9)
    held = primitives
    for c in axes:
        held = held.withColumn(f"__el_{c}", F.floor(F.col(c) / cell))
    met = held.join(asked, [f"__el_{c}" for c in axes]).drop(*[f"__el_{c}" for c in axes])
    return met.where(_along([F.col(c) for c in axes], a, b) <= margin)


def erf(x: Column) -> Column:
    """Within 1.5e-7."""
    t = 1 / (1 + ERF[0] * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(ERF[1:]):
        poly = (poly + c) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def line_integral() -> Column:
    """Of a primitive's bell along the segment from a to b, in closed form."""
    axes = "xyz"
    d = {c: F.col(f"b{c}") - F.col(f"a{c}") for c in axes}
    length = F.sqrt(d["x"] ** 2 + d["y"] ** 2 + d["z"] ** 2)
    u = [d[c] / length / F.col(f"s{c}") for c in axes]
    m = [(F.col(c) - F.col(f"a{c}")) / F.col(f"s{c}") for c in axes]
    product = lambda p, q: sum((x * y for x, y in zip(p, q, strict=True)), F.lit(0.0))
    a, b, c = product(u, u), product(u, m), product(m, m)
    s = F.sqrt(a / 2)
    return F.exp(-(c - b * b / a) / 2) * F.sqrt(F.pi() / (2 * a)) * (erf(s * (length - b / a)) + erf(s * b / a))


def channel_gain(primitives: DataFrame, segments: DataFrame, key: str, hertz: float, margin: float = MARGIN, cell: float = 2.0) -> DataFrame:
    """By segment: how many primitives it meets, the depth in nepers, the gain in dB and the phase in radians.

    Free space where it meets none; a segment without length has gain 0 dB and phase 0.
    Segments whose place is null are left out.  Keys must differ.
    """
    axes = "xyz"
    length = F.sqrt(sum(((F.col(f"b{c}") - F.col(f"a{c}")) ** 2 for c in axes), F.lit(0.0)))
    ways = segments.select(key, *[f"{e}{c}" for e in "ab" for c in axes]).withColumn("__el_length", length).where("__el_length IS NOT NULL")
    met = corridor(primitives, ways.where("__el_length >= 1e-9"), margin, cell).select(key, (F.col("occupancy") * line_integral()).alias("part"), line_integral().alias("i")).where(F.col("i") > LEAST_INTEGRAL)
    depth = met.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("part").alias("depth"))
    wave, far = LIGHT / hertz, F.col("__el_length") >= 1e-9
    tau = F.coalesce("depth", F.lit(0.0))
    gain = F.when(far, 20 * F.log10(F.lit(wave) / (4 * F.pi() * F.col("__el_length")) * F.exp(-tau))).otherwise(0.0)
    phase = F.when(far, -F.pmod(2 * F.pi() * F.col("__el_length") / wave, 2 * F.pi())).otherwise(0.0)
    return ways.join(depth, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), tau.alias("depth"), gain.alias("gain_db"), phase.alias("phase"))
