"""Minimum cuts of small weighted graphs, one a row: tones of a frame, nodes of a mesh cycle.

A graph comes as an array in its row, so graphs are dealt over tasks like rows;
the cut of one is found in memory by contracting the most tightly joined pair
until two vertices are left, for all graphs of one size in a batch at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LEAST_WEIGHT, EQUAL_WEIGHT, EQUAL_WITHIN, LEAST_VERTICES = 0.5, 1e6, 1e-9, 4
QUANTUM, RISK, LEAST_NODES = 1 / 64, 0.25, 3
#: Graphs of one size are cut together, so many weights at a time.
CELLS = 1 << 20


def min_cut(weights: np.ndarray) -> tuple[float, list[int]]:
    """Weight of the lightest cut of a symmetric matrix of weights from 0 up, and the side of vertex 0.

    In a graph of several parts the cut is 0 and the side is the part of vertex 0.
    """
    n = len(weights)
    if n < 2:
        return 0.0, list(range(n))
    part, grown = {0}, [0]
    while grown:
        near = set(np.flatnonzero(weights[grown.pop()] > 0).tolist()) - part
        part |= near
        grown += near
    if len(part) < n:
        return 0.0, sorted(part)
    w = weights.astype(float).copy()
    np.fill_diagonal(w, 0.0)
    groups = {k: [k] for k in range(n)}
    best, side = np.inf, [0]
    while len(groups) > 1:
        names = list(groups)
        tight = w[names[0], names].copy()
        left, order = names[1:], [names[0]]
        at = {v: k for k, v in enumerate(names)}
        while left:
            nxt = max(left, key=lambda v: (tight[at[v]], -v))
            phase = tight[at[nxt]]
            left.remove(nxt)
            order.append(nxt)
            tight += w[nxt, names]
        last, before = order[-1], order[-2]
        if phase < best:
            best, side = phase, groups[last]
        w[before] += w[last]
        w[:, before] += w[:, last]
        w[before, before] = 0.0
        groups[before] = groups[before] + groups.pop(last)
    if 0 not in side:
        side = sorted(set(range(n)) - set(side))
    return float(best), sorted(side)


def min_cuts(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``min_cut`` of many graphs of one size (graph, vertex, vertex): weights, and for each vertex whether it is on the side of vertex 0."""
    g, n = weights.shape[:2]
    if n < 2:
        return np.zeros(g), np.ones((g, n), bool)
    every, w = np.arange(g), weights.astype(float)
    w[:, range(n), range(n)] = 0.0
    part = np.zeros((g, n), bool)
    part[:, 0] = True
    for _ in range(n - 1):
        more = part | (part[:, :, None] & (w > 0)).any(axis=1)
        if (more == part).all():
            break
        part = more
    whole = part.all(axis=1)
    alive, member = np.ones((g, n), bool), np.broadcast_to(np.eye(n, dtype=bool), (g, n, n)).copy()
    best, side = np.full(g, np.inf), np.zeros((g, n), bool)
    for left in range(n, 1, -1):  # a phase leaves one vertex less in every graph
        todo, tight = alive.copy(), w[:, 0].copy()
        todo[:, 0] = False
        last = np.zeros(g, int)
        for _ in range(left - 1):
            before = last
            last = np.argmax(np.where(todo, tight, -np.inf), axis=1)  # the first of equals
            phase = tight[every, last]
            todo[every, last] = False
            tight += w[every, last]
        better = phase < best
        best = np.where(better, phase, best)
        side[better] = member[every, last][better]
        w[every, before] += w[every, last]
        w[every, :, before] += w[every, :, last]
        w[every, before, before] = 0.0
        member[every, before] |= member[every, last]
        alive[every, last] = False
    side = np.where(side[:, :1], side, ~side)
    return np.where(whole, best, 0.0), np.where(whole[:, None], side, part)


def likeness(sensitivity: np.ndarray) -> np.ndarray:
    """Weights between tones of a frame, or of each of many: one over how far apart they are; weak ones are no edge."""
    apart = np.abs(sensitivity[..., :, None] - sensitivity[..., None, :])
    w = np.where(apart > EQUAL_WITHIN, 1 / np.maximum(apart, EQUAL_WITHIN), EQUAL_WEIGHT)
    w[w <= LEAST_WEIGHT] = 0.0
    n = sensitivity.shape[-1]
    w[..., range(n), range(n)] = 0.0
    return w


def sensitive_sides(s: np.ndarray) -> tuple[list[float | None], list[list[int]]]:
    """For frames of one size (frame, tone): cut weights (None where there is nothing to cut) and the tones of the sides with the larger means."""
    g, n = s.shape
    if n < LEAST_VERTICES:
        return [None] * g, [list(range(n))] * g
    w = likeness(s)
    joined = w.any(axis=(1, 2))
    cuts, side = min_cuts(w)
    a, b = ((s * x).sum(axis=1) / np.maximum(x.sum(axis=1), 1) for x in (side, ~side))
    side = np.where((~side.any(axis=1) | side.all(axis=1) | (a >= b))[:, None], side, ~side)
    side[~joined] = np.arange(n) < n // 2
    row, tone = np.nonzero(side)
    sides = [x.tolist() for x in np.split(tone, np.searchsorted(row, np.arange(1, g)))]
    return [c if j else None for c, j in zip(cuts.tolist(), joined.tolist(), strict=True)], sides


def partition_tones(df: DataFrame, key: str, sensitivity: Column) -> DataFrame:
    """(key, cut, sensitive): the tones of each row parted by the minimum cut of their likeness.

    Rows with fewer than four tones are sensitive as a whole; null arrays and
    arrays that hold nulls or NaN give an empty side.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), sensitivity.cast("array<double>").alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts, sides = [None] * b.num_rows, [[]] * b.num_rows
            by_size: dict[int, tuple[list, list]] = {}
            for k, s in enumerate(b.column(1).to_pylist()):
                if s is not None and all(x is not None and math.isfinite(x) for x in s):
                    at, held = by_size.setdefault(len(s), ([], []))
                    at.append(k)
                    held.append(s)
            for n, (at, held) in by_size.items():
                step = max(1, CELLS // max(1, n * n))
                for k in range(0, len(at), step):
                    for row, cut, side in zip(at[k : k + step], *sensitive_sides(np.array(held[k : k + step], float).reshape(len(at[k : k + step]), n)), strict=True):
                        cuts[row], sides[row] = cut, side
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cuts, pa.float64()), pa.array(sides, pa.list_(pa.int32()))], names=["key", "cut", "sensitive"])

    return rows.mapInArrow(run, f"key {kind}, cut double, sensitive array<int>").withColumnRenamed("key", key)


def mesh_risk(edges: DataFrame, keys: list[str], a: str, b: str, coupling: str, quantum: float = QUANTUM, risk: float = RISK, least: int = LEAST_NODES) -> DataFrame:
    """By cycle: nodes, the weight of the weakest cut, the side of the smallest node and whether the mesh is at risk.

    Couplings are rounded down to a quantum but a live one is never lost; of
    repeated edges the largest counts.  A cycle's mesh is one row.  Nulls are no edge.
    """
    fine = edges.where(f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL AND `{a}` <> `{b}`")
    steps = F.greatest(F.floor(F.greatest(F.col(coupling), F.lit(0.0)) / quantum), (F.col(coupling) > 0).cast("long"))
    one = fine.groupBy(*keys, F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(F.max(F.coalesce(steps, F.lit(0))).alias("w"))
    held = one.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("u", "v", "w"))).alias("__el_edges"))  # the mesh of a cycle
    out = held.select(*keys, F.lit(0).cast("int").alias("n"), F.lit(0.0).alias("cut"), F.array().cast("array<long>").alias("side"), F.lit(True).alias("at_risk")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for mesh in batch.column(batch.num_columns - 1).to_pylist():
                names = sorted({e[c] for e in mesh for c in "uv"})
                at = {v: k for k, v in enumerate(names)}
                w = np.zeros((len(names), len(names)))
                for e in mesh:
                    w[at[e["u"]], at[e["v"]]] = w[at[e["v"]], at[e["u"]]] = e["w"]
                cut, side = min_cut(w)
                rows.append((len(names), cut * quantum, [int(names[k]) for k in side], len(names) >= least and cut * quantum <= risk))
            n, cuts, sides, risks = zip(*rows, strict=True) if rows else ((), (), (), ())
            arrays = [pa.array(n, pa.int32()), pa.array(cuts, pa.float64()), pa.array(sides, pa.list_(pa.int64())), pa.array(risks, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*keys, "n", "cut", "side", "at_risk"])

    return held.mapInArrow(run, out)
