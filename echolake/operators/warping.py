"""Dynamic time warping: windows against templates, within a band, without the pairs that cannot win.

Templates are few and broadcast after a check of their size.  For each window a
lower bound to every template (what sticks out of the template's envelope) is
cheap; templates are tried in its order until the bound passes the second best
distance, so no pair is lost that the result could depend on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the classifier.
LEAST_ROWS, MOST_DISTANCE, BAND = 10, 50.0, 5
EPSILON = 1e-10
#: Numbers in all templates together, at most.
TEMPLATE_NUMBERS = 4_000_000


def banded(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Warping distances of pairs of sequences, a: (pairs, n, features) and b: (pairs, m, features); inf outside the band."""
    pairs, n, m = len(a), a.shape[1], b.shape[1]
    if not n or not m or abs(n - m) > band:
        return np.full(pairs, np.inf)
    before = np.full((pairs, m + 1), np.inf)
    before[:, 0] = 0.0
    for i in range(1, n + 1):
        now = np.full((pairs, m + 1), np.inf)
        low, high = max(1, i - band), min(m, i + band)
        cost = np.sqrt(((a[:, i - 1, None] - b[:, low - 1 : high]) ** 2).sum(-1))
        for j in range(low, high + 1):
            now[:, j] = cost[:, j - low] + np.minimum(np.minimum(before[:, j], now[:, j - 1]), before[:, j - 1])
        before = now
    return before[:, m]


def lower_bounds(a: np.ndarray, template: np.ndarray, band: int) -> np.ndarray:
    """What no warping within the band can save, for each sequence of a: (windows, n, features)."""
    n, m = a.shape[1], len(template)
    if not n or not m or abs(n - m) > band:
        return np.full(len(a), np.inf)
    out = np.zeros(len(a))
    for i in range(n):
        near = template[max(0, i - band) : min(m, i + band + 1)]
        off = np.maximum(np.maximum(a[:, i] - near.max(0), near.min(0) - a[:, i]), 0.0)
        out += np.sqrt((off**2).sum(-1))
    return out


def two_best(windows: np.ndarray, templates: Sequence[np.ndarray], band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window the best template's number (-1 for none; ties: the first), the two least distances, and how many pairs were warped."""
    n = len(windows)
    bound = np.stack([lower_bounds(windows, t, band) for t in templates], axis=1) if templates else np.zeros((n, 0))
    order = np.argsort(bound, axis=1, kind="stable")
    first, second, which, warped = np.full(n, np.inf), np.full(n, np.inf), np.full(n, -1), np.zeros(n, int)
    for turn in range(len(templates)):
        at = order[:, turn]
        go = np.flatnonzero((bound[np.arange(n), at] <= second + 1e-9) & np.isfinite(bound[np.arange(n), at]))
        for t in np.unique(at[go]).tolist():
            own = go[at[go] == t]
            d = banded(windows[own], np.broadcast_to(templates[t], (len(own), *templates[t].shape)), band)
            warped[own] += 1
            better = (d < first[own]) | ((d == first[own]) & np.isfinite(d) & (t < which[own]))
            second[own] = np.where(better, first[own], np.minimum(second[own], d))
            which[own] = np.where(better, t, which[own])
            first[own] = np.where(better, d, first[own])
    return which, first, second, warped


def windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str], rows: int) -> DataFrame:
    """(keys, turn, sequence): every ``rows`` rows of a key on end as one sequence; rows with a null feature and a last part of fewer rows are left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fine = df
    for f in features:
        fine = fine.where(F.col(f).isNotNull())
    placed = fine.withColumn("__el_n", F.row_number().over(w) - 1)
    turn = F.floor(F.col("__el_n") / rows).cast("long")
    one = F.struct(F.col("__el_n"), F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    held = placed.groupBy(*keys, turn.alias("turn")).agg(F.array_sort(F.collect_list(one)).alias("__el_s"))  # ``rows`` rows each
    return held.where(F.size("__el_s") == rows).select(*keys, "turn", F.col("__el_s.v").alias("sequence"))


def classify(df: DataFrame, ids: Sequence[str], sequence: str, templates: DataFrame, band: int = BAND, most: float = MOST_DISTANCE, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``ids`` with ``template``, ``distance``, ``recognized``, ``confidence`` and ``pairs_warped``.

    ``templates`` has name and sequence.  The nearest template is recognised up
    to ``most``; the confidence is how far the second one is behind.  Sequences
    that are null, of fewer than ``least_rows`` rows or of uneven features give
    no row; equal distances go to the smaller name.
    """
    held = templates.where(F.size("sequence") >= least_rows).agg(F.count(F.lit(1)), F.sum(F.size("sequence") * F.size(F.get("sequence", F.lit(0))))).first()
    if (held[1] or 0) > TEMPLATE_NUMBERS:
        raise ValueError(f"{held[1]} numbers of templates are more than {TEMPLATE_NUMBERS} to broadcast")
    known = [(r["name"], np.array(r["sequence"], float)) for r in templates.where(F.size("sequence") >= least_rows).orderBy("name").collect()]
    shared = df.sparkSession.sparkContext.broadcast(known)
    kept = df.select(*ids, F.col(sequence).alias("__el_sequence"))
    schema = kept.select(*ids, F.lit(None).cast("string").alias("template"), F.lit(0.0).alias("distance"), F.lit(True).alias("recognized"), F.lit(0.0).alias("confidence"), F.lit(0).cast("int").alias("pairs_warped"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_shape: dict[tuple, list[int]] = {}
            rows = batch.column(batch.num_columns - 1).to_pylist()
            for k, s in enumerate(rows):
                if s and len(s) >= least_rows and all(r and len(r) == len(s[0]) and all(x is not None for x in r) for r in s):
                    by_shape.setdefault((len(s), len(s[0])), []).append(k)
            for (_, features), own in sorted(by_shape.items()):
                mine = [(n, t) for n, t in shared.value if t.ndim == 2 and t.shape[1] == features]
                which, first, second, warped = two_best(np.array([rows[k] for k in own]), [t for _, t in mine], band)
                fine = np.isfinite(first) & (first <= most)
                with np.errstate(invalid="ignore", divide="ignore"):
                    apart = np.where(np.isfinite(second) & (second > EPSILON), 1 - first / second, 1 - first / most)
                confidence = np.where(fine, np.clip(apart, 0.0, 1.0), 0.0)
                names = [mine[w][0] if w >= 0 and ok else None for w, ok in zip(which.tolist(), fine.tolist(), strict=True)]
                kept_columns = [c.take(pa.array(own)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [*kept_columns, pa.array(names, pa.string()), pa.array(first), pa.array(fine), pa.array(confidence), pa.array(warped, pa.int32())],
                    names=[*batch.schema.names[:-1], "template", "distance", "recognized", "confidence", "pairs_warped"],
                )

    return kept.mapInArrow(run, schema.schema)
