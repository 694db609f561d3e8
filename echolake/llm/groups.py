"""Groups of rows that a sorted partition brings one after the other, and a table's own columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def streamed_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """(key, rows) for each run of equal values in the first ``keys`` columns, integers without nulls.

    One group is held at a time.
    """
    key: tuple[int, ...] | None = None
    parts: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        ends = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            now = tuple(int(c[a]) for c in columns)
            if now != key and parts:
                yield key, pa.Table.from_batches(parts)
                parts = []
            key = now
            parts.append(batch.slice(a, b - a))
    if parts:
        yield key, pa.Table.from_batches(parts)


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, also those with dots in their names."""
    return [F.col(f"`{c}`") for c in df.columns]
