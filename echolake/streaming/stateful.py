"""Kernels of ordered folds over streams with state of any shape, by transformWithState."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from echolake.operators.folds import Kernel, _missing


class _Fold(StatefulProcessor):
    def __init__(self, kernel: Kernel, columns: list[str], order: list[str], t: str, row_id: str, names: list[str]):
        self.kernel, self.columns, self.order, self.t, self.row_id, self.names = kernel, columns, order, t, row_id, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("state", "state binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = pickle.loads(self.held.get()[0]) if self.held.exists() else self.kernel.start
        own = pd.concat(list(rows)).sort_values(self.order)  # one key's rows of one batch
        out = []
        for i, s, *v in zip(*[own[c].tolist() for c in (self.row_id, self.t, *self.columns)], strict=True):
            v = [_plain(x) for x in v]
            if _missing(s) or any(_missing(x) for n, x in enumerate(v) if n not in self.kernel.optional):
                continue
            now, got = self.kernel.step(now, tuple(v), float(s))
            if got is not None:
                out.append((key[0], i, *got))
        self.held.update((pickle.dumps(now),))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def _plain(x: object) -> object:
    """Arrays of rows as lists of dicts, as tables give them."""
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
    return [o.asDict() if hasattr(o, "asDict") else o for o in x] if isinstance(x, list) else x


def fold_state_stream(df: DataFrame, key: str, order: Sequence[str], x: Sequence[str], t: str, row_id: str, kernel: Kernel, mode: str = "append") -> DataFrame:
    """What ``folds.fold`` gives, over a stream whose batches bring each key's rows in order.

    The state is stored as bytes, so it may hold lists and texts.  Needs the
    RocksDB state store.  Keys must not be null.
    """
    kinds = dict(df.dtypes)
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"`{key}` {kinds[key]}, `{row_id}` {kinds[row_id]}, {kernel.output}")
    processor = _Fold(kernel, list(x), list(order), t, row_id, schema.names)
    return df.groupBy(key).transformWithStateInPandas(processor, schema, mode, "None")
