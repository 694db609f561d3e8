"""Vector search: stated queries against all rows, in blocks of a bounded size.

A block of queries is broadcast as one matrix and every task goes through its
rows with matrix products, keeping the best of each query; a row leaves a task
only as one of its ``k`` best.  Each block is a job of its own whose result is
written, so the plan does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolake.plans.shared import materialize, materialize_all

#: Queries of one broadcast block: 16,384 vectors of 128 doubles are 16 MB.
QUERIES_PER_BLOCK = 16_384
_TILE_ROWS, _TILE_QUERIES = 1024, 1024
_WORD = 32


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def sign_sketch(v: Column) -> Column:
    """One bit for each component, whether it is above 0, in words of 32 bits."""
    words = F.ceil(F.size(v) / _WORD).cast("int")
    power = lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i.cast("double"))).otherwise(0.0)
    word = lambda k: F.aggregate(F.transform(F.slice(v, k * _WORD + 1, F.lit(_WORD)), power), F.lit(0.0), lambda s, b: s + b).cast("long")
    return F.when(words > 0, F.transform(F.sequence(F.lit(0), words - 1), word)).otherwise(F.array().cast("array<long>"))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def _cosines(rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
    return 1 - asked @ rows.T


def _squares(rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
    return np.maximum((asked * asked).sum(1)[:, None] + (rows * rows).sum(1) - 2 * (asked @ rows.T), 0)


def _bits(rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
    return sum((np.bitwise_count(asked[:, j, None] ^ rows[None, :, j]).astype(np.float64) for j in range(rows.shape[1])), np.zeros((len(asked), len(rows))))


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; those of length 0 become NaN, which is near nothing."""
    n = np.sqrt((m * m).sum(1))
    return m / np.where(n > 0, n, np.nan)[:, None]


#: Metric -> number type, what is done to vectors once, and distances (queries x rows).
METRICS: dict[str, tuple] = {"cosine": (np.float64, _unit, _cosines), "l2": (np.float64, lambda m: m, _squares), "hamming": (np.int64, lambda m: m, _bits)}


def matrices(ids: pa.Array, vectors: pa.Array, kind: type) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vector: ids and a matrix of the vectors, without null ids and vectors that are null or hold nulls or NaN."""
    out = {}
    lists = vectors if pa.types.is_list(vectors.type) else vectors.cast(pa.list_(vectors.type.value_type))
    sizes = np.where(np.asarray(ids.is_valid()) & np.asarray(lists.is_valid()), np.asarray(lists.value_lengths().fill_null(0)), 0)
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        flat = lists.take(pa.array(at)).flatten()
        m = np.asarray(flat.cast(pa.float64()) if kind is np.float64 else flat.fill_null(0)).reshape(-1, n).astype(kind)
        fine = np.isfinite(m).all(1) if kind is np.float64 else np.ones(len(m), bool)
        out[n] = keys[at[fine]], m[fine]
    return out


class Best:
    """The k smallest distances of each query so far; ties go to the smaller key."""

    def __init__(self, n: int, k: int):
        self.k, self.distance, self.key = k, np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def take(self, first: int, distance: np.ndarray, keys: np.ndarray) -> None:
        """Distances of queries ``first`` and on to rows with ``keys``; NaN is no distance."""
        here = slice(first, first + len(distance))
        distance = np.where(np.isnan(distance), np.inf, distance)
        least = self.distance[here, -1]
        if distance.shape[1] > self.k:
            least = np.minimum(least, np.partition(distance, self.k - 1, axis=1)[:, self.k - 1])
        q, r = np.nonzero((distance <= least[:, None]) & np.isfinite(distance))
        some = np.unique(q)
        if not len(some):
            return
        all_q = np.concatenate([np.repeat(some, self.k), q])
        all_d = np.concatenate([self.distance[here][some].ravel(), distance[q, r]])
        all_k = np.concatenate([self.key[here][some].ravel(), keys[r]])
        order = np.lexsort((all_k, all_d, all_q))
        begin = np.searchsorted(all_q[order], some)
        top = order[begin[:, None] + np.arange(self.k)]
        self.distance[first + some], self.key[first + some] = all_d[top], all_k[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, place = np.nonzero(np.isfinite(self.distance))
        return q, self.key[q, place], self.distance[q, place]


def best_in_blocks(rows: DataFrame, key: str, asked: DataFrame, k: int, prepare: Callable[[pa.Table], object], score: Callable[[object, pa.RecordBatch, dict], Iterator[tuple]]) -> DataFrame:
    """(query, key, distance): the ``k`` best rows of every query, blocks of queries one after the other.

    ``prepare`` makes a block of ``asked`` (columns query, ...) into what is
    broadcast: an object with ``groups``, {group: query ids}.  ``score`` gives
    (group, first query, distances, keys) tiles of a batch of rows.
    """
    n = asked.count()
    blocks = max(1, -(-n // QUERIES_PER_BLOCK))
    cut = materialize(asked.withColumn("__el_block", F.floor(F.rand(7) * blocks).cast("int")), "queries") if blocks > 1 else asked.withColumn("__el_block", F.lit(0))
    schema = "query long, other long, distance double"

    def of_block(b: int) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(prepare(cut.where(F.col("__el_block") == b).drop("__el_block").toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shared.value
            best = {g: Best(len(ids), k) for g, ids in held.groups.items()}
            for batch in batches:
                for start in range(0, batch.num_rows, _TILE_ROWS):
                    for g, first, distance, keys in score(held, batch.slice(start, _TILE_ROWS), best):
                        own = held.groups[g][first : first + len(distance)]
                        best[g].take(first, np.where(own[:, None] == keys, np.nan, distance), keys)
            for g, found in best.items():
                q, other, distance = found.rows()
                yield pa.RecordBatch.from_arrays([pa.array(held.groups[g][q], pa.int64()), pa.array(other, pa.int64()), pa.array(distance)], names=["query", "other", "distance"])

        return rows.mapInArrow(run, schema)

    found = of_block(0) if blocks == 1 else materialize_all((of_block(b) for b in range(blocks)), "neighbours")
    w = Window.partitionBy("query").orderBy("distance", "other")
    top = found.distinct().withColumn("__el_rank", F.row_number().over(w)).where(F.col("__el_rank") <= k)
    return top.select("query", F.col("other").alias(key), "distance")


class _Block:
    def __init__(self, groups: dict[int, np.ndarray], vectors: dict[int, np.ndarray]):
        self.groups, self.vectors = groups, vectors


def nearest(df: DataFrame, key: str, is_query: Column, vector: str, metric: str, k: int) -> DataFrame:
    """The ``k`` nearest other rows of each query row: (query, key, distance), ties by key.

    ``key`` is an integer; a row is never near one of the same key.  Vectors
    meet those of their own length; null keys, vectors that are null, empty or
    hold nulls or NaN, and zero vectors under ``cosine`` are near nothing.
    Repeated query ids count once if their results agree.
    """
    kind, once, distances = METRICS[metric]
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    asked = df.where(is_query).select(F.col(key).cast("long").alias("query"), F.col(vector).alias("vector"))

    def prepare(t: pa.Table) -> _Block:
        t = t.combine_chunks()
        found = matrices(t.column("query").combine_chunks(), t.column("vector").combine_chunks(), kind) if t.num_rows else {}
        return _Block({n: ids for n, (ids, _) in found.items()}, {n: once(m) for n, (_, m) in found.items()})

    def score(held: _Block, batch: pa.RecordBatch, best: dict) -> Iterator[tuple]:
        for n, (keys, m) in matrices(batch.column(0), batch.column(1), kind).items():
            if n not in held.vectors:
                continue
            m = once(m)
            for first in range(0, len(held.groups[n]), _TILE_QUERIES):
                yield n, first, distances(m, held.vectors[n][first : first + _TILE_QUERIES]), keys

    return best_in_blocks(rows, key, asked, k, prepare, score)


#: Centres of one broadcast block.
CENTRES_PER_BLOCK = 16_384


def nearest_of(centres: DataFrame, df: DataFrame, key: str, vector: str, metric: str, digits: int | None = None) -> DataFrame:
    """Each row of ``df`` with its ``nearest`` key of ``centres`` and the ``distance``; ties go to the larger key.

    Centres are broadcast in blocks, one after the other; rows that are near
    nothing (see ``nearest``) are left out.  ``digits``: distances are rounded first.
    """
    kind, once, distances = METRICS[metric]
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    held = centres.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    blocks = max(1, -(-held.count() // CENTRES_PER_BLOCK))
    held = materialize(held.withColumn("__el_block", F.floor(F.rand(7) * blocks).cast("int")), "centres")

    def of_block(b: int) -> DataFrame:
        t = held.where(F.col("__el_block") == b).drop("__el_block").toArrow()
        found = matrices(t.column("key").combine_chunks(), t.column("vector").combine_chunks(), kind) if t.num_rows else {}
        shared = df.sparkSession.sparkContext.broadcast({n: (ids[order], once(m[order])) for n, (ids, m) in found.items() for order in [np.argsort(-ids)]})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, (keys, m) in matrices(batch.column(0), batch.column(1), kind).items():
                    if n not in shared.value:
                        continue
                    ids, c = shared.value[n]
                    d = distances(once(m), c).T
                    d = np.where(np.isnan(d), np.inf, d if digits is None else d.round(digits))
                    at = d.argmin(axis=1)
                    fine = np.isfinite(d[np.arange(len(at)), at])
                    arrays = [pa.array(keys[fine], pa.int64()), pa.array(ids[at][fine], pa.int64()), pa.array(d[np.arange(len(at)), at][fine])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["key", "nearest", "distance"])

        return rows.mapInArrow(run, "key long, nearest long, distance double")

    if blocks == 1:
        return of_block(0).withColumnRenamed("key", key)
    found = materialize_all((of_block(b) for b in range(blocks)), "nearest")
    best = found.groupBy("key").agg(F.min_by(F.struct("nearest", "distance"), F.struct("distance", -F.col("nearest"))).alias("b"))
    return best.select(F.col("key").alias(key), "b.*")
