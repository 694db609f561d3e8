"""Rotated sign sketches: a randomized Hadamard transform before the signs, distances estimated from the bits, exact re-ranking.

A code is the signs of the rotated vector, its norm and how well the signs
stand for it; the inner product with a rotated query is estimated without bias
from these.  The search reads codes, of one bit a component; only candidates
meet whole vectors.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolake.operators import vectors as V

SEED = 20_260_101


@functools.lru_cache(64)
def signs(seed: int, n: int) -> np.ndarray:
    """``n`` signs from the SplitMix64 sequence of the seed, by the top bit of each number."""
    out, state, mask = np.empty(n), seed & (2**64 - 1), 2**64 - 1
    for k in range(n):
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = state
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & mask
        out[k] = 1.0 if (z ^ (z >> 31)) >> 63 else -1.0
        state = z ^ (z >> 31)  # the sequence goes on from the mixed number
    return out


def rotated(m: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rows of ``m`` with signs flipped, padded with zeros to a power of two and transformed; lengths stay."""
    n, d = m.shape
    wide = 1 << max(0, d - 1).bit_length()
    x = np.zeros((n, wide))
    x[:, :d] = m * signs(seed, wide)[:d]
    h = 1
    while h < wide:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, wide)
        h *= 2
    return x / np.sqrt(wide)


def codes(df: DataFrame, key: str, vector: str, seed: int = SEED) -> DataFrame:
    """(key, dim, bits, norm, fit): signs of the rotated vector, packed, and what the estimate needs; bad vectors have no code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, (ids, m) in V.matrices(batch.column(0), batch.column(1), np.float64).items():
                norm = np.sqrt((m * m).sum(1))
                ids, m, norm = ids[norm > 0], m[norm > 0], norm[norm > 0]
                x = rotated(m, seed)
                fit = np.abs(x).sum(1) / np.sqrt(x.shape[1]) / norm
                bits = [b.tobytes() for b in np.packbits(x >= 0, axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.full(len(ids), d), pa.int32()), pa.array(bits, pa.binary()), pa.array(norm), pa.array(fit)], names=["key", "dim", "bits", "norm", "fit"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector")).mapInArrow(run, "key long, dim int, bits binary, norm double, fit double")


def _signs_of(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.asarray(batch.column(1)) == d)
    wide = 1 << max(0, d - 1).bit_length()
    raw = np.frombuffer(b"".join(batch.column(2).take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
    return at, np.unpackbits(raw, axis=1)[:, :wide], np.asarray(batch.column(0))[at]


def candidates(coded: DataFrame, asked: DataFrame, k: int, by: str = "cosine", seed: int = SEED) -> DataFrame:
    """(query, key, distance) of the ``k`` best codes of each query (columns query, vector).

    ``by``: ``cosine`` or ``l2`` as estimated, or ``hamming``, differing bits of the first components.
    """

    def prepare(t: pa.Table) -> V._Block:
        found = V.matrices(t.column("query").combine_chunks(), t.column("vector").combine_chunks(), np.float64) if t.num_rows else {}
        return V._Block({d: ids for d, (ids, _) in found.items()}, {d: m for d, (_, m) in found.items()})

    def score(held: V._Block, batch: pa.RecordBatch, best: dict) -> Iterator[tuple]:
        for d, m in held.vectors.items():
            at, bits, keys = _signs_of(batch, d)
            if not len(at):
                continue
            norm, fit = (np.asarray(batch.column(c))[at] for c in (3, 4))
            for first in range(0, len(m), V._TILE_QUERIES):
                own = m[first : first + V._TILE_QUERIES]
                x = rotated(own, seed)
                if by == "hamming":
                    yield d, first, V._bits(np.packbits(bits[:, :d], axis=1).astype(np.int64), np.packbits(x[:, :d] >= 0, axis=1).astype(np.int64)), keys
                    continue
                inner = x @ (bits * 2.0 - 1).T / np.sqrt(x.shape[1]) / fit  # with unit vectors
                length = np.sqrt((own * own).sum(1))[:, None]
                with np.errstate(invalid="ignore", divide="ignore"):
                    yield d, first, (1 - inner / length if by == "cosine" else length**2 + norm**2 - 2 * norm * inner), keys

    return V.best_in_blocks(coded, "key", asked, k, prepare, score)


def reranked(found: DataFrame, df: DataFrame, key: str, vector: str, asked: DataFrame, k: int, by: str = "cosine") -> DataFrame:
    """The ``k`` best of ``found`` by exact distance to the vectors of ``df``: (query, key, distance)."""
    met = found.select("query", F.col("key").alias("__el_key")).join(df.select(F.col(key).cast("long").alias("__el_key"), F.col(vector).alias("__el_v")), "__el_key").join(asked.withColumnRenamed("vector", "__el_q"), "query")
    square = F.aggregate(F.zip_with("__el_v", "__el_q", lambda a, b: (a.cast("double") - b.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)
    exact = met.select("query", F.col("__el_key").alias(key), (1 - V.cosine(F.col("__el_v"), F.col("__el_q")) if by == "cosine" else square).alias("distance"))
    w = Window.partitionBy("query").orderBy("distance", key)
    return exact.distinct().withColumn("__el_rank", F.row_number().over(w)).where(F.col("__el_rank") <= k).drop("__el_rank")


def search(df: DataFrame, key: str, is_query: Column, vector: str, k: int, n_candidates: int, by: str = "cosine", exact: bool = False, coded: DataFrame | None = None) -> DataFrame:
    """The ``k`` nearest rows of each query by estimate and re-ranking; ``exact``: by all vectors.

    ``coded``: the written codes of ``df``, where they are kept between searches.
    """
    if exact:
        return V.nearest(df, key, is_query, vector, by, k)
    asked = df.where(is_query).select(F.col(key).cast("long").alias("query"), F.col(vector).alias("vector"))
    found = candidates(codes(df, key, vector) if coded is None else coded, asked, n_candidates, by)
    return reranked(found, df, key, vector, asked, k, by)
