"""Sharding: a uniform shuffle with exact shard sizes.

Rows are cut into source blocks by a hash of their id.  A communication matrix
(blocks x shards) is drawn from the multivariate hypergeometric distribution:
how many rows of each block go to each shard, with exact block and shard
totals.  Each block is permuted locally and dealt out by its row of the matrix,
and each shard is permuted again.  That is a uniform random permutation cut
into shards whose counts differ by one at most.

The draw is seeded and blocks don't depend on Spark's partitions, so a retried
task and a second run give the same shards.  The matrix has ``MAX_BLOCKS`` x
shards numbers at most, whatever the input.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.llm.groups import own_columns
from echolake.plans.ranking import exact_rank
from echolake.plans.shared import materialize

ROWS_PER_BLOCK = 50_000
MAX_BLOCKS = 4096
_NUMPY = 10**9  # its generator takes urns below this
_SPREAD = 12


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows without replacement are good; any size."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good < _NUMPY and bad < _NUMPY:
        return int(rng.hypergeometric(good, bad, draws))
    return _inverted(rng.random(), good, bad, draws)


def _inverted(u: float, good: int, bad: int, draws: int) -> int:
    """The same law by inversion: chances from the ratios of neighbours, outwards from the mode.

    Chances more than ``_SPREAD`` deviations from it are below what a double can tell from 0.
    """
    n = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    mode = (draws + 1) * (good + 1) // (n + 2)
    sd = math.sqrt(draws * (good / n) * (bad / n) * ((n - draws) / max(1, n - 1)))
    reach = int(_SPREAD * sd) + 20
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rise = np.cumsum(np.log(good - up) - np.log(up + 1) + np.log(draws - up) - np.log(bad - draws + up + 1))
    fall = np.cumsum(np.log(down) - np.log(good - down + 1) + np.log(bad - draws + down) - np.log(draws - down + 1))
    chance = np.exp(np.concatenate([fall[::-1], [0.0], rise]))
    chance = np.cumsum(chance)
    return mode - len(down) + min(int(np.searchsorted(chance, u * chance[-1], "right")), len(chance) - 1)


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows that each block sends to each shard; row and column sums are as given."""
    rng = np.random.default_rng(seed)
    left = list(shards)
    out = np.zeros((len(blocks), len(shards)), np.int64)
    for b, n in enumerate(blocks):
        rest = sum(left)
        for s, room in enumerate(left):
            rest -= room
            got = _hypergeometric(rng, room, rest, n)
            out[b, s] = got
            left[s] -= got
            n -= got
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shuffle_into_shards(
    df: DataFrame, key: str, ties: list[str], shards: int, seed: int = 6, shard: str = "shard", slot: str = "slot"
) -> DataFrame:
    """``df`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    Shard counts differ by one at most.  Null keys form a group of their own.
    ``df`` is read more than once; rows equal in ``key`` and ``ties`` may swap.
    """
    if clash := {shard, slot} & set(df.columns):
        raise ValueError(f"there are columns {sorted(clash)} already")
    spark = df.sparkSession
    total = df.count()
    blocks = max(1, min(MAX_BLOCKS, -(-total // ROWS_PER_BLOCK)))
    hashed = lambda k: F.xxhash64(F.col(key), *[F.col(t) for t in ties], F.lit(seed), F.lit(k))
    cut = df.withColumn("__el_block", F.pmod(hashed(0), F.lit(blocks)).cast("int"))
    counts = {r["__el_block"]: r["count"] for r in cut.groupBy("__el_block").count().collect()}  # MAX_BLOCKS rows
    sizes = [counts.get(b, 0) for b in range(blocks)]
    matrix = communication_matrix(sizes, shard_sizes(total, shards), seed)
    ends = [(b, np.cumsum(matrix[b]).tolist()) for b in range(blocks)]
    table = spark.createDataFrame(ends, "__el_block int, __el_ends array<long>")
    local = exact_rank(cut, ["__el_block"], hashed(1), [key, *ties], "__el_at", total)
    dealt = local.join(F.broadcast(table), "__el_block").withColumn(
        shard, F.size(F.filter("__el_ends", lambda e: e <= F.col("__el_at"))).cast("int")
    )
    dealt = materialize(dealt.select(*own_columns(df), shard), "shards")
    return exact_rank(dealt, [shard], hashed(2), [key, *ties], slot, total).select(*own_columns(df), shard, slot)


def document_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into 40 shards whose row counts differ by one at most."""
    text = F.col("text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        document_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = materialize(docs, "sizes")
    out = shuffle_into_shards(rows, "doc_id", ["size", "text_crc32"], shards=40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
