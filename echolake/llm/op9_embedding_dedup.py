"""Embedding near-dedup: random-hyperplane sign hashing, exact cosines, components.

Each of several tables hashes a vector to the signs of its products with random
hyperplanes.  Vectors that share a bucket of any table are compared by exact
cosine in double precision.  Bits and tables follow from the number of vectors:
buckets hold ``ROWS_PER_BUCKET`` unrelated vectors at most, and a pair at the
threshold itself is found with probability ``RECALL`` (closer pairs are all but
sure).  So n vectors take a number of tables that grows with n to the power
log(1 / 0.856) / log 2 = 0.22, once they need more than ``LEAST_BITS``.

A bucket of any size is cut into blocks; a task multiplies one pair of blocks.
It returns how many vectors each row links with, counting a pair in the first
table that has it in one bucket, and one edge a row that keeps what is
connected; pairs themselves never leave a task.  Equal vectors are one row with
a multiplicity.

Only ids are dealt to the tables; a row then takes its vector to its block,
as floats where these hold it exactly, and no codes, which the task computes
again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.llm.components import connected_components
from echolake.llm.groups import streamed_groups
from echolake.plans.shared import materialize

THRESHOLD = 0.9
RECALL = 0.995
LEAST_BITS, MOST_BITS = 8, 24
ROWS_PER_BUCKET = 1024
ROWS_PER_BLOCK = 2048
_CHUNK = 128
_UNIT, _PLANE = 1 << 20, 1 << 10  # whole numbers, whose products doubles hold exactly


def plan(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for so many distinct vectors."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, rows) / ROWS_PER_BUCKET))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def hyperplanes(dim: int, bits: int, tables: int, seed: int = 9) -> np.ndarray:
    """Normals of random hyperplanes, rounded to whole numbers."""
    return np.rint(np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits)) * _PLANE)


def bucket_codes(x: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each row of ``x`` in each table.

    Sums of whole numbers are exact in any order, so a vector has the same codes wherever they are computed.
    """
    whole = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * _UNIT)
    signs = (whole @ planes > 0).reshape(len(x), -1, bits)
    return (signs @ (1 << np.arange(bits))).astype(np.int32)


def _packed(v: np.ndarray) -> bytes:
    """The vector's bytes, as floats where these hold it exactly."""
    with np.errstate(over="ignore"):
        small = v.astype(np.float32)
    return (small if (small == v).all() else v).tobytes()


def _unpacked(raw: list[bytes], dim: int) -> np.ndarray:
    widths = {len(r) for r in raw}
    if len(widths) == 1:
        kind = np.float32 if widths == {4 * dim} else np.float64
        return np.frombuffer(b"".join(raw), kind).reshape(len(raw), dim).astype(np.float64)
    return np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64).astype(np.float64) for r in raw])


def _classes(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, class_id, dim, vec): the vector's bytes; class_id is null for one that can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            ids: list[int | None] = [None] * batch.num_rows
            raw: list[bytes | None] = [None] * batch.num_rows
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == dim)
                x = pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False)
                x = np.ascontiguousarray(x, np.float64).reshape(len(at), dim) + 0.0  # no negative zeros
                with np.errstate(over="ignore", invalid="ignore"):
                    size = np.linalg.norm(x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300), axis=1)
                for i, v, ok in zip(at.tolist(), x, np.isfinite(x).all(axis=1) & (size > 0), strict=True):
                    if ok:
                        raw[i] = _packed(v)
                        ids[i] = xxhash.xxh3_64_intdigest(raw[i]) - (1 << 63)
            columns = [batch.column(0), pa.array(ids, pa.int64()), pa.array(lengths, pa.int32()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "class_id", "dim", "vec"])

    return rows.select(F.col(key).cast("long"), vector).mapInArrow(run, "id long, class_id long, dim int, vec binary")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(class_id, dim, codes): the bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            raw, dims = batch.column(2).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            codes: list[np.ndarray | None] = [None] * len(raw)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim not in planes:
                    planes[dim] = hyperplanes(dim, bits, tables)
                for i, c in zip(at.tolist(), bucket_codes(_unpacked([raw[i] for i in at], dim), planes[dim], bits), strict=True):
                    codes[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(codes, pa.list_(pa.int32()))], names=["class_id", "dim", "codes"])

    return classes.select("class_id", "dim", "vec").mapInArrow(run, "class_id long, dim int, codes array<int>")


def _labels(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the least row that it reaches."""
    label = np.arange(len(linked))
    some = np.flatnonzero(linked.any(axis=1))
    near = linked[np.ix_(some, some)]
    while len(some):
        least = np.array([label[some[row]].min() for row in near])
        new = label.copy()
        new[some] = np.minimum(label[some], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def multiply(table: int, one: dict, two: dict | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Link counts of the rows of ``one`` then ``two``, and for each the row that stands for its component.

    Blocks are dicts of ``unit``, ``many`` and ``codes``; ``two`` is None where a block meets itself.
    """
    other = one if two is None else two
    n, m = len(one["unit"]), len(other["unit"])
    linked, counts = np.zeros((n, m), bool), np.zeros(n + (0 if two is None else m), np.int64)
    for k in range(0, n, _CHUNK):
        near = one["unit"][k : k + _CHUNK] @ other["unit"].T >= threshold
        if two is None:
            near[np.arange(len(near)), np.arange(k, k + len(near))] = False
        linked[k : k + _CHUNK] = near
        if table and near.any():
            i, j = np.nonzero(near)
            seen = (one["codes"][k + i, :table] == other["codes"][j, :table]).any(axis=1)
            near[i[seen], j[seen]] = False
        counts[k : k + len(near)] += near @ other["many"]
        if two is not None:
            counts[n:] += one["many"][k : k + _CHUNK] @ near
    if two is None:
        return counts, _labels(linked | linked.T)
    whole = np.zeros((n + m, n + m), bool)
    whole[:n, n:], whole[n:, :n] = linked, linked.T
    return counts, _labels(whole)


def _compared(classes: DataFrame, hashed: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """Rows (class_id, links, other): partial link counts, and an edge if ``other`` isn't null."""
    place = ["table", "dim", "code"]
    dealt = hashed.select("class_id", "dim", F.posexplode("codes").alias("table", "code"))
    size = dealt.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = size.select(*place, F.ceil(F.col("n") / ROWS_PER_BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("class_id"), "blocks").cast("int")
    met = dealt.join(blocks, place).withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = [*place, "lo", "hi"]
    met = met.withColumn("lo", F.least("mine", "theirs")).withColumn("hi", F.greatest("mine", "theirs")).select(*group, "mine", "class_id")
    met = met.join(classes.select("class_id", "many", "vec"), "class_id").select(*group, "mine", "class_id", "many", "vec")
    met = met.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group, "class_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("class_id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
        planes: dict[int, np.ndarray] = {}
        for (table, dim, _code, lo, hi), rows in streamed_groups(batches, 5):
            part, ids, many = (rows.column(k).to_numpy() for k in (5, 6, 7))
            x = _unpacked(rows.column(8).to_pylist(), dim)
            if dim not in planes:
                planes[dim] = hyperplanes(dim, bits, tables)
            codes = bucket_codes(x, planes[dim][:, : table * bits], bits) if table else np.zeros((len(x), 0), np.int32)
            whole = {"unit": _unit(x), "many": many, "codes": codes}
            cut = lambda at, whole=whole: {k: v[at] for k, v in whole.items()}
            low, high = np.flatnonzero(part == lo), np.flatnonzero(part != lo)
            if lo == hi:
                counts, label = multiply(table, whole, None, threshold)
            elif len(low) and len(high):
                counts, label = multiply(table, cut(low), cut(high), threshold)
                ids = ids[np.concatenate([low, high])]
            else:
                continue
            joined = label != np.arange(len(ids))
            kept = np.flatnonzero((counts > 0) | joined)
            other = pa.array(ids[label[kept]], pa.int64(), mask=~joined[kept])
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.array(counts[kept]), other], schema=kind)

    return met.mapInArrow(run, "class_id long, links long, other long")


def near_duplicates(df: DataFrame, key: str, vector: str, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Rows (``key``, n_links, component_id, kept), one for each row of ``df``.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; vectors of different lengths don't link.  A component's
    id is its least key; a row is kept if that is its own.  Repeated rows are
    vectors of their own that link with each other.
    """
    rows = materialize(_classes(df, key, vector), "vectors")
    usable = rows.where("class_id is not null")
    grouped = usable.groupBy("class_id").agg(F.count(F.lit(1)).alias("many"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    classes = materialize(grouped, "classes")
    bits, tables = plan(classes.count(), threshold, recall)
    hashed = materialize(_hashed(classes, bits, tables), "codes")
    found = materialize(_compared(classes, hashed, bits, tables, threshold), "links")
    roots = connected_components(found.where("other is not null"), "class_id", "other")
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    known = classes.select("class_id", "many").join(links, "class_id", "left").join(roots.withColumnRenamed("node", "class_id"), "class_id", "left")
    known = known.select("class_id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "class_id").alias("root"))
    least = usable.groupBy("class_id").agg(F.min("id").alias("id")).join(known.select("class_id", "root"), "class_id")
    names = least.groupBy("root").agg(F.min("id").alias("name"))
    named = known.join(names, "root").select("class_id", "n_links", "name")
    out = rows.select("id", "class_id").join(named, "class_id", "left")
    name = F.coalesce("name", "id")
    return out.select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        name.alias("component_id"),
        F.col("id").eqNullSafe(name).alias("kept"),
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every vector at a cosine of 0.9."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return near_duplicates(rows, "vec_id", "embedding")


ORACLE_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node
), root AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node
), n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN root ON vec_id = node LEFT JOIN n ON vec_id = a
"""
