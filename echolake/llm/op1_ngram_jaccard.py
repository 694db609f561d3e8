r"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Documents with the same n-gram set are one row of the incidence matrix.  Which
rows can reach the similarity follows from their sizes alone: a pair of sizes a
and b at similarity s differs in at most (1 - s) / (1 + s) * (a + b) n-grams.

1. The n-gram space is cut into segments, more than may differ.  At least one
   segment with n-grams is then the same in both rows, so each row is dealt to
   blocks by the hash of each of its first segments, one more than may differ.
   Unlike single n-grams, whole segments seldom agree because of a common
   passage.
2. In each block, the rows are first multiplied with one pivot; that joins groups
   of copies, however large, without their pairs.
3. In blocks that still hold several components, the rows outside the largest
   meet all others, in pairs of parts of a bounded number of rows: by
   size, then by parity sketches (the bits in which two sketches differ are at
   most the n-grams in which the rows differ).  A task returns a spanning forest
   of the pairs that remain, and their overlap counts are accumulated in
   products of a block's rows with its pivots.
4. Where a pair of a forest was no link after all, rows that the forests connect
   may still link.  In each such group the rows outside the largest component
   meet all others by their n-grams, once and not block by block; a task returns
   a spanning forest of the links in the product of two parts.
5. A link never leaves its component.  To count all links, the rows of each
   component are cut into parts, and each pair of parts is one sparse product
   inside a task, which returns the number of links of each row.

All bounds are exact, so no link is lost.  N-grams and sets are compared by
hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolake.llm.components import connected_components
from echolake.llm.groups import own_columns
from echolake.plans.shared import materialize

SKETCH_BITS = 512  # at least; longer sets have one or two bits an n-gram
ROWS_PER_PRODUCT = 256
ROWS_PER_PART = 1024
NGRAMS_PER_PART = 1 << 21
_BITMAP = (20, 27)  # powers of two of bits: 16 MB at most
_CACHE_WORDS = 300_000
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


_words = _Words()


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles, A-Z in lower case.

    With fewer words, the whole sequence is one; without words, the set is empty.
    Words are parted by space, tab, line feed, vertical tab, form feed or return.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    odd = _mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
    if len(h) < n:
        return _mix(np.array([sum(int(x) * int(m) for x, m in zip(h, odd, strict=False)) + len(h) & 0xFFFFFFFFFFFFFFFF], np.uint64))
    total = h[: len(h) - n + 1] * odd[0]
    for k in range(1, n):
        total = total + h[k : len(h) - n + 1 + k] * odd[k]
    return np.unique(_mix(total + _U(n)))


@dataclass(frozen=True)
class Bounds:
    """Size-derived bounds for the similarity ``percent`` / 100."""

    percent: int

    def largest(self, a: int) -> int:
        return 100 * a // self.percent

    def differ(self, a: int, b: int) -> int:
        """In how many n-grams sets of these sizes may differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def classes(self, a: int) -> Iterator[tuple[int, int]]:
        """(c, d): pairs whose larger set has a size from 2^c to 2^(c+1) - 1 may differ by d."""
        own = a.bit_length() - 1
        for c in (own, own + 1):
            b = min(self.largest(a), (2 << c) - 1)
            if b >= 1 << c:
                yield c, self.differ(a, b)

    def segments(self, c: int) -> int:
        most = self.differ((2 << c) - 1, (2 << c) - 1)
        return most + most // 3 + 7

    def linked(self, common: np.ndarray | int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)

    def fit(self, a, b):
        """Whether sets of these sizes (numbers or arrays) can be similar enough."""
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)

    def near(self, bits, a, b):
        """Whether sets of these sizes whose sketches differ in so many bits can link."""
        return bits * (100 + self.percent) <= (a + b) * (100 - self.percent)


def block_keys(s: np.ndarray, bounds: Bounds) -> list[np.ndarray]:
    """Keys of the blocks that a set (sorted, distinct) is dealt to."""
    out = []
    for c, d in bounds.classes(len(s)):
        if d == 0:
            continue  # the same set only
        m = bounds.segments(c)
        segment = ((s >> _U(32)) * _U(m)) >> _U(32)
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        sums = np.add.reduceat(_mix(s), starts)[: d + 1]
        out.append(_mix(sums + segment[starts[: d + 1]] * _U(0xD6E8FEB86659FD93) + _U(c + 1)))
        if len(starts) <= d:  # all its segments may differ: a block of all such sets
            out.append(np.array([c], np.uint64))
    return out


def sketch(s: np.ndarray) -> bytes:
    """Parities of how many n-grams fall on each bit; a power of two of bits."""
    bits = max(SKETCH_BITS, 2 << (len(s).bit_length() - 1))
    odd = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(sketch: bytes, size: int) -> bytes:
    """The sketch of ``size`` bytes of the same set."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = (int.from_bytes(sketch[:half], "little") ^ int.from_bytes(sketch[half:], "little")).to_bytes(half, "little")
    return sketch


def sketch_distance(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return (int.from_bytes(fold(a, size), "little") ^ int.from_bytes(fold(b, size), "little")).bit_count()


def _incidence(docs: DataFrame, n: int, bounds: Bounds) -> DataFrame:
    """(doc_id, n_shingles, set_id, bits, keys): set_id is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
            sizes, ids, keys, marks = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), n)
                sizes.append(len(s))
                if len(s):
                    ids.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                    marks.append(sketch(s))
                    found = block_keys(s, bounds)
                    keys.append(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))
                else:
                    ids.append(None)
                    marks.append(None)
                    keys.append(np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(marks, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_id", "bits", "keys"])

    schema = "doc_id long, n_shingles long, set_id long, bits binary, keys array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap with 16 bits an id, of bounded size, that holds all ids; where it is full it filters nothing."""
    power = min(max((16 * ids.count()).bit_length(), _BITMAP[0]), _BITMAP[1])
    place = F.pmod(F.xxhash64(column), F.lit(1 << power))
    words = ids.select(F.shiftright(place, 5).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), 32) as int))").alias("bit"))
    found = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << power - 5, np.uint32)
    out[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def _items(docs: DataFrame, ids: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """(set_id, items): the n-grams of the sets of ``ids`` and of some more; copies may repeat."""
    wanted = sets.join(ids.select("set_id").distinct(), "set_id", "left_semi").select("doc_id")
    found = _bitmap(wanted, "doc_id")
    bitmap = docs.sparkSession.sparkContext.broadcast(found)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
            place = batch.column(0).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(bitmap.value[place >> 5] >> (place & 31).astype(np.uint32) & 1)
            found = [shingle_set(batch.column(1)[i].as_py(), n) for i in hit.tolist()]
            found = {xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63): s.tobytes() for s in found if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], names=["set_id", "items"])

    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(32 * len(found)))
    return docs.select(place.alias("p"), "text").mapInArrow(read, "set_id long, items binary")


def overlaps(rows: list[np.ndarray], pivot: np.ndarray) -> np.ndarray:
    """Overlap counts of a block of rows (sorted, distinct) with a pivot row: one sparse product."""
    ends = np.cumsum([0, *map(len, rows)])
    items = np.concatenate(rows)
    at = np.searchsorted(pivot, items)
    at[at == len(pivot)] = 0
    return np.bincount(np.repeat(np.arange(len(rows)), np.diff(ends))[pivot[at] == items], minlength=len(rows))


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, n: int, bounds: Bounds) -> DataFrame:
    """The pairs (x, pivot) whose overlap count reaches the bound.

    Rows of one pivot form blocks of about ``ROWS_PER_PRODUCT``; the pivot's row is
    copied to each, and a block is one product.
    """
    if not pairs.take(1):
        return pairs
    size = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_PRODUCT).cast("int").alias("blocks"))
    rows = pairs.join(size, "pivot").select(F.col("x").alias("set_id"), "pivot", F.pmod(F.xxhash64("x"), "blocks").cast("int").alias("block"), F.lit(1).alias("turn"))
    heads = size.select(F.col("pivot").alias("set_id"), "pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("turn"))
    dealt = materialize(rows.unionByName(heads), "dealt")
    full = _items(docs, dealt, sets, n).join(dealt, "set_id").repartition("pivot", "block").sortWithinPartitions("pivot", "block", "turn")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot, rows = None, np.zeros(0, np.uint64), {}

        def linked() -> list[int]:
            near = {x: r for x, r in rows.items() if bounds.fit(len(r), len(pivot))}
            if not near:
                return []
            common, sizes = overlaps(list(near.values()), pivot), np.array([len(r) for r in near.values()])
            return np.array(list(near))[bounds.linked(common, sizes, len(pivot))].tolist()

        def packed(found: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["x", "pivot"])

        for batch in batches:
            out: list[tuple[int, int]] = []
            ids, pivots, blocks, turns, items = (batch.column(batch.schema.get_field_index(c)) for c in ("set_id", "pivot", "block", "turn", "items"))
            for i, (x, p, b, t) in enumerate(zip(ids.to_pylist(), pivots.to_pylist(), blocks.to_pylist(), turns.to_pylist(), strict=True)):
                if (p, b) != key:
                    out += [(y, key[0]) for y in linked()] if rows else []
                    key, rows = (p, b), {}
                row = np.frombuffer(items[i].as_py(), np.uint64)
                if t == 0:
                    pivot = row
                else:
                    rows[x] = row  # copies are one row
            yield packed(out)
        if rows:
            yield packed([(y, key[0]) for y in linked()])

    return full.mapInArrow(multiply, "x long, pivot long").distinct()


def _screened(pairs: DataFrame, sets: DataFrame, bounds: Bounds) -> DataFrame:
    """The pairs (x, pivot) that sizes and sketches allow."""
    own = ["set_id", "n_shingles", "bits"]
    left = sets.select(*[F.col(c).alias(n) for c, n in zip(own, ("x", "a", "p"), strict=True)])
    right = sets.select(*[F.col(c).alias(n) for c, n in zip(own, ("pivot", "b", "q"), strict=True)])
    fits = F.least("a", "b") * 100 >= F.greatest("a", "b") * bounds.percent
    joined = pairs.join(left, "x").join(right, "pivot").where(fits).select("x", "pivot", "a", "b", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [sketch_distance(p.as_py(), q.as_py()) for p, q in zip(batch.column(4), batch.column(5), strict=True)]
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            kept = pa.array(bounds.near(np.array(bits, np.int64), a, b), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["x", "pivot"])

    return joined.mapInArrow(run, "x long, pivot long")


def candidate_pairs(sizes: np.ndarray, roots: np.ndarray, bits: list[bytes], first: int, bounds: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different components that may link.

    With ``first``, only pairs of one of the first so many rows and one of the rest.
    """
    words = min(map(len, bits))
    marks = np.frombuffer(b"".join([fold(x, words) for x in bits]), np.uint64).reshape(len(bits), -1)
    brief = np.frombuffer(b"".join([fold(x, SKETCH_BITS // 8) for x in bits]), np.uint64).reshape(len(bits), -1)
    i, j = [], []
    for k in range(first or len(bits) - 1):
        rest = np.arange(first or k + 1, len(bits))
        rest = rest[(roots[rest] != roots[k]) & bounds.fit(sizes[rest], sizes[k])]
        for table in (brief, marks):
            if len(rest):
                rest = rest[bounds.near(np.bitwise_count(table[rest] ^ table[k]).sum(axis=1, dtype=np.int64), sizes[rest], sizes[k])]
        i.append(np.full(len(rest), k))
        j.append(rest)
    return np.concatenate(i), np.concatenate(j)


def spanning_forest(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, pivot) that connect what the pairs connect; rows with most pairs are the pivots."""
    n = len(roots)
    met = np.zeros((n, n), bool)
    met[i, j] = met[j, i] = True
    seen, out = np.zeros(n, bool), []
    for start in np.argsort(-met.sum(axis=1), kind="stable").tolist():
        if seen[start]:
            continue
        queue = np.flatnonzero(roots == roots[start]).tolist()
        seen[queue] = True
        for pivot in queue:  # grows meanwhile
            for row in np.flatnonzero(met[pivot] & ~seen).tolist():
                if not seen[row]:
                    same = np.flatnonzero(roots == roots[row])
                    seen[same] = True
                    queue.extend(same.tolist())
                    out.append((row, pivot))
    return out


def _met(blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, lo, hi, part, set_id, root): pairs of parts of the rows of blocks that hold several components.

    Rows of a block's largest component, often all but a few, meet only the others.
    """
    named = blocks.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    sizes = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    ends = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all")).where("most < all")
    parts = lambda n: F.ceil(n / ROWS_PER_PART).cast("int")
    ends = ends.select("key", "main", parts(F.col("all") - F.col("most")).alias("others"), parts(F.col("most")).alias("mains"))
    mixed = named.join(ends, "key").withColumn("other", F.col("root") != F.col("main"))
    hashed = F.xxhash64("set_id")
    part = F.when(F.col("other"), F.pmod(hashed, "others")).otherwise(F.pmod(hashed, "mains") + F.col("others")).cast("int")
    last = F.when(F.col("other"), F.col("others") + F.col("mains")).otherwise(F.col("others")) - 1
    dealt = mixed.withColumn("part", part).withColumn("met", F.explode(F.sequence(F.lit(0), last)))
    return dealt.select("key", F.least("part", "met").alias("lo"), F.greatest("part", "met").alias("hi"), "part", "set_id", "root")


def _forest(full: DataFrame, pairs) -> DataFrame:
    """Rows (x, pivot): a spanning forest of ``pairs(rows, first)`` in each pair of parts.

    ``full``: (key, lo, hi, part, set_id, root, more); a row of ``rows`` is (root, more).
    """
    group = ["key", "lo", "hi"]
    full = full.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group, "part", "set_id")

    def found(key: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
        first = sum(r[0] == key[1] for r in rows) if key[1] != key[2] else 0
        if len(rows) < 2 or first == len(rows) or (key[1] != key[2] and first == 0):
            return []
        i, j = pairs([r[2:] for r in rows], first)
        return [(rows[a][1], rows[b][1]) for a, b in spanning_forest(np.array([r[2] for r in rows]), i, j)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def packed(links: list[tuple[int, int]]) -> pa.RecordBatch:
            x, pivot = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(pivot, pa.int64())], names=["x", "pivot"])

        for batch in batches:
            out: set[tuple[int, int]] = set()
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:3] != key:
                    out.update(found(key, rows) if rows else ())
                    key, rows = row[:3], []
                if not rows or rows[-1][1] != row[4]:  # else a copy of the row before
                    rows.append(row[3:])
            yield packed(sorted(out))
        if rows:
            yield packed(found(key, rows))

    return full.mapInArrow(run, "x long, pivot long").distinct()


def _candidates(met: DataFrame, sets: DataFrame, bounds: Bounds) -> DataFrame:
    """Rows (x, pivot) that connect what may link by size and sketch."""

    def pairs(rows: list[tuple], first: int) -> tuple[np.ndarray, np.ndarray]:
        roots, sizes, bits = zip(*rows, strict=True)
        return candidate_pairs(np.array(sizes), np.array(roots), list(bits), first, bounds)

    full = met.join(sets.select("set_id", "n_shingles", "bits"), "set_id")
    return _forest(full.select("key", "lo", "hi", "part", "set_id", "root", "n_shingles", "bits"), pairs)


def _linked_parts(met: DataFrame, docs: DataFrame, sets: DataFrame, n: int, bounds: Bounds) -> DataFrame:
    """Rows (x, pivot) that connect what links, by the product of each pair of parts."""

    def pairs(rows: list[tuple], first: int) -> tuple[np.ndarray, np.ndarray]:
        roots = np.array([r[0] for r in rows])
        found = list(linked_rows([np.frombuffer(r[1], np.uint64) for r in rows], first, bounds))
        i = np.concatenate([np.full(len(rest), k) for k, rest in found])
        j = np.concatenate([rest for _, rest in found])
        apart = roots[i] != roots[j]
        return i[apart], j[apart]

    met = materialize(met, "dealt")
    full = _items(docs, met, sets, n).join(met, "set_id")
    return _forest(full.select("key", "lo", "hi", "part", "set_id", "root", "items"), pairs)


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``roots`` (node, root) after more links (x, pivot)."""
    if not links.take(1):
        return roots
    return connected_components(roots.select(F.col("node").alias("x"), F.col("root").alias("pivot")).unionByName(links), "x", "pivot")


def linked_rows(items: list[np.ndarray], first: int, bounds: Bounds) -> Iterator[tuple[int, np.ndarray]]:
    """For each set (sorted, distinct) in turn, the later ones that it links with: a sparse product, row by row.

    With ``first``, only pairs of one of the first so many sets and one of the rest.
    Sets are multiplied by their differences from one of them, which near copies share.
    """
    n, sizes = len(items), np.array([len(x) for x in items], np.int64)
    apart = [np.setxor1d(x, items[0], assume_unique=True) for x in items]
    off = np.array([len(x) for x in apart], np.int64)
    ends = np.concatenate([[0], np.cumsum(off)])
    _, column = np.unique(np.concatenate(apart), return_inverse=True)
    rows = np.repeat(np.arange(n), off)[np.argsort(column, kind="stable")]
    degree = np.bincount(column)
    starts = np.cumsum(degree) - degree
    for k in range(first or n - 1):
        mine = column[ends[k] : ends[k + 1]]
        long = degree[mine]
        place = np.repeat(starts[mine] - np.cumsum(long) + long, long) + np.arange(long.sum())
        rest = np.arange(first or k + 1, n)
        differ = off[k] + off[rest] - 2 * np.bincount(rows[place], minlength=n)[rest]
        yield k, rest[bounds.linked((sizes[k] + sizes[rest] - differ) // 2, sizes[k], sizes[rest])]


def link_counts(items: list[np.ndarray], many: np.ndarray, first: int, bounds: Bounds) -> np.ndarray:
    """With how many rows each set links; a set has ``many`` rows."""
    counts = np.zeros(len(items), np.int64)
    for k, rest in linked_rows(items, first, bounds):
        counts[k] += many[rest].sum()
        counts[rest] += many[k]
    return counts


def _links(roots: DataFrame, docs: DataFrame, sets: DataFrame, n: int, bounds: Bounds) -> DataFrame:
    """Rows (set_id, links): with how many rows of other sets a set links, null if none of its pairs does."""
    members = roots.withColumnRenamed("node", "set_id").join(sets.select("set_id", "n_shingles", "many"), "set_id")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / ROWS_PER_PART), F.ceil(F.sum("n_shingles") / NGRAMS_PER_PART)).cast("int")
    cut = members.join(members.groupBy("root").agg(parts.alias("parts")), "root").withColumn("part", F.pmod(F.xxhash64("set_id"), "parts").cast("int"))
    dealt = cut.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = materialize(dealt.select("root", F.least("part", "met").alias("lo"), F.greatest("part", "met").alias("hi"), "part", "set_id", "many"), "dealt")
    group = ["root", "lo", "hi"]
    full = _items(docs, dealt, sets, n).join(dealt, "set_id").select(*group, "part", "set_id", "many", "items")
    full = full.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group, "part", "set_id")

    def result(key: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
        first = sum(r[0] == key[1] for r in rows) if key[1] != key[2] else 0
        if len(rows) < 2 or first == len(rows) or (key[1] != key[2] and first == 0):
            return []
        counts = link_counts([np.frombuffer(r[3], np.uint64) for r in rows], np.array([r[2] for r in rows], np.int64), first, bounds)
        return [(r[1], c) for r, c in zip(rows, counts.tolist(), strict=True) if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def packed(found: list[tuple[int, int]]) -> pa.RecordBatch:
            x, links = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(links, pa.int64())], names=["set_id", "links"])

        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            for i, row in enumerate(zip(*columns, strict=True)):
                if row[:3] != key:
                    out += result(key, rows) if rows else []
                    key, rows = row[:3], []
                if not rows or rows[-1][1] != row[4]:  # else a copy of the row before
                    rows.append((*row[3:], batch.columns[-1][i].as_py()))
            yield packed(out)
        if rows:
            yield packed(result(key, rows))

    return full.mapInArrow(run, "set_id long, links long").groupBy("set_id").agg(F.sum("links").alias("links"))


def _found(docs: DataFrame, n: int, bounds: Bounds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``docs`` with their set_id, the sets, and the components (node, root) of linked sets."""
    rows = materialize(_incidence(docs, n, bounds), "incidence")
    full = rows.where("set_id is not null")
    sets = materialize(full.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("many")), "sets")
    keyed = full.where(F.size("keys") > 0).groupBy("set_id").agg(F.first("keys").alias("keys"))
    # most keys are of one set, so that partial sums shrink nothing: one shuffle serves the ends and the join
    dealt = keyed.select("set_id", F.explode("keys").alias("key")).where("key is not null").repartition("key")
    ends = dealt.groupBy("key").agg(F.min("set_id").alias("pivot"), F.max("set_id").alias("other")).where("pivot <> other")
    blocks = materialize(dealt.join(ends.select("key", "pivot"), "key").select("key", "set_id", "pivot"), "blocks")

    first = blocks.where("set_id <> pivot").select(F.col("set_id").alias("x"), "pivot").distinct()
    first = materialize(_screened(first, sets, bounds), "pairs")
    links = materialize(_verified(first, docs, sets, n, bounds), "links")
    roots = connected_components(links, "x", "pivot")
    rows_of = blocks.select("key", "set_id")
    forest = materialize(_candidates(_met(rows_of, roots), sets, bounds), "pairs")
    linked = materialize(_verified(forest, docs, sets, n, bounds), "links")
    roots = _joined(roots, linked)
    # what may link is connected by the forest; where all of it are links, nothing that may link is apart
    if forest.join(linked, ["x", "pivot"], "left_anti").take(1):
        roots = materialize(roots, "roots")
        supposed = materialize(_joined(roots, forest).select(F.col("root").alias("key"), F.col("node").alias("set_id")), "supposed")
        roots = _joined(roots, materialize(_linked_parts(_met(supposed, roots), docs, sets, n, bounds), "links"))
    return rows, sets, roots


def _named(rows: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, set_id, many)."""
    joined = sets.select("set_id", "doc_id", "many").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    names = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = joined.join(names, "root").select("set_id", "many", "component_id")
    out = rows.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "set_id", "many")


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, set_id), one for each row of ``docs``.

    ``set_id`` tells sets of shingles apart, null for an empty one.  Documents link at a Jaccard similarity of ``percent`` / 100 or more; a
    component's id is the least doc_id in it.  Null and empty texts have no
    shingles and link with nothing; nor do rows of a null doc_id count for the
    id.  Repeated rows are repeated in the result.  ``docs`` is read four times.
    """
    return _named(*_found(docs, n, Bounds(percent))).select("doc_id", "n_shingles", "component_id", "set_id")


def first_of_components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, by least doc_id; all other columns stay.

    Where a doc_id has several rows, each set of shingles that is the first of
    its component keeps one row, the least by text and then by the other
    columns.  Rows of a null doc_id all stay, as do texts without words.  Only
    ids meet the documents: a text is shuffled only where Spark doesn't
    broadcast them, or its doc_id is repeated.
    """
    found = materialize(jaccard_components(docs.select("doc_id", "text"), n, percent), "components")
    first = found.where("doc_id = component_id").select("doc_id", F.coalesce("set_id", F.lit(0)).alias("__el_set")).distinct()
    repeated = materialize(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is not null and n > 1").select("doc_id"), "repeated")
    single = docs.join(first.join(repeated, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi").select(*own_columns(docs))

    @F.pandas_udf("long")
    def set_ids(texts: pd.Series) -> pd.Series:
        found = [shingle_set(t, n) for t in texts]
        return pd.Series([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0 for s in found])

    several = docs.join(repeated, "doc_id", "left_semi").select(*own_columns(docs)).withColumn("__el_set", set_ids("text")).join(first, ["doc_id", "__el_set"], "left_semi")
    plain = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    order = Window.partitionBy("doc_id", "__el_set").orderBy("text", F.xxhash64(*[f"`{c}`" for c in plain]))
    several = several.withColumn("__el_rank", F.row_number().over(order)).where("__el_rank = 1")
    return single.unionByName(several.select(*own_columns(docs))).unionByName(docs.where("doc_id is null"))


def jaccard_links(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``jaccard_components`` with ``n_links``, the number of other rows that each links with.

    Copies are rows of their own that link with each other.  ``docs`` is read five times.
    """
    bounds = Bounds(percent)
    rows, sets, roots = _found(docs, n, bounds)
    roots = materialize(roots, "roots")
    links = materialize(_links(roots, docs, sets, n, bounds), "links")
    out = _named(rows, sets, roots).join(links, "set_id", "left")
    n_links = F.coalesce(F.col("many") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
    return out.select("doc_id", "n_shingles", "component_id", n_links.alias("n_links"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components and numbers of links of all documents at a Jaccard similarity of 0.85 over 4-word shingles."""
    return jaccard_links(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM word WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), copy AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first FROM (SELECT doc_id, string_agg(s, chr(10) ORDER BY s) AS h FROM shingle GROUP BY doc_id)
), one AS (SELECT s.doc_id, s.s, z.n FROM shingle s JOIN size z USING (doc_id) JOIN copy c ON c.doc_id = s.doc_id AND c.first = s.doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT first AS node, first AS root FROM copy UNION SELECT pair.b, reach.root FROM reach JOIN pair ON pair.a = reach.node
), root AS (SELECT node, min(root) AS root FROM reach GROUP BY node
), many AS (SELECT first, count(*) AS n FROM copy GROUP BY first
), link AS (SELECT a, sum(n) AS n FROM pair JOIN many ON first = b GROUP BY a)
SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(r.root, w.doc_id) AS component_id, CAST(coalesce(m.n - 1, 0) + coalesce(l.n, 0) AS BIGINT) AS n_links
FROM word w LEFT JOIN size z USING (doc_id) LEFT JOIN copy c USING (doc_id) LEFT JOIN root r ON r.node = c.first LEFT JOIN many m ON m.first = c.first LEFT JOIN link l ON l.a = c.first
"""
