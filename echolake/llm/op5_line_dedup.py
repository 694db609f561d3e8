"""Line dedup: sharded cuckoo filters before exact reference counts.

A line's key is the 128-bit hash of its normal form.  ``LineIndex`` holds, by
shard of the key, exact reference counts (documents that hold the key, and the
largest id among them) and a cuckoo filter of the keys.  Filters answer
"certainly new" without a join, so that

* ``insert`` joins only keys that the filter may know with the counts,
* ``delete`` takes documents back: counts fall, keys without documents leave
  the filter, and a later decision is as if these had never been there,
* ``drops`` joins only lines that a filter of the repeated keys lets through:
  filters of a checked size are broadcast to the texts, larger ones are dealt
  with the lines by shard.

False positives of a filter cost a join row and are then removed by the exact
counts, so the results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.plans.shared import materialize

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of one shard's filter, about; the number of shards follows from the number of keys.
KEYS_PER_SHARD = 1 << 18
#: Filters of up to so many bytes are broadcast to the lines; of more, lines are dealt to the filters by shard.
BROADCAST_BYTES = 32 << 20
#: Lines that meet one copy of a shard's filter, about.
LINES_PER_PART = 1 << 20
_STRIPPED = " \t\n\x0b\x0c\r"
_SLOTS = 4


class CuckooFilter:
    """16-bit fingerprints in buckets of four; bytes in, bytes out."""

    def __init__(self, table: np.ndarray, n: int = 0):
        self.table, self.n = table, n

    @classmethod
    def of_size(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(3, int(np.ceil(np.log2(max(1, keys) / (_SLOTS * 0.8)))))
        return cls(np.zeros((buckets, _SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        table = np.frombuffer(raw, np.uint16).reshape(-1, _SLOTS).copy()
        return cls(table, int((table > 0).sum()))

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @property
    def full(self) -> bool:
        return self.n > 0.9 * self.table.size

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: (n, 2) of 64 bits.  Fingerprints and both buckets of each."""
        mask = np.uint64(len(self.table) - 1)
        print_ = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        print_[print_ == 0] = 1
        one = keys[:, 0] & mask
        return print_, one.astype(np.int64), (one ^ self._jump(print_)).astype(np.int64)

    def _jump(self, print_: np.ndarray) -> np.ndarray:
        return (print_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(len(self.table) - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, a, b = self._places(keys)
        return ((self.table[a] == p[:, None]) | (self.table[b] == p[:, None])).any(axis=1)

    def _place(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; which of them found one."""
        order = np.argsort(at, kind="stable")
        bucket = at[order]
        begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        turn = np.arange(len(bucket)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(bucket)]])))
        free = self.table[bucket] == 0
        fits = turn < free.sum(axis=1)
        slot = np.argmax(np.cumsum(free, axis=1) == (turn + 1)[:, None], axis=1)
        self.table[bucket[fits], slot[fits]] = p[order][fits]
        done = np.zeros(len(at), bool)
        done[order[fits]] = True
        self.n += int(fits.sum())
        return done

    def insert(self, keys: np.ndarray) -> bool:
        """False where a key found no room: build a larger filter then.

        All keys at a time: into free slots of the first bucket, of the second,
        and the rest by evictions, one a bucket and round.
        """
        rng = np.random.default_rng(len(keys))
        p, a, b = self._places(keys)
        left = ~self._place(p, a)
        p, at = p[left], b[left]
        for _ in range(500):
            left = ~self._place(p, at)
            p, at = p[left], at[left]
            if not len(p):
                return True
            _, first = np.unique(at, return_index=True)
            slot = rng.integers(_SLOTS, size=len(first))
            out = self.table[at[first], slot].copy()
            self.table[at[first], slot] = p[first]
            p[first] = out
            at[first] ^= self._jump(out).astype(np.int64)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted; equal fingerprints of a bucket go one by one."""
        p, *places = self._places(keys)
        for side in (0, 1):
            at = places[side]
            left = np.arange(len(p))
            while True:
                held = self.table[at[left]] == p[left, None]
                some = np.flatnonzero(held.any(axis=1))
                if not len(some):
                    break
                now = some[np.unique(at[left[some]], return_index=True)[1]]
                self.table[at[left[now]], np.argmax(held[now], axis=1)] = 0
                self.n -= len(now)
                left = np.delete(left, now)
            p, places = p[left], [x[left] for x in places]

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        size = len(keys)
        while not (made := cls.of_size(size)).insert(keys):
            size = max(2 * size, 64)
        return made


def _pairs(keys: pd.Series | list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def _long_lines(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, list[bytes]]:
    """Row numbers and keys of all lines whose normal form has ``min_chars`` characters."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    rows, flat = pc.list_parent_indices(lines), pc.list_flatten(lines)
    normal = pc.ascii_lower(pc.utf8_trim(flat, characters=_STRIPPED))
    long = pc.greater_equal(pc.utf8_length(normal), min_chars)
    keys = [xxhash.xxh3_128_digest(x) for x in normal.filter(long).to_pylist()]
    return rows.filter(long).to_numpy(zero_copy_only=False), keys


def _slices(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def _shards(keys: int) -> int:
    return max(8, -(-keys // KEYS_PER_SHARD))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS, probe: object = None, shards: int = 1) -> DataFrame:
    """Rows (doc_id, key), each key once a document row; null doc_id: none.

    ``probe``: a broadcast of filters by shard; only keys that it may hold come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {s: CuckooFilter.from_bytes(raw) for s, raw in probe.value.items()} if probe is not None else None
        for batch in (part for b in batches for part in _slices(b)):
            ids = batch.column(0).to_pylist()
            rows, keys = _long_lines(batch.column(1), min_chars)
            if filters is not None and keys:
                pairs = _pairs(keys)
                shard, may = _shard_of(pairs, shards), np.zeros(len(keys), bool)
                for s in np.unique(shard):
                    if s in filters:
                        here = np.flatnonzero(shard == s)
                        may[here] = filters[s].contains(pairs[here])
                rows, keys = rows[may], [k for k, m in zip(keys, may.tolist(), strict=True) if m]
            found = list({(r, k) for r, k in zip(rows.tolist(), keys, strict=True) if ids[r] is not None})
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[r] for r, _ in found], pa.int64()), pa.array([k for _, k in found], pa.binary())],
                names=["doc_id", "key"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key binary")


def _shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return ((pairs[:, 0] >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _with_shard(df: DataFrame, shards: int) -> DataFrame:
    """The same shard as ``_shard_of``: bytes 4 to 7 of the key, little-endian."""
    word = F.conv(F.concat(*[F.hex(F.substring("key", k, 1)) for k in (8, 7, 6, 5)]), 16, 10).cast("long")
    return df.withColumn("shard", F.pmod(word, F.lit(shards)).cast("int"))


def _filters(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) of distinct keys; a group is the keys of one shard, not their documents."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "filter": [CuckooFilter.build(_pairs(pdf["key"])).to_bytes()]})

    return _with_shard(keys.select("key"), shards).groupBy("shard").applyInPandas(build, "shard int, filter binary")


def dealt_keys(found: DataFrame, filters: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
    """The rows of ``found`` (doc_id, key) that the filters may hold, each shard's in parts of a bounded size.

    A part is a stream: a copy of the shard's filter, then its rows; ``counts``
    (key, n_docs) tells how many rows a shard has.
    """
    parts = _with_shard(counts.select("key", "n_docs"), shards).groupBy("shard").agg(F.ceil(F.sum("n_docs") / LINES_PER_PART).cast("int").alias("parts"))
    deal = ["shard", "part"]
    heads = filters.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("doc_id"), F.col("filter").alias("key"), F.lit(0).alias("turn"))
    rows = _with_shard(found, shards).join(F.broadcast(parts), "shard")
    rows = rows.select("shard", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"), "doc_id", "key", F.lit(1).alias("turn"))
    met = heads.unionByName(rows).repartition(*deal).sortWithinPartitions(*deal, "turn")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: CuckooFilter | None = None
        of: tuple | None = None
        for batch in batches:
            shard, part, turn = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 4))
            change = (turn[1:] == 0) | (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])
            ends = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            kept = np.zeros(batch.num_rows, bool)
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if a == b:
                    continue
                if turn[a] == 0:
                    held, of = CuckooFilter.from_bytes(batch.column(3)[a].as_py()), (shard[a], part[a])
                    a += 1
                if a < b and of == (shard[a], part[a]):
                    kept[a:b] = held.contains(_pairs(batch.column(3)[a:b].to_pylist()))
            mask = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column(2).filter(mask), batch.column(3).filter(mask)], names=["doc_id", "key"])

    return met.select("shard", "part", "doc_id", "key", "turn").mapInArrow(probe, "doc_id long, key binary")


@dataclass(frozen=True)
class LineIndex:
    """counts: (key, n_docs, max_doc); postings: (key, doc_id); filters: (shard, filter) of all keys."""

    counts: DataFrame
    postings: DataFrame
    filters: DataFrame
    shards: int

    @staticmethod
    def count(postings: DataFrame) -> DataFrame:
        return postings.groupBy("key").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = MIN_CHARS) -> LineIndex:
        """The index of a first batch.  Postings and filters are made when first used."""
        postings = line_keys(docs, min_chars)
        counts = materialize(cls.count(postings), "line-counts")
        shards = _shards(counts.count())
        return cls(counts, postings, _filters(counts, shards), shards)

    def insert(self, docs: DataFrame, min_chars: int = MIN_CHARS) -> LineIndex:
        """Add documents whose ids aren't held yet."""
        added = materialize(line_keys(docs, min_chars), "line-postings")
        batch = _with_shard(self.count(added), self.shards)

        def look(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if len(keys) == 0:
                return keys.assign(seen=pd.Series(dtype=bool))[["key", "n_docs", "max_doc", "seen"]]
            seen = CuckooFilter.from_bytes(held["filter"].iloc[0]).contains(_pairs(keys["key"])) if len(held) else np.zeros(len(keys), bool)
            return keys.assign(seen=seen)[["key", "n_docs", "max_doc", "seen"]]

        grouped = batch.groupBy("shard").cogroup(self.filters.groupBy("shard"))
        probed = materialize(grouped.applyInPandas(look, "key binary, n_docs long, max_doc long, seen boolean"), "line-batch")
        may, new = probed.where("seen").drop("seen"), probed.where("not seen").drop("seen")
        known = self.counts.join(may.select("key"), "key", "left_semi").unionByName(may)
        changed = known.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
        kept = self.counts.join(may.select("key"), "key", "left_anti")
        counts = materialize(kept.unionByName(changed).unionByName(new), "line-counts")

        def grow(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            shard = int((keys if len(keys) else held)["shard"].iloc[0])
            mine = CuckooFilter.from_bytes(held["filter"].iloc[0]) if len(held) else CuckooFilter.of_size(len(keys))
            fits = mine.n + len(keys) <= 0.9 * mine.table.size and (len(keys) == 0 or mine.insert(_pairs(keys["key"])))
            return pd.DataFrame({"shard": [shard], "filter": [mine.to_bytes() if fits else None]})

        fresh = materialize(
            _with_shard(new, self.shards).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(grow, "shard int, filter binary"),
            "line-filters",
        )
        small = fresh.where("filter is null").select("shard")  # too full: made anew from the exact keys
        postings = self.postings.unionByName(added)
        shards = _shards(counts.count())
        if shards > 2 * self.shards:  # shards have outgrown a group's size: deal all keys anew
            return LineIndex(counts, postings, _filters(counts, shards), shards)
        rebuilt = _filters(_with_shard(counts, self.shards).join(F.broadcast(small), "shard", "left_semi"), self.shards)
        return LineIndex(counts, postings, fresh.where("filter is not null").unionByName(rebuilt), self.shards)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take documents back: as if they had never been inserted."""
        gone = doc_ids.select("doc_id").distinct()
        touched = self.postings.join(gone, "doc_id", "left_semi").select("key").distinct()
        postings = materialize(self.postings.join(gone, "doc_id", "left_anti"), "line-postings")
        again = self.count(postings.join(touched, "key", "left_semi"))
        counts = materialize(self.counts.join(touched, "key", "left_anti").unionByName(again), "line-counts")
        lost = _with_shard(self.counts.join(counts, "key", "left_anti").select("key"), self.shards)

        def shrink(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            mine = CuckooFilter.from_bytes(held["filter"].iloc[0])
            if len(keys):
                mine.delete(_pairs(keys["key"]))
            return pd.DataFrame({"shard": [int(held["shard"].iloc[0])], "filter": [mine.to_bytes()]})

        filters = materialize(
            lost.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(shrink, "shard int, filter binary"),
            "line-filters",
        )
        return LineIndex(counts, postings, filters, self.shards)

    def drops(self, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
        """Rows (doc_id, drop): the keys whose lines the document loses."""
        repeated = self.counts.where(F.col("n_docs") >= min_docs).select("key", "max_doc", "n_docs")
        shards = _shards(repeated.count())
        filters = materialize(_filters(repeated, shards), "line-repeats")
        total = filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
        if total <= BROADCAST_BYTES:
            probe = docs.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in filters.collect()})
            may = line_keys(docs, min_chars, probe, shards)
        else:
            may = dealt_keys(line_keys(docs, min_chars), filters, self.counts, shards)
        found = may.join(repeated.select("key", "max_doc"), "key").where(F.col("doc_id") != F.col("max_doc"))
        return found.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))


def drop_lines(docs: DataFrame, drops: DataFrame, min_chars: int = MIN_CHARS, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with ``text`` without the lines that ``drops`` names, ``n_lines`` and ``n_dropped``.

    A null text without drops stays null; it counts as one empty line.  Repeated
    rows each lose the same lines.  A column that is there already raises an error.
    """
    if clash := {n_lines, n_dropped} & set(docs.columns):
        raise ValueError(f"there are columns {sorted(clash)} already")
    wanted = drops.select(F.col("doc_id").alias("__el_drop_id"), F.col("drop").alias("__el_drop_keys"))
    joined = docs.join(wanted, F.col("doc_id") == F.col("__el_drop_id"), "left").drop("__el_drop_id")
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in _slices(b)):
            texts, drop = batch.column(text), batch.column(batch.num_columns - 1)
            lines = pc.add(pc.fill_null(pc.count_substring(texts, "\n"), 0), 1).cast(pa.int64())
            lost = np.zeros(batch.num_rows, np.int64)
            hit = np.flatnonzero(drop.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                changed = texts.to_pylist()
                for i in hit.tolist():
                    gone, kept = set(drop[i].as_py()), []
                    own = (changed[i] or "").split("\n")
                    _rows, keys = _long_lines(pa.array(own), 0)
                    kept = [line for line, k, n in zip(own, keys, _lengths(own), strict=True) if n < min_chars or k not in gone]
                    lost[i] = len(own) - len(kept)
                    changed[i] = "\n".join(kept)
                texts = pa.array(changed, pa.string())
            columns = [*batch.columns[:text], texts, *batch.columns[text + 1 : -1], lines, pa.array(lost)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], n_lines, n_dropped])

    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    places = [f"c{k}" for k in range(len(joined.columns))]  # an Arrow function takes no columns with dots in their names
    return joined.toDF(*places).mapInArrow(run, f"{cols}, `{n_lines}` long, `{n_dropped}` long")


def _lengths(lines: list[str]) -> list[int]:
    return [len(x.strip(_STRIPPED)) for x in lines]


def dedup_lines(docs: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` without repeated lines, with ``n_lines`` and ``n_dropped``.

    Lines of 40 characters in 5 documents stay in the largest doc_id only.
    Rows with a null doc_id are no documents: they count nowhere and keep all.
    """
    index = LineIndex.of(docs)
    return drop_lines(docs, index.drops(docs), n_lines=n_lines, n_dropped=n_dropped)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and the digest of what each document keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


ORACLE_SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), repeated AS (
  SELECT key, max(doc_id) AS max_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE doc_id <> max_doc) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE max_doc IS NULL OR doc_id = max_doc), '')) AS kept_sha256
FROM keyed LEFT JOIN repeated USING (key) GROUP BY doc_id
"""
