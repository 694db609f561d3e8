from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from echolake.llm.op5_line_dedup import ORACLE_SQL, CuckooFilter, LineIndex, drop_lines, op5_line_dedup


def key(line: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))


def brute(rows: list[tuple]) -> Counter:
    held = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40 and d is not None:
                held[key(line)].add(d)
    out = Counter()
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if d is None or len(held.get(key(x), ())) < 5 or d == max(held[key(x)])]
        out[d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def test_query_against_brute_force(spark, sf_dir, documents):
    found = Counter(map(tuple, op5_line_dedup(spark, sf_dir).collect()))
    assert found == brute([(d["doc_id"], d["text"]) for d in documents])


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert Counter(map(tuple, op5_line_dedup(spark, d).collect())) == Counter(duckdb.sql(ORACLE_SQL).fetchall())


@pytest.mark.parametrize("drop_first", [True, False])
def test_insert_and_delete_are_reversible(spark, drop_first):
    line = lambda k: f"this is line number {k} and it is long enough to count"
    first = [(k, "\n".join(line(j) for j in range(k % 7, k % 7 + 9))) for k in range(40)]
    second = [(100 + k, "\n".join([line(k), line(200), f"only {k}"])) for k in range(30)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = LineIndex.of(frame(first)).insert(frame(second))
    counts = lambda i: Counter(map(lambda r: (bytes(r[0]), r[1], r[2]), i.counts.collect()))
    assert counts(index) == counts(LineIndex.of(frame(first + second)))
    gone, left = (first, second) if drop_first else (second, first)
    back = index.delete(frame(gone).select("doc_id"))
    assert counts(back) == counts(LineIndex.of(frame(left)))
    texts = lambda i: Counter(map(tuple, drop_lines(frame(left), i.drops(frame(left))).select("doc_id", "text").collect()))
    assert texts(back) == texts(LineIndex.of(frame(left)))


def test_cuckoo_filter():
    keys = np.random.default_rng(0).integers(0, 2**63, (3000, 2)).astype(np.uint64)
    f = CuckooFilter.from_bytes(CuckooFilter.build(keys[:2000]).to_bytes())
    assert f.contains(keys[:2000]).all() and f.contains(keys[2000:]).mean() < 0.01
    f.delete(keys[:1000])
    assert f.contains(keys[1000:2000]).all() and f.n == 1000 and f.contains(keys[:1000]).mean() < 0.01


def test_cuckoo_filter_of_equal_fingerprints():
    one = np.array([[5, 9]], np.uint64)
    keys = np.concatenate([one] * 6 + [np.random.default_rng(1).integers(0, 2**63, (50, 2)).astype(np.uint64)])
    f = CuckooFilter.build(keys)
    assert f.n == 56
    f.delete(np.concatenate([one] * 5))
    assert f.n == 51 and f.contains(keys).all()
    f.delete(one)
    assert not f.contains(one).any() and f.contains(keys[6:]).all()


@pytest.mark.parametrize("limit,per_shard,per_part", [(0, 1 << 18, 1 << 20), (0, 3, 4), (1 << 20, 2, 4)])
def test_filters_of_any_size_are_used(spark, edge_dir, monkeypatch, limit, per_shard, per_part):
    """Broadcast or dealt by shard, many shards or few, hot shards in parts: the same rows."""
    import pyarrow.parquet as pq

    import echolake.llm.op5_line_dedup as op5

    monkeypatch.setattr(op5, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(op5, "KEYS_PER_SHARD", per_shard)
    monkeypatch.setattr(op5, "LINES_PER_PART", per_part)
    docs = pq.read_table(f"{edge_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert Counter(map(tuple, op5_line_dedup(spark, edge_dir).collect())) == brute([(d["doc_id"], d["text"]) for d in docs])
