from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from echolake.llm.op6_sharding import _inverted, communication_matrix, op6_sharding, shard_sizes


def test_query(spark, sf_dir, documents):
    rows = op6_sharding(spark, sf_dir).collect()
    raw = [(d["doc_id"], (d["text"] or "").encode()) for d in documents]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len(t) + 16, zlib.crc32(t)) for i, t in raw)
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 40
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert Counter(map(tuple, op6_sharding(spark, sf_dir).collect())) == Counter(map(tuple, rows))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=12), st.integers(1, 9), st.integers(0, 9))
def test_matrix_has_exact_sums(blocks, shards, seed):
    sizes = shard_sizes(sum(blocks), shards)
    m = communication_matrix(blocks, sizes, seed)
    assert (m >= 0).all() and m.sum(axis=1).tolist() == blocks and m.sum(axis=0).tolist() == sizes


def test_matrix_follows_the_hypergeometric_law():
    draws = np.array([communication_matrix([6, 4], [5, 5], s)[0, 0] for s in range(4000)])
    assert abs(draws.mean() - 3) < 0.06 and abs(draws.var() - 6 * 0.5 * 0.5 * 4 / 9 * 10 / 10) < 0.06


def test_large_urns_are_drawn_by_the_same_law():
    u = (np.arange(4000) + 0.5) / 4000
    got = Counter(_inverted(x, 30, 50, 20) for x in u.tolist())
    want = {k: math.comb(30, k) * math.comb(50, 20 - k) / math.comb(80, 20) for k in range(21)}
    assert all(abs(got[k] / 4000 - p) < 0.001 for k, p in want.items())
    draws = np.array([_inverted(x, 3 * 10**11, 7 * 10**11, 10**9) for x in u.tolist()])
    sd = math.sqrt(10**9 * 0.3 * 0.7 * 0.999)
    assert abs(draws.mean() - 3 * 10**8) < 0.05 * sd and abs(draws.std() / sd - 1) < 0.01
    m = communication_matrix([2 * 10**9, 10**9, 5], shard_sizes(3 * 10**9 + 5, 4), 1)
    assert m.sum(axis=1).tolist() == [2 * 10**9, 10**9, 5] and m.sum(axis=0).tolist() == shard_sizes(3 * 10**9 + 5, 4)
