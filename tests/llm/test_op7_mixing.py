from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echolake.llm.op7_mixing import fit_budget, mix, op7_mixing, source_targets


def targets(sizes: dict) -> dict:
    """By water filling, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    goal, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        share = {s: (goal - sum(capped.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return share | capped
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_query(spark, sf_dir, documents):
    rows = op7_mixing(spark, sf_dir).collect()
    words = [(d["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")), d["source"]) for d in documents]
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, n) for d, n, _ in words)
    sizes, source = defaultdict(int), {}
    for d, n, s in words:
        sizes[s] += n
        source[d] = s
    want, taken = targets(sizes), defaultdict(int)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        own = [n for _, n, x in words if x == s and n]
        assert want[s] - max(min(own, default=0) + 1, 0.01 * want[s]) <= taken[s] <= want[s] + 1e-6
    assert Counter(map(tuple, op7_mixing(spark, sf_dir).collect())) == Counter(map(tuple, rows))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=4), st.integers(0, 60))
def test_fit_is_within_a_document_of_the_best_subset(histogram, budget):
    lengths, counts = list(histogram), list(histogram.values())
    take = fit_budget(lengths, counts, budget)
    assert all(0 <= t <= n for t, n in zip(take, counts, strict=True))
    got = int(np.dot(take, lengths))
    best = max(v for x in itertools.product(*[range(n + 1) for n in counts]) if (v := int(np.dot(x, lengths))) <= budget)
    assert got <= budget and best - got < max(lengths)


def test_fit_is_exact_where_lengths_are_many():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(5, 4000, 800))
    counts = rng.integers(1, 50, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    assert int((fit_budget(lengths, counts, budget) * lengths).sum()) == budget


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(2)
    sizes = {f"s{k:04}": int(n) for k, n in enumerate(rng.integers(0, 50, 700) ** 3)} | {None: 9}
    code = lambda s: "1" if s is None else "0" + s
    rows = spark.createDataFrame([(code(s), n) for s, n in sizes.items()], "__el_source string, source_size long")
    found = {r[0]: r[2] for r in source_targets(rows).collect()}
    want = targets(sizes)
    assert all(found[code(s)] == pytest.approx(want[s], abs=1e-6) for s in sizes)


def test_other_columns_never_matter(spark):
    rows = [(k, k % 9, "ab"[k % 2], 1.5, "x", 2, 3, 4, 5) for k in range(60)]
    names = ["doc_id", "size", "source", "target", "source_size", "passes", "extra", "w", "n"]
    out = mix(spark.createDataFrame(rows, names), "size", "source", "doc_id", out=("a", "b", "c"))
    assert out.columns == [*names, "a", "b", "c"] and Counter(tuple(r)[:9] for r in out.collect()) == Counter(rows)
    with pytest.raises(ValueError, match="target"):
        mix(spark.createDataFrame(rows, names), "size", "source", "doc_id")
