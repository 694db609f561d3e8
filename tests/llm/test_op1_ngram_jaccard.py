from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from echolake.llm.op1_ngram_jaccard import ORACLE_SQL, Bounds, block_keys, first_of_components, fold, jaccard_components, jaccard_links, linked_rows, op1_ngram_jaccard, overlaps, shingle_set, sketch, sketch_distance, spanning_forest


def shingles(text: str | None, n: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows: list[tuple], n: int, percent: int) -> list[tuple]:
    sets = [shingles(t, n) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_query_against_brute_force(spark, sf_dir, documents):
    found = [tuple(r)[:3] for r in op1_ngram_jaccard(spark, sf_dir).collect()]
    assert Counter(found) == Counter(brute([(d["doc_id"], d["text"]) for d in documents], 4, 85))


@pytest.mark.parametrize("n,percent", [(5, 80), (2, 50), (4, 85)])
def test_random_corpora(spark, n, percent):
    rng = random.Random(n)
    rows, base = [], [[str(rng.randrange(30)) for _ in range(rng.randrange(1, 40))] for _ in range(12)]
    for k in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = str(rng.randrange(30))
        rows.append((k, " ".join(w[: len(w) - rng.randrange(2)])))
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).drop("set_id")
    assert Counter(map(tuple, found.collect())) == Counter(brute(rows, n, percent))


def test_linked_sets_share_a_block():
    rng, bounds = np.random.default_rng(3), Bounds(80)
    for size in (7, 12, 40, 130, 700):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            d = bounds.differ(len(a), len(a)) // 2
            b = np.unique(np.concatenate([a[d:], rng.integers(0, 2**63, d).astype(np.uint64)]))
            if bounds.linked(len(np.intersect1d(a, b)), len(a), len(b)) and d:
                keys = [set(np.concatenate(block_keys(x, bounds)).tolist()) for x in (a, b)]
                assert keys[0] & keys[1]


def test_shingle_sets():
    assert len(shingle_set("a b c d e", 4)) == 2
    assert len(shingle_set("a\vb", 4)) == 1 and len(shingle_set("a\u2003b c d e", 4)) == 1
    assert (shingle_set("A b C d", 4) == shingle_set("a B c D", 4)).all()
    assert len(shingle_set(" \n", 4)) == len(shingle_set(None, 4)) == 0
    assert len(shingle_set("É x y z", 4)) == 1 and shingle_set("É x y z", 4)[0] != shingle_set("é x y z", 4)[0]


def test_sketches_fold_and_never_overstate():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.unique(np.concatenate([a[200:], rng.integers(0, 2**63, 50).astype(np.uint64)]))
    short = a[:700]
    assert len(sketch(short)) < len(sketch(a)) and sketch_distance(sketch(a), sketch(a)) == 0
    assert 150 < sketch_distance(sketch(a), sketch(b)) <= 250
    assert sketch_distance(sketch(a), sketch(short)) <= 2300
    assert fold(sketch(a), len(sketch(short))) == fold(fold(sketch(a), 2 * len(sketch(short))), len(sketch(short)))


def test_forest_connects_what_the_pairs_connect():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = 40
        roots = rng.integers(0, 30, n)
        i, j = np.nonzero(np.triu(rng.random((n, n)) < 0.03, 1))
        i, j = i[roots[i] != roots[j]], j[roots[i] != roots[j]]

        def groups(pairs, roots=roots):
            label = roots.copy()
            for a, b in pairs:
                label[label == label[a]] = label[b]
            return {tuple(np.flatnonzero(label == x)) for x in label}

        found = spanning_forest(roots, i, j)
        assert groups(found) == groups(zip(i, j, strict=True)) and len(found) < len(set(roots.tolist()))


def test_one_large_group_in_parts(spark, monkeypatch):
    import echolake.llm.op1_ngram_jaccard as op1

    monkeypatch.setattr(op1, "ROWS_PER_PART", 8)
    monkeypatch.setattr(op1, "ROWS_PER_PRODUCT", 4)
    rng = random.Random(8)
    base, rows = [str(k) for k in range(100)], []
    for k in range(90):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(100)] = f"new{rng.randrange(9)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard_components(df, 4, 85).drop("set_id").collect())) == Counter(brute(rows, 4, 85))


def n_links(rows: list[tuple], n: int, percent: int) -> list[int]:
    sets = [shingles(t, n) for _, t in rows]
    return [sum(bool(a) and i != j and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]


def test_links_of_a_group_in_parts(spark, monkeypatch):
    import echolake.llm.op1_ngram_jaccard as op1

    monkeypatch.setattr(op1, "ROWS_PER_PART", 16)
    rng, base = random.Random(9), [str(k) for k in range(300)]
    rows = [(100, None), (101, ""), (102, "alone"), (None, " ".join(base)), (103, " ".join(base)), (103, " ".join(base[:290]))]
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(300)] = f"new{rng.randrange(9)}"
        rows.append((k, " ".join(w)))
    want = Counter((*r, c) for r, c in zip(brute(rows, 4, 85), n_links(rows, 4, 85), strict=True))
    assert len({c[3] for c in want}) > 10  # not all in the group link
    assert Counter(map(tuple, jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect())) == want


def test_query_counts_links(spark, edge_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{edge_dir}/documents.parquet").collect()]
    found = op1_ngram_jaccard(spark, edge_dir).select("doc_id", "n_links").collect()
    assert Counter(map(tuple, found)) == Counter((d, c) for (d, _), c in zip(docs, n_links(docs, 4, 85), strict=True))


def test_query_against_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert Counter(map(tuple, op1_ngram_jaccard(spark, d).collect())) == Counter(duckdb.sql(ORACLE_SQL).fetchall())


def test_products_count_overlaps():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(30)]
    bounds = Bounds(50)
    common = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (overlaps(sets, sets[3]) == common[3]).all()
    for first in (0, 11):
        for k, rest in linked_rows(sets, first, bounds):
            assert rest.tolist() == [j for j in range(first or k + 1, 30) if bounds.linked(common[k, j], len(sets[k]), len(sets[j]))]


def test_blocks_of_candidates_that_do_not_link(spark, monkeypatch):
    """Sketches let pairs through that don't link, so that n-grams have to meet by parts."""
    import echolake.llm.op1_ngram_jaccard as op1

    monkeypatch.setattr(op1, "ROWS_PER_PART", 6)
    monkeypatch.setattr(op1.Bounds, "near", lambda self, bits, a, b: np.asarray(bits) >= 0)
    rng, rows = random.Random(10), []
    base = [str(k) for k in range(60)]
    for k in range(80):
        w = list(base)
        at = rng.randrange(50)
        w[at : at + rng.choice([1, 1, 6, 9])] = [f"v{k % 9}"]
        rows.append((k, " ".join(w)))
    found = jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert Counter(map(tuple, found)) == Counter((*r, c) for r, c in zip(brute(rows, 4, 85), n_links(rows, 4, 85), strict=True))


def test_first_of_components_with_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [
        (1, text, "a"), (2, text + " end", "b"), (2, "another text of its own that nothing is like", "c"), (2, "another text of its own that nothing is like", "c"),
        (3, "some more words here", "d"), (3, "SOME more words here", "d"), (3, "quite different words there", "e"), (4, None, "f"), (4, "", "g"), (5, " ", "h"), (None, text, "i"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = Counter(map(tuple, first_of_components(docs, 4, 85).collect()))
    assert found == Counter([rows[0], rows[2], rows[5], rows[6], rows[7], rows[9], rows[10]])
