from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from echolake.llm.op9_embedding_dedup import ORACLE_SQL, bucket_codes, hyperplanes, multiply, near_duplicates, op9_embedding_dedup, plan


def brute(rows: list[tuple], threshold: float = 0.9) -> Counter:
    unit = []
    for _, v in rows:
        ok = v and all(x is not None for x in v)
        x = np.array(v, float) if ok else np.zeros(0)
        unit.append(x / np.linalg.norm(x) if ok and np.isfinite(x).all() and np.linalg.norm(x) > 0 else None)
    n, links, group = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                group[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, links[i], least.get(find(i)), d is not None and least.get(find(i)) == d) for i, (d, _) in enumerate(rows))


def test_query_against_brute_force(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pylist()
    want = brute([(r["vec_id"], r["embedding"]) for r in t])
    found = Counter((r[0], r[1], r[2], bool(r[3])) for r in op9_embedding_dedup(spark, sf_dir).collect())
    lost = sum((want - found).values())
    assert lost <= 0.02 * len(t)
    pairs = lambda c: sum(n * k[1] for k, n in c.items())
    assert pairs(want) * 0.98 <= pairs(found) <= pairs(want)


def test_one_hot_group(spark):
    rng = np.random.default_rng(5)
    center = rng.standard_normal(12)
    rows = [(k, (center + 0.05 * rng.standard_normal(12)).tolist()) for k in range(300)] + [(1000 + k, rng.standard_normal(12).tolist()) for k in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = Counter((r[0], r[1], r[2], bool(r[3])) for r in near_duplicates(df, "vec_id", "embedding", recall=0.9999).collect())
    assert sum((brute(rows) - found).values()) <= 4


def test_blocks_count_each_pair_once():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    block = lambda s: {"unit": x[s], "many": np.ones(len(x[s]), np.int64), "codes": np.zeros((len(x[s]), 1), np.int32)}
    near = (x @ x.T >= 0.5) & ~np.eye(40, dtype=bool)
    whole, _ = multiply(0, block(slice(0, 40)), None, 0.5)
    assert (whole == near.sum(axis=1)).all()
    a, b = slice(0, 25), slice(25, 40)
    both = multiply(0, block(a), block(b), 0.5)[0]
    both[:25] += multiply(0, block(a), None, 0.5)[0]
    both[25:] += multiply(0, block(b), None, 0.5)[0]
    assert (both == near.sum(axis=1)).all()


def test_query_against_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = Counter(duckdb.sql(ORACLE_SQL).fetchall())
    assert Counter(map(tuple, op9_embedding_dedup(spark, d).collect())) == want


def test_codes_are_the_same_in_any_batch():
    rng = np.random.default_rng(7)
    x, planes = rng.standard_normal((500, 64)), hyperplanes(64, 9, 20)
    whole = bucket_codes(x, planes, 9)
    assert all((bucket_codes(x[k : k + 1], planes[:, : 7 * 9], 9) == whole[k, :7]).all() for k in range(500))


def test_tables_grow_slowly():
    assert plan(1) == plan(200_000) and plan(200_000)[0] == 8
    assert plan(10**9)[1] < 8 * plan(200_000)[1]


def test_doubles_that_floats_cannot_hold(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(16)
    rows = [(k, (base + 0.05 * rng.standard_normal(16)).tolist()) for k in range(20)]
    rows += [(50 + k, np.float32(base + 0.05 * rng.standard_normal(16)).astype(float).tolist()) for k in range(20)] + [(90, (base * 1e300).tolist()), (91, (base * 1e-200).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r[0]: (r[1], r[2], bool(r[3])) for r in near_duplicates(df, "vec_id", "embedding").collect()}
    assert found == {d: (41, 0, d == 0) for d, _ in rows}
