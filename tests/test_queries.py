"""Every query of the reference's own operators against its SQL in DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

from echolake.registry import ORACLE_SQL, QUERIES

SMALL = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def normal(row: tuple) -> tuple:
    return tuple(float(f"{x:.9g}") + 0.0 if isinstance(x, float) and math.isfinite(x) else x for x in row)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    want = duck.execute(ORACLE_SQL[name])
    assert sorted(d[0] for d in want.description) == columns
    order = [[d[0] for d in want.description].index(c) for c in columns]
    rows = Counter(normal(tuple(r[i] for i in order)) for r in want.fetchall())
    assert rows, "the SQL gives no rows, which proves nothing"
    assert Counter(normal(tuple(r)) for r in df.select(*columns).collect()) == rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_episodes_and_joints_on_awkward_rows(spark):
    from pyspark.sql import functions as F

    from echolake.operators import features as M
    from echolake.operators import semantic as R

    rows = [(1, k, p, b) for k, (p, b) in enumerate([(True, 1.0), (True, None), (True, 1.0), (False, 1.0), (True, 1.0), (True, 9.0), (True, 2.0), (True, 2.0)])]
    s = spark.createDataFrame(rows, "k long, i long, present boolean, x double")
    got = M.episodes(s, ["k"], ["i"], F.col("present"), F.col("x") < 4, 2).first()
    assert (got["monitored"], got["episodes"]) == (6, 2)  # the null row neither ends nor lengthens one
    none = spark.createDataFrame([([], [])], "a array<double>, b array<double>").select(R.joint_distances(F.col("a"), F.col("b"))).first()[0]
    assert none == []


def test_running_totals_over_many_ranges(spark):
    from itertools import accumulate

    from echolake.plans.ranking import with_running_total

    rows = [(k, float(v), (v * 7 + (k or 0)) % 5 + 1) for k in (1, 2, None) for v in range(60)]
    got = with_running_total(spark.createDataFrame(rows, "k long, v double, n long"), ["k"], "v", "n", "upto").collect()
    for k in (1, 2, None):
        own = sorted((r["v"], r["n"], r["upto"]) for r in got if r["k"] == k)
        assert [r[2] for r in own] == list(accumulate(r[1] for r in own)) and len(own) == 60


def test_searches_of_many_queries_in_blocks(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from echolake.operators import vectors as V

    monkeypatch.setattr(V, "QUERIES_PER_BLOCK", 7)
    x = np.random.default_rng(3).standard_normal((80, 70))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    got = V.nearest(df.withColumn("s", V.sign_sketch(F.col("v"))), "k", F.col("k") % 2 == 0, "s", "hamming", 3).collect()
    bits = (x > 0).astype(int)
    for q in range(0, 80, 2):
        d = sorted((int((bits[q] != bits[k]).sum()), k) for k in range(80) if k != q)[:3]
        assert sorted((r["distance"], r["k"]) for r in got if r["query"] == q) == d
