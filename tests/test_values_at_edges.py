"""Queries against their SQL on rows whose values are the thresholds themselves."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

from echolake.registry import ORACLE_SQL, QUERIES


def both(spark, folder, name, table, rows):
    """Rows of the query and of its SQL over one table."""
    rows.to_parquet(folder / f"{table}.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, df.select(*columns).collect())), sorted(want)


def events(values, hours=11):
    begin = datetime(2024, 1, 1)
    rows = [(10 * k + 8, begin + timedelta(hours=hours * k), 1, "view", float(v), "{}") for k, v in enumerate(values)]
    return pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])


def lines(prices, a_frame=1):
    n = range(len(prices))
    return pd.DataFrame({"l_orderkey": [k // a_frame for k in n], "l_partkey": [1] * len(n), "l_suppkey": [1] * len(n), "l_linenumber": [k % a_frame for k in n], "l_quantity": [float(7 + k % 9) for k in n], "l_extendedprice": prices})


@pytest.mark.parametrize("x", [66.5, 38.5, 52.5, 59.5, 45.5, 31.5])
def test_action_at_an_edge_with_its_margin(spark, tmp_path, x):
    first = {66.5: 60.0, 38.5: 20.0, 52.5: 45.0, 59.5: 69.0, 45.5: 60.0, 31.5: 45.0}[x]
    got, want = both(spark, tmp_path, "coherence_gate", "events", events([first] * 3 + [x] * 3 + [first] * 2))
    assert got == want


@pytest.mark.parametrize("name", ["sleeping_fsm", "elderly_fsm"])
def test_motion_at_its_threshold(spark, tmp_path, name):
    values = [100.0, 120.0, 120.0, 120.0, 130.0, 360.0, 360.0, 40.0, 40.0, 40.0, 100.0, 100.0, 100.0, 400.0, 400.0, 40.0, 120.0, 110.0, 110.0, 20.0, 20.0, 20.0, 400.0]
    got, want = both(spark, tmp_path, name, "events", events(values, hours=26))
    assert want and got == want


def test_signal_over_the_least_noise(spark, tmp_path):
    prices = [3000.0, 3000.01, 2999.99, 9000.01, 14999.99, 33000.01, 39000.0, 45000.02, 99000.01, 104999.99, 6000.0]
    got, want = both(spark, tmp_path, "frame_snr", "lineitem", lines(prices))
    assert got == want and sum(r[1] == float("inf") for r in want) == 2
