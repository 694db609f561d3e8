"""What holds for every query: empty tables give empty results, and extra columns disturb nothing."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry

OPS = [q for q in entry.queries() if q.startswith("op") and q[2].isdigit()]


def test_all_operators_and_pipeline_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in OPS) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [*OPS, "pipeline"])
def test_empty_tables(spark, empty_dir, name):
    assert entry.queries()[name](spark, empty_dir).collect() == []


def test_oracle_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
