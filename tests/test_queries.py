"""Registered queries against their DuckDB SQL on the smallest given tables."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

import __spark_entry__ as entry_point
from checks.oracle import ORACLE
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    got = entry_point.queries()[name](spark, SF).toPandas()
    assert compare(got, con.execute(entry_point.oracle_sql()[name]).fetchdf()) is None


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    out = entry_point.entry(spark)
    assert isinstance(out, DataFrame) and out.columns == ["month", "cluster_index", "label", "total"]
    assert out.count() > 0


def test_robust_z_stores_what_it_reads(spark, monkeypatch):
    from checks import queries

    stored = []
    monkeypatch.setattr(queries, "durable", lambda df: stored.append(df.columns) or df)
    assert entry_point.queries()["robust_z"](spark, SF).count() > 0
    assert stored == [["id", "counterparty_normalized", "amount"]]
