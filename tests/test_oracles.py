"""Every registered query against its SQL on the smallest data set."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as contract
from amperoute.oracles import ORACLES
from amperoute.registry import QUERIES

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="benchmark tables not present")


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def comparable(rows, names):
    order = [names.index(n) for n in sorted(names)]

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v
        return None if v is None else str(v)

    def rank(row):
        return [(v is None, isinstance(v, float), v if v is not None else "") for v in row]

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=rank)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, oracle, name):
    frame = contract.queries()[name](spark, str(FOLDER))
    expected = oracle.execute(contract.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(frame.columns) == sorted(names)
    assert comparable([tuple(r) for r in frame.collect()], frame.columns) == comparable(expected.fetchall(), names)


def test_entry_has_rows(spark):
    assert not contract.entry(spark).isEmpty()
