"""Every registered query against its SQL twin on the smallest tables, and the entry module's contract."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


def plain(value):
    if isinstance(value, float):
        return str(value) if math.isnan(value) or math.isinf(value) else round(value, 6) + 0.0
    if type(value).__name__ == "Decimal":
        return round(float(value), 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("p1_", "p4_", "p5_"))))
def test_equals_sql(spark, tables, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    relation = tables.sql(entry.oracle_sql()[name])
    at = [relation.columns.index(c) for c in columns]
    assert sorted(relation.columns) == columns
    theirs = Counter(repr(tuple(plain(r[i]) for i in at)) for r in relation.fetchall())
    assert ours == theirs


def test_entry_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert entry.entry(spark).count() > 0
