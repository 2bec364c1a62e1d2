"""The queries of the subpackage against their SQL twins on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from gleanery.llm import queries, sql

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


def plain(value):
    if isinstance(value, float):
        return str(value) if math.isnan(value) or math.isinf(value) else round(value, 6) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    df = queries.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    relation = con.sql(sql.ORACLE[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert ours == Counter(repr(tuple(plain(r[i]) for i in at)) for r in relation.fetchall())
