"""Bytes that queries over the hits write for exchanges; meetings of questions and documents alone would be more than the input."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import plain

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The documents ten times with shifted keys, every other time from another source with other digits; the other tables as they are."""
    path = tmp_path_factory.mktemp("tables")
    for name in os.listdir(FOLDER):
        if name != "documents.parquet":
            (path / name).symlink_to(f"{FOLDER}/{name}")
    copies = spark.read.parquet(f"{FOLDER}/documents.parquet").crossJoin(spark.range(10).withColumnRenamed("id", "copy"))
    source = F.when(F.col("copy") % 2 == 0, F.col("source")).otherwise(F.concat("source", F.lit("_2")))
    text = F.when(F.col("copy") % 2 == 0, F.col("text")).otherwise(F.translate("text", "0123456789", "1234567890"))
    copies.withColumn("doc_id", F.col("doc_id") + F.col("copy") * 10_000).withColumn("source", source).withColumn("text", text).drop("copy").repartition(4).write.parquet(str(path / "documents.parquet"))
    return path


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@pytest.mark.parametrize("name", ["g3_number_conflicts", "g9_retrieval_quality", "o3_promoted_hits", "a1_answer_metrics", "j3_path_rrf", "j13_enriched_hits", "g8_domain_guard"])
def test_exchanges_write_less_than_the_input(spark, folder, name):
    size = sum(p.stat().st_size for p in (folder / "documents.parquet").glob("*.parquet"))
    before = shuffled(spark)
    df = entry.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    ours = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert shuffled(spark) - before < size
    con = duckdb.connect()
    for table in os.listdir(folder):
        con.execute(f"create view {table.split('.')[0]} as select * from '{folder}/{table}{'/*.parquet' if table.startswith('documents') else ''}'")
    relation = con.sql(entry.oracle_sql()[name])
    at = [relation.columns.index(c) for c in columns]
    assert ours == Counter(repr(tuple(plain(r[i]) for i in at)) for r in relation.fetchall())
    assert ours
