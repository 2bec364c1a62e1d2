"""Documents of hits: their texts are read where they lie, and never shuffled to meet the few hits."""

import re

import pytest

from gleanery.plans import judging, load, retrieval

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def joins_by_exchange(df):
    return len(re.findall(r"SortMergeJoin|ShuffledHashJoin", plan_of(df).split("== Initial Plan ==")[0]))


@pytest.fixture
def no_static_broadcast(spark):
    """No table is small enough to be broadcast for its size alone, as none is at scale."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["g1_graded_hits", "g3_number_conflicts", "g9_retrieval_quality", "o3_promoted_hits", "j13_enriched_hits", "j3_path_rrf"])
def test_no_join_of_hits_by_exchange(spark, no_static_broadcast, name):
    assert joins_by_exchange(load()[0][name](spark, SMALL)) == 0


def test_too_many_hits_to_broadcast(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, judging._hits(spark, SMALL, 5, "source").collect()), key=str)
    want = rows()
    monkeypatch.setattr(judging, "BROADCAST_HITS", 1)
    assert rows() == want and want
    paths = lambda: sorted(map(tuple, retrieval.path_rrf(spark, SMALL).collect()), key=str)
    want = paths()
    monkeypatch.setattr(retrieval, "BROADCAST_HITS", 1)
    assert paths() == want and want
