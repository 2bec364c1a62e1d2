"""Rank fusion and merging of result lists, as full-outer joins and grouped sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.lexical import rank_within


def weighted_rrf(lexical: DataFrame, dense: DataFrame, k: int, lexical_weight: float = 0.4, dense_weight: float = 0.6, c: int = 60) -> DataFrame:
    """Reciprocal ranks of two lists, weighted; lists are ``qid, doc_id, rank``."""
    both = lexical.select("qid", "doc_id", F.col("rank").alias("lexical_rank")).join(dense.select("qid", "doc_id", F.col("rank").alias("dense_rank")), ["qid", "doc_id"], "full_outer")
    score = F.coalesce(lexical_weight / (c + F.col("lexical_rank")), F.lit(0.0)) + F.coalesce(dense_weight / (c + F.col("dense_rank")), F.lit(0.0))
    return rank_within(both.withColumn("score", F.round(score, 6)), "qid", [F.desc("score"), F.col("doc_id")], k)


def plain_rrf(lexical: DataFrame, dense: DataFrame, k: int = 15, c: int = 60) -> DataFrame:
    """Unweighted fusion that keeps both ranks (null where a list lacks the document)."""
    return weighted_rrf(lexical, dense, k, 1.0, 1.0, c)


def path_rrf(paths: dict[str, DataFrame], key: list[str], k: int, c: int = 60) -> DataFrame:
    """Fusion of any number of paths ``qid, *key, rank``, scaled by the best score; repeats in a path add up."""
    stacked = reduce(DataFrame.unionByName, [p.select("qid", *key, "rank", F.lit(name).alias("path")) for name, p in paths.items()])
    fused = stacked.groupBy("qid", *key).agg(F.sum(1.0 / (c + F.col("rank"))).alias("raw"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"), F.count(F.lit(1)).alias("n_paths"))
    best = F.max("raw").over(Window.partitionBy("qid"))
    return rank_within(fused.withColumn("score", F.round(F.col("raw") / best, 6)).drop("raw"), "qid", [F.desc("score"), *[F.col(x) for x in key]], k)


def best_of(lists: list[DataFrame], key: list[str], score: str, k: int) -> DataFrame:
    """Union of several lists where each key keeps its highest score."""
    stacked = reduce(DataFrame.unionByName, [x.select("qid", *key, score) for x in lists])
    merged = stacked.groupBy("qid", *key).agg(F.max(score).alias(score))
    return rank_within(merged, "qid", [F.desc(score), *[F.col(x) for x in key]], k)


def append_new(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """All of ``first``, then the rows of ``second`` whose key it lacks."""
    return first.unionByName(second.join(first.select("qid", *key), ["qid", *key], "left_anti"))


def cascade(sources: list[DataFrame], key: str, k: int) -> DataFrame:
    """Sources in order of preference; the first row of each key wins until there are k."""
    stacked = reduce(DataFrame.unionByName, [s.select("qid", key, "rank").withColumn("source_no", F.lit(n)) for n, s in enumerate(sources, 1)])
    first = rank_within(stacked.withColumn("pair", F.concat_ws("\u0001", "qid", key)), "pair", [F.col("source_no"), F.col("rank")], 1, "turn").drop("pair", "turn")
    return rank_within(first, "qid", [F.col("source_no"), F.col("rank"), F.col(key)], k, "place")


def top_up(primary: DataFrame, secondary: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Add unseen secondary rows to the queries whose primary list has fewer than ``least`` rows."""
    full = primary.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("qid")
    extra = secondary.filter(F.col(key).isNotNull()).join(full, "qid", "left_anti").join(primary.select("qid", key), ["qid", key], "left_anti")
    return primary.select("qid", key, "rank", F.lit(1).alias("tier")).unionByName(extra.select("qid", key, "rank", F.lit(2).alias("tier")))
