"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import leakage, mixing, neardup, pairs, residue, sketch, splitting, textstats
from gleanery.runtime import cut_lineage, once, table


def _latencies(spark: SparkSession, d: str) -> DataFrame:
    """``metric, grp, day, value``: both latency columns, each record once however often it was sent."""
    # e2e_set has a fixed size; Spark broadcasts it below its own threshold and shuffles it otherwise.
    categories = table(spark, d, "e2e_set").groupBy("id").agg(F.min("category").alias("category"))
    reports = table(spark, d, "e2e_report").select("report_id", "id", "generated_at", "latency_ms")
    reports = once(reports, "report_id")
    e2e = reports.join(categories, "id", "left").select(F.lit("e2e_latency_ms").alias("metric"), "category", F.to_date("generated_at").alias("day"), F.col("latency_ms").cast("double").alias("value"))
    bench = once(table(spark, d, "benchmark_results").select("bench_id", "model", "finished_at", "latency"), "bench_id")
    bench = bench.select(F.lit("bench_latency_s").alias("metric"), F.col("model").alias("category"), F.to_date("finished_at").alias("day"), F.col("latency").alias("value"))
    return e2e.unionByName(bench).withColumnRenamed("category", "grp")


def p1_day_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return sketch.quantile_rows(sketch.cell_sketches(_latencies(spark, d)))


def p1_day_sketches(spark: SparkSession, d: str) -> DataFrame:
    return sketch.cell_sketches(_latencies(spark, d))


def p1_period_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Months and the whole span from the day sketches, without reading the rows again."""
    days = cut_lineage(sketch.cell_sketches(_latencies(spark, d)))
    months = sketch.quantile_rows(sketch.roll_up(days, F.to_date(F.date_trunc("month", "day")))).withColumn("span", F.lit("month"))
    whole = sketch.quantile_rows(sketch.roll_up(days, F.lit(None).cast("date"))).withColumn("span", F.lit("all"))
    return months.unionByName(whole)


def p1_rank_check(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the whole span, where every cell has been compacted, against exact ranks."""
    values = cut_lineage(_latencies(spark, d).withColumn("day", F.lit(None).cast("date")))
    whole = sketch.roll_up(sketch.cell_sketches(_latencies(spark, d)), F.lit(None).cast("date"))
    return sketch.rank_check(values, whole)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "chunks"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.clean(table(spark, d, "chunks")).select("doc_id", "source", "page").distinct()


def p3_evidence(spark: SparkSession, d: str) -> DataFrame:
    return residue.evidence(table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "chunks"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(table(spark, d, "chunks"))


def p4_cover(spark: SparkSession, d: str) -> DataFrame:
    """Every document put together again from its pieces, whose lengths and overlaps are kept."""
    return splitting.cover(splitting.split_documents(table(spark, d, "chunks")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.NearDuplicates(table(spark, d, "kb_documents")).pairs()


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.NearDuplicates(table(spark, d, "kb_documents")).groups()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, d, "evaluation_results"), table(spark, d, "e2e_report"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "qa_set"))


def p7_details(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_details(table(spark, d, "documents"), table(spark, d, "qa_set"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(mixing.measured(table(spark, d, "documents")), table(spark, d, "mix_plan"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached_shares(mixing.measured(table(spark, d, "documents")), table(spark, d, "mix_plan"))


def p8_within(spark: SparkSession, d: str) -> DataFrame:
    return mixing.targets_met(mixing.measured(table(spark, d, "documents")), table(spark, d, "mix_plan"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return textstats.non_prose(textstats.document_stats(table(spark, d, "documents")))


def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    return textstats.document_stats(table(spark, d, "documents"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return textstats.scored(textstats.document_stats(table(spark, d, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        p1_day_percentiles,
        p1_day_sketches,
        p1_period_percentiles,
        p1_rank_check,
        p3_found,
        p3_clean,
        p3_evidence,
        p4_found,
        p4_pieces,
        p4_cover,
        p5_found,
        p5_groups,
        p6_found,
        p7_found,
        p7_details,
        p8_mixture,
        p8_shares,
        p8_within,
        p9_found,
        p9_stats,
        p9_scores,
    ]
    return {f.__name__: f for f in found}
