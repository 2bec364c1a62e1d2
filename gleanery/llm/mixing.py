"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets an Efraimidis-Spirakis key, -ln(u) / weight, with u a hash of its id and weight its
text quality; ascending keys are a weighted random order. Within a source the documents are put in that
order and their token counts prefix-summed. A plan then takes complete epochs of a source first, and the
rest of the source's budget as the documents whose prefix sum lies under it.

The prefix sum of a source never runs in one task: keys are cut into buckets, bucket totals (a bounded
table) are accumulated, and documents are ordered within their bucket only. The order is shared by all
plans, so a larger budget contains the smaller one.

Defined results for odd input: null or empty texts have no tokens and are never drawn, nor documents without an id; a null source
belongs to no plan; null, negative or NaN weights and budgets count as 0; a null repeat cap is no cap, a
negative one 0; a source named twice in a plan has its weights added and the smaller cap; a source without
documents reaches 0; ties of keys go by id; a document sent twice counts once.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.runtime import cut_lineage, spread

#: A byte-level BPE for many languages; a parameter of every call, never part of this repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Documents a key bucket should hold; more documents make more buckets.
BUCKET_ROWS = 20_000
SEED = 20240601
#: Classes of equal width in which the weights of a source are counted.
WEIGHT_CLASSES = 20


@lru_cache(maxsize=2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("mixing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def quality(text: str) -> float:
    """Weight in [0.05, 1]: share of letters and digits, less what repeats line by line."""
    visible = len(re.sub(r"\s+", "", text))
    if not visible:
        return 0.05
    letters = len(re.sub(r"[\W_]+", "", text)) / visible
    lines = [x for x in text.split("\n") if x.strip()]
    fresh = len(set(lines)) / len(lines)
    return max(0.05, min(1.0, letters * fresh))


def _measure(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens = [len(encoder.encode_ordinary(t)) for t in texts]
            weights = [quality(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(tokens, pa.int64()), pa.array(weights, pa.float64())], names=["doc_id", "source", "tokens", "weight"])

    return run


def measured(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens, weight``; texts are tokenised once and only these columns go on."""
    sized = spread(documents.select("doc_id", "source", "text")).mapInArrow(_measure(tokenizer), "doc_id long, source string, tokens long, weight double")
    return cut_lineage(sized.filter("tokens > 0 and doc_id is not null").dropDuplicates(["doc_id"]))


def _weight_class():
    return F.least(F.floor(F.col("weight") * WEIGHT_CLASSES), F.lit(WEIGHT_CLASSES - 1))


def prefix_sums(sized: DataFrame, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, source, tokens, before``: tokens of the source that come before in its random order."""
    # u lies in (0, 1): 53 bits of the hash, shifted off zero.
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / float(2**53)
    keyed = sized.withColumn("key", -F.log(u) / F.col("weight"))
    buckets = max(16, math.ceil(sized.count() / bucket_rows))
    # The share of a source's keys below a key is the mean of 1 - exp(-weight * key) over its weights: monotone,
    # and even whatever the weights are, so a bucket is a range of keys that holds its share of the documents.
    classes = [F.count(F.when(_weight_class() == i, 1)).alias(f"w{i}") for i in range(WEIGHT_CLASSES)]
    weights = keyed.groupBy("source").agg(*classes, F.count(F.lit(1)).alias("n_weights"))
    below = sum((F.col(f"w{i}") * (1 - F.exp(-F.col("key") * ((i + 0.5) / WEIGHT_CLASSES))) for i in range(WEIGHT_CLASSES)), F.lit(0.0)) / F.col("n_weights")
    keyed = keyed.join(weights, "source").withColumn("bucket", F.floor(below * buckets).cast("int")).select("doc_id", "source", "tokens", "weight", "key", "bucket")
    totals = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("bucket_tokens"))
    base = totals.select("source", "bucket", (F.sum("bucket_tokens").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_tokens")).alias("base"))
    within = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = keyed.withColumn("upto", within).join(base, ["source", "bucket"])
    return placed.select("doc_id", "source", "tokens", (F.col("base") + F.col("upto") - F.col("tokens")).alias("before"))


def plan_targets(sized: DataFrame, plans: DataFrame) -> DataFrame:
    """Per plan and source: target tokens, complete epochs and the fraction's budget."""
    clean = lambda c: F.when(F.isnan(c) | (F.col(c) < 0), 0.0).otherwise(F.coalesce(F.col(c), F.lit(0.0)))
    lines = (
        plans.filter("source is not null")
        .groupBy("plan_id", "source")
        .agg(F.sum(clean("target_weight")).alias("target_weight"), F.min("max_repeats").alias("max_repeats"), F.max(clean("budget_ratio")).alias("budget_ratio"))
    )
    per_source = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("source_docs"))
    corpus = per_source.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("corpus_tokens"))
    total = F.sum("target_weight").over(Window.partitionBy("plan_id"))
    share = F.when(total > 0, F.col("target_weight") / total).otherwise(0.0)
    lines = lines.withColumn("target_share", share).join(per_source, "source", "left").crossJoin(F.broadcast(corpus))  # one row: the corpus total
    available = F.coalesce("available", F.lit(0))
    target = F.col("target_share") * F.col("budget_ratio") * F.col("corpus_tokens")
    cap = F.greatest(F.coalesce(F.col("max_repeats").cast("long"), F.lit(2**31)), F.lit(0))
    epochs = F.when(available > 0, F.least(F.floor(F.col("target_tokens") / available + 1e-12), cap)).otherwise(0)
    lines = lines.withColumn("target_tokens", target).withColumn("available", available).withColumn("epochs", epochs.cast("long"))
    rest = F.when((F.col("available") > 0) & (F.col("epochs") < cap), F.greatest(F.col("target_tokens") - F.col("epochs") * F.col("available"), F.lit(0.0))).otherwise(0.0)
    return lines.select("plan_id", "source", "target_weight", "target_share", "max_repeats", "target_tokens", "available", "epochs", rest.alias("rest_tokens"))


def mixture(sized: DataFrame, plans: DataFrame, seed: int = SEED) -> DataFrame:
    """``plan_id, source, doc_id, tokens, repeats``: one row per drawn document, repeats as a number.

    The document at the edge of a budget is drawn if that comes closer to the target than leaving it.
    """
    placed = prefix_sums(sized, seed)
    # Plans are a table of settings; Spark broadcasts it below its own size threshold and shuffles otherwise.
    joined = placed.join(plan_targets(sized, plans).filter("epochs > 0 or rest_tokens > 0"), "source")
    extra = F.when(F.col("before") + F.col("tokens") / 2 <= F.col("rest_tokens"), 1).otherwise(0)
    return joined.select("plan_id", "source", "doc_id", "tokens", (F.col("epochs") + extra).alias("repeats")).filter("repeats > 0")


def reached_shares(sized: DataFrame, plans: DataFrame, seed: int = SEED) -> DataFrame:
    """Report per plan and source: what was wanted and what the drawn mixture has."""
    drawn = mixture(sized, plans, seed).groupBy("plan_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"))
    wanted = plan_targets(sized, plans)
    both = wanted.join(drawn, ["plan_id", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    total = F.sum("tokens").over(Window.partitionBy("plan_id"))
    return both.select(
        "plan_id",
        "source",
        "target_share",
        F.round("target_tokens", 3).alias("target_tokens"),
        "available",
        "tokens",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("actual_share"),
        F.round(F.greatest(F.col("target_tokens") - F.col("tokens"), F.lit(0.0)), 3).alias("short_tokens"),
    )


def targets_met(sized: DataFrame, plans: DataFrame, seed: int = SEED) -> DataFrame:
    """``plan_id, source, within``: the source reached its tokens within its largest document, or gave all its cap allows."""
    largest = sized.groupBy("source").agg(F.max("tokens").alias("largest"))
    rows = reached_shares(sized, plans, seed).join(plan_targets(sized, plans).select("plan_id", "source", "max_repeats"), ["plan_id", "source"]).join(largest, "source", "left")
    cap = F.greatest(F.coalesce(F.col("max_repeats").cast("long"), F.lit(2**31)), F.lit(0))
    near = F.abs(F.col("tokens") - F.col("target_tokens")) <= F.coalesce("largest", F.lit(0)) / 2 + 1e-3
    used_up = F.col("tokens") == F.col("available") * F.least(cap, F.col("most_repeats"))
    return rows.select("plan_id", "source", ((near | (used_up & (F.col("most_repeats") == cap)) | (F.col("available") == 0) | (cap == 0)) & (F.col("most_repeats") <= cap)).alias("within"))
