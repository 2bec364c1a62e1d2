"""Grading of answers and retrieved texts: overlap, support, conflicts, citations, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators.lexical import rank_within

#: What ends a sentence in the support check.
FACT_SEPARATORS = "。\\n.！？"


def grade(cover: Column) -> tuple[Column, Column]:
    """Grade and score of a token coverage."""
    name = F.when(cover >= 0.3, "relevant").when(cover >= 0.1, "ambiguous").otherwise("irrelevant")
    score = F.when(cover >= 0.3, F.least(F.lit(1.0), cover + 0.5)).when(cover >= 0.1, cover + 0.3).otherwise(cover)
    return name, T.rounded(score, 3)


def graded(pairs: DataFrame) -> DataFrame:
    """``pairs(qid, doc_id, query, text)`` with coverage of the query's tokens, grade and score."""
    q = T.mixed_tokens("query")
    cover = F.size(F.array_intersect(q, T.mixed_tokens("text"))) / F.greatest(F.size(q), F.lit(1))
    scored = pairs.withColumn("coverage", cover)
    name, score = grade(F.col("coverage"))
    return scored.select("qid", "doc_id", F.round("coverage", 6).alias("coverage"), name.alias("grade"), score.alias("relevance_score"))


def support(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Share of each answer sentence's tokens that its sources have; the score is what is missing on average.

    Sentence tokens meet source tokens by an equi-join, so no list of all source tokens is built.
    """
    sent = answers.select("aid", F.posexplode(T.sentences("answer", FACT_SEPARATORS, 10)).alias("n", "s"))
    tokens = sent.select("aid", "n", F.explode(T.mixed_tokens("s")).alias("token"))
    known = sources.select("aid", F.explode(T.mixed_tokens("text")).alias("token")).distinct().withColumn("known", F.lit(1))
    cover = tokens.join(known, ["aid", "token"], "left").groupBy("aid", "n").agg((F.sum(F.coalesce("known", F.lit(0))) / F.count(F.lit(1))).alias("cover"))
    every = sent.select("aid", "n").join(cover, ["aid", "n"], "left").withColumn("cover", F.coalesce("cover", F.lit(0.0)))
    summed = every.groupBy("aid").agg(F.avg("cover").alias("mean_cover"), F.count(F.when(F.col("cover") < 0.2, 1)).alias("n_unsupported"))
    out = answers.select("aid").join(summed, "aid", "left")
    score = T.rounded(F.greatest(F.lit(0.0), 1.0 - F.coalesce("mean_cover", F.lit(0.0))), 3)
    return out.select("aid", score.alias("hallucination_score"), (score < 0.3).alias("passed"), F.coalesce("n_unsupported", F.lit(0)).alias("n_unsupported"))


NUMBER_CLAIM = r"([一-鿿]+)\s*[:：]?\s*(\d+\.?\d*)\s*%?"


def number_conflicts(rows: DataFrame, keep: int = 3) -> DataFrame:
    """Topics for which a group's sources state different numbers: ``rows(qid, ord, source, text)``."""
    claims = rows.select("qid", "ord", "source", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(NUMBER_CLAIM), 1).alias("topic"), F.regexp_extract_all("text", F.lit(NUMBER_CLAIM), 2).alias("value"))).alias("pos", "c"))
    claims = claims.select("qid", "ord", "source", "pos", F.col("c.topic").alias("topic"), F.col("c.value").alias("value"))
    topics = claims.groupBy("qid", "topic").agg(F.count_distinct("value").alias("n_values"), F.count_distinct("source").alias("n_sources"), F.min(F.struct("ord", "pos")).alias("first"))
    return rank_within(topics.filter("n_values > 1 and n_sources > 1"), "qid", [F.col("first")], keep, "place").drop("first")


def citations(answers: DataFrame, n_docs: int, transitions: tuple[str, ...]) -> DataFrame:
    """Cited and orphan sentences, valid and invalid references, citation rate."""
    parts = T.sentences("answer", "。！？\\n.", 10)
    has = lambda s: F.size(F.regexp_extract_all(s, F.lit(r"\[(\d+)\]"), 1)) > 0
    bridge = lambda s: s.rlike("|".join(transitions)) | s.startswith("#") | s.startswith("---")
    refs = F.array_distinct(F.flatten(F.transform(parts, lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"\[(\d+)\]"), 1), lambda r: r.try_cast("int")))))
    cited = F.size(F.filter(parts, lambda s: has(s)))
    orphan = F.size(F.filter(parts, lambda s: ~has(s) & ~bridge(s)))
    row = answers.select("aid", cited.alias("n_cited"), orphan.alias("n_orphan"), F.size(F.filter(refs, lambda r: r.between(1, n_docs))).alias("n_valid"), F.size(F.filter(refs, lambda r: ~r.between(1, n_docs))).alias("n_invalid"))
    return row.withColumn("citation_rate", F.when(F.col("n_cited") + F.col("n_orphan") > 0, F.round(F.col("n_cited") / (F.col("n_cited") + F.col("n_orphan")), 2)).otherwise(0.0))


#: Polarity words of the answer comparison, and what is no entity.
NEGATIVE = ("不是", "错误", "不正确", "并非", "没有", "不存在", "不能")
POSITIVE = ("是", "正确", "存在", "有", "可以")
PLAIN_NUMBERS = ("0", "1", "2", "3")
NO_ENTITIES = ("The", "This", "That", "Agent", "Step", "DNA", "RAG", "CRAG", "Web", "LLM")


def answer_conflicts(pairs: DataFrame) -> DataFrame:
    """Heuristics on ``pairs(pid, a, b)``: numbers, length, polarity, Latin entities, Han terms; a verdict."""
    both_ways = lambda x, y: F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))
    numbers = lambda c: F.array_except(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+\.?\d*)"), 1)), F.array(*map(F.lit, PLAIN_NUMBERS)))
    names = lambda c: F.array_except(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b([A-Z][a-z]{1,}(?:\s[A-Z][a-z]+)*)\b"), 1)), F.array(*map(F.lit, NO_ENTITIES)))
    terms = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("([一-龥]{2,4})"), 1))
    any_of = lambda c, words: c.rlike("|".join(words))
    a, b = F.col("a"), F.col("b")
    neg_a, neg_b, pos_a, pos_b = any_of(a, NEGATIVE), any_of(b, NEGATIVE), any_of(a, POSITIVE), any_of(b, POSITIVE)
    row = pairs.select(
        "pid",
        ((F.size(numbers(a)) > 0) & (F.size(numbers(b)) > 0) & (both_ways(numbers(a), numbers(b)) >= 2)).alias("numbers_differ"),
        (F.greatest(F.length(a), F.length(b)) / F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)) > 3).alias("lengths_differ"),
        (((neg_a & pos_b) | (pos_a & neg_b)) & (neg_a != neg_b)).alias("polarity_differs"),
        ((F.size(names(a)) > 0) & (F.size(names(b)) > 0) & (both_ways(names(a), names(b)) >= 2)).alias("entities_differ"),
        ((F.size(F.array_except(terms(a), terms(b))) > 10) & (F.size(F.array_except(terms(b), terms(a))) > 10)).alias("terms_differ"),
    )
    any_difference = F.col("numbers_differ") | F.col("lengths_differ") | F.col("polarity_differs") | F.col("entities_differ") | F.col("terms_differ")
    return row.withColumn("verdict", F.when(any_difference, "partial").otherwise("agree"))


def votes(samples: DataFrame) -> DataFrame:
    """Most frequent opening (100 characters) among ``samples(gid, ord, answer)``; the first seen wins a tie."""
    counted = samples.groupBy("gid", T.strip(F.substring("answer", 1, 100)).alias("opening")).agg(F.count(F.lit(1)).alias("n_votes"), F.min("ord").alias("first"))
    total = counted.groupBy("gid").agg(F.sum("n_votes").alias("n_samples"), F.max(F.struct("n_votes", (-F.col("first")).alias("f"), "opening")).alias("best"))
    return total.select("gid", F.md5("best.opening").alias("winner_md5"), F.col("best.n_votes").alias("winning_votes"), "n_samples", F.round(F.col("best.n_votes") / F.col("n_samples"), 6).alias("consistency"))
