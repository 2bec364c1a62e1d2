"""Lexical ranking: postings, BM25 and sparse dot products as joins and aggregates.

Queries always come as a batch. Statistics (document counts, lengths, document frequencies) are taken
over all documents: a document is one row, so its terms are told apart without an exchange and only sums
per term are shuffled, pre-added in each task. The best k of a query are found by a scan in which each task
keeps its own best (``scans``), so neither postings nor the meetings of queries and documents are shuffled.
All hits of a query, and ids that don't tell documents apart, are scored by joins: postings are filtered by
the terms of the queries, a broadcast of checked size (a join by exchange beyond it), before anything of
them is shuffled. Scores are rounded before ranking, and every order ends in the document's id, so that
ranks do not depend on the order of summation.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleanery.functions.text import bag_tokens, stable_slot
from gleanery.operators import scans
from gleanery.runtime import cut_lineage, scratch, spread

K1, B, EPSILON = 1.5, 0.75, 0.25


def rank_within(df: DataFrame, group: str, order: list[Column], k: int | None, name: str = "rank") -> DataFrame:
    """1-based rank per group; with ``k`` Spark keeps only k rows per group before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    # The cast comes after the filter, which Spark must see on the rank itself.
    return (ranked if k is None else ranked.filter(F.col(name) <= k)).withColumn(name, F.col(name).cast("long"))


def postings(documents: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, term, tf``."""
    return spread(documents.select("doc_id", text)).select("doc_id", F.explode(bag_tokens(text)).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


#: Query terms that are broadcast (about 50 bytes each); more meet the postings by an exchange.
BROADCAST_TERMS = 500_000
#: Rows of the statistics that are no terms: documents and tokens. No token starts with this character.
_DOCUMENTS, _TOKENS = "\u0001documents", "\u0001tokens"


def term_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """``term, n``: documents of each term, and two rows with the number of documents and of tokens; one pass."""
    counts = spread(documents.select(F.lower(text).alias("text"))).mapInArrow(scans.document_counts(_DOCUMENTS, _TOKENS), "term string, n long")
    return counts.groupBy("term").agg(F.sum("n").alias("n"))


def collection_size(statistics: DataFrame) -> DataFrame:
    """One row: ``n_documents, avgdl, floor_idf``, the last being EPSILON of the mean idf of all terms."""
    pick = lambda term: F.max(F.when(F.col("term") == term, F.col("n")))
    totals = statistics.filter(F.col("term").isin(_DOCUMENTS, _TOKENS)).agg(pick(_DOCUMENTS).alias("n_documents"), pick(_TOKENS).alias("n_tokens"))
    terms = statistics.filter(~F.col("term").startswith("\u0001")).crossJoin(F.broadcast(totals))  # one row
    mean = terms.agg((F.avg(raw_idf(F.col("n_documents"), F.col("n"))) * EPSILON).alias("floor_idf"))
    return totals.crossJoin(F.broadcast(mean)).select("n_documents", (F.col("n_tokens") / F.col("n_documents")).alias("avgdl"), "floor_idf")  # one row


def raw_idf(n_documents: Column, df: Column) -> Column:
    return F.log((n_documents - df + 0.5) / (df + 0.5))


def asked_terms(queries: DataFrame) -> DataFrame:
    """``qid, term, qtf`` of ``queries(qid, query)``."""
    return queries.select("qid", F.explode(bag_tokens("query")).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint only where the rows are few enough."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df


def matching_postings(terms: DataFrame, documents: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, dl, term, tf`` of the terms in ``terms(term)`` only."""
    bags = spread(documents.select("doc_id", text)).select("doc_id", bag_tokens(text).alias("bag"))
    tokens = bags.select("doc_id", F.size("bag").alias("dl"), F.explode("bag").alias("term"))
    return tokens.join(terms, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_weights(asked: DataFrame, statistics: DataFrame) -> DataFrame:
    """``qid, term, qtf, avgdl, idf`` of the query terms that the collection has."""
    size = collection_size(statistics)
    known = asked.join(statistics, "term").crossJoin(F.broadcast(size))  # one row
    idf = raw_idf(F.col("n_documents"), F.col("n"))
    # A negative idf (a term in over half of the documents) becomes a share of the mean idf.
    return known.select("qid", "term", "qtf", "avgdl", F.when(idf < 0, F.col("floor_idf")).otherwise(idf).alias("idf"))


def scored_postings(asked: DataFrame, matched: DataFrame, statistics: DataFrame, k: int | None) -> DataFrame:
    """BM25 scores and ranks from ``asked(qid, term, qtf)``, ``matched(doc_id, dl, term, tf)`` and the statistics."""
    hits = query_weights(asked, statistics).join(matched, "term")
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / norm
    scores = hits.groupBy("qid", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    return rank_within(scores, "qid", [F.desc("score"), F.col("doc_id")], k)


def stored(df: DataFrame) -> DataFrame:
    """A table made once and read again, compressed and by columns."""
    path = scratch(df.sparkSession, "terms")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def lowered(documents: DataFrame) -> DataFrame:
    """``doc_id, text`` as the scans take them apart."""
    return spread(documents.select("doc_id", F.lower("text").alias("text")))


def scanned_postings(asked: DataFrame, documents: DataFrame, statistics: DataFrame, k: int, tokens: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """BM25 scores and ranks of the k best, from documents or ``tokens`` as ``scans.best_rows`` takes them."""
    weights = cut_lineage(query_weights(asked, statistics).select("qid", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "avgdl"))
    first = weights.select("avgdl").first()
    avgdl = first["avgdl"] if first else 1.0

    def share(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))

    best = scans.best_rows(weights.select("qid", "term", "weight"), documents, k, share, tokens)
    return rank_within(best, "qid", [F.desc("score"), F.col("doc_id")], k)


def bm25(queries: DataFrame, documents: DataFrame, k: int | None = 20) -> DataFrame:
    """``qid, doc_id, score, rank`` for ``queries(qid, query)`` over ``documents(doc_id, text)``."""
    documents = documents.filter("text is not null")
    asked, statistics = asked_terms(queries), stored(term_statistics(documents))
    if k is not None and scans.scannable(queries, documents):
        return scanned_postings(asked, lowered(documents), statistics, k)
    matched = matching_postings(bounded_broadcast(asked.select("term").distinct(), BROADCAST_TERMS), documents)
    return scored_postings(asked, matched, statistics, k)


# --- stored index ----------------------------------------------------------------------------------

#: Folders the postings are dealt to by term; a search reads those of its terms only.
BUCKETS = 32
#: Documents whose postings of the queries' terms a task gathers from the folders.
GROUP_DOCUMENTS = 20_000


def _bucket(term="term"):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(documents: DataFrame, path: str) -> None:
    """Postings of ``documents(doc_id, text)``, in folders by term and sorted by it, and the term statistics."""
    documents = documents.filter("text is not null")
    bags = spread(documents.select("doc_id", "text")).select("doc_id", bag_tokens("text").alias("bag"))
    if scans.scannable(documents.select(F.col("doc_id").alias("qid")), documents):
        # A document is one row, so its terms are counted where it is read and written by that task.
        doc = documents.schema["doc_id"].dataType
        rows = bags.mapInArrow(scans.counted(to_arrow_type(doc)), f"doc_id {doc.simpleString()}, dl int, term string, tf long").withColumn("bucket", _bucket())
    else:
        rows = bags.select("doc_id", F.size("bag").alias("dl"), F.explode("bag").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).withColumn("bucket", _bucket()).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    rows.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    term_statistics(documents).write.mode("overwrite").parquet(f"{path}/terms")


def search_index(queries: DataFrame, path: str, k: int | None = 20) -> DataFrame:
    """BM25 from a stored index: folders without a query term are not read."""
    spark = queries.sparkSession
    asked = asked_terms(queries)
    terms = asked.select("term").distinct()
    buckets = [r[0] for r in terms.select(_bucket()).distinct().collect()]  # BUCKETS at most
    stored = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(buckets) if buckets else F.lit(False))
    statistics = spark.read.parquet(f"{path}/terms")
    if k is not None and scans.plain_ids(queries, stored):
        size = statistics.filter(F.col("term") == _DOCUMENTS).first()
        groups = math.ceil((size["n"] if size else 1) / GROUP_DOCUMENTS) or 1
        return scanned_postings(asked, stored, statistics, k, lambda numbers: scans.gathered(stored.join(F.broadcast(numbers), "term"), groups))
    matched = stored.join(bounded_broadcast(terms, BROADCAST_TERMS), "term", "left_semi").select("doc_id", "dl", "term", "tf")
    return scored_postings(asked, matched, statistics, k)


def update_index(path: str, into: str, changed: DataFrame, removed: DataFrame) -> None:
    """A new index at ``into``: documents of ``changed(doc_id, text)`` replaced or added, ids of ``removed`` taken out.

    Statistics change by the difference of old and new postings of those documents; no text is read again.
    """
    spark = changed.sparkSession
    gone = changed.select("doc_id").union(removed.select("doc_id")).distinct()
    old = spark.read.parquet(f"{path}/postings")
    write_index(changed, f"{into}/part")
    fresh = spark.read.parquet(f"{into}/part/postings")
    kept = old.join(gone, "doc_id", "left_anti")
    kept.unionByName(fresh).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{into}/postings")
    lost = old.join(gone, "doc_id", "left_semi")
    minus = lost.groupBy("term").agg((-F.count(F.lit(1))).alias("n"))
    whole = lost.select("doc_id", "dl").distinct()
    totals = whole.agg((-F.count(F.lit(1))).alias("d"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("t")).select(F.explode(F.array(F.struct(F.lit(_DOCUMENTS).alias("term"), F.col("d").alias("n")), F.struct(F.lit(_TOKENS).alias("term"), F.col("t").alias("n")))).alias("r")).select("r.term", "r.n")
    parts = spark.read.parquet(f"{path}/terms").unionByName(spark.read.parquet(f"{into}/part/terms")).unionByName(minus).unionByName(totals)
    parts.groupBy("term").agg(F.sum("n").alias("n")).filter("n > 0").write.mode("overwrite").parquet(f"{into}/terms")


def bm25_filled(queries: DataFrame, documents: DataFrame, k: int = 20) -> DataFrame:
    """BM25 where documents without any query term score 0 and fill up to k, in document order.

    The first 2k documents hold at least k that a query with under k matches has not matched.
    """
    matched = bm25(queries, documents, k)
    first = documents.filter("text is not null").select("doc_id").orderBy("doc_id").limit(2 * k)
    fill = queries.select("qid").distinct().crossJoin(F.broadcast(first))  # 2k ids
    fill = fill.join(matched.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").select("qid", "doc_id", F.lit(0.0).alias("score"))
    return rank_within(matched.select("qid", "doc_id", "score").unionByName(fill), "qid", [F.desc("score"), F.col("doc_id")], k)


def min_max(ranked: DataFrame, score: str = "score") -> DataFrame:
    """Scores of each query mapped to [0, 1] over the rows returned; 1 where all are equal."""
    w = Window.partitionBy("qid")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return ranked.withColumn("norm_score", F.when(high > low, F.round((F.col(score) - low) / (high - low), 6)).otherwise(F.lit(1.0)))


def sparse_vectors(documents: DataFrame, text: str = "text", key: str = "doc_id", slots: int = 10_000) -> DataFrame:
    """Long sparse vectors ``key, idx, val``: hashed term counts, collisions added."""
    return spread(documents.select(key, text)).select(key, F.explode(bag_tokens(text)).alias("term")).groupBy(key, stable_slot(F.col("term"), slots).alias("idx")).agg(F.count(F.lit(1)).cast("double").alias("val"))


def sparse_top(queries: DataFrame, documents: DataFrame, k: int | None = 10) -> DataFrame:
    """Top documents by the dot product of sparse vectors; only slots of the queries leave a document."""
    q = sparse_vectors(queries.withColumnRenamed("query", "text"), key="qid").withColumnRenamed("val", "qval")
    documents = documents.filter("text is not null")
    if k is not None and scans.scannable(queries, documents):
        weights = cut_lineage(q.select("qid", F.col("idx").alias("term"), F.col("qval").alias("weight")))
        best = scans.best_rows(weights, lowered(documents), k, lambda tf, dl: tf, key=scans.slot_of())
        return rank_within(best, "qid", [F.desc("score"), F.col("doc_id")], k)
    bags = spread(documents.select("doc_id", "text")).select("doc_id", F.explode(bag_tokens("text")).alias("term"))
    # Of a document's tokens those in a slot of a query: the slots are fewer than the table has.
    slots = F.broadcast(q.select("idx").distinct())
    d = bags.withColumn("idx", stable_slot(F.col("term"))).join(slots, "idx", "left_semi").groupBy("doc_id", "idx").agg(F.count(F.lit(1)).cast("double").alias("val"))
    hits = q.join(d, "idx").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("qval") * F.col("val")), 6).alias("score"))
    return rank_within(hits, "qid", [F.desc("score"), F.col("doc_id")], k)
