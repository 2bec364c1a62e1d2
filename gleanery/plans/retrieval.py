"""Lexical, vector and fused retrieval; the query set is every document or vector whose id divides by 100."""

from pyspark.sql import functions as F

from gleanery.functions import sqltext as S
from gleanery.functions import text as T
from gleanery.operators import fusion, lexical, vector
from gleanery.plans.registry import query
from gleanery.runtime import cut_lineage, scratch, table


def text_queries(spark, d):
    return table(spark, d, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.coalesce("title", "source").alias("query"))


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")


def vector_queries(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")


Q = "q AS (SELECT doc_id AS qid, coalesce(title, source) AS query FROM documents WHERE doc_id % 100 = 0)"

BM = f"""{Q},
toks AS (SELECT doc_id, {S.bag_tokens('text')} AS t FROM documents WHERE text IS NOT NULL),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL),
size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
raw AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), size),
idf AS (SELECT term, CASE WHEN idf < 0 THEN (SELECT 0.25 * avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
asked AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({S.bag_tokens('query')}) AS term FROM q) GROUP BY ALL),
bscore AS (SELECT qid, p.doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl))), 6) AS score
  FROM asked JOIN idf USING (term) JOIN post p USING (term) JOIN toks ON toks.doc_id = p.doc_id, size GROUP BY ALL),
bm AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bscore)"""

SP = f"""qs AS (SELECT qid, {S.slot('term')} AS idx, count(*) AS v FROM (SELECT qid, unnest({S.bag_tokens('query')}) AS term FROM q) GROUP BY ALL),
ds AS (SELECT doc_id, {S.slot('term')} AS idx, count(*) AS v FROM (SELECT doc_id, unnest({S.bag_tokens('text')}) AS term FROM documents) GROUP BY ALL),
sp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM
  (SELECT qid, doc_id, round(sum(qs.v * ds.v) :: DOUBLE, 6) AS score FROM qs JOIN ds USING (idx) GROUP BY ALL))"""


@query("l1_bm25_top20", f"WITH {BM} SELECT * FROM bm WHERE rank <= 20")
def bm25_top20(spark, d):
    return lexical.bm25(text_queries(spark, d), documents(spark, d))


@query(
    "l2_bm25_minmax",
    f"""WITH {BM}, fill AS (SELECT doc_id FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 40),
zeros AS (SELECT qid, doc_id, 0.0 :: DOUBLE AS score FROM q, fill WHERE NOT EXISTS (SELECT 1 FROM bm WHERE bm.qid = q.qid AND bm.doc_id = fill.doc_id AND rank <= 20)),
every AS (SELECT qid, doc_id, score FROM bm WHERE rank <= 20 UNION ALL SELECT * FROM zeros),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM every)
SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) ELSE 1.0 END AS norm_score
FROM (SELECT * FROM top WHERE rank <= 20) WINDOW w AS (PARTITION BY qid)""",
)
def bm25_minmax(spark, d):
    return lexical.min_max(lexical.bm25_filled(text_queries(spark, d), documents(spark, d)))


@query("f7_bm25_positive", f"WITH {BM} SELECT qid, count(*) AS n_positive FROM bm WHERE score > 0 GROUP BY qid")
def bm25_positive(spark, d):
    return lexical.bm25(text_queries(spark, d), documents(spark, d), None).filter("score > 0").groupBy("qid").agg(F.count(F.lit(1)).alias("n_positive"))


@query("v13_sparse_top10", f"WITH {Q}, {SP} SELECT * FROM sp WHERE rank <= 10")
def sparse_top10(spark, d):
    return lexical.sparse_top(text_queries(spark, d), documents(spark, d))


@query("t8_sparse_vectors", f"SELECT doc_id, {S.slot('term')} AS idx, count(*) :: DOUBLE AS val FROM (SELECT doc_id, unnest({S.bag_tokens('text')}) AS term FROM documents) GROUP BY ALL")
def sparse_vectors(spark, d):
    return lexical.sparse_vectors(documents(spark, d))


_PAIR = f"""lex AS (SELECT qid, doc_id, rank FROM bm WHERE rank <= 20), den AS (SELECT qid, doc_id, rank FROM sp WHERE rank <= 20)"""


#: Hits that are broadcast (about 50 bytes each); more meet the documents by an exchange.
BROADCAST_HITS = 500_000


def _two_lists(spark, d, k=20):
    q, docs = text_queries(spark, d), documents(spark, d)
    return cut_lineage(lexical.bm25(q, docs, k)), cut_lineage(lexical.sparse_top(q, docs, k))


def _rrf_sql(a: float, b: float, k: int) -> str:
    return f"""WITH {BM}, {SP}, {_PAIR},
u AS (SELECT qid, doc_id, lex.rank AS lexical_rank, den.rank AS dense_rank, round(coalesce({a} / (60 + lex.rank), 0) + coalesce({b} / (60 + den.rank), 0), 6) AS score FROM lex FULL JOIN den USING (qid, doc_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM u) WHERE rank <= {k}"""


@query("j1_weighted_rrf", _rrf_sql(0.4, 0.6, 10))
def weighted_rrf(spark, d):
    return fusion.weighted_rrf(*_two_lists(spark, d), 10)


@query("j2_plain_rrf", _rrf_sql(1.0, 1.0, 15))
def plain_rrf(spark, d):
    return fusion.plain_rrf(*_two_lists(spark, d))


def _paths(spark, d):
    a, b = (lexical.bounded_broadcast(x, BROADCAST_HITS) for x in _two_lists(spark, d))
    keys = table(spark, d, "documents").select("doc_id", "source", "collection")
    return {"lexical": a.join(keys, "doc_id"), "sparse": b.join(keys, "doc_id")}


@query(
    "j3_path_rrf",
    f"""WITH {BM}, {SP}, {_PAIR},
u AS (SELECT qid, source, collection, rank, 'lexical' AS path FROM lex JOIN documents USING (doc_id) UNION ALL SELECT qid, source, collection, rank, 'sparse' FROM den JOIN documents USING (doc_id)),
g AS (SELECT qid, source, collection, sum(1.0 / (60 + rank)) AS raw, string_agg(path, ',' ORDER BY path) AS paths, count(*) AS n_paths FROM u GROUP BY ALL),
s AS (SELECT qid, source, collection, paths, n_paths, round(raw / max(raw) OVER (PARTITION BY qid), 6) AS score FROM g)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source, collection NULLS FIRST) AS rank FROM s) WHERE rank <= 10""",
)
def path_rrf(spark, d):
    return fusion.path_rrf(_paths(spark, d), ["source", "collection"], 10)


@query(
    "j4_max_merge",
    f"""WITH {BM}, {SP}, u AS (SELECT qid, doc_id, score FROM bm WHERE rank <= 20 UNION ALL SELECT qid, doc_id, score FROM sp WHERE rank <= 20),
g AS (SELECT qid, doc_id, max(score) AS score FROM u GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM g) WHERE rank <= 10""",
)
def max_merge(spark, d):
    return fusion.best_of(list(_two_lists(spark, d)), ["doc_id"], "score", 10)


@query(
    "j5_append_new",
    f"WITH {BM}, {SP}, {_PAIR} SELECT qid, doc_id, rank FROM lex UNION ALL SELECT qid, doc_id, rank FROM den WHERE NOT EXISTS (SELECT 1 FROM lex WHERE lex.qid = den.qid AND lex.doc_id = den.doc_id)",
)
def append_new(spark, d):
    a, b = _two_lists(spark, d)
    return fusion.append_new(a.select("qid", "doc_id", "rank"), b.select("qid", "doc_id", "rank"), ["doc_id"])


@query(
    "j6_cascade",
    f"""WITH {BM}, {SP}, {_PAIR}, u AS (SELECT qid, doc_id, rank, 1 AS source_no FROM lex UNION ALL SELECT qid, doc_id, rank, 2 FROM den),
f AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY source_no, rank) AS turn FROM u)
SELECT * FROM (SELECT qid, doc_id, rank, source_no, row_number() OVER (PARTITION BY qid ORDER BY source_no, rank, doc_id) AS place FROM f WHERE turn = 1) WHERE place <= 25""",
)
def cascade(spark, d):
    return fusion.cascade(list(_two_lists(spark, d)), "doc_id", 25)


@query(
    "j14_top_up",
    f"""WITH {BM}, {SP}, p AS (SELECT qid, doc_id, rank FROM bm WHERE rank <= 20 AND score > 14),
s AS (SELECT qid, doc_id, rank FROM sp WHERE rank <= 5)
SELECT qid, doc_id, rank, 1 AS tier FROM p UNION ALL
SELECT qid, doc_id, rank, 2 FROM s WHERE qid NOT IN (SELECT qid FROM p GROUP BY qid HAVING count(*) >= 3) AND NOT EXISTS (SELECT 1 FROM p WHERE p.qid = s.qid AND p.doc_id = s.doc_id)""",
)
def top_up(spark, d):
    a, b = _two_lists(spark, d)
    return fusion.top_up(a.filter("score > 14"), b.filter("rank <= 5"), "doc_id")


@query("j13_enriched_hits", f"WITH {BM} SELECT qid, bm.doc_id, rank, source, collection, n_chars FROM bm JOIN documents USING (doc_id) WHERE rank <= 5")
def enriched_hits(spark, d):
    top = lexical.bounded_broadcast(cut_lineage(lexical.bm25(text_queries(spark, d), documents(spark, d), 5)), BROADCAST_HITS)
    return top.join(table(spark, d, "documents").select("doc_id", "source", "collection", "n_chars"), "doc_id").select("qid", "doc_id", "rank", "source", "collection", "n_chars")


@query(
    "o1_rerank_overlap",
    f"""WITH {BM}, t AS (SELECT bm.qid, bm.doc_id, bm.rank, {S.mixed_tokens('q.query')} AS a, {S.mixed_tokens('d.text')} AS b FROM bm JOIN q USING (qid) JOIN documents d ON d.doc_id = bm.doc_id WHERE bm.rank <= 8),
s AS (SELECT qid, doc_id, rank AS first_rank, round({S.coverage('a', 'b')}, 6) AS rerank_score FROM t)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, first_rank) AS rank FROM s) WHERE rank <= 5""",
)
def rerank_overlap(spark, d):
    q, docs = text_queries(spark, d), documents(spark, d)
    first = lexical.bm25(q, docs, 8).select("qid", "doc_id", F.col("rank").alias("first_rank"))
    scored = first.join(q, "qid").join(docs, "doc_id").select("qid", "doc_id", "first_rank", F.round(T.coverage(T.mixed_tokens("query"), T.mixed_tokens("text")), 6).alias("rerank_score"))
    return lexical.rank_within(scored, "qid", [F.desc("rerank_score"), F.col("first_rank")], 5)


# --- vectors ---------------------------------------------------------------------------------------

VQ = "vq AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 100 = 0)"


def _distance_sql(expression: str, k: int = 10) -> str:
    return f"""WITH {VQ}, s AS (SELECT qid, vec_id, round({expression}, 6) AS score FROM vq, embeddings e)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""


_D64 = lambda c: f"CAST({c} AS DOUBLE[])"


@query("v1_cosine_top10", _distance_sql(f"list_cosine_similarity({_D64('q')}, {_D64('e.embedding')})"))
def cosine_top10(spark, d):
    return vector.exact_top(vector_queries(spark, d), vectors(spark, d))


@query("v2_inner_top10", _distance_sql(f"list_inner_product({_D64('q')}, {_D64('e.embedding')})"))
def inner_top10(spark, d):
    return vector.exact_top(vector_queries(spark, d), vectors(spark, d), metric="ip")


@query("v2_euclid_top10", _distance_sql(f"-list_distance({_D64('q')}, {_D64('e.embedding')})"))
def euclid_top10(spark, d):
    return vector.exact_top(vector_queries(spark, d), vectors(spark, d), metric="l2")


@query(
    "f1_filtered_top5",
    f"""WITH {VQ}, s AS (SELECT qid, vec_id, round(list_cosine_similarity({_D64('q')}, {_D64('e.embedding')}), 6) AS score FROM vq, embeddings e WHERE label = 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
)
def filtered_top5(spark, d):
    return vector.exact_top(vector_queries(spark, d), vectors(spark, d).filter("label = 3"), 5)


@query(
    "v3_label_recall",
    f"""WITH {VQ}, s AS (SELECT qid, vec_id, label, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity({_D64('q')}, {_D64('e.embedding')}), 6) DESC, vec_id) AS rank FROM vq, embeddings e)
SELECT s.qid, round(avg(CASE WHEN s.label = o.label THEN 1.0 ELSE 0.0 END), 6) AS same_label FROM s JOIN embeddings o ON o.vec_id = s.qid WHERE rank <= 10 GROUP BY s.qid""",
)
def label_recall(spark, d):
    top = cosine_top10(spark, d)
    labels = vectors(spark, d).select("vec_id", "label")
    both = top.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("qid"), F.col("label").alias("own")), "qid")
    return both.groupBy("qid").agg(F.round(F.avg(F.when(F.col("label") == F.col("own"), 1.0).otherwise(0.0)), 6).alias("same_label"))


@query(
    "v4_binary_top10",
    f"""WITH {VQ}, h AS (SELECT qid, vec_id, list_sum(list_transform(range(1, len(q) + 1), lambda i: CASE WHEN (q[i] > 0) <> (e.embedding[i] > 0) THEN 1 ELSE 0 END)) :: BIGINT AS hamming,
  round(list_cosine_similarity({_D64('q')}, {_D64('e.embedding')}), 6) AS score FROM vq, embeddings e),
n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hamming, vec_id) AS c FROM h)
SELECT qid, vec_id, hamming, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM n WHERE c <= 100) WHERE rank <= 10""",
)
def binary_top10(spark, d):
    return vector.binary_top(vector_queries(spark, d), vectors(spark, d))


@query(
    "v5_scalar_codes",
    """WITH f AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding) :: DOUBLE AS v FROM embeddings),
r AS (SELECT dim, min(v) AS low, CASE WHEN max(v) = min(v) THEN min(v) + 1e-6 ELSE max(v) END AS high FROM f GROUP BY dim)
SELECT vec_id, dim :: INTEGER AS dim, trunc((v - low) * 254.0 / (high - low) - 127.0) :: INTEGER AS code FROM f JOIN r USING (dim)""",
)
def scalar_codes(spark, d):
    return vector.scalar_codes(vectors(spark, d)).select("vec_id", "dim", "code")


@query("v6_code_sizes", "SELECT count(*) AS n_vectors, any_value(len(embedding)) :: BIGINT AS dims, count(*) * any_value(len(embedding)) * 4 AS float_bytes, count(*) * any_value(len(embedding)) + 8 * any_value(len(embedding)) AS scalar_bytes, count(*) * any_value(len(embedding)) // 8 AS binary_bytes FROM embeddings")
def code_sizes(spark, d):
    n, dims = F.count(F.lit(1)), F.first(F.size("embedding")).cast("long")
    return vectors(spark, d).agg(n.alias("n_vectors"), dims.alias("dims"), (n * dims * 4).alias("float_bytes"), (n * dims + dims * 8).alias("scalar_bytes"), F.floor(n * dims / 8).alias("binary_bytes"))


@query(
    "v5_scalar_error",
    """WITH f AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding) :: DOUBLE AS v FROM embeddings),
r AS (SELECT dim, min(v) AS low, CASE WHEN max(v) = min(v) THEN min(v) + 1e-6 ELSE max(v) END AS high FROM f GROUP BY dim)
SELECT dim :: INTEGER AS dim, round(max(abs((trunc((v - low) * 254.0 / (high - low) - 127.0) + 127) * (high - low) / 254.0 + low - v)), 7) AS max_error FROM f JOIN r USING (dim) GROUP BY dim""",
)
def scalar_error(spark, d):
    codes = vector.scalar_codes(vectors(spark, d))
    return codes.groupBy("dim").agg(F.round(F.max(F.abs(F.col("decoded") - F.col("v"))), 7).alias("max_error"))


#: Lists of the inverted index, lists each vector stands in, and lists a query reads (a quarter).
LISTS, COPIES, PROBES = 64, 3, 16


@query("v7_ivf_recall")
def ivf_recall(spark, d):
    """Recall of the stored lists against the full scan, and the rows a query was compared with as a share of the vectors.

    The test vectors have no clusters, which leaves lists little to save; the share is reported with the recall.
    """
    store = vectors(spark, d)
    centers = vector.k_means(vector.fit_sample(store), LISTS)
    path = scratch(spark, "lists")
    vector.write_lists(store, centers, path, COPIES)
    lists = spark.read.parquet(path)
    found = cut_lineage(vector.list_top(vector_queries(spark, d), lists, centers, PROBES, 10, COPIES))
    share = found.groupBy("qid").agg((F.max("n_read") / store.count()).alias("share"))
    return vector.recall(found, vector.exact_top(vector_queries(spark, d), store, metric="l2"), 10).join(share, "qid").select("qid", "recall", F.round("share", 6).alias("share_read"))


#: Rows whose exact distance is taken after a search on codes.
SURVIVORS = 200


@query("v8_pq_recall")
def pq_recall(spark, d):
    store = vectors(spark, d)
    books = vector.Codebooks(vector.fit_sample(store), parts=8, codes=256)
    return vector.recall(vector.coded_top(vector_queries(spark, d), store, books, rerank=SURVIVORS), vector.exact_top(vector_queries(spark, d), store, metric="l2"), 10)


@query("v9_rq_recall")
def rq_recall(spark, d):
    store = vectors(spark, d)
    books = vector.Codebooks(vector.fit_sample(store), parts=4, codes=64, layers=4)
    return vector.recall(vector.coded_top(vector_queries(spark, d), store, books, rerank=SURVIVORS), vector.exact_top(vector_queries(spark, d), store, metric="l2"), 10)


def _cut(df, dims=32):
    return df.withColumn("embedding", F.slice("embedding", 1, dims))


@query("v10_truncated_pq")
def truncated_pq(spark, d):
    """First dimensions, product codes of them, exact distance of the survivors; recall against the cut vectors."""
    q, store = _cut(vector_queries(spark, d)), _cut(vectors(spark, d))
    books = vector.Codebooks(vector.fit_sample(store), parts=8, codes=256)
    return vector.recall(vector.coded_top(q, store, books, rerank=SURVIVORS), vector.exact_top(q, store, metric="l2"), 10)


@query("v10_truncated_rq")
def truncated_rq(spark, d):
    q, store = _cut(vector_queries(spark, d)), _cut(vectors(spark, d))
    books = vector.Codebooks(vector.fit_sample(store), parts=4, codes=64, layers=4)
    return vector.recall(vector.coded_top(q, store, books, rerank=SURVIVORS), vector.exact_top(q, store, metric="l2"), 10)


@query("v3_index_recall")
def index_recall(spark, d):
    """Recall at ten of the residual-code index against the flat inner product (vectors of unit length)."""
    q, store = vector_queries(spark, d), vectors(spark, d)
    books = vector.Codebooks(vector.fit_sample(store), parts=4, codes=64, layers=4)
    return vector.recall(vector.coded_top(q, store, books, rerank=SURVIVORS), vector.exact_top(q, store, metric="ip"), 10)


@query(
    "v10_truncated_top10",
    f"""WITH {VQ}, s AS (SELECT qid, vec_id, round(-list_distance({_D64('q[1:32]')}, {_D64('e.embedding[1:32]')}), 6) AS score FROM vq, embeddings e)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
)
def truncated_top10(spark, d):
    cut = lambda df: df.withColumn("embedding", F.slice("embedding", 1, 32))
    return vector.exact_top(cut(vector_queries(spark, d)), cut(vectors(spark, d)), metric="l2")


@query(
    "v12_tiered_top10",
    f"""WITH {VQ}, s AS (SELECT qid, vec_id, label < 2 AS hot, round(-list_distance({_D64('q')}, {_D64('e.embedding')}), 6) AS score FROM vq, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, hot ORDER BY score DESC, vec_id) AS tier_rank FROM s),
c AS (SELECT qid, vec_id, score, tier_rank, CASE WHEN hot THEN 1 ELSE 2 END AS tier FROM r WHERE (hot AND tier_rank <= 5) OR (NOT hot AND tier_rank <= 10))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, tier_rank) AS rank FROM c) WHERE rank <= 10""",
)
def tiered_top10(spark, d):
    q, store = vector_queries(spark, d), vectors(spark, d)
    return vector.tiered(vector.exact_top(q, store.filter("label < 2"), 5, "l2"), vector.exact_top(q, store.filter("not label < 2"), 10, "l2"), 10)


@query(
    "v14_cache_lookup",
    f"""WITH {VQ}, s AS (SELECT qid, vec_id, round(list_cosine_similarity({_D64('q')}, {_D64('e.embedding')}), 6) AS score FROM vq, embeddings e WHERE e.vec_id <> qid),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT qid, vec_id AS cached_id, score, score >= 0.9 AS hit FROM b WHERE rank = 1 AND score > 0""",
)
def cache_lookup(spark, d):
    best = vector.exact_top(vector_queries(spark, d), vectors(spark, d), 2).filter("vec_id <> qid")
    best = lexical.rank_within(best.drop("rank"), "qid", [F.desc("score"), F.col("vec_id")], 1)
    return best.filter("score > 0").select("qid", F.col("vec_id").alias("cached_id"), "score", (F.col("score") >= 0.9).alias("hit"))


@query(
    "c8_unit_vectors",
    """WITH f AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda v: v :: DOUBLE * v :: DOUBLE))) AS norm, embedding FROM embeddings)
SELECT vec_id, round(norm, 6) AS norm, round(CASE WHEN norm = 0 THEN 0 ELSE embedding[1] :: DOUBLE / norm END, 6) AS first_unit FROM f""",
)
def unit_vectors(spark, d):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return vectors(spark, d).select("vec_id", norm.alias("n"), "embedding").select("vec_id", F.round("n", 6).alias("norm"), F.round(F.col("embedding")[0].cast("double") / F.when(F.col("n") == 0, 1.0).otherwise(F.col("n")), 6).alias("first_unit"))
