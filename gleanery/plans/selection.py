"""Filters on web-like results, path rules, choices of documents and merges of their grades."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import sqltext as S
from gleanery.functions import text as T
from gleanery.operators import fusion, ingest, judge, lexical, vector
from gleanery.plans.judging import G1, _hits
from gleanery.plans.registry import query
from gleanery.plans.retrieval import _D64, BM, SP, VQ, _rrf_sql, _two_lists, documents, text_queries, vector_queries, vectors
from gleanery.runtime import cut_lineage, table

# --- web-like results ------------------------------------------------------------------------------

#: Titles and hosts that are no content.
JUNK_TITLES = r"contact\s*us|microsoft\s*support|cards?\s*chat|merriam[- ]webster|dictionary\.com|login|sign\s*in|cookie|privacy\s*policy"
JUNK_HOSTS = ("support.microsoft.com", "login.microsoftonline.com", "www.merriam-webster.com", "www.cardschat.com", "dictionary.cambridge.org")

#: Documents as results of a search: their source as engine and host, every seventh from a made-up engine.
_WEB = """wb AS (SELECT doc_id, coalesce(title, '') AS title, coalesce(text, '') AS body, CASE WHEN doc_id % 7 = 0 THEN 'mock' ELSE source END AS engine,
CASE WHEN doc_id % 11 = 0 THEN 'mock://' || source WHEN doc_id % 13 = 0 THEN 'https://support.microsoft.com/x' ELSE 'https://www.' || replace(coalesce(source, 'none'), '_', '-') || '.org/' || doc_id END AS url, published_at FROM documents)"""


def web_results(spark, d):
    url = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("mock://"), "source")).when(F.col("doc_id") % 13 == 0, "https://support.microsoft.com/x")
    url = url.otherwise(F.concat(F.lit("https://www."), F.replace(F.coalesce("source", F.lit("none")), F.lit("_"), F.lit("-")), F.lit(".org/"), F.col("doc_id").cast("string")))
    engine = F.when(F.col("doc_id") % 7 == 0, "mock").otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("body"), engine.alias("engine"), url.alias("url"), "published_at")


@query("f4_real_results", f"WITH {_WEB} SELECT doc_id, url FROM wb WHERE coalesce(engine, '') <> 'mock' AND NOT starts_with(url, 'mock://')")
def real_results(spark, d):
    return web_results(spark, d).filter((F.coalesce("engine", F.lit("")) != "mock") & ~F.col("url").startswith("mock://")).select("doc_id", "url")


@query(
    "f5_without_junk",
    f"""WITH {_WEB}, h AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/]*)', 1)), '^www\\.', '') AS host FROM wb)
SELECT doc_id, host FROM h WHERE NOT regexp_matches(title, '(?i){JUNK_TITLES}') AND host NOT IN ({', '.join(f"'{x}'" for x in JUNK_HOSTS)}) AND NOT (length({S.strip('body')}) < 8 AND length({S.strip('title')}) < 4)""",
)
def without_junk(spark, d):
    """Without service pages: by title, by host, and what has neither body nor title."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)), r"^www\.", "")
    junk = F.col("title").rlike("(?i)" + JUNK_TITLES) | F.col("host").isin(*JUNK_HOSTS) | ((F.length(T.strip("body")) < 8) & (F.length(T.strip("title")) < 4))
    return web_results(spark, d).withColumn("host", host).filter(~junk).select("doc_id", "host")


@query(
    "f6_same_day",
    """WITH p AS (SELECT doc_id, published_at, CAST(published_at + INTERVAL 8 HOUR AS DATE) AS day FROM documents), t AS (SELECT max(day) AS today FROM p)
SELECT doc_id, CASE WHEN day IS NULL THEN 'unknown' ELSE 'today' END AS date_status, row_number() OVER (ORDER BY published_at DESC NULLS LAST, doc_id) :: BIGINT AS place FROM p, t WHERE day IS NULL OR day = today""",
)
def same_day(spark, d):
    """Results of the newest calendar day at UTC+8, newest first, and undated ones after them."""
    local = F.to_date(F.col("published_at") + F.expr("INTERVAL 8 HOURS"))
    rows = table(spark, d, "documents").select("doc_id", "published_at", local.alias("day"))
    today = rows.agg(F.max("day").alias("today"))
    kept = rows.join(F.broadcast(today), F.col("day").isNull() | (F.col("day") == F.col("today")))  # one row
    # One day's results: a report that is shown whole.
    kept = kept.withColumn("all", F.lit(0))
    return lexical.rank_within(kept, "all", [F.desc_nulls_last("published_at"), F.col("doc_id")], None, "place").select("doc_id", F.when(F.col("day").isNull(), "unknown").otherwise("today").alias("date_status"), "place")


@query("f11_allowed_paths", "WITH p AS (SELECT DISTINCT source FROM chunks WHERE source IS NOT NULL) SELECT source FROM p WHERE (starts_with(source, 'guides/') OR starts_with(source, 'notes/')) AND NOT contains(source, '..')")
def allowed_paths(spark, d):
    """Paths below an allowed root; a path that climbs out of it is not."""
    under = F.lit(False)
    for root in ("guides/", "notes/"):
        under = under | F.col("source").startswith(root)
    return table(spark, d, "chunks").select("source").filter(under & ~F.contains("source", F.lit(".."))).distinct()


@query("f13_agent_tasks", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND (user_id = 8 OR CAST(props ->> '$.k' AS INTEGER) = 8)")
def agent_tasks(spark, d):
    """Tasks an agent gave or got (user and the partner named in the properties), in one state."""
    partner = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").filter((F.col("event_type") == "error") & ((F.col("user_id") == 8) | (partner == 8))).select("event_id", "user_id", "event_type")


@query(
    "s11_feed_items",
    """SELECT doc_id, coalesce(title, '') AS title, strftime(published_at, '%Y-%m-%d') AS day FROM documents WHERE published_at IS NOT NULL AND NOT regexp_matches(coalesce(title, ''), '[\\x00-\\x1f]')""",
)
def feed_items(spark, d):
    """Items of an RSS feed: written as XML per source, read back with an XML schema."""
    rows = table(spark, d, "documents").filter(F.col("published_at").isNotNull() & ~F.coalesce("title", F.lit("")).rlike(r"[\x00-\x1f]"))
    safe = F.coalesce("title", F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(raw), F.lit(entity))
    item = F.concat(F.lit("<item><title>|"), safe, F.lit("|</title><link>urn:"), F.col("doc_id").cast("string"), F.lit("</link><pubDate>"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), F.lit("</pubDate></item>"))
    feeds = rows.select(item.alias("xml"))
    parsed = feeds.select(F.from_xml("xml", "title string, link string, pubDate string").alias("i"))
    return parsed.select(F.substring("i.link", 5, 30).cast("long").alias("doc_id"), F.expr("substring(i.title, 2, length(i.title) - 2)").alias("title"), F.date_format(T.parse_when(F.col("i.pubDate")), "yyyy-MM-dd").alias("day"))


@query(
    "t10_parsed_dates",
    """SELECT doc_id, form, strftime(CASE WHEN form IN ('iso', 'plain', 'rfc') THEN date_trunc('second', published_at) ELSE date_trunc('day', published_at) END, '%Y-%m-%d %H:%M:%S') AS moment FROM documents, (VALUES ('iso'), ('plain'), ('rfc'), ('date'), ('inside')) t(form) WHERE published_at IS NOT NULL""",
)
def parsed_dates(spark, d):
    """One moment in five spellings, read back by the one parser."""
    p = F.col("published_at").cast("timestamp")
    forms = {
        "iso": F.date_format(p, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "plain": F.date_format(p, "yyyy-MM-dd HH:mm:ss"), "rfc": F.concat(F.date_format(p, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000")),
        "date": F.date_format(p, "yyyy/MM/dd"), "inside": F.concat(F.lit("发布于"), F.date_format(p, "yyyy年M月d"), F.lit("日的消息")),
    }
    spelt = table(spark, d, "documents").filter("published_at is not null").select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("said")) for k, v in forms.items()])).alias("f"))
    return spelt.select("doc_id", "f.form", F.date_format(T.parse_when(F.col("f.said")), "yyyy-MM-dd HH:mm:ss").alias("moment"))


# --- choices ---------------------------------------------------------------------------------------


@query(
    "o5_answer_documents",
    f"""WITH {G1}, r AS (SELECT g.qid, g.doc_id, rank, relevance_score, source = 'forum_archive' AS dialog FROM g JOIN documents d USING (doc_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY qid, dialog ORDER BY CASE WHEN dialog THEN 0 ELSE -relevance_score END, rank) AS n FROM r)
SELECT qid, doc_id, CASE WHEN dialog THEN 0 ELSE n END :: BIGINT AS place FROM t WHERE n <= CASE WHEN dialog THEN 1 ELSE 2 END""",
)
def answer_documents(spark, d):
    """One document of the dialog before all others, then the two most relevant ones."""
    ranks = _hits(spark, d).select("qid", "doc_id", "rank")
    sources = table(spark, d, "documents").select("doc_id", (F.coalesce("source", F.lit("")) == "forum_archive").alias("dialog"))
    rows = judge.graded(_hits(spark, d)).select("qid", "doc_id", "relevance_score").join(ranks, ["qid", "doc_id"]).join(sources, "doc_id")
    order = [F.when(F.col("dialog"), 0.0).otherwise(-F.col("relevance_score")), F.col("rank")]
    placed = rows.withColumn("n", F.row_number().over(Window.partitionBy("qid", "dialog").orderBy(*order)))
    return placed.filter(F.col("n") <= F.when(F.col("dialog"), 1).otherwise(2)).select("qid", "doc_id", F.when(F.col("dialog"), 0).otherwise(F.col("n")).cast("long").alias("place"))


@query(
    "j8_prior_first",
    f"""WITH {BM}, p AS (SELECT qid, (qid + 1) AS doc_id, 0 AS place FROM q WHERE qid + 1 IN (SELECT doc_id FROM documents)) SELECT * FROM p UNION ALL SELECT qid, doc_id, rank AS place FROM bm WHERE rank <= 5 AND NOT EXISTS (SELECT 1 FROM p WHERE p.qid = bm.qid AND p.doc_id = bm.doc_id)""",
)
def prior_first(spark, d):
    """The document the dialog stands on comes before the hits, as place 0, and only once."""
    prior = text_queries(spark, d).select("qid", (F.col("qid") + 1).alias("doc_id")).join(documents(spark, d).select("doc_id"), "doc_id", "left_semi").select("qid", "doc_id", F.lit(0).cast("long").alias("place"))
    hits = _hits(spark, d).select("qid", "doc_id", F.col("rank").alias("place"))
    return fusion.append_new(prior, hits, ["doc_id"])


@query(
    "j9_merged_grades",
    f"""WITH {BM}, h AS (SELECT qid, doc_id, rank FROM bm WHERE rank <= 5), m AS (SELECT qid, doc_id, rank, CASE WHEN rank % 2 = 1 THEN rank END AS said, row_number() OVER (PARTITION BY qid ORDER BY rank DESC) AS pos, CASE WHEN rank <= 2 THEN 'relevant' ELSE 'ambiguous' END AS grade FROM h)
SELECT h.qid, h.doc_id, coalesce(a.grade, b.grade, 'ambiguous') AS grade, a.grade IS NOT NULL AS by_index FROM h LEFT JOIN m a ON a.qid = h.qid AND a.said = h.rank LEFT JOIN m b ON b.qid = h.qid AND b.said IS NULL AND b.pos = h.rank""",
)
def merged_grades(spark, d):
    """Grades that name their document go to it; those that name none go by position; the rest is undecided."""
    hits = _hits(spark, d).select("qid", "doc_id", "rank")
    back = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rank"))).cast("long")
    grades = hits.select("qid", F.when(F.col("rank") % 2 == 1, F.col("rank")).alias("said"), back.alias("pos"), F.when(F.col("rank") <= 2, "relevant").otherwise("ambiguous").alias("grade"))
    named = grades.filter("said is not null").select("qid", F.col("said").alias("rank"), F.col("grade").alias("by_name"))
    placed = grades.filter("said is null").select("qid", F.col("pos").alias("rank"), F.col("grade").alias("by_place"))
    both = hits.join(named, ["qid", "rank"], "left").join(placed, ["qid", "rank"], "left")
    return both.select("qid", "doc_id", F.coalesce("by_name", "by_place", F.lit("ambiguous")).alias("grade"), F.col("by_name").isNotNull().alias("by_index"))


#: Characters all documents of a question may take together when they are cut from the start.
TRUNCATE_CHARS = 600


@query(
    "o7_truncated_context",
    f"""WITH {BM}, h AS (SELECT qid, doc_id, rank, coalesce(text, '') AS t FROM bm JOIN documents USING (doc_id) WHERE rank <= 5),
b AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT qid, doc_id, rank, least(length(t), {TRUNCATE_CHARS} - before) :: BIGINT AS n_chars, md5(substr(t, 1, ({TRUNCATE_CHARS} - before) :: BIGINT)) AS part_md5 FROM b WHERE before < {TRUNCATE_CHARS}""",
)
def truncated_context(spark, d):
    """Documents in order until the budget is used up, the last one cut: what is left when no sentence can be chosen."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = _hits(spark, d).select("qid", "doc_id", "rank", F.coalesce("text", F.lit("")).alias("t")).withColumn("before", F.coalesce(F.sum(F.length("t")).over(w), F.lit(0))).filter(F.col("before") < TRUNCATE_CHARS)
    room = F.lit(TRUNCATE_CHARS) - F.col("before")
    return rows.select("qid", "doc_id", "rank", F.least(F.length("t").cast("long"), room).alias("n_chars"), F.md5(F.substring(F.col("t"), F.lit(1), room.cast("int"))).alias("part_md5"))


#: A cache entry lives this many seconds after its last use, and a user has room for so many.
TTL_SECONDS, CAPACITY = 86_400, 5


@query(
    "o11_cache_entries",
    f"""WITH e AS (SELECT user_id, event_type || ':' || (props ->> '$.k') AS key, max(ts) AS used, count(*) AS n_uses FROM events GROUP BY ALL), t AS (SELECT max(ts) AS now FROM events),
a AS (SELECT e.* FROM e, t WHERE used >= now - INTERVAL {TTL_SECONDS} SECOND) SELECT user_id, key, n_uses, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY used DESC, key) :: BIGINT AS place FROM a) WHERE place <= {CAPACITY}""",
)
def cache_entries(spark, d):
    """What an LRU cache with time to live still holds: unexpired keys, the last used first, up to its capacity."""
    e = table(spark, d, "events")
    used = e.groupBy("user_id", F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")).alias("key")).agg(F.max("ts").alias("used"), F.count(F.lit(1)).alias("n_uses"))
    now = e.agg(F.max("ts").alias("now"))
    alive = used.join(F.broadcast(now), F.col("used") >= F.col("now") - F.expr(f"INTERVAL {TTL_SECONDS} SECONDS"))  # one row
    return lexical.rank_within(alive, "user_id", [F.desc("used"), F.col("key")], CAPACITY, "place").select("user_id", "key", "n_uses", "place")


# --- vectors and both ------------------------------------------------------------------------------


@query(
    "v15_similar_errors",
    f"""WITH {VQ}, s AS (SELECT qid, vec_id, round(list_cosine_similarity({_D64('q')}, {_D64('e.embedding')}), 4) AS score, round(list_cosine_similarity({_D64('q')}, {_D64('e.embedding')}), 6) AS fine FROM vq, embeddings e WHERE label = 1 AND vec_id <> qid)
SELECT qid, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fine DESC, vec_id) AS t FROM s) WHERE t <= 3 AND score > 0""",
)
def similar_errors(spark, d):
    """The three most similar entries of the book of errors (one label of the vectors), above zero."""
    book = vectors(spark, d).filter("label = 1")
    near = vector.exact_top(vector_queries(spark, d), book, 4).filter("vec_id <> qid")
    best = lexical.rank_within(near.drop("rank"), "qid", [F.desc("score"), F.col("vec_id")], 3)
    return best.select("qid", "vec_id", F.round("score", 4).alias("score")).filter("score > 0")


#: Each side of the dense and sparse search gets twice the wanted results.
_K = 10
_HYBRID = f"""WITH {BM}, dv AS (SELECT e.vec_id AS qid, x.vec_id AS doc_id, round(list_cosine_similarity({_D64('e.embedding')}, {_D64('x.embedding')}), 6) AS score FROM embeddings e, embeddings x WHERE e.vec_id IN (SELECT qid FROM q) AND x.vec_id IN (SELECT doc_id FROM documents)),
den AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM dv QUALIFY rank <= {2 * _K}),
lex AS (SELECT qid, doc_id, score, rank FROM bm WHERE rank <= {2 * _K}),
u AS (SELECT qid, doc_id, lex.rank AS lexical_rank, den.rank AS dense_rank, lex.score AS lexical_score, den.score AS dense_score FROM lex FULL JOIN den USING (qid, doc_id))"""


def dense_and_lexical(spark, d, k=2 * _K):
    """Both lists over one set of documents: text by BM25, and the vector of the same number by cosine."""
    q, docs = text_queries(spark, d), documents(spark, d)
    own = vectors(spark, d).select("vec_id", "embedding").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    asked = own.join(q.select(F.col("qid").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "qid")
    return cut_lineage(lexical.bm25(q, docs, k)), cut_lineage(vector.exact_top(asked, own, k).withColumnRenamed("vec_id", "doc_id"))


@query(
    "v16_hybrid_top10",
    _HYBRID + f", s AS (SELECT qid, doc_id, lexical_rank, dense_rank, round(coalesce(1.0 / (60 + lexical_rank), 0) + coalesce(1.0 / (60 + dense_rank), 0), 6) :: DOUBLE AS score FROM u) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {_K}",
)
def hybrid_top10(spark, d):
    lex, den = dense_and_lexical(spark, d)
    return fusion.plain_rrf(lex, den, _K)


@query(
    "j1_dense_lexical",
    _HYBRID + f", s AS (SELECT qid, doc_id, lexical_rank, dense_rank, coalesce(dense_score, lexical_score) AS payload_score, CASE WHEN dense_rank IS NULL THEN 'lexical' ELSE 'dense' END AS payload_from, round(coalesce(0.4 / (60 + lexical_rank), 0) + coalesce(0.6 / (60 + dense_rank), 0), 6) :: DOUBLE AS score FROM u) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {_K}",
)
def dense_lexical(spark, d):
    """Weighted fusion of a vector and a text list; where both have a document, the vector side's row is kept."""
    lex, den = dense_and_lexical(spark, d)
    fused = fusion.weighted_rrf(lex, den, _K)
    rows = fused.join(lex.select("qid", "doc_id", F.col("score").alias("lexical_score")), ["qid", "doc_id"], "left").join(den.select("qid", "doc_id", F.col("score").alias("dense_score")), ["qid", "doc_id"], "left")
    return rows.select("qid", "doc_id", "lexical_rank", "dense_rank", F.coalesce("dense_score", "lexical_score").alias("payload_score"), F.when(F.col("dense_rank").isNull(), "lexical").otherwise("dense").alias("payload_from"), "score", "rank")


@query(
    "j2_dense_lexical",
    _HYBRID + ", s AS (SELECT qid, doc_id, lexical_rank, dense_rank, coalesce(lexical_score, dense_score) AS payload_score, CASE WHEN lexical_rank IS NULL THEN 'dense' ELSE 'lexical' END AS payload_from, round(coalesce(1.0 / (60 + lexical_rank), 0) + coalesce(1.0 / (60 + dense_rank), 0), 6) :: DOUBLE AS score FROM u) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 15",
)
def dense_lexical_plain(spark, d):
    """Unweighted fusion of 20 and 20 to 15; where both have a document, the text side's row is kept."""
    lex, den = dense_and_lexical(spark, d, 20)
    fused = fusion.plain_rrf(lex, den, 15)
    rows = fused.join(lex.select("qid", "doc_id", F.col("score").alias("lexical_score")), ["qid", "doc_id"], "left").join(den.select("qid", "doc_id", F.col("score").alias("dense_score")), ["qid", "doc_id"], "left")
    return rows.select("qid", "doc_id", "lexical_rank", "dense_rank", F.coalesce("lexical_score", "dense_score").alias("payload_score"), F.when(F.col("lexical_rank").isNull(), "dense").otherwise("lexical").alias("payload_from"), "score", "rank")


_J1 = _rrf_sql(0.4, 0.6, 10)


@query("r23_similarities", f"SELECT qid, doc_id, round(CASE WHEN score < 0.5 THEN least(0.95, 0.55 + score * 20) ELSE score END, 6) AS similarity, CASE WHEN (CASE WHEN score < 0.5 THEN least(0.95, 0.55 + score * 20) ELSE score END) >= 0.7 THEN 'high' ELSE 'medium' END AS confidence FROM ({_J1})")
def similarities(spark, d):
    """Fusion scores on the scale of similarities, with a confidence."""
    s = F.col("score")
    mapped = F.when(s < 0.5, F.least(F.lit(0.95), 0.55 + s * 20)).otherwise(s)
    return fusion.weighted_rrf(*_two_lists(spark, d), 10).select("qid", "doc_id", F.round(mapped, 6).alias("similarity"), F.when(mapped >= 0.7, "high").otherwise("medium").alias("confidence"))


#: Weight of a path by its confidence.
PATH_WEIGHTS = {"high": 1.2, "medium": 1.0, "low": 0.8, "very_low": 0.6}


@query(
    "r25_best_paths",
    f"""WITH {BM}, {SP}, u AS (SELECT qid, 'lexical' AS path, 1 AS no, 1.0 :: DOUBLE / rank AS sim FROM bm WHERE rank <= 5 UNION ALL SELECT qid, 'sparse', 2, 1.0 :: DOUBLE / (rank + 1) FROM sp WHERE rank <= 8),
g AS (SELECT qid, path, no, avg(sim) AS m FROM u GROUP BY ALL), s AS (SELECT qid, path, no, round(m * CASE WHEN m >= 0.7 THEN 1.2 WHEN m >= 0.4 THEN 1.0 WHEN m >= 0.3 THEN 0.8 ELSE 0.6 END, 6) AS score FROM g)
SELECT qid, path, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, no) AS t FROM s) WHERE t = 1""",
)
def best_paths(spark, d):
    """Mean similarity of a path times the weight of its confidence; the first best path wins."""
    q, docs = text_queries(spark, d), documents(spark, d)
    a = lexical.bm25(q, docs, 5).select("qid", F.lit("lexical").alias("path"), F.lit(1).alias("no"), (1.0 / F.col("rank")).alias("sim"))
    b = lexical.sparse_top(q, docs, 8).select("qid", F.lit("sparse").alias("path"), F.lit(2).alias("no"), (1.0 / (F.col("rank") + 1)).alias("sim"))
    m = F.col("m")
    weight = F.when(m >= 0.7, PATH_WEIGHTS["high"]).when(m >= 0.4, PATH_WEIGHTS["medium"]).when(m >= 0.3, PATH_WEIGHTS["low"]).otherwise(PATH_WEIGHTS["very_low"])
    scores = a.unionByName(b).groupBy("qid", "path", "no").agg(F.avg("sim").alias("m")).select("qid", "path", "no", F.round(m * weight, 6).alias("score"))
    return lexical.rank_within(scores, "qid", [F.desc("score"), F.col("no")], 1, "t").select("qid", "path", "score")


#: Points of a file's kind and folder for the hot set.
HOT_TYPES = {"md": 10, "py": 8, "txt": 6, "json": 5, "yaml": 5, "yml": 5}
HOT_FOLDERS = {"guides": 10, "notes": 8, "imports": 7}


@query(
    "c10_hot_set",
    f"""WITH c AS (SELECT DISTINCT doc_id, source, ingested_at FROM chunks WHERE source IS NOT NULL), s AS (SELECT doc_id, source, CASE lower(regexp_extract(source, '\\.([A-Za-z0-9]+)$', 1)) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in HOT_TYPES.items())} ELSE 0 END
 + CASE {' '.join(f"WHEN contains(source, '{k}') THEN {v}" for k, v in HOT_FOLDERS.items())} ELSE 0 END + CASE WHEN contains(source, 'handbook') THEN 20 ELSE 0 END + CASE WHEN contains(source, '/agents/') THEN 10 ELSE 0 END AS score FROM c),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS total FROM s) SELECT doc_id, score :: INTEGER AS score FROM t WHERE place <= least(5000, total // 5) AND score > 0""",
)
def hot_set(spark, d):
    """Documents worth a fast store: points for kind, folder and role, the best fifth up to a fixed size."""
    rows = table(spark, d, "chunks").filter("source is not null").select("doc_id", "source", "ingested_at").distinct()
    kind = F.lower(F.regexp_extract("source", r"\.([A-Za-z0-9]+)$", 1))
    points = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in HOT_TYPES.items() for x in p]), kind), F.lit(0))
    folder = F.lit(None).cast("int")
    folder = F.coalesce(*[F.when(F.contains("source", F.lit(k)), F.lit(v)) for k, v in HOT_FOLDERS.items()], F.lit(0))
    score = points + folder + F.when(F.contains("source", F.lit("handbook")), 20).otherwise(0) + F.when(F.contains("source", F.lit("/agents/")), 10).otherwise(0)
    scored = rows.select("doc_id", score.cast("int").alias("score"))
    n = min(5000, scored.count() // 5)
    return scored.orderBy(F.desc("score"), "doc_id").limit(n).filter("score > 0")


@query("c5_typed_chunks")
def typed_chunks(spark, d):
    """800-character pieces with 200 shared, and the kind of the file they come from."""
    rows = table(spark, d, "kb_documents").filter("content is not null").select(F.monotonically_increasing_id().alias("doc_id"), "id", "source", F.col("content").alias("text"))
    held = cut_lineage(rows)
    pieces = ingest.recursive_chunks(held.select("doc_id", "text"), 800, 200, measure=len)
    return pieces.join(held.select("doc_id", "id", F.lower(F.regexp_extract("source", r"\.([A-Za-z0-9]+)$", 1)).alias("type")), "doc_id").select("id", "page", "type", "chunk")


@query("g5_cited_documents", f"WITH er AS (SELECT result_id, any_value(response) AS r FROM evaluation_results GROUP BY result_id), b AS (SELECT DISTINCT result_id, CAST(x AS INTEGER) AS page FROM (SELECT result_id, unnest(regexp_extract_all(r, '第\\s*(\\d+)\\s*块', 1)) AS x FROM er)), c AS (SELECT DISTINCT doc_id, source, page, content FROM chunks WHERE source = 'guides/merged_handbook.md' AND content IS NOT NULL) SELECT result_id, doc_id, source, page, md5(substr(content, 1, 200)) AS text_md5 FROM b JOIN c USING (page)")
def cited_documents(spark, d):
    """Blocks of the handbook an answer names, with source, number and excerpt: an equi-join on the number."""
    answers = table(spark, d, "evaluation_results").dropDuplicates(["result_id"])
    named = answers.select("result_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("response", F.lit(r"第\s*(\d+)\s*块"), 1), lambda x: x.try_cast("int")))).alias("page"))
    blocks = table(spark, d, "chunks").filter("source = 'guides/merged_handbook.md' and content is not null").select("doc_id", "source", "page", "content").distinct()
    return named.join(blocks, "page").select("result_id", "doc_id", "source", "page", F.md5(F.substring("content", 1, 200)).alias("text_md5"))


@query("v12_promotions", "WITH a AS (SELECT user_id, count(*) AS n_uses, max(ts) AS last_use FROM events GROUP BY user_id HAVING count(*) >= 3) SELECT user_id, n_uses, place FROM (SELECT *, row_number() OVER (ORDER BY last_use DESC, user_id) :: BIGINT AS place FROM a) WHERE place <= 100")
def promotions(spark, d):
    """What the hot tier holds: entries used three times and more, the last used first, up to its capacity."""
    used = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_uses"), F.max("ts").alias("last_use")).filter("n_uses >= 3")
    top = used.orderBy(F.desc("last_use"), "user_id").limit(100).withColumn("all", F.lit(0))
    return lexical.rank_within(top, "all", [F.desc("last_use"), F.col("user_id")], None, "place").select("user_id", "n_uses", "place")
