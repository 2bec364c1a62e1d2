"""Grading queries over retrieved documents and stored answers."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import sqltext as S
from gleanery.operators import judge, lexical
from gleanery.plans.registry import query
from gleanery.plans.retrieval import BM, documents, text_queries
from gleanery.runtime import cut_lineage, table


#: Hits that are broadcast with their questions (about 200 bytes each); more meet the texts by an exchange.
BROADCAST_HITS = 200_000


def _hits(spark, d, k=5, *more):
    """``doc_id, qid, rank, query, text`` and ``more`` columns of the document; the texts are read where they lie and not shuffled."""
    q, docs = text_queries(spark, d), documents(spark, d)
    # Callers read the hits more than once; these are k rows a question.
    top = cut_lineage(lexical.bm25(q, docs, k).select("qid", "doc_id", "rank").join(q, "qid"))
    return lexical.bounded_broadcast(top, BROADCAST_HITS).join(table(spark, d, "documents").select("doc_id", "text", *more), "doc_id")


G1 = f"""{BM}, gt AS (SELECT bm.qid, bm.doc_id, rank, {S.mixed_tokens('q.query')} AS a, {S.mixed_tokens('d.text')} AS b FROM bm JOIN q USING (qid) JOIN documents d ON d.doc_id = bm.doc_id WHERE rank <= 5),
gc AS (SELECT qid, doc_id, rank, len(list_intersect(a, b)) / greatest(len(a), 1) AS c FROM gt),
g AS (SELECT qid, doc_id, rank, round(c, 6) AS coverage, CASE WHEN c >= 0.3 THEN 'relevant' WHEN c >= 0.1 THEN 'ambiguous' ELSE 'irrelevant' END AS grade,
  CAST(round(CAST(CASE WHEN c >= 0.3 THEN least(1.0, 0.5 + c) WHEN c >= 0.1 THEN 0.3 + c ELSE c END :: DOUBLE AS DECIMAL(28, 9)), 3) AS DOUBLE) AS relevance_score FROM gc)"""


@query("g1_graded_hits", f"WITH {G1} SELECT qid, doc_id, coverage, grade, relevance_score FROM g")
def graded_hits(spark, d):
    return judge.graded(_hits(spark, d))


@query("r15_review_gate", f"WITH {G1} SELECT qid, coalesce(max(relevance_score), 0) AS best, coalesce(max(relevance_score), 0) < 0.5 AS needs_review FROM q LEFT JOIN g USING (qid) GROUP BY qid")
def review_gate(spark, d):
    best = judge.graded(_hits(spark, d)).groupBy("qid").agg(F.max("relevance_score").alias("best"))
    out = text_queries(spark, d).select("qid").join(best, "qid", "left").select("qid", F.coalesce("best", F.lit(0.0)).alias("best"))
    return out.withColumn("needs_review", F.col("best") < 0.5)


@query(
    "g9_retrieval_quality",
    f"""WITH {G1} SELECT qid, count(*) AS total, count(*) FILTER (grade = 'relevant') AS n_relevant, round(count(*) FILTER (grade = 'relevant') / count(*), 3) AS context_precision,
round(least(1.0, count(*) FILTER (grade = 'relevant') / 3), 3) AS context_recall FROM g GROUP BY qid""",
)
def retrieval_quality(spark, d):
    relevant = F.count(F.when(F.col("grade") == "relevant", 1))
    out = judge.graded(_hits(spark, d)).groupBy("qid").agg(F.count(F.lit(1)).alias("total"), relevant.alias("n_relevant"))
    return out.select("qid", "total", "n_relevant", F.round(F.col("n_relevant") / F.col("total"), 3).alias("context_precision"), F.round(F.least(F.lit(1.0), F.col("n_relevant") / 3), 3).alias("context_recall"))


@query(
    "g2_support",
    f"""WITH {BM}, src AS (SELECT bm.qid AS aid, d.text FROM bm JOIN documents d ON d.doc_id = bm.doc_id WHERE rank <= 5 AND d.doc_id <> bm.qid),
ans AS (SELECT DISTINCT qid AS aid, d.text AS answer FROM q JOIN documents d ON d.doc_id = q.qid WHERE d.text IS NOT NULL),
sent AS (SELECT aid, row_number() OVER () AS n, s FROM (SELECT aid, unnest({S.sentences('answer', '。\\n.！？', 10)}) AS s FROM ans)),
tok AS (SELECT aid, n, unnest({S.mixed_tokens('s')}) AS token FROM sent),
known AS (SELECT DISTINCT aid, unnest({S.mixed_tokens('text')}) AS token FROM src WHERE text IS NOT NULL),
cov AS (SELECT tok.aid, n, avg(CASE WHEN known.token IS NULL THEN 0.0 ELSE 1.0 END) AS c FROM tok LEFT JOIN known ON known.aid = tok.aid AND known.token = tok.token GROUP BY ALL),
per AS (SELECT sent.aid, coalesce(c, 0) AS c FROM sent LEFT JOIN cov USING (aid, n)),
tot AS (SELECT aid, avg(c) AS m, count(*) FILTER (c < 0.2) AS bad FROM per GROUP BY aid)
SELECT aid, CAST(round(CAST(greatest(0, 1 - coalesce(m, 0)) :: DOUBLE AS DECIMAL(28, 9)), 3) AS DOUBLE) AS hallucination_score, CAST(round(CAST(greatest(0, 1 - coalesce(m, 0)) :: DOUBLE AS DECIMAL(28, 9)), 3) AS DOUBLE) < 0.3 AS passed, coalesce(bad, 0) AS n_unsupported FROM ans LEFT JOIN tot USING (aid)""",
)
def support(spark, d):
    hits = _hits(spark, d).filter("doc_id <> qid").select(F.col("qid").alias("aid"), "text")
    answers = documents(spark, d).filter("doc_id % 100 = 0 and text is not null").select(F.col("doc_id").alias("aid"), F.col("text").alias("answer"))
    return judge.support(answers, hits)


@query(
    "g3_number_conflicts",
    f"""WITH {BM}, r AS (SELECT bm.qid, rank AS ord, d.source, d.text FROM bm JOIN documents d ON d.doc_id = bm.doc_id WHERE rank <= 5),
m AS (SELECT qid, ord, source, regexp_extract_all(text, '([\\x{{4e00}}-\\x{{9fff}}]+)\\s*[:：]?\\s*(\\d+\\.?\\d*)\\s*%?', 1) AS t, regexp_extract_all(text, '([\\x{{4e00}}-\\x{{9fff}}]+)\\s*[:：]?\\s*(\\d+\\.?\\d*)\\s*%?', 2) AS v FROM r),
c AS (SELECT qid, ord, source, unnest(range(len(t))) AS pos, unnest(t) AS topic, unnest(v) AS value FROM m),
g AS (SELECT qid, topic, count(DISTINCT value) AS n_values, count(DISTINCT source) AS n_sources, min(ord * 1000000 + pos) AS first FROM c GROUP BY ALL)
SELECT * EXCLUDE (first) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first) AS place FROM g WHERE n_values > 1 AND n_sources > 1) WHERE place <= 3""",
)
def number_conflicts(spark, d):
    return judge.number_conflicts(_hits(spark, d, 5, "source").select("qid", F.col("rank").alias("ord"), "source", "text"))


RESULTS = "er AS (SELECT result_id, any_value(model) AS model, any_value(query) AS query, any_value(response) AS response, any_value(latency) AS latency, any_value(success) AS success, any_value(scores) AS scores, any_value(evaluated_at) AS evaluated_at FROM evaluation_results GROUP BY result_id)"


def results(spark, d):
    return table(spark, d, "evaluation_results").dropDuplicates(["result_id"])


#: Words that mark a sentence as a transition.
TRANSITIONS = ("综上", "总之", "因此", "所以", "总结", "总的来说", "需要注意的是", "值得注意", "简而言之", "换言之", "In summary", "Therefore", "Thus", "Hence")


@query(
    "g4_citations",
    f"""WITH {RESULTS}, p AS (SELECT result_id AS aid, {S.sentences('response', '。！？\\n.', 10)} AS s FROM er WHERE response IS NOT NULL),
n AS (SELECT aid, len(list_filter(s, lambda x: regexp_matches(x, '\\[\\d+\\]'))) :: INTEGER AS n_cited,
 len(list_filter(s, lambda x: NOT regexp_matches(x, '\\[\\d+\\]') AND NOT regexp_matches(x, '{'|'.join(TRANSITIONS)}') AND NOT starts_with(x, '#') AND NOT starts_with(x, '---'))) :: INTEGER AS n_orphan,
 list_distinct(flatten(list_transform(s, lambda x: list_transform(regexp_extract_all(x, '\\[(\\d+)\\]', 1), lambda r: TRY_CAST(r AS INTEGER))))) AS refs FROM p)
SELECT aid, n_cited, n_orphan, len(list_filter(refs, lambda r: r BETWEEN 1 AND 5)) :: INTEGER AS n_valid, len(list_filter(refs, lambda r: NOT r BETWEEN 1 AND 5)) :: INTEGER AS n_invalid,
 CASE WHEN n_cited + n_orphan > 0 THEN round(n_cited / (n_cited + n_orphan), 2) ELSE 0.0 END AS citation_rate FROM n""",
)
def citation_check(spark, d):
    answers = results(spark, d).filter("response is not null").select(F.col("result_id").alias("aid"), F.col("response").alias("answer"))
    return judge.citations(answers, 5, TRANSITIONS)


_TERMS = lambda c: f"list_distinct(regexp_extract_all({c}, '[\\x{{4e00}}-\\x{{9fa5}}]{{2,4}}'))"
_NUMS = lambda c: f"list_filter(list_distinct(regexp_extract_all({c}, '\\d+\\.?\\d*')), lambda n: NOT list_contains({S.values(judge.PLAIN_NUMBERS)}, n))"
_NAMES = lambda c: f"list_filter(list_distinct(regexp_extract_all({c}, '\\b([A-Z][a-z]{{1,}}(?:\\s[A-Z][a-z]+)*)\\b', 1)), lambda n: NOT list_contains({S.values(judge.NO_ENTITIES)}, n))"
_LESS = lambda x, y: f"len(list_filter({x}, lambda v: NOT list_contains({y}, v)))"


@query(
    "g6_answer_conflicts",
    f"""WITH {RESULTS}, w AS (SELECT result_id AS pid, response AS b, lag(response) OVER (PARTITION BY query ORDER BY evaluated_at, result_id) AS a FROM er WHERE response IS NOT NULL AND query IS NOT NULL),
x AS (SELECT pid, a, b, {_NUMS('a')} AS na, {_NUMS('b')} AS nb, {_NAMES('a')} AS ea, {_NAMES('b')} AS eb, {_TERMS('a')} AS ta, {_TERMS('b')} AS tb,
 regexp_matches(a, '{'|'.join(judge.NEGATIVE)}') AS ga, regexp_matches(b, '{'|'.join(judge.NEGATIVE)}') AS gb, regexp_matches(a, '{'|'.join(judge.POSITIVE)}') AS pa, regexp_matches(b, '{'|'.join(judge.POSITIVE)}') AS pb FROM w WHERE a IS NOT NULL),
y AS (SELECT pid, len(na) > 0 AND len(nb) > 0 AND {_LESS('na', 'nb')} + {_LESS('nb', 'na')} >= 2 AS numbers_differ, greatest(length(a), length(b)) / greatest(least(length(a), length(b)), 1) > 3 AS lengths_differ,
 ((ga AND pb) OR (pa AND gb)) AND ga <> gb AS polarity_differs, len(ea) > 0 AND len(eb) > 0 AND {_LESS('ea', 'eb')} + {_LESS('eb', 'ea')} >= 2 AS entities_differ, {_LESS('ta', 'tb')} > 10 AND {_LESS('tb', 'ta')} > 10 AS terms_differ FROM x)
SELECT *, CASE WHEN numbers_differ OR lengths_differ OR polarity_differs OR entities_differ OR terms_differ THEN 'partial' ELSE 'agree' END AS verdict FROM y""",
)
def answer_conflicts(spark, d):
    """Each answer against the one before it to the same question."""
    rows = results(spark, d).filter("response is not null and query is not null")
    before = F.lag("response").over(Window.partitionBy("query").orderBy("evaluated_at", "result_id"))
    return judge.answer_conflicts(rows.select(F.col("result_id").alias("pid"), before.alias("a"), F.col("response").alias("b")).filter("a is not null"))


@query(
    "g7_votes",
    f"""WITH {RESULTS}, k AS (SELECT query AS gid, result_id AS ord, {S.strip('substr(response, 1, 100)')} AS o FROM er WHERE response IS NOT NULL AND query IS NOT NULL),
c AS (SELECT gid, o, count(*) AS n, min(ord) AS f FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY n DESC, f) AS t, sum(n) OVER (PARTITION BY gid) AS total FROM c)
SELECT gid, md5(o) AS winner_md5, n AS winning_votes, total :: BIGINT AS n_samples, round(n / total, 6) AS consistency FROM r WHERE t = 1""",
)
def votes(spark, d):
    rows = results(spark, d).filter("response is not null and query is not null")
    return judge.votes(rows.select(F.col("query").alias("gid"), F.col("result_id").alias("ord"), F.col("response").alias("answer")))


@query(
    "g5_cited_sources",
    f"""WITH {RESULTS} SELECT result_id, n FROM (SELECT result_id, unnest(list_distinct(regexp_extract_all(response, '第\\s*(\\d+)\\s*块|see block (\\d+)', 0))) AS n FROM er WHERE response IS NOT NULL)""",
)
def cited_blocks(spark, d):
    found = F.array_distinct(F.regexp_extract_all("response", F.lit(r"第\s*(\d+)\s*块|see block (\d+)"), 0))
    return results(spark, d).filter("response is not null").select("result_id", F.explode(found).alias("n"))
