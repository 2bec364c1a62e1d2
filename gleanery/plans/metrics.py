"""Quality and system metrics: answer metrics, intent matrices, batteries, budgets, caches, tasks."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import sqltext as S
from gleanery.functions import text as T
from gleanery.operators import judge, rules, vector
from gleanery.plans.evaluation import _SCORE_SQL, CASES, RELEVANCY_REFUSALS, RESULTS, _any, _sql_any, case_scores, cases
from gleanery.plans.judging import G1, _hits
from gleanery.plans.registry import query
from gleanery.plans.retrieval import _D64, VQ, documents, text_queries, vector_queries, vectors
from gleanery.plans.routing import REP, question_domains, rep
from gleanery.plans.routing import _DOMAIN_SQL
from gleanery.plans.telemetry import BENCH, bench, nearest_index
from gleanery.runtime import table

finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))


def results(spark, d):
    return table(spark, d, "evaluation_results").dropDuplicates(["result_id"])


# --- answers ---------------------------------------------------------------------------------------

#: Words that say nothing about support.
STOPS = ("的", "是", "在", "了", "和", "与", "或", "等", "有", "为", "以", "及")


@query(
    "a1_answer_metrics",
    f"""WITH {G1}, a AS (SELECT q.qid, coalesce(q.query, '') AS question, substr(coalesce(d.text, ''), 1, 200) AS answer FROM q JOIN documents d ON d.doc_id = q.qid),
ct AS (SELECT gt.qid, string_agg(coalesce(d.text, ''), ' ' ORDER BY rank) AS ctx FROM gt JOIN documents d USING (doc_id) GROUP BY gt.qid),
p AS (SELECT qid, round(count(*) FILTER (grade = 'relevant') / count(*), 3) AS context_precision FROM g GROUP BY qid),
w AS (SELECT a.qid, question, answer, ctx, {S.mixed_tokens('question')} AS qt, {S.mixed_tokens('answer')} AS ant, {S.mixed_tokens('ctx')} AS cxt,
 list_filter(list_distinct(regexp_split_to_array({S.strip('lower(answer)')}, '{S.SPACE}+')), lambda x: x <> '' AND NOT list_contains({S.values(STOPS)}, x)) AS aw, list_distinct(regexp_split_to_array({S.strip('lower(ctx)')}, '{S.SPACE}+')) AS cw FROM a JOIN ct ON ct.qid = a.qid),
o AS (SELECT *, len(list_intersect(qt, ant)) / greatest(len(qt), 1) AS o FROM w),
m AS (SELECT qid, CASE WHEN answer = '' OR question = '' THEN 0.0 WHEN {_sql_any('answer', RELEVANCY_REFUSALS)} THEN 0.25 WHEN len(qt) = 0 THEN 0.0 WHEN length({S.strip('answer')}) < 8 AND o < 0.1 THEN 0.0 WHEN o > 0 THEN round(least(1.0, o * 1.2) :: DOUBLE, 3) ELSE 0.0 END AS answer_relevancy,
 round(CASE WHEN len(ant) > 0 THEN len(list_intersect(ant, cxt)) / len(ant) ELSE 0.0 END, 3) AS context_recall, CASE WHEN answer = '' THEN 0.0 WHEN len(aw) = 0 THEN 0.5 ELSE round(len(list_intersect(aw, cw)) / len(aw), 3) END AS faithfulness FROM o)
SELECT m.qid, answer_relevancy, context_precision, context_recall, faithfulness, round((answer_relevancy + context_precision + context_recall + faithfulness) / 4, 3) AS overall FROM m JOIN p USING (qid)""",
)
def answer_metrics(spark, d):
    """Relevancy, precision, recall and faithfulness of an answer (a document's opening) against its five contexts."""
    hits = _hits(spark, d)
    precision = judge.graded(hits).groupBy("qid").agg(F.round(F.count(F.when(F.col("grade") == "relevant", 1)) / F.count(F.lit(1)), 3).alias("context_precision"))
    # Five texts of one question: a bounded group.
    contexts = hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias("ctx"))
    answers = text_queries(spark, d).join(documents(spark, d).withColumnRenamed("doc_id", "qid"), "qid").select("qid", F.coalesce("query", F.lit("")).alias("question"), F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("answer"))
    rows = answers.join(contexts, "qid").select("qid", "question", "answer", T.mixed_tokens("question").alias("qt"), T.mixed_tokens("answer").alias("at"), T.mixed_tokens("ctx").alias("ct"), "ctx")
    words = lambda c: F.array_distinct(F.split(T.strip(F.lower(c)), r"(?U)\s+"))
    aw = F.array_except(words("answer"), F.array(*map(F.lit, (*STOPS, ""))))
    rows = rows.withColumn("o", F.size(F.array_intersect("qt", "at")) / F.greatest(F.size("qt"), F.lit(1))).withColumn("aw", aw).withColumn("cw", words("ctx"))
    relevancy = F.when((F.col("answer") == "") | (F.col("question") == ""), 0.0).when(_any(F.col("answer"), RELEVANCY_REFUSALS), 0.25).when(F.size("qt") == 0, 0.0).when((F.length(T.strip("answer")) < 8) & (F.col("o") < 0.1), 0.0)
    relevancy = relevancy.when(F.col("o") > 0, F.round(F.least(F.lit(1.0), F.col("o") * 1.2), 3)).otherwise(0.0)
    recall = F.round(F.when(F.size("at") > 0, F.size(F.array_intersect("at", "ct")) / F.size("at")).otherwise(0.0), 3)
    faithful = F.when(F.col("answer") == "", 0.0).when(F.size("aw") == 0, 0.5).otherwise(F.round(F.size(F.array_intersect("aw", "cw")) / F.size("aw"), 3))
    out = rows.select("qid", relevancy.alias("answer_relevancy"), recall.alias("context_recall"), faithful.alias("faithfulness")).join(precision, "qid")
    parts = ("answer_relevancy", "context_precision", "context_recall", "faithfulness")
    return out.select("qid", *parts, F.round(sum((F.col(c) for c in parts[1:]), F.col(parts[0])) / 4, 3).alias("overall"))


@query(
    "a7_golden_scores",
    f"""WITH {CASES}, k AS (SELECT report_id, lower(answer) AS a, list_filter(coalesce(kws, []), lambda k: k IS NOT NULL) AS ks, list_distinct(list_filter(regexp_split_to_array({S.strip('lower(answer)')}, '{S.SPACE}+'), lambda w: w <> '')) AS aw, list_distinct(list_filter(regexp_split_to_array({S.strip("lower(coalesce(question, ''))")}, '{S.SPACE}+'), lambda w: w <> '')) AS ew FROM cs),
m AS (SELECT report_id, len(list_filter(ks, lambda k: contains(a, lower(k)))) / greatest(len(ks), 1) * 100.0 AS kw, len(list_intersect(aw, ew)) / greatest(len(ew), 1) * 100.0 AS ov, ((CASE WHEN contains(a, '[1]') THEN 1 ELSE 0 END) + (CASE WHEN contains(a, '[2]') THEN 1 ELSE 0 END)) / 2 * 100.0 AS ci FROM k)
SELECT report_id, round(kw, 1) AS keyword_coverage, round(ov, 1) AS answer_similarity, round(ci, 1) AS citation_match, round(least(10.0, (kw * 0.4 + ov * 0.4 + ci * 0.2) / 10), 4) AS score FROM m""",
)
def golden_scores(spark, d):
    """Keywords, words shared with the expected text (here the question) and citations, weighted 4 : 4 : 2."""
    words = lambda c: F.array_distinct(F.filter(F.split(T.strip(F.lower(c)), r"(?U)\s+"), lambda w: w != ""))
    a = F.lower("answer")
    ks = F.filter(F.coalesce("kws", F.array().cast("array<string>")), lambda k: k.isNotNull())
    kw = F.size(F.filter(ks, lambda k: F.contains(a, F.lower(k)))) / F.greatest(F.size(ks), F.lit(1)) * 100
    expected = words(F.coalesce("question", F.lit("")))
    ov = F.size(F.array_intersect(words(F.col("answer")), expected)) / F.greatest(F.size(expected), F.lit(1)) * 100
    ci = (F.contains(a, F.lit("[1]")).cast("int") + F.contains(a, F.lit("[2]")).cast("int")) / 2 * 100
    rows = cases(spark, d).select("report_id", kw.alias("kw"), ov.alias("ov"), ci.alias("ci"))
    score = F.least(F.lit(10.0), (F.col("kw") * 0.4 + F.col("ov") * 0.4 + F.col("ci") * 0.2) / 10)
    return rows.select("report_id", F.round("kw", 1).alias("keyword_coverage"), F.round("ov", 1).alias("answer_similarity"), F.round("ci", 1).alias("citation_match"), F.round(score, 4).alias("score"))


@query(
    "g9_pipeline_quality",
    f"""WITH {CASES}, k AS (SELECT report_id, answer, coalesce(h, 0) AS h, CASE WHEN len(kws) > 0 THEN len(list_filter(kws, lambda k: k IS NOT NULL AND k <> '' AND contains(lower(answer), lower(k)))) / len(kws) ELSE 0 END :: DOUBLE AS pr,
 len(list_distinct(regexp_extract_all(answer, '\\[(\\d+)\\]', 1))) AS nc FROM cs),
m AS (SELECT report_id, round(pr, 3) AS pr3, round(1 - h, 3) AS fa, round(least(1.0, nc / greatest(length(answer) / 200.0 :: DOUBLE, 1)) :: DOUBLE, 3) AS ci, CASE WHEN length(answer) > 500 THEN 1.0 WHEN length(answer) > 200 THEN 0.7 WHEN length(answer) > 50 THEN 0.4 ELSE 0.1 END :: DOUBLE AS co FROM k)
SELECT report_id, pr3 AS precision_, fa AS faithfulness, ci AS citation_density, co AS completeness, round(pr3 * 30 + fa * 40 + ci * 15 + co * 15, 4) AS overall FROM m""",
)
def pipeline_quality(spark, d):
    """Precision, faithfulness, citations per 200 characters and completeness by length, weighted 30 : 40 : 15 : 15."""
    n = F.length("answer")
    named = F.size(F.filter("kws", lambda k: k.isNotNull() & (k != "") & F.contains(F.lower("answer"), F.lower(k))))
    rows = cases(spark, d).select(
        "report_id",
        F.round(F.when(F.size("kws") > 0, named / F.size("kws")).otherwise(0.0), 3).alias("precision_"),
        F.round(1 - F.coalesce("hallucination_score", F.lit(0.0)), 3).alias("faithfulness"),
        F.round(F.least(F.lit(1.0), F.size(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), 1))) / F.greatest(n / 200, F.lit(1.0))), 3).alias("citation_density"),
        F.when(n > 500, 1.0).when(n > 200, 0.7).when(n > 50, 0.4).otherwise(0.1).alias("completeness"),
    )
    return rows.withColumn("overall", F.round(F.col("precision_") * 30 + F.col("faithfulness") * 40 + F.col("citation_density") * 15 + F.col("completeness") * 15, 4))


_CITES = ("[来源", "[1]", "[2]", "来源:", "参考")
_UNSURE = ("可能", "也许", "大概", "不确定", "我不确定", "没有相关信息")
_FORM = ("\n", "。", "：", "、")


@query(
    "a33_weighted_totals",
    f"""WITH {CASES}, k AS (SELECT report_id, answer, coalesce(latency_ms, 0) / 1000.0 :: DOUBLE AS sec, len(list_filter(coalesce(kws, []), lambda k: k IS NOT NULL AND contains(lower(answer), lower(k)))) / greatest(len(coalesce(kws, [])), 1) AS rate,
 list_filter(regexp_split_to_array({S.strip("replace(replace(coalesce(question, ''), '？', ''), '?', '')")}, '{S.SPACE}+'), lambda w: w <> '') AS qw, {' + '.join(f"(CASE WHEN contains(answer, '{w}') THEN 1 ELSE 0 END)" for w in _UNSURE)} AS doubt FROM cs),
s AS (SELECT report_id, answer = '' AS blank, round(least(10.0, rate * 10) :: DOUBLE, 1) AS accuracy, round((least(10.0, length(answer) / 100.0) * 0.5 + rate * 5) :: DOUBLE, 4) AS completeness, round(least(10.0, len(list_filter(qw, lambda w: contains(answer, w))) / greatest(len(qw), 1) * 10) :: DOUBLE, 1) AS relevance,
 CASE WHEN {_sql_any('answer', _CITES)} THEN 8.0 ELSE 4.0 END :: DOUBLE AS citation, least(10, doubt * 2) :: DOUBLE AS hallucination, CASE WHEN {_sql_any('answer', _FORM)} THEN 8.0 ELSE 5.0 END :: DOUBLE AS format_score, CASE WHEN length(answer) > 50 THEN 8.0 ELSE 6.0 END :: DOUBLE AS fluency, CASE WHEN sec < 2 THEN 10 WHEN sec < 5 THEN 8 WHEN sec < 10 THEN 6 ELSE 4 END :: DOUBLE AS time_score FROM k)
SELECT report_id, accuracy, completeness, relevance, time_score, round(CASE WHEN blank THEN time_score * 0.1 + 1.0 ELSE accuracy * 0.25 + completeness * 0.2 + relevance * 0.15 + citation * 0.1 + time_score * 0.1 + (10 - hallucination) * 0.1 + format_score * 0.05 + fluency * 0.05 END, 4) AS total FROM s""",
)
def weighted_totals(spark, d):
    """Eight scores with fixed weights; time in bands of 2, 5 and 10 seconds; an empty answer has time and no doubt only."""
    answer = F.col("answer")
    kws = F.coalesce("kws", F.array().cast("array<string>"))
    rate = F.size(F.filter(kws, lambda k: k.isNotNull() & F.contains(F.lower(answer), F.lower(k)))) / F.greatest(F.size(kws), F.lit(1))
    asked = F.filter(F.split(T.strip(F.replace(F.replace(F.coalesce("question", F.lit("")), F.lit("？"), F.lit("")), F.lit("?"), F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    doubt = sum((F.contains(answer, F.lit(w)).cast("int") for w in _UNSURE), F.lit(0))
    sec = F.coalesce("latency_ms", F.lit(0)) / 1000
    s = cases(spark, d).withColumn("rate", rate).select(
        "report_id", (answer == "").alias("blank"),
        F.round(F.least(F.lit(10.0), F.col("rate") * 10), 1).alias("accuracy"),
        F.round(F.least(F.lit(10.0), F.length(answer) / 100) * 0.5 + F.col("rate") * 5, 4).alias("completeness"),
        F.round(F.least(F.lit(10.0), F.size(F.filter(asked, lambda w: F.contains(answer, w))) / F.greatest(F.size(asked), F.lit(1)) * 10), 1).alias("relevance"),
        F.when(_any(answer, _CITES), 8.0).otherwise(4.0).alias("citation"), F.least(F.lit(10), doubt * 2).cast("double").alias("hallucination"),
        F.when(_any(answer, _FORM), 8.0).otherwise(5.0).alias("format_score"), F.when(F.length(answer) > 50, 8.0).otherwise(6.0).alias("fluency"),
        F.when(sec < 2, 10.0).when(sec < 5, 8.0).when(sec < 10, 6.0).otherwise(4.0).alias("time_score"),
    )
    c = F.col
    total = c("accuracy") * 0.25 + c("completeness") * 0.2 + c("relevance") * 0.15 + c("citation") * 0.1 + c("time_score") * 0.1 + (10 - c("hallucination")) * 0.1 + c("format_score") * 0.05 + c("fluency") * 0.05
    return s.select("report_id", "accuracy", "completeness", "relevance", "time_score", F.round(F.when(c("blank"), c("time_score") * 0.1 + 1.0).otherwise(total), 4).alias("total"))


_TECH = ("RAG", "LLM", "向量", "检索", "生成", "模型", "数据库", "API", "Agent", "框架")
_SHAPES = ("1.", "2.", "：", "、", "\n")
_POINTS = ("结果", "原因", "影响", "because", "result")


@query(
    "a34_response_scores",
    f"""WITH {RESULTS}, x AS (SELECT result_id, coalesce(response, '') AS r, list_distinct(list_filter(regexp_split_to_array({S.strip("replace(replace(replace(coalesce(query, ''), '？', ''), '什么', ''), '如何', '')")}, '{S.SPACE}+'), lambda w: w <> '')) AS qw FROM er),
s AS (SELECT result_id, r, ({' + '.join(f"(CASE WHEN contains(lower(r), '{p}') THEN 1 ELSE 0 END)" for p in _POINTS)}) / {len(_POINTS)} * 10.0 :: DOUBLE AS accuracy, CASE WHEN length(r) BETWEEN 50 AND 500 THEN 10.0 WHEN length(r) < 50 THEN greatest(1.0, length(r) / 50.0 :: DOUBLE * 10) ELSE greatest(6.0, 10 - (length(r) - 500) / 100.0 :: DOUBLE) END :: DOUBLE AS completeness,
 least(10.0, len(list_filter(qw, lambda w: length(w) > 1 AND contains(r, w))) / greatest(len(qw), 1) * 15.0) :: DOUBLE AS relevance, least(10, 2 * ({' + '.join(f"(CASE WHEN contains(r, '{w}') THEN 1 ELSE 0 END)" for w in _TECH)})) :: DOUBLE AS professionalism, CASE WHEN {_sql_any('r', _SHAPES)} THEN 8.0 ELSE 5.0 END :: DOUBLE AS readability FROM x),
t AS (SELECT result_id, CASE WHEN r = '' THEN 0.0 ELSE round(accuracy * 0.35 + completeness * 0.2 + relevance * 0.2 + professionalism * 0.15 + readability * 0.1, 4) END AS total FROM s)
SELECT result_id, total, CASE WHEN total >= 9 THEN 'A' WHEN total >= 8 THEN 'B' WHEN total >= 6 THEN 'C' WHEN total >= 4 THEN 'D' ELSE 'F' END AS letter FROM t""",
)
def response_scores(spark, d):
    """Key points, length, question words, terms and form of a response, weighted, with a letter."""
    r = F.col("r")
    asked = F.replace(F.replace(F.replace(F.coalesce("query", F.lit("")), F.lit("？"), F.lit("")), F.lit("什么"), F.lit("")), F.lit("如何"), F.lit(""))
    rows = results(spark, d).select("result_id", F.coalesce("response", F.lit("")).alias("r"), F.array_distinct(F.filter(F.split(T.strip(asked), r"(?U)\s+"), lambda w: w != "")).alias("qw"))
    n = F.length(r)
    accuracy = sum((F.contains(F.lower(r), F.lit(p)).cast("int") for p in _POINTS), F.lit(0)) / len(_POINTS) * 10
    completeness = F.when(n.between(50, 500), 10.0).when(n < 50, F.greatest(F.lit(1.0), n / 50 * 10)).otherwise(F.greatest(F.lit(6.0), 10 - (n - 500) / 100))
    relevance = F.least(F.lit(10.0), F.size(F.filter("qw", lambda w: (F.length(w) > 1) & F.contains(r, w))) / F.greatest(F.size("qw"), F.lit(1)) * 15)
    tech = F.least(F.lit(10), sum((F.contains(r, F.lit(w)).cast("int") for w in _TECH), F.lit(0)) * 2)
    total = accuracy * 0.35 + completeness * 0.2 + relevance * 0.2 + tech * 0.15 + F.when(_any(r, _SHAPES), 8.0).otherwise(5.0) * 0.1
    scored = rows.select("result_id", F.when(r == "", 0.0).otherwise(F.round(total, 4)).alias("total"))
    t = F.col("total")
    return scored.withColumn("letter", F.when(t >= 9, "A").when(t >= 8, "B").when(t >= 6, "C").when(t >= 4, "D").otherwise("F"))


#: Weights of the five dimensions.
FIVE = {"accuracy": 0.30, "relevance": 0.20, "completeness": 0.20, "professionalism": 0.15, "readability": 0.15}
_FIVE_SQL = " + ".join(f"scores.{k} * 10 * {v}" for k, v in FIVE.items())


@query("a25_weighted_grades", f"WITH {RESULTS}, t AS (SELECT model, round({_FIVE_SQL}, 4) AS total FROM er), g AS (SELECT model, CASE WHEN total IS NULL THEN 'none' WHEN total >= 90 THEN 'excellent' WHEN total >= 80 THEN 'good' WHEN total >= 60 THEN 'passing' WHEN total >= 40 THEN 'failing' ELSE 'poor' END AS grade FROM t) SELECT model, grade, count(*) AS n FROM g GROUP BY ALL")
def weighted_grades(spark, d):
    """Distribution of the five-dimension grade per model; a score with a missing dimension has none."""
    total = F.round(sum((F.col(f"scores.{k}") * 10 * v for k, v in FIVE.items()), F.lit(0.0)), 4)
    t = F.col("total")
    grade = F.when(t.isNull(), "none").when(t >= 90, "excellent").when(t >= 80, "good").when(t >= 60, "passing").when(t >= 40, "failing").otherwise("poor")
    return results(spark, d).select("model", total.alias("total")).groupBy("model", grade.alias("grade")).agg(F.count(F.lit(1)).alias("n"))


@query("a9_category_medians", f"{_SCORE_SQL} SELECT category, count(*) AS n, round(median(total_raw), 4) AS median_score, round(quantile_cont(total_raw, 0.9), 4) AS p90_score, round(avg(CASE WHEN refuse THEN 1.0 ELSE 0.0 END), 4) AS refusal_rate FROM t GROUP BY category")
def category_medians(spark, d):
    p = lambda x: F.round(F.percentile("total_raw", F.lit(x)), 4)
    return case_scores(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), p(0.5).alias("median_score"), p(0.9).alias("p90_score"), F.round(F.avg(F.when(F.col("refuse"), 1.0).otherwise(0.0)), 4).alias("refusal_rate"))


@query("a9_difficulty_counts", "SELECT category, difficulty, source_type, grouping(category, difficulty, source_type) :: BIGINT AS level, count(*) AS n, count(passage) AS n_with_passage FROM qa_set GROUP BY CUBE (category, difficulty, source_type)")
def difficulty_counts(spark, d):
    return table(spark, d, "qa_set").cube("category", "difficulty", "source_type").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.count("passage").alias("n_with_passage"))


@query(
    "a21_judge_batch",
    f"WITH {RESULTS}, lg AS (SELECT unnest(['accuracy', 'completeness', 'relevance']) AS dim, unnest([scores.accuracy, scores.completeness, scores.relevance]) AS v, {rules.question_type.sql('query')} AS category, CASE WHEN length(response) > 400 THEN 'hard' WHEN length(response) > 150 THEN 'medium' ELSE 'easy' END AS difficulty FROM er WHERE query IS NOT NULL AND response IS NOT NULL) SELECT category, difficulty, dim, round(avg(v), 4) AS mean, count(v) AS n FROM lg GROUP BY GROUPING SETS ((category, dim), (difficulty, dim), (dim))",
)
def judge_batch(spark, d):
    """Mean of each judged dimension over all, by kind of question and by difficulty (length of the answer)."""
    rows = results(spark, d).filter("query is not null and response is not null")
    pairs = F.array(*[F.struct(F.lit(x).alias("dim"), F.col(f"scores.{x}").alias("v")) for x in ("accuracy", "completeness", "relevance")])
    n = F.length("response")
    lg = rows.select(rules.question_type.column(F.col("query")).alias("category"), F.when(n > 400, "hard").when(n > 150, "medium").otherwise("easy").alias("difficulty"), F.explode(pairs).alias("p")).select("category", "difficulty", "p.dim", "p.v")
    return lg.groupingSets([[F.col("category"), F.col("dim")], [F.col("difficulty"), F.col("dim")], [F.col("dim")]], F.col("category"), F.col("difficulty"), F.col("dim")).agg(F.round(F.avg("v"), 4).alias("mean"), F.count("v").alias("n"))


# --- intents ---------------------------------------------------------------------------------------

_INTENTS = f"""{_DOMAIN_SQL}, it AS (SELECT e.id, coalesce(e.category, 'none') AS l1, coalesce(dm.domain, 'none') AS l1_said, round(coalesce(dm.score, 0) / (coalesce(dm.score, 0) + 2), 4) AS confidence, {rules.question_type.sql("coalesce(e.question, '')")} AS l2_said,
CASE WHEN e.allow_refuse THEN 'open_ended' ELSE 'reasoning' END AS l2, {rules.tool_route.sql("coalesce(e.question, '')")} AS route_said, CASE WHEN contains(coalesce(e.question, ''), '关系') THEN 'graph_search' ELSE 'vector_search' END AS route FROM e2e_set e LEFT JOIN dm ON dm.id = e.id AND place = 1)"""


def intents(spark, d):
    """Labels of the end-to-end questions beside what the rules say: domain, kind of question, route."""
    first = question_domains(spark, d).filter("place = 1").select("id", "domain", "score")
    e = table(spark, d, "e2e_set").withColumn("qu", F.coalesce("question", F.lit(""))).join(first, "id", "left")
    score = F.coalesce("score", F.lit(0))
    return e.select(
        "id", F.coalesce("category", F.lit("none")).alias("l1"), F.coalesce("domain", F.lit("none")).alias("l1_said"), F.round(score / (score + 2), 4).alias("confidence"), rules.question_type.column(F.col("qu")).alias("l2_said"),
        F.when(F.col("allow_refuse"), "open_ended").otherwise("reasoning").alias("l2"), rules.tool_route.column(F.col("qu")).alias("route_said"), F.when(F.contains("qu", F.lit("关系")), "graph_search").otherwise("vector_search").alias("route"),
    )


_LEVELS = "lv AS (SELECT id, unnest(['l1', 'l2', 'route']) AS level, unnest([l1, l2, route]) AS truth, unnest([l1_said, l2_said, route_said]) AS said, confidence FROM it)"


def _levels(spark, d):
    levels = F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias("truth"), F.col(f"{x}_said").alias("said")) for x in ("l1", "l2", "route")])
    return intents(spark, d).select("id", "confidence", F.explode(levels).alias("v")).select("id", "confidence", "v.level", "v.truth", "v.said")


@query("j11_intent_matches", f"WITH {_INTENTS} SELECT id, l1 = l1_said AS l1_right, l2 = l2_said AS l2_right, route = route_said AS route_right FROM it")
def intent_matches(spark, d):
    c = F.col
    return intents(spark, d).select("id", (c("l1") == c("l1_said")).alias("l1_right"), (c("l2") == c("l2_said")).alias("l2_right"), (c("route") == c("route_said")).alias("route_right"))


@query("a3_intent_confusion", f"WITH {_INTENTS}, {_LEVELS} SELECT level, truth, said, count(*) AS n FROM lv GROUP BY ALL")
def intent_confusion(spark, d):
    return _levels(spark, d).groupBy("level", "truth", "said").agg(F.count(F.lit(1)).alias("n"))


@query("a4_intent_accuracy", f"WITH {_INTENTS}, {_LEVELS} SELECT level, count(*) AS n, round(avg(CASE WHEN truth = said THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (confidence < 0.7) AS n_unsure, count(*) FILTER (truth <> said) AS n_wrong FROM lv GROUP BY level")
def intent_accuracy(spark, d):
    wrong = F.col("truth") != F.col("said")
    return _levels(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(~wrong, 1.0).otherwise(0.0)), 6).alias("accuracy"), F.count(F.when(F.col("confidence") < 0.7, 1)).alias("n_unsure"), F.count(F.when(wrong, 1)).alias("n_wrong"))


@query("a4_intent_errors", f"WITH {_INTENTS}, {_LEVELS} SELECT id, level, truth, said FROM lv WHERE truth <> said AND confidence < 0.7")
def intent_errors(spark, d):
    return _levels(spark, d).filter((F.col("truth") != F.col("said")) & (F.col("confidence") < 0.7)).select("id", "level", "truth", "said")


@query(
    "a18_decision_accuracy",
    f"""WITH {_INTENTS}, {BENCH}, x AS (SELECT 'routing' AS agent, CASE WHEN l1 <> 'none' THEN l1 = l1_said END AS right_, confidence FROM it UNION ALL SELECT model, success, CASE WHEN latency > 0 AND isfinite(latency) THEN 1 / (1 + latency) END FROM br)
SELECT agent, count(*) AS n, round(count(*) FILTER (right_) / count(*), 4) AS accuracy, round(avg(confidence), 4) AS mean_confidence FROM x GROUP BY ROLLUP (agent)""",
)
def decision_accuracy(spark, d):
    """Right decisions of the router and of each agent; unknown outcomes stay in the denominator."""
    routing = intents(spark, d).select(F.lit("routing").alias("agent"), F.when(F.col("l1") != "none", F.col("l1") == F.col("l1_said")).alias("right_"), "confidence")
    agents = bench(spark, d).select(F.col("model").alias("agent"), F.col("success").alias("right_"), F.when((F.col("latency") > 0) & finite("latency").isNotNull(), 1 / (1 + F.col("latency"))).alias("confidence"))
    return routing.unionByName(agents).rollup("agent").agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.when(F.col("right_"), 1)) / F.count(F.lit(1)), 4).alias("accuracy"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


# --- system ----------------------------------------------------------------------------------------


@query("a17_communication", f"WITH {BENCH} SELECT model AS agent, sum(input_tokens) :: BIGINT AS input_tokens, sum(output_tokens) :: BIGINT AS output_tokens, sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) :: BIGINT AS total_tokens, count(*) AS calls, count(*) FILTER (success) AS good_calls, round(avg(latency) FILTER (isfinite(latency)), 4) AS mean_latency FROM br GROUP BY ROLLUP (model)")
def communication(spark, d):
    both = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return bench(spark, d).withColumnRenamed("model", "agent").rollup("agent").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(both).alias("total_tokens"), F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("success"), 1)).alias("good_calls"), F.round(F.avg(finite("latency")), 4).alias("mean_latency"))


#: Tokens a model may use in all; a warning comes at four fifths.
TOKEN_BUDGET = 100_000


@query(
    "a14_budget_usage",
    f"""WITH {BENCH}, g AS (SELECT model, CAST(finished_at AS DATE) AS day, sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) :: BIGINT AS tokens FROM br GROUP BY ALL), u AS (SELECT *, sum(tokens) OVER (PARTITION BY model ORDER BY day NULLS FIRST) :: BIGINT AS used FROM g)
SELECT model, day, tokens, used, CASE WHEN used >= {TOKEN_BUDGET} THEN 'exceeded' WHEN used >= 0.8 * {TOKEN_BUDGET} THEN 'warning' ELSE 'ok' END AS state FROM u""",
)
def budget_usage(spark, d):
    """Tokens used up to each day against a budget; the running sum goes over days, not calls."""
    g = bench(spark, d).groupBy("model", F.to_date("finished_at").alias("day")).agg(F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"))
    used = F.sum("tokens").over(Window.partitionBy("model").orderBy("day"))
    return g.withColumn("used", used).withColumn("state", F.when(F.col("used") >= TOKEN_BUDGET, "exceeded").when(F.col("used") >= 0.8 * TOKEN_BUDGET, "warning").otherwise("ok"))


@query(
    "a15_provider_percentiles",
    f"""WITH {BENCH}, c AS (SELECT model, latency, success, row_number() OVER (PARTITION BY model, query ORDER BY finished_at, bench_id) > 1 AS cached FROM br JOIN (SELECT bench_id, any_value(query) AS query FROM benchmark_results GROUP BY bench_id) USING (bench_id)),
r AS (SELECT model, latency, row_number() OVER (PARTITION BY model ORDER BY latency) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM c WHERE success AND NOT cached AND isfinite(latency)),
p AS (SELECT model, min(latency) FILTER (i = floor(n * 0.5)) AS p50, min(latency) FILTER (i = floor(n * 0.95)) AS p95, min(latency) FILTER (i = floor(n * 0.99)) AS p99 FROM r GROUP BY model)
SELECT c.model, count(*) AS n, round(count(*) FILTER (cached) / count(*), 4) AS cache_rate, any_value(p50) AS p50, any_value(p95) AS p95, any_value(p99) AS p99 FROM c LEFT JOIN p ON p.model = c.model GROUP BY c.model""",
)
def provider_percentiles(spark, d):
    """A question a model has had before comes from its cache; percentiles are those of the other good calls."""
    turn = F.row_number().over(Window.partitionBy("model", "query").orderBy("finished_at", "bench_id"))
    rows = bench(spark, d).select("model", "latency", "success", (turn > 1).alias("cached"))
    ranks = nearest_index(rows.filter(F.col("success") & ~F.col("cached") & finite("latency").isNotNull()), "model", "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("n")
    rates = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.when(F.col("cached"), 1)) / F.count(F.lit(1)), 4).alias("cache_rate"))
    return rates.join(ranks, "model", "left")


@query("a16_agent_sums", f"WITH {BENCH} SELECT model AS agent, CAST(finished_at AS DATE) AS day, count(*) AS n, round(sum(latency) FILTER (latency BETWEEN 0 AND 3600), 3) AS busy_s, sum(output_tokens) :: BIGINT AS output_tokens FROM br GROUP BY ALL")
def agent_sums(spark, d):
    return bench(spark, d).groupBy(F.col("model").alias("agent"), F.to_date("finished_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(F.col("latency").between(0, 3600), F.col("latency"))), 3).alias("busy_s"), F.sum("output_tokens").alias("output_tokens"))


@query("a22_mode_counts", "SELECT event_type AS mode, count(*) AS n, count(*) FILTER (props ->> '$.k' IS NOT NULL) AS n_with_metrics, round(avg(value), 4) AS mean_value FROM events GROUP BY ROLLUP (event_type)")
def mode_counts(spark, d):
    return table(spark, d, "events").withColumnRenamed("event_type", "mode").rollup("mode").agg(F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("props", "$.k")).alias("n_with_metrics"), F.round(F.avg("value"), 4).alias("mean_value"))


@query(
    "a23_daily_warnings",
    f"""WITH {REP}, t AS (SELECT CAST(generated_at AS DATE) AS day, error, coalesce(ok, false) AS ok, row_number() OVER (PARTITION BY run_id, id ORDER BY generated_at, report_id) AS tries FROM rp)
SELECT day, round(avg(tries), 4) AS mean_tries, count(*) FILTER (ok AND error IS NOT NULL) AS n_warnings, count(DISTINCT {rules.error_class.sql('error')}) FILTER (ok AND error IS NOT NULL) AS n_warning_kinds FROM t GROUP BY day""",
)
def daily_warnings(spark, d):
    """Attempts per question and run, and errors that stood beside a sound answer."""
    tries = F.row_number().over(Window.partitionBy("run_id", "id").orderBy("generated_at", "report_id"))
    rows = rep(spark, d).select(F.to_date("generated_at").alias("day"), "error", F.coalesce("ok", F.lit(False)).alias("ok"), tries.alias("tries"))
    warned = F.col("ok") & F.col("error").isNotNull()
    return rows.groupBy("day").agg(F.round(F.avg("tries"), 4).alias("mean_tries"), F.count(F.when(warned, 1)).alias("n_warnings"), F.count_distinct(F.when(warned, rules.error_class.column(F.col("error")))).alias("n_warning_kinds"))


@query(
    "a26_retrieval_battery",
    f"""WITH {G1}, t AS (SELECT q.qid, max(coverage) FILTER (rank = 1) AS cov, max(doc_id) FILTER (rank = 1) AS top FROM q LEFT JOIN g USING (qid) GROUP BY q.qid),
x AS (SELECT t.*, a.collection AS asked, b.collection AS got FROM t LEFT JOIN documents a ON a.doc_id = t.qid LEFT JOIN documents b ON b.doc_id = t.top)
SELECT count(*) AS n, round(100.0 * count(cov) / count(*), 1) AS found_pct, round(avg(cov), 4) AS mean_coverage, round(100.0 * count(*) FILTER (asked = got) / count(*), 1) AS agreement_pct FROM x""",
)
def retrieval_battery(spark, d):
    """Questions with results, mean coverage of the best ones, and how often they lie in the asked collection."""
    hits = _hits(spark, d)
    top = judge.graded(hits).join(hits.select("qid", "doc_id", "rank"), ["qid", "doc_id"]).filter("rank = 1").select("qid", F.col("doc_id").alias("top"), F.col("coverage").alias("cov"))
    where = table(spark, d, "documents").select("doc_id", "collection")
    x = text_queries(spark, d).select("qid").join(top, "qid", "left").join(where.select(F.col("doc_id").alias("qid"), F.col("collection").alias("asked")), "qid", "left").join(where.select(F.col("doc_id").alias("top"), F.col("collection").alias("got")), "top", "left")
    n = F.count(F.lit(1))
    return x.agg(n.alias("n"), F.round(100 * F.count("cov") / n, 1).alias("found_pct"), F.round(F.avg("cov"), 4).alias("mean_coverage"), F.round(100 * F.count(F.when(F.col("asked") == F.col("got"), 1)) / n, 1).alias("agreement_pct"))


@query("a27_task_stats", "SELECT user_id AS agent, count(*) AS received, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS open_ FROM events GROUP BY user_id")
def task_stats(spark, d):
    n = lambda *kinds: F.count(F.when(F.col("event_type").isin(*kinds), 1))
    return table(spark, d, "events").groupBy(F.col("user_id").alias("agent")).agg(F.count(F.lit(1)).alias("received"), n("purchase").alias("completed"), n("error").alias("failed"), F.count(F.when(~F.col("event_type").isin("purchase", "error"), 1)).alias("open_"))


@query("a28_bus_metrics", "SELECT event_type AS topic, count(*) AS n_messages, count(DISTINCT user_id) AS n_senders, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY event_type")
def bus_metrics(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("topic")).agg(F.count(F.lit(1)).alias("n_messages"), F.count_distinct("user_id").alias("n_senders"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query(
    "a28_retry_metrics",
    f"""WITH {REP}, g AS (SELECT run_id, id, count(*) AS tries, count(*) FILTER (NOT ok) AS failures, bool_or(ok) AS got_there FROM rp WHERE id IS NOT NULL GROUP BY ALL)
SELECT id, sum(tries) :: BIGINT AS tries, sum(tries - 1) :: BIGINT AS retries, sum(failures) :: BIGINT AS failures, round(avg(CASE WHEN got_there THEN 1.0 ELSE 0.0 END), 4) AS success_rate FROM g GROUP BY id""",
)
def retry_metrics(spark, d):
    g = rep(spark, d).filter("id is not null").groupBy("run_id", "id").agg(F.count(F.lit(1)).alias("tries"), F.count(F.when(~F.col("ok"), 1)).alias("failures"), F.max("ok").alias("got_there"))
    return g.groupBy("id").agg(F.sum("tries").alias("tries"), F.sum(F.col("tries") - 1).alias("retries"), F.sum("failures").alias("failures"), F.round(F.avg(F.when(F.col("got_there"), 1.0).otherwise(0.0)), 4).alias("success_rate"))


@query(
    "a29_cache_hit_rate",
    f"""WITH {VQ}, s AS (SELECT qid, max(round(list_cosine_similarity({_D64('q')}, {_D64('e.embedding')}), 6)) AS best FROM vq, embeddings e WHERE e.vec_id <> qid GROUP BY qid)
SELECT count(*) AS lookups, count(*) FILTER (best >= 0.5) AS hits, round(count(*) FILTER (best >= 0.5) / count(*), 4) AS hit_rate FROM s""",
)
def cache_hit_rate(spark, d):
    """Lookups of a semantic cache that a stored question answers (similarity of a half and more)."""
    best = vector.exact_top(vector_queries(spark, d), vectors(spark, d), 2).filter("vec_id <> qid").groupBy("qid").agg(F.max("score").alias("best"))
    n, hits = F.count(F.lit(1)), F.count(F.when(F.col("best") >= 0.5, 1))
    return best.agg(n.alias("lookups"), hits.alias("hits"), F.round(hits / n, 4).alias("hit_rate"))


@query(
    "a30_latency_benchmark",
    f"""WITH {BENCH} SELECT model, count(*) AS n, round(avg(latency) * 1000, 3) AS mean_ms, round(quantile_cont(latency, 0.5) * 1000, 3) AS p50_ms, round(quantile_cont(latency, 0.95) * 1000, 3) AS p95_ms, round(quantile_cont(latency, 0.99) * 1000, 3) AS p99_ms, round(1 / avg(latency), 4) AS qps FROM br WHERE isfinite(latency) AND latency > 0 GROUP BY model""",
)
def latency_benchmark(spark, d):
    p = lambda x: F.round(F.percentile("latency", F.lit(x)) * 1000, 3)
    good = bench(spark, d).filter(finite("latency").isNotNull() & (F.col("latency") > 0))
    return good.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency") * 1000, 3).alias("mean_ms"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms"), p(0.99).alias("p99_ms"), F.round(1 / F.avg("latency"), 4).alias("qps"))


@query(
    "g10_resolved_answers",
    f"""WITH {RESULTS}, w AS (SELECT result_id AS pid, query AS question, response AS b, lag(response) OVER (PARTITION BY query ORDER BY evaluated_at, result_id) AS a FROM er JOIN (SELECT result_id, any_value(evaluated_at) AS evaluated_at FROM evaluation_results GROUP BY result_id) USING (result_id) WHERE response IS NOT NULL AND query IS NOT NULL),
n AS (SELECT *, list_sort(list_distinct(regexp_extract_all(a, '(\\d+\\.?\\d*)', 1))) AS na, list_sort(list_distinct(regexp_extract_all(b, '(\\d+\\.?\\d*)', 1))) AS nb FROM w WHERE a IS NOT NULL),
k AS (SELECT *, list_sort(list_distinct(list_concat(list_filter(na, lambda x: NOT list_contains(nb, x)), list_filter(nb, lambda x: NOT list_contains(na, x))))) AS points FROM n)
SELECT pid, len(na) > 0 AND len(nb) > 0 AND len(points) >= 2 AS conflict, CASE WHEN len(na) > 0 AND len(nb) > 0 AND len(points) >= 2 THEN 'both' WHEN length(a) >= length(b) THEN 'a' ELSE 'b' END AS kept, CASE WHEN len(na) > 0 AND len(nb) > 0 AND len(points) >= 2 THEN question || ' ' || array_to_string(list_slice(points, 1, 3), ' ') END AS search_again FROM k""",
)
def resolved_answers(spark, d):
    """Of two answers that agree the longer stays (the first on ties); if their numbers differ both stay and the points are searched."""
    rows = results(spark, d).filter("response is not null and query is not null")
    before = F.lag("response").over(Window.partitionBy("query").orderBy("evaluated_at", "result_id"))
    pairs = rows.select(F.col("result_id").alias("pid"), F.col("query").alias("question"), before.alias("a"), F.col("response").alias("b")).filter("a is not null")
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+\.?\d*)"), 1))
    k = pairs.withColumn("na", numbers("a")).withColumn("nb", numbers("b")).withColumn("points", F.array_sort(F.array_union(F.array_except("na", "nb"), F.array_except("nb", "na"))))
    conflict = (F.size("na") > 0) & (F.size("nb") > 0) & (F.size("points") >= 2)
    return k.select("pid", conflict.alias("conflict"), F.when(conflict, "both").when(F.length("a") >= F.length("b"), "a").otherwise("b").alias("kept"), F.when(conflict, F.concat_ws(" ", "question", F.array_join(F.slice("points", 1, 3), " "))).alias("search_again"))
