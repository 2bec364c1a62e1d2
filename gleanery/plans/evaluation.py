"""Evaluation analytics over reports, results and question sets."""

from pyspark.sql import functions as F

from gleanery.functions import sqltext as S
from gleanery.functions import text as T
from gleanery.plans.registry import query
from gleanery.runtime import table

# Marks of a refusal, of a citation and of doubt, and the weights of the case score.
REFUSALS = ("未找到可靠依据", "无法基于证据", "知识库与外部检索均未找到", "无法回答", "没有相关", "未找到与", "不足以回答", "无法从知识库")
RELEVANCY_REFUSALS = ("不知道", "无法回答", "没有相关", "无法确定", "未找到可靠依据", "无法基于证据", "知识库与外部检索均未找到")
CITED = ("[1]", "[2]", "[来源", "来源", "参考")
DOUBT = ("可能", "也许", "大概", "不确定")
SHAPED = ("\n", "。", "：", "【")
WEIGHTS = {"accuracy": 0.28, "completeness": 0.16, "relevance": 0.12, "citation_quality": 0.10, "time_score": 0.10, "anti_hallucination": 0.12, "format_score": 0.06, "fluency": 0.06}

# Means and scores are rounded in decimal arithmetic: on exact ties decimal and binary rounding part.
CASES = """rp AS (SELECT report_id, any_value(id) AS id, any_value(question) AS question, any_value(answer_preview) AS a, any_value(latency_ms) AS latency_ms, any_value(no_knowledge) AS no_knowledge,
 any_value(used_mock_web) AS used_mock_web, any_value(hallucination_score) AS h, any_value(error) AS error, any_value(ok) AS ok, any_value(generated_at) AS generated_at FROM e2e_report GROUP BY report_id),
cs AS (SELECT rp.*, coalesce(a, '') AS answer, s.expected_keywords AS kws, s.allow_refuse, s.category FROM rp JOIN e2e_set s USING (id))"""


def reports(spark, d):
    return table(spark, d, "e2e_report").dropDuplicates(["report_id"])


def cases(spark, d):
    """Reports with their question's row; the question set is fixed, so Spark broadcasts it by its own size check."""
    asked = table(spark, d, "e2e_set").select("id", F.col("expected_keywords").alias("kws"), "allow_refuse", "category")
    return reports(spark, d).join(asked, "id").withColumn("answer", F.coalesce("answer_preview", F.lit("")))


def _any(text, words):
    condition = F.lit(False)
    for w in words:
        condition = condition | F.contains(text, F.lit(w))
    return condition


def _sql_any(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" if w != "\n" else f"contains({text}, chr(10))" for w in words) + ")"


_HITS = "len(list_filter(kws, lambda k: k IS NOT NULL AND k <> '' AND contains(lower(answer), lower(k))))"


@query("a6_keyword_hits", f"WITH {CASES} SELECT report_id, {_HITS} :: INTEGER AS hits, round(CASE WHEN len(kws) > 0 THEN {_HITS} / len(kws) ELSE 1.0 END, 4) AS keyword_rate FROM cs")
def keyword_hits(spark, d):
    hits = F.size(F.filter("kws", lambda k: k.isNotNull() & (k != "") & F.contains(F.lower("answer"), F.lower(k))))
    return cases(spark, d).select("report_id", hits.alias("hits"), F.round(F.when(F.size("kws") > 0, hits / F.size("kws")).otherwise(1.0), 4).alias("keyword_rate"))


_SCORE_SQL = f"""WITH {CASES}, k AS (SELECT *, {_HITS} AS hits, CASE WHEN len(kws) > 0 THEN {_HITS} / len(kws) ELSE 1.0 END AS rate, coalesce(no_knowledge, false) OR {_sql_any('answer', REFUSALS)} AS refuse, coalesce(latency_ms, 0) / 1000.0 AS sec,
 list_filter(regexp_split_to_array(replace(replace(question, '？', ' '), '?', ' '), '\\s+'), lambda t: length(t) > 1) AS qt,
 {' + '.join(f"(CASE WHEN contains(answer, '{w}') THEN 1 ELSE 0 END)" for w in DOUBT)} AS doubt FROM cs WHERE question IS NOT NULL),
s AS (SELECT report_id, category, allow_refuse, latency_ms, h, CASE WHEN coalesce(allow_refuse, false) AND refuse THEN true ELSE rate >= 0.34 AND NOT (refuse AND NOT coalesce(allow_refuse, false)) AND NOT (len(kws) > 0 AND hits = 0 AND NOT coalesce(allow_refuse, false)) END AS passed, refuse,
 round(least(10.0, rate * 10), 2) AS accuracy, round(least(10.0, len(list_filter(qt, lambda t: contains(answer, t))) / greatest(len(qt), 1) * 10 + CASE WHEN rate > 0 THEN 3 ELSE 0 END), 2) AS relevance,
 CASE WHEN {_sql_any('answer', CITED)} THEN 9.0 WHEN answer <> '' THEN 3.0 ELSE 0.0 END AS citation_quality, CASE WHEN sec < 3 THEN 10.0 WHEN sec < 6 THEN 8.0 WHEN sec < 12 THEN 6.0 WHEN sec < 20 THEN 4.0 ELSE 2.0 END AS time_score,
 round(greatest(0.0, 10 - least(10.0, doubt * 2.0 + coalesce(h, 0) * 10)), 2) AS anti_hallucination, CASE WHEN {_sql_any('answer', SHAPED)} THEN 8.0 WHEN answer <> '' THEN 5.0 ELSE 0.0 END AS format_score,
 CASE WHEN length(answer) > 60 THEN 8.5 WHEN length(answer) > 20 THEN 6.0 ELSE 3.0 END AS fluency, least(10.0, length(answer) / 80.0 :: DOUBLE) AS ls FROM k),
sc AS (SELECT * EXCLUDE (ls), CAST(round(CAST(ls * 0.45 :: DOUBLE + accuracy * 0.55 :: DOUBLE AS DECIMAL(28, 9)), 2) AS DOUBLE) AS completeness FROM s),
t AS (SELECT *, {' + '.join(f'{k} :: DOUBLE * {w} :: DOUBLE' for k, w in WEIGHTS.items())} AS total_raw FROM sc)"""


def case_scores(spark, d):
    """Eight scores of 0 to 10 per case, their weighted total and whether the case passes."""
    answer = F.col("answer")
    rows = cases(spark, d).filter("question is not null")
    hits = F.size(F.filter("kws", lambda k: k.isNotNull() & (k != "") & F.contains(F.lower(answer), F.lower(k))))
    rows = rows.withColumn("hits", hits).withColumn("rate", F.when(F.size("kws") > 0, F.col("hits") / F.size("kws")).otherwise(1.0))
    rows = rows.withColumn("refuse", F.coalesce("no_knowledge", F.lit(False)) | _any(answer, REFUSALS))
    may = F.coalesce("allow_refuse", F.lit(False))
    passed = F.when(may & F.col("refuse"), True).otherwise((F.col("rate") >= 0.34) & ~(F.col("refuse") & ~may) & ~((F.size("kws") > 0) & (F.col("hits") == 0) & ~may))
    words = F.filter(F.split(F.replace(F.replace("question", F.lit("？"), F.lit(" ")), F.lit("?"), F.lit(" ")), r"\s+"), lambda t: F.length(t) > 1)
    relevance = F.size(F.filter(words, lambda t: F.contains(answer, t))) / F.greatest(F.size(words), F.lit(1)) * 10 + F.when(F.col("rate") > 0, 3).otherwise(0)
    doubt = sum((F.when(F.contains(answer, F.lit(w)), 1).otherwise(0) for w in DOUBT), F.lit(0))
    sec = F.coalesce("latency_ms", F.lit(0)) / 1000
    accuracy = F.round(F.least(F.lit(10.0), F.col("rate") * 10), 2)
    scored = rows.select(
        "report_id", "category", "allow_refuse", "latency_ms", F.col("hallucination_score").alias("h"), passed.alias("passed"), "refuse",
        accuracy.alias("accuracy"),
        F.round(F.least(F.lit(10.0), relevance), 2).alias("relevance"),
        F.when(_any(answer, CITED), 9.0).when(answer != "", 3.0).otherwise(0.0).alias("citation_quality"),
        F.when(sec < 3, 10.0).when(sec < 6, 8.0).when(sec < 12, 6.0).when(sec < 20, 4.0).otherwise(2.0).alias("time_score"),
        F.round(F.greatest(F.lit(0.0), 10 - F.least(F.lit(10.0), doubt * 2.0 + F.coalesce("hallucination_score", F.lit(0.0)) * 10)), 2).alias("anti_hallucination"),
        F.when(_any(answer, SHAPED), 8.0).when(answer != "", 5.0).otherwise(0.0).alias("format_score"),
        F.when(F.length(answer) > 60, 8.5).when(F.length(answer) > 20, 6.0).otherwise(3.0).alias("fluency"),
        T.rounded(F.least(F.lit(10.0), F.length(answer) / 80) * 0.45 + accuracy * 0.55, 2).alias("completeness"),
    )
    return scored.withColumn("total_raw", sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)))


@query("a8_case_scores", f"{_SCORE_SQL} SELECT report_id, passed, refuse, accuracy, completeness, relevance, citation_quality :: DOUBLE AS citation_quality, time_score :: DOUBLE AS time_score, anti_hallucination, format_score :: DOUBLE AS format_score, fluency :: DOUBLE AS fluency, round(total_raw, 4) AS total_score FROM t")
def case_score_rows(spark, d):
    return case_scores(spark, d).select("report_id", "passed", "refuse", *[k for k in WEIGHTS], F.round("total_raw", 4).alias("total_score"))


_GRADE = "CASE WHEN {p} >= 0.85 AND {m} >= 7.5 THEN 'A' WHEN {p} >= 0.7 AND {m} >= 6.5 THEN 'B' WHEN {p} >= 0.55 AND {m} >= 5.5 THEN 'C' ELSE 'D' END"


@query(
    "a9_report_rollup",
    f"""{_SCORE_SQL}, g AS (SELECT category, allow_refuse, grouping(category, allow_refuse) AS level, count(*) AS n, avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) AS p, avg(total_raw) AS m, avg(h) AS h FROM t GROUP BY ROLLUP (category, allow_refuse))
SELECT category, allow_refuse, level :: BIGINT AS level, n, CAST(round(CAST(p AS DECIMAL(28, 9)), 6) AS DOUBLE) AS pass_rate, CAST(round(CAST(m AS DECIMAL(28, 9)), 6) AS DOUBLE) AS mean_score, CAST(round(CAST(h AS DECIMAL(28, 9)), 6) AS DOUBLE) AS mean_hallucination, {_GRADE.format(p='CAST(round(CAST(p AS DECIMAL(28, 9)), 6) AS DOUBLE)', m='CAST(round(CAST(m AS DECIMAL(28, 9)), 6) AS DOUBLE)')} AS grade FROM g""",
)
def report_rollup(spark, d):
    g = case_scores(spark, d).rollup("category", "allow_refuse").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), T.rounded(F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)), 6).alias("pass_rate"), T.rounded(F.avg("total_raw"), 6).alias("mean_score"), T.rounded(F.avg("h"), 6).alias("mean_hallucination")
    )
    p, m = F.col("pass_rate"), F.col("mean_score")
    return g.withColumn("grade", F.when((p >= 0.85) & (m >= 7.5), "A").when((p >= 0.7) & (m >= 6.5), "B").when((p >= 0.55) & (m >= 5.5), "C").otherwise("D"))


_REL = f"""WITH {CASES}, k AS (SELECT report_id, category, h, question, answer, {S.mixed_tokens('question')} AS qt, {S.mixed_tokens('answer')} AS ant FROM cs WHERE question IS NOT NULL),
o AS (SELECT *, len(list_intersect(qt, ant)) / greatest(len(qt), 1) AS o FROM k),
r AS (SELECT report_id, category, CASE WHEN answer = '' OR question = '' THEN 0.0 WHEN {_sql_any('answer', RELEVANCY_REFUSALS)} THEN 0.25 WHEN len(qt) = 0 THEN 0.0 WHEN length({S.strip('answer')}) < 8 AND o < 0.1 THEN 0.0
 WHEN o > 0 THEN CAST(round(CAST(least(1.0, least(1.0, o * 1.2) * CASE WHEN length(answer) > 1000 THEN 0.8 WHEN length(answer) > 500 THEN 0.9 ELSE 1.0 END) :: DOUBLE AS DECIMAL(28, 9)), 3) AS DOUBLE) ELSE 0.0 END AS relevancy, CASE WHEN answer = '' THEN 0.0 ELSE round(1 - h, 3) END AS faithfulness FROM o)"""


def relevancy_rows(spark, d):
    rows = cases(spark, d).filter("question is not null")
    answer = F.col("answer")
    q = T.mixed_tokens("question")
    overlap = F.size(F.array_intersect(q, T.mixed_tokens("answer"))) / F.greatest(F.size(q), F.lit(1))
    penalty = F.when(F.length(answer) > 1000, 0.8).when(F.length(answer) > 500, 0.9).otherwise(1.0)
    rows = rows.withColumn("o", overlap)
    score = (
        F.when((answer == "") | (F.col("question") == ""), 0.0)
        .when(_any(answer, RELEVANCY_REFUSALS), 0.25)
        .when(F.size(q) == 0, 0.0)
        .when((F.length(T.strip("answer")) < 8) & (F.col("o") < 0.1), 0.0)
        .when(F.col("o") > 0, T.rounded(F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("o") * 1.2) * penalty), 3))
        .otherwise(0.0)
    )
    return rows.select("report_id", "category", score.alias("relevancy"), F.when(answer == "", 0.0).otherwise(F.round(1 - F.col("hallucination_score"), 3)).alias("faithfulness"))


@query("a1_answer_relevancy", f"{_REL} SELECT * FROM r")
def answer_relevancy(spark, d):
    return relevancy_rows(spark, d)


@query("a2_batch_means", f"{_REL} SELECT category, CAST(round(CAST(avg(relevancy) AS DECIMAL(28, 9)), 6) AS DOUBLE) AS relevancy, CAST(round(CAST(avg(faithfulness) AS DECIMAL(28, 9)), 6) AS DOUBLE) AS faithfulness, count(*) AS n FROM r GROUP BY category")
def batch_means(spark, d):
    return relevancy_rows(spark, d).groupBy("category").agg(T.rounded(F.avg("relevancy"), 6).alias("relevancy"), T.rounded(F.avg("faithfulness"), 6).alias("faithfulness"), F.count(F.lit(1)).alias("n"))


@query("a3_refusal_confusion", f"{_SCORE_SQL} SELECT coalesce(allow_refuse, false) AS may_refuse, refuse AS refused, passed, count(*) AS n FROM t GROUP BY ALL")
def refusal_confusion(spark, d):
    return case_scores(spark, d).groupBy(F.coalesce("allow_refuse", F.lit(False)).alias("may_refuse"), F.col("refuse").alias("refused"), "passed").agg(F.count(F.lit(1)).alias("n"))


@query("a4_failed_cases", f"{_SCORE_SQL} SELECT report_id, category, round(total_raw, 4) AS total_score FROM t WHERE NOT passed")
def failed_cases(spark, d):
    return case_scores(spark, d).filter("not passed").select("report_id", "category", F.round("total_raw", 4).alias("total_score"))


@query(
    "a10_latency_percentiles",
    f"""WITH {CASES} SELECT category, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.9), 6) AS p90, round(quantile_cont(latency_ms, 0.99), 6) AS p99, max(latency_ms) AS max_ms FROM cs WHERE latency_ms > 0 GROUP BY category""",
)
def latency_percentiles(spark, d):
    """Exact, interpolated; Spark's percentile counts distinct values per group before it sorts."""
    p = lambda x: F.round(F.percentile("latency_ms", F.lit(x)), 6)
    return cases(spark, d).filter("latency_ms > 0").groupBy("category").agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max("latency_ms").alias("max_ms"))


@query(
    "j10_a5_precision_recall",
    f"""WITH {CASES}, e AS (SELECT DISTINCT report_id, lower(unnest(kws)) AS k FROM cs), got AS (SELECT report_id, k FROM e JOIN cs USING (report_id) WHERE contains(lower(answer), k)),
m AS (SELECT DISTINCT category, lower(unnest(kws)) AS k FROM cs), f AS (SELECT DISTINCT cs.report_id, m.k FROM cs JOIN m ON m.category IS NOT DISTINCT FROM cs.category WHERE contains(lower(answer), m.k)),
c AS (SELECT coalesce(e.report_id, f.report_id) AS report_id, count(*) FILTER (e.k IS NOT NULL AND f.k IS NOT NULL) AS tp, count(*) FILTER (e.k IS NULL) AS fp, count(*) FILTER (f.k IS NULL) AS fn FROM e FULL JOIN f ON e.report_id = f.report_id AND e.k = f.k GROUP BY 1)
SELECT report_id, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision_, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall_, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM c""",
)
def precision_recall(spark, d):
    """Expected keywords against those of the whole category that the answer names."""
    rows = cases(spark, d).select("report_id", "category", "kws", F.lower("answer").alias("answer"))
    want = rows.select("report_id", F.explode(F.transform("kws", lambda k: F.lower(k))).alias("k")).distinct().withColumn("want", F.lit(1))
    vocabulary = rows.select("category", F.explode(F.transform("kws", lambda k: F.lower(k))).alias("k")).distinct().groupBy("category").agg(F.collect_list("k").alias("ks"))  # the fixed question set's words
    vocabulary = vocabulary.withColumnRenamed("category", "cat")
    named = rows.join(vocabulary, F.col("category").eqNullSafe(F.col("cat"))).select("report_id", F.explode(F.filter("ks", lambda k: F.contains(F.col("answer"), k))).alias("k")).distinct().withColumn("got", F.lit(1))
    both = want.join(named, ["report_id", "k"], "full_outer")
    n = lambda c: F.count(F.when(c, 1))
    counts = both.groupBy("report_id").agg(n(F.col("want").isNotNull() & F.col("got").isNotNull()).alias("tp"), n(F.col("want").isNull()).alias("fp"), n(F.col("got").isNull()).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return counts.select("report_id", "tp", "fp", "fn", share(tp, tp + fp).alias("precision_"), share(tp, tp + fn).alias("recall_"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


# --- stored scores ---------------------------------------------------------------------------------

DIMS = ("accuracy", "completeness", "relevance", "professionalism", "readability")
SCORE_WEIGHTS = {"accuracy": 0.35, "completeness": 0.20, "relevance": 0.20, "professionalism": 0.15, "readability": 0.10}
RESULTS = "er AS (SELECT result_id, any_value(model) AS model, any_value(query) AS query, any_value(response) AS response, any_value(latency) AS latency, any_value(success) AS success, any_value(scores) AS scores FROM evaluation_results GROUP BY result_id)"
_LONG = f"""lg AS (SELECT result_id, model, unnest([{', '.join(f"'{x}'" for x in DIMS)}]) AS dim, unnest([{', '.join(f'scores.{x}' for x in DIMS)}]) AS v FROM er)"""


def long_scores(spark, d):
    rows = table(spark, d, "evaluation_results").dropDuplicates(["result_id"])
    pairs = F.array(*[F.struct(F.lit(x).alias("dim"), F.col(f"scores.{x}").alias("v")) for x in DIMS])
    return rows.select("result_id", "model", F.explode(pairs).alias("p")).select("result_id", "model", "p.dim", "p.v")


@query(
    "a24_weighted_overall",
    f"WITH {RESULTS}, {_LONG}, w AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in SCORE_WEIGHTS.items())}) t(dim, w)) SELECT result_id, round(sum(v * w :: DOUBLE) / sum(w :: DOUBLE), 6) AS overall, count(*) AS n_scores FROM lg JOIN w USING (dim) WHERE v IS NOT NULL GROUP BY result_id",
)
def weighted_overall(spark, d):
    """Missing scores drop out of numerator and denominator."""
    weight = F.create_map(*[F.lit(x) for pair in SCORE_WEIGHTS.items() for x in pair])
    rows = long_scores(spark, d).filter("v is not null").withColumn("w", F.element_at(weight, F.col("dim")))
    return rows.groupBy("result_id").agg(F.round(F.sum(F.col("v") * F.col("w")) / F.sum("w"), 6).alias("overall"), F.count(F.lit(1)).alias("n_scores"))


@query("a21_dimension_means", f"WITH {RESULTS}, {_LONG} SELECT model, dim, CAST(round(CAST(avg(v) AS DECIMAL(28, 9)), 6) AS DOUBLE) AS mean, count(v) AS n FROM lg GROUP BY CUBE (model, dim)")
def dimension_means(spark, d):
    return long_scores(spark, d).cube("model", "dim").agg(T.rounded(F.avg("v"), 6).alias("mean"), F.count("v").alias("n"))


@query(
    "a25_grade_bands",
    f"WITH {RESULTS} SELECT model, CASE WHEN scores.total * 10 >= 90 THEN 'excellent' WHEN scores.total * 10 >= 80 THEN 'good' WHEN scores.total * 10 >= 60 THEN 'fair' WHEN scores.total * 10 >= 40 THEN 'weak' WHEN scores.total IS NULL THEN 'none' ELSE 'poor' END AS band, count(*) AS n FROM er GROUP BY ALL",
)
def grade_bands(spark, d):
    t = F.col("scores.total") * 10
    band = F.when(t >= 90, "excellent").when(t >= 80, "good").when(t >= 60, "fair").when(t >= 40, "weak").when(t.isNull(), "none").otherwise("poor")
    return table(spark, d, "evaluation_results").dropDuplicates(["result_id"]).groupBy("model", band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("a34_model_means_padded", f"WITH {RESULTS} SELECT model, CAST(round(CAST(avg(CASE WHEN success THEN coalesce(scores.total, 0) ELSE 0 END) AS DECIMAL(28, 9)), 6) AS DOUBLE) AS padded_mean, CAST(round(CAST(avg(scores.total) AS DECIMAL(28, 9)), 6) AS DOUBLE) AS plain_mean, count(*) AS n FROM er GROUP BY model")
def model_means(spark, d):
    total = F.col("scores.total")
    return table(spark, d, "evaluation_results").dropDuplicates(["result_id"]).groupBy("model").agg(T.rounded(F.avg(F.when(F.col("success"), F.coalesce(total, F.lit(0.0))).otherwise(0.0)), 6).alias("padded_mean"), T.rounded(F.avg(total), 6).alias("plain_mean"), F.count(F.lit(1)).alias("n"))


_TECH = ("RAG", "LLM", "向量", "检索", "生成", "模型", "数据库", "API", "Agent", "框架")
_SHAPE = ("1.", "2.", "：", "、", "\n")


@query(
    "a33_length_and_form",
    f"""WITH {RESULTS}, x AS (SELECT result_id, coalesce(response, '') AS r FROM er)
SELECT result_id, round(CASE WHEN r = '' THEN 0.0 WHEN length(r) BETWEEN 50 AND 500 THEN 10.0 WHEN length(r) < 50 THEN greatest(1.0, length(r) / 50.0 :: DOUBLE * 10) ELSE greatest(6.0, 10 - (length(r) - 500) / 100.0 :: DOUBLE) END, 4) AS completeness,
least(10, 2 * ({' + '.join(f"(CASE WHEN contains(r, '{w}') THEN 1 ELSE 0 END)" for w in _TECH)})) :: INTEGER AS professionalism, CASE WHEN r = '' THEN 0 WHEN {_sql_any('r', _SHAPE)} THEN 8 ELSE 5 END :: INTEGER AS readability FROM x""",
)
def length_and_form(spark, d):
    r = F.coalesce("response", F.lit(""))
    n = F.length(r)
    completeness = F.when(r == "", 0.0).when(n.between(50, 500), 10.0).when(n < 50, F.greatest(F.lit(1.0), n / 50 * 10)).otherwise(F.greatest(F.lit(6.0), 10 - (n - 500) / 100))
    tech = sum((F.when(F.contains(r, F.lit(w)), 1).otherwise(0) for w in _TECH), F.lit(0))
    form = F.when(r == "", 0).when(_any(r, _SHAPE), 8).otherwise(5)
    return table(spark, d, "evaluation_results").dropDuplicates(["result_id"]).select("result_id", F.round(completeness, 4).alias("completeness"), F.least(F.lit(10), tech * 2).alias("professionalism"), form.alias("readability"))
