"""Routes, domain and collection rules, dialog consistency and error classes."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import sqltext as S
from gleanery.functions import text as T
from gleanery.operators import judge, lexical, rules
from gleanery.plans.evaluation import reports
from gleanery.plans.judging import G1, _hits
from gleanery.plans.registry import query
from gleanery.plans.retrieval import BM, text_queries
from gleanery.plans.rules import QUESTIONS, questions
from gleanery.runtime import table

REP = "rp AS (SELECT report_id, any_value(id) AS id, any_value(run_id) AS run_id, any_value(question) AS question, any_value(answer_preview) AS answer, any_value(latency_ms) AS latency_ms, any_value(no_knowledge) AS no_knowledge, any_value(used_mock_web) AS used_mock_web, any_value(hallucination_score) AS h, any_value(error) AS error, any_value(ok) AS ok, any_value(generated_at) AS generated_at FROM e2e_report GROUP BY report_id)"


def rep(spark, d):
    return reports(spark, d).withColumnRenamed("answer_preview", "answer").withColumnRenamed("hallucination_score", "h")


# --- rewriting -------------------------------------------------------------------------------------

#: What is added to the keywords on the first and on later retries.
RETRY_WORDS = {1: (5, " 相关概念 定义 说明"), 2: (3, " 原理 机制 类型")}


@query(
    "r2_retry_rewrites",
    f"WITH {QUESTIONS}, k AS (SELECT q, {S.bag_tokens('q')} AS words FROM qs) " + " UNION ALL ".join(f"SELECT q, {retry} AS retry, array_to_string(list_slice(words, 1, {n}), ' ') || '{tail}' AS rewritten FROM k" for retry, (n, tail) in RETRY_WORDS.items()),
)
def retry_rewrites(spark, d):
    """The first keywords of a question and words that widen the search, one row per retry."""
    words = questions(spark, d).select("q", T.bag_tokens("q").alias("words"))
    variants = F.array(*[F.struct(F.lit(retry).alias("retry"), F.concat(F.array_join(F.slice("words", 1, n), " "), F.lit(tail)).alias("rewritten")) for retry, (n, tail) in RETRY_WORDS.items()])
    return words.select("q", F.explode(variants).alias("v")).select("q", "v.retry", "v.rewritten")


#: Other words for a keyword.
SYNONYMS = {"安装": ("安装", "配置", "部署", "setup"), "优化": ("优化", "加速", "提升", "改进"), "问题": ("问题", "错误", "bug", "异常"), "方法": ("方法", "方案", "策略", "技巧"), "gpu": ("gpu", "显卡", "cuda"), "内存": ("内存", "memory", "ram")}
#: Searches proposed where nothing was found.
PROPOSALS = (("gpu", "GPU 加速"), ("安装", "安装指南"), ("优化", "性能优化"))
_PAIRS = [(k, s) for k, words in SYNONYMS.items() for s in words if s != k]
_KEPT = "list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: length(w) > 1 AND w NOT IN ({stops}))"


@query(
    "r22_query_variants",
    f"""WITH {QUESTIONS}, k AS (SELECT q, list_filter(regexp_split_to_array({S.strip('lower(q)')}, '{S.SPACE}+'), lambda w: length(w) > 1 AND NOT list_contains({S.values(T.KEYWORD_STOPS)}, w)) AS words FROM qs),
v AS (SELECT q, words, list_slice(list_distinct(list_concat([q], list_filter([{', '.join(f"CASE WHEN contains(lower(q), '{k}') THEN replace(q, '{k}', '{s}') END" for k, s in _PAIRS)}], lambda x: x IS NOT NULL))), 1, 5) AS ignored FROM k)
SELECT q, len(list_filter([{', '.join(f"contains(lower(q), '{k}')" for k in SYNONYMS)}], lambda x: x)) :: INTEGER AS n_keys,
array_to_string(list_slice(list_concat([q], list_filter([{', '.join(f"CASE WHEN contains(q, '{k}') THEN replace(q, '{k}', '{s}') END" for k, s in _PAIRS)}], lambda x: x IS NOT NULL)), 1, 5), ' | ') AS variants,
array_to_string(list_slice(list_concat(CASE WHEN len(words) > 2 THEN [array_to_string(list_slice(words, 1, 2), ' ')] ELSE [] END, {', '.join(f"CASE WHEN contains(lower(q), '{k}') THEN ['{p}'] ELSE [] END" for k, p in PROPOSALS)}), 1, 3), ' | ') AS proposals FROM v""",
)
def query_variants(spark, d):
    """Up to five wordings with synonyms put in, and up to three searches to propose where nothing is found."""
    words = T.keywords("q")
    swaps = F.array(*[F.when(F.contains("q", F.lit(k)), F.replace(F.col("q"), F.lit(k), F.lit(s))) for k, s in _PAIRS])
    variants = F.slice(F.concat(F.array("q"), F.filter(swaps, lambda x: x.isNotNull())), 1, 5)
    none = F.array().cast("array<string>")
    proposals = F.slice(F.concat(F.when(F.size(words) > 2, F.array(F.array_join(F.slice(words, 1, 2), " "))).otherwise(none), *[F.when(F.contains(F.lower("q"), F.lit(k)), F.array(F.lit(p))).otherwise(none) for k, p in PROPOSALS]), 1, 3)
    n_keys = sum((F.contains(F.lower("q"), F.lit(k)).cast("int") for k in SYNONYMS), F.lit(0))
    return questions(spark, d).select("q", n_keys.alias("n_keys"), F.array_join(variants, " | ").alias("variants"), F.array_join(proposals, " | ").alias("proposals"))


# --- domains and collections -----------------------------------------------------------------------

#: Collections that serve a domain, the preferred one first.
DOMAIN_COLLECTIONS = {
    "typology": ("kb_typology",), "enneatype": ("kb_typology", "kb_mood"), "agent_ops": ("kb_agents",), "security": ("kb_agents", "kb_evals"), "routing": ("kb_rag", "kb_agents"),
    "chunking": ("kb_rag",), "retrieval": ("kb_rag",), "citation": ("kb_rag", "kb_evals"), "evaluation": ("kb_evals",), "mood_index": ("kb_mood",),
}
_SERVES = [(domain, pos, c) for domain, cs in DOMAIN_COLLECTIONS.items() for pos, c in enumerate(cs, 1)]
_SERVES_SQL = "serves AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in _SERVES) + ") t(domain, pos, collection))"
_DOMAIN_SQL = """k AS (SELECT DISTINCT category AS domain, unnest(expected_keywords) AS kw FROM e2e_set WHERE category IS NOT NULL), kk AS (SELECT DISTINCT domain, kw FROM k WHERE kw IS NOT NULL AND kw <> ''),
s AS (SELECT q.id, domain, sum(CASE WHEN regexp_matches(kw, '^[\\x00-\\x7f]+$') AND length(kw) > 4 THEN 1 ELSE 2 END) :: BIGINT AS score FROM e2e_set q JOIN kk ON contains(lower(coalesce(q.question, '')), lower(kw)) GROUP BY ALL),
dm AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, domain) :: INTEGER AS place FROM s)"""


def question_domains(spark, d):
    """``id, domain, score, place`` of the end-to-end questions; both sides are fixed tables."""
    asked = table(spark, d, "e2e_set").select("id", F.lower(F.coalesce("question", F.lit(""))).alias("t"))
    words = table(spark, d, "e2e_set").filter("category is not null").select(F.col("category").alias("domain"), F.explode("expected_keywords").alias("kw")).filter("kw is not null and kw <> ''").distinct()
    weight = F.when(F.col("kw").rlike(r"^[\x00-\x7f]+$") & (F.length("kw") > 4), 1).otherwise(2)
    scores = asked.join(F.broadcast(words), F.contains("t", F.lower("kw"))).groupBy("id", "domain").agg(F.sum(weight).alias("score"))
    return scores.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "domain")))


def serves(spark):
    return spark.createDataFrame(_SERVES, "domain string, pos int, collection string")


@query(
    "r8_recommended_collections",
    f"""WITH {_DOMAIN_SQL}, {_SERVES_SQL}, av AS (SELECT DISTINCT collection FROM chunks WHERE collection IS NOT NULL),
c AS (SELECT id, collection, place * 100 + pos AS ord FROM dm JOIN serves USING (domain) WHERE collection IN (SELECT collection FROM av) UNION ALL SELECT id, collection, 100000 FROM e2e_set, av),
f AS (SELECT id, collection, min(ord) AS ord FROM c GROUP BY ALL) SELECT id, collection, row_number() OVER (PARTITION BY id ORDER BY ord, collection) :: BIGINT AS place FROM f""",
)
def recommended_collections(spark, d):
    """Collections of a question's domains in order, each once, then the remaining ones; sets of fixed size."""
    available = table(spark, d, "chunks").select("collection").filter("collection is not null").distinct()
    wanted = question_domains(spark, d).join(serves(spark), "domain").join(available, "collection", "left_semi").select("id", "collection", (F.col("place") * 100 + F.col("pos")).alias("ord"))
    rest = table(spark, d, "e2e_set").select("id").crossJoin(F.broadcast(available)).withColumn("ord", F.lit(100000))  # a handful of collections
    first = wanted.unionByName(rest).groupBy("id", "collection").agg(F.min("ord").alias("ord"))
    return lexical.rank_within(first, "id", [F.col("ord"), F.col("collection")], None, "place").select("id", "collection", "place")


@query(
    "r9_collection_conflicts",
    f"""WITH {_DOMAIN_SQL}, {_SERVES_SQL}, a AS (SELECT id, (['kb_agents', 'kb_evals', 'kb_mood', 'kb_rag', 'kb_typology'])[length(coalesce(question, '')) % 5 + 1] AS asked FROM e2e_set),
p AS (SELECT a.id, asked, domain, (SELECT collection FROM serves v WHERE v.domain = dm.domain AND pos = 1) AS preferred, EXISTS (SELECT 1 FROM serves v WHERE v.domain = dm.domain AND v.collection = asked) AS fits FROM a LEFT JOIN dm ON dm.id = a.id AND place = 1)
SELECT id, asked, domain, preferred IS NOT NULL AND NOT fits AS conflict, preferred AS suggestion FROM p""",
)
def collection_conflicts(spark, d):
    """Whether the collection a question is put to serves its first domain, and which to use instead."""
    asked = table(spark, d, "e2e_set").select("id", F.element_at(F.array(*[F.lit(c) for c in ("kb_agents", "kb_evals", "kb_mood", "kb_rag", "kb_typology")]), (F.length(F.coalesce("question", F.lit(""))) % 5 + 1).cast("int")).alias("asked"))
    served = F.create_map(*[x for k, v in DOMAIN_COLLECTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    first = question_domains(spark, d).filter("place = 1").select("id", "domain", F.try_element_at(served, F.col("domain")).alias("cs"))
    both = asked.join(first, "id", "left")
    return both.select("id", "asked", "domain", (F.coalesce(F.size("cs") > 0, F.lit(False)) & ~F.coalesce(F.array_contains("cs", F.col("asked")), F.lit(False))).alias("conflict"), F.get("cs", F.lit(0)).alias("suggestion"))


_DOC_DOMAIN = f"""kq AS (SELECT DISTINCT category AS domain, unnest(expected_keywords) AS kw FROM e2e_set WHERE category IS NOT NULL), kw AS (SELECT DISTINCT domain, kw FROM kq WHERE kw IS NOT NULL AND kw <> ''),
kr AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY kw) AS pos FROM kw),
qn AS (SELECT q.qid, domain, count(*) AS n FROM q JOIN kw ON contains(lower(q.query), lower(kw)) GROUP BY ALL), qd AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, domain) AS place FROM qn),
hit AS (SELECT qid, lower(coalesce(d.text, '')) AS t FROM bm JOIN documents d USING (doc_id) WHERE rank <= 8),
ok AS (SELECT DISTINCT qd.qid FROM qd JOIN kr USING (domain) JOIN hit ON hit.qid = qd.qid WHERE place <= 2 AND pos <= 20 AND contains(t, lower(kw))),
md AS (SELECT qid, qid IN (SELECT qid FROM ok) OR qid NOT IN (SELECT qid FROM qd) AS matches FROM q)"""


def docs_match(spark, d):
    """``qid, matches``: a keyword of one of a query's two first domains stands in one of its eight best documents."""
    words = table(spark, d, "e2e_set").filter("category is not null").select(F.col("category").alias("domain"), F.explode("expected_keywords").alias("kw")).filter("kw is not null and kw <> ''").distinct()
    q = text_queries(spark, d)
    found = q.join(F.broadcast(words), F.contains(F.lower("query"), F.lower("kw"))).groupBy("qid", "domain").agg(F.count(F.lit(1)).alias("n"))  # keywords of the fixed question set
    domains = lexical.rank_within(found, "qid", [F.desc("n"), F.col("domain")], 2, "place")
    ranked = lexical.rank_within(words, "domain", [F.col("kw")], 20, "pos")
    hits = _hits(spark, d, 8).select("qid", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    ok = domains.join(F.broadcast(ranked), "domain").select("qid", "kw").join(hits, "qid").filter(F.contains("t", F.lower("kw"))).select("qid").distinct().withColumn("ok", F.lit(True))
    known = domains.select("qid").distinct().withColumn("known", F.lit(True))
    return q.select("qid").join(ok, "qid", "left").join(known, "qid", "left").select("qid", (F.coalesce("ok", F.lit(False)) | F.col("known").isNull()).alias("matches"))


@query("r10_docs_match_domain", f"WITH {BM}, {_DOC_DOMAIN} SELECT * FROM md")
def docs_match_domain(spark, d):
    return docs_match(spark, d)


@query(
    "g8_guarded_answers",
    f"""WITH {REP}, v AS (SELECT report_id, {rules.retrieval_need.sql("coalesce(question, '')")} AS need, {S.strip("coalesce(answer, '')")} = '' AS blank, coalesce(no_knowledge, false) AS no_knowledge FROM rp)
SELECT report_id, CASE WHEN need = 'unanswerable' THEN 'refuse_unanswerable' WHEN NOT blank THEN 'keep' WHEN no_knowledge THEN 'refuse_no_evidence' ELSE 'refuse_no_answer' END AS outcome FROM v""",
)
def guarded_answers(spark, d):
    """An unanswerable question is refused whatever was answered; an empty answer becomes a refusal with its reason."""
    need = rules.retrieval_need.column(F.coalesce("question", F.lit("")))
    blank = T.strip(F.coalesce("answer", F.lit(""))) == ""
    outcome = F.when(need == "unanswerable", "refuse_unanswerable").when(~blank, "keep").when(F.coalesce("no_knowledge", F.lit(False)), "refuse_no_evidence").otherwise("refuse_no_answer")
    return rep(spark, d).select("report_id", outcome.alias("outcome"))


@query("g8_domain_guard", f"WITH {BM}, {_DOC_DOMAIN} SELECT qid, CASE WHEN matches THEN 'keep' ELSE 'refuse_domain' END AS outcome FROM md")
def domain_guard(spark, d):
    return docs_match(spark, d).select("qid", F.when(F.col("matches"), "keep").otherwise("refuse_domain").alias("outcome"))


# --- routes ----------------------------------------------------------------------------------------


@query(
    "r13_retry_routes",
    f"""WITH {G1}, n AS (SELECT q.qid, count(*) FILTER (grade = 'relevant') AS n_relevant, {rules.realtime.sql('any_value(query)')} <> '' AS web FROM q LEFT JOIN g USING (qid) GROUP BY q.qid)
SELECT qid, retry, n_relevant, CASE WHEN n_relevant >= 1 THEN 'generate' WHEN web THEN 'web_search' WHEN retry < 1 THEN 'rewrite_query' ELSE 'web_search' END AS route FROM n, (VALUES (0), (1)) t(retry)""",
)
def retry_routes(spark, d):
    """Where a graded first pass goes on: answer, search the web, or rewrite the query once."""
    n = judge.graded(_hits(spark, d)).groupBy("qid").agg(F.count(F.when(F.col("grade") == "relevant", 1)).alias("n"))
    rows = text_queries(spark, d).join(n, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n_relevant"), (rules.realtime.column(F.col("query")) != "").alias("web"), F.explode(F.array(F.lit(0), F.lit(1))).alias("retry"))
    route = F.when(F.col("n_relevant") >= 1, "generate").when(F.col("web"), "web_search").when(F.col("retry") < 1, "rewrite_query").otherwise("web_search")
    return rows.select("qid", "retry", "n_relevant", route.alias("route"))


#: Regenerations a failed check may cause.
MOST_REGENERATIONS = 1


@query(
    "r14_check_routes",
    f"""WITH {REP}, t AS (SELECT report_id, coalesce(h, 0) < 0.3 AS passed, row_number() OVER (PARTITION BY run_id, id ORDER BY generated_at, report_id) - 1 AS done FROM rp)
SELECT report_id, passed, 'check_conflicts' AS route_off, CASE WHEN NOT passed AND done < {MOST_REGENERATIONS} THEN 'regenerate' ELSE 'check_conflicts' END AS route_on, CASE WHEN done = 0 THEN 'regenerate' ELSE 'check_conflicts' END AS route_forced FROM t""",
)
def check_routes(spark, d):
    """After the fact check: with the loop off, with it on, and with one regeneration forced."""
    done = F.row_number().over(Window.partitionBy("run_id", "id").orderBy("generated_at", "report_id")) - 1
    rows = rep(spark, d).select("report_id", (F.coalesce("h", F.lit(0.0)) < 0.3).alias("passed"), done.alias("done"))
    on = F.when(~F.col("passed") & (F.col("done") < MOST_REGENERATIONS), "regenerate").otherwise("check_conflicts")
    return rows.select("report_id", "passed", F.lit("check_conflicts").alias("route_off"), on.alias("route_on"), F.when(F.col("done") == 0, "regenerate").otherwise("check_conflicts").alias("route_forced"))


#: Words of errors that lower the route at once.
CRITICAL = ("timeout", "unavailable", "rate limit", "quota exceeded")
_LOWER = {"enhanced": "standard", "standard": "fast", "fast": "fallback"}
_STRATEGY = "CASE WHEN c >= 0.8 THEN 'fast' WHEN c >= 0.5 THEN 'standard' ELSE 'enhanced' END"
_CRITICAL_SQL = "(" + " OR ".join(f"contains(lower(coalesce(error, '')), '{w}')" for w in CRITICAL) + ")"


def strategies(spark, d):
    c = 1 - F.coalesce("h", F.lit(1.0))
    critical = F.lower(F.coalesce("error", F.lit(""))).rlike("|".join(CRITICAL))
    tries = F.row_number().over(Window.partitionBy("run_id", "id").orderBy("generated_at", "report_id")) - 1
    rows = rep(spark, d).select("report_id", F.round(c, 6).alias("confidence"), F.when(c >= 0.8, "fast").when(c >= 0.5, "standard").otherwise("enhanced").alias("strategy"), (critical | (tries >= 3)).alias("lower"))
    lowered = F.element_at(F.create_map(*[F.lit(x) for pair in _LOWER.items() for x in pair]), F.col("strategy"))
    return rows.select("report_id", "confidence", "strategy", F.when(F.col("lower"), lowered).otherwise(F.col("strategy")).alias("final_strategy"))


_STRATEGIES = f"""{REP}, st0 AS (SELECT report_id, 1 - coalesce(h, 1.0) AS c, {_CRITICAL_SQL} OR row_number() OVER (PARTITION BY run_id, id ORDER BY generated_at, report_id) - 1 >= 3 AS lower_ FROM rp),
st AS (SELECT report_id, round(c, 6) AS confidence, {_STRATEGY} AS strategy, CASE WHEN NOT lower_ THEN {_STRATEGY} WHEN c >= 0.8 THEN 'fallback' WHEN c >= 0.5 THEN 'fast' ELSE 'standard' END AS final_strategy FROM st0)"""


@query("r16_smart_routes", f"WITH {_STRATEGIES} SELECT * FROM st")
def smart_routes(spark, d):
    """Route by confidence, and one rung lower after a critical error or the third retry."""
    return strategies(spark, d)


@query("a19_strategy_confidence", f"WITH {_STRATEGIES} SELECT strategy, count(*) AS n, round(avg(confidence), 4) AS mean_confidence, count(*) FILTER (strategy <> final_strategy) AS n_lowered FROM st GROUP BY strategy")
def strategy_confidence(spark, d):
    return strategies(spark, d).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.count(F.when(F.col("strategy") != F.col("final_strategy"), 1)).alias("n_lowered"))


#: Domains where a wrong answer costs most.
CAREFUL_DOMAINS = ("security", "evaluation")


@query(
    "r17_adaptive_strategies",
    f"""WITH {REP}, g AS (SELECT category, CAST(generated_at AS DATE) AS day, count(*) * 1000.0 :: DOUBLE / avg(CASE WHEN latency_ms > 0 THEN latency_ms END) AS qps, avg(CASE WHEN no_knowledge THEN 0.0 ELSE 1.0 END) AS hit_rate FROM rp JOIN e2e_set s USING (id) GROUP BY ALL)
SELECT category, day, round(qps, 6) AS qps, round(hit_rate, 6) AS hit_rate, CASE WHEN lower(category) IN ('security', 'evaluation') THEN 'accuracy' WHEN qps > 10000 THEN 'speed' WHEN hit_rate > 0.5 THEN 'ultimate' ELSE 'balanced' END AS strategy FROM g""",
)
def adaptive_strategies(spark, d):
    asked = table(spark, d, "e2e_set").select("id", "category")
    g = rep(spark, d).join(asked, "id").groupBy("category", F.to_date("generated_at").alias("day")).agg(
        (F.count(F.lit(1)) * 1000.0 / F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms")))).alias("qps"), F.avg(F.when(F.col("no_knowledge"), 0.0).otherwise(1.0)).alias("hit_rate")
    )
    strategy = F.when(F.lower("category").isin(*CAREFUL_DOMAINS), "accuracy").when(F.col("qps") > 10000, "speed").when(F.col("hit_rate") > 0.5, "ultimate").otherwise("balanced")
    return g.select("category", "day", F.round("qps", 6).alias("qps"), F.round("hit_rate", 6).alias("hit_rate"), strategy.alias("strategy"))


#: Skills agents announce: name and description.
SKILLS = (("search", "search find lookup documents 检索 查询"), ("grade", "grade check relevance 评分 可靠"), ("explain", "explain why how 为什么 说明"), ("compare", "compare differ difference 区别 关系"), ("maintain", "adjust use correct 校正 处理"))


def _skill_score_sql(name, words):
    return " + ".join([f"(CASE WHEN contains(lower(q), '{name}') THEN 3 ELSE 0 END)", *[f"(CASE WHEN contains(lower(q), '{w}') THEN 1 ELSE 0 END)" for w in words.split()]])


@query(
    "r18_matched_skills",
    f"WITH {QUESTIONS}, s AS (" + " UNION ALL ".join(f"SELECT q, {n} AS no, '{name}' AS skill, {_skill_score_sql(name, words)} AS score FROM qs" for n, (name, words) in enumerate(SKILLS)) + ") SELECT q, skill, score :: INTEGER AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, no) AS t FROM s WHERE score > 0) WHERE t = 1",
)
def matched_skills(spark, d):
    """The best skill for a task: three points for its name, one for each word of its description; the first on ties."""
    t = F.lower("q")
    score = lambda name, words: sum((F.contains(t, F.lit(w)).cast("int") for w in words.split()), F.contains(t, F.lit(name)).cast("int") * 3)
    options = F.array(*[F.struct(score(name, words).alias("score"), F.lit(-n).alias("turn"), F.lit(name).alias("skill")) for n, (name, words) in enumerate(SKILLS)])
    return questions(spark, d).select("q", F.array_max(options).alias("b")).filter("b.score > 0").select("q", "b.skill", "b.score")


@query(
    "r19_error_types",
    f"""WITH {REP} SELECT report_id, CASE WHEN coalesce(no_knowledge, false) THEN 'knowledge_gap' WHEN {S.strip("coalesce(answer, '')")} = '' THEN 'grading_error' WHEN coalesce(h, 0) > 0.3 THEN 'hallucination' WHEN error IS NOT NULL THEN 'fact_check_fail' ELSE 'unknown' END AS error_type FROM rp WHERE NOT coalesce(ok, true)""",
)
def error_types(spark, d):
    """The first stage, from early to late, that explains a failed run."""
    kind = F.when(F.coalesce("no_knowledge", F.lit(False)), "knowledge_gap").when(T.strip(F.coalesce("answer", F.lit(""))) == "", "grading_error").when(F.coalesce("h", F.lit(0.0)) > 0.3, "hallucination").when(F.col("error").isNotNull(), "fact_check_fail").otherwise("unknown")
    return rep(spark, d).filter(~F.coalesce("ok", F.lit(True))).select("report_id", kind.alias("error_type"))


# --- dialog ----------------------------------------------------------------------------------------

#: Words that tie a question to the dialog before it.
DIALOG_KEYS = ("功能", "堆栈", "主导", "辅助", "劣势", "排序", "认知", "MBTI", "人格")
FOLLOW_UPS = ("排序", "功能", "呢", "那")
TYPE_CODE = r"\b([IE][NS][TF][JP])\b"
STACK = r"\b([IE][NS][TF][JP])\s*[:：]?\s*([NSTF][ie])\s*[-–—/]\s*([NSTF][ie])\s*[-–—/]\s*([NSTF][ie])\s*[-–—/]\s*([NSTF][ie])\b"


def turns(spark, d):
    """Reports as turns of a dialog: one run of one question set is a conversation, in order."""
    return rep(spark, d).select("run_id", "report_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"), "generated_at")


_TURNS = f"{REP}, tn AS (SELECT run_id, report_id, coalesce(question, '') AS question, coalesce(answer, '') AS answer, generated_at, lag(coalesce(question, '')) OVER w AS prev_q, lag(coalesce(answer, '')) OVER w AS prev_a FROM rp WINDOW w AS (PARTITION BY run_id ORDER BY generated_at, report_id))"


def type_codes(c):
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("(?i)" + TYPE_CODE), 1), lambda x: F.upper(x)))


def _codes_sql(c):
    return f"list_distinct(list_transform(regexp_extract_all({c}, '(?i){TYPE_CODE}', 1), lambda x: upper(x)))"


def _has(words, c):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query(
    "r20_related_turns",
    f"""WITH {_TURNS}, k AS (SELECT *, {_codes_sql('question')} AS tq, {_codes_sql("prev_q || ' ' || prev_a")} AS tp FROM tn WHERE prev_q IS NOT NULL),
m AS (SELECT *, len(list_intersect(tq, tp)) > 0 AS shared FROM k)
SELECT report_id, question <> '' AND prev_q <> '' AND (shared OR ({_has(DIALOG_KEYS, 'question')} AND {_has(DIALOG_KEYS, 'prev_q')} AND (shared OR len(tq) = 0) AND (length(question) < 40 OR {_has(FOLLOW_UPS, 'question')}))) AS related FROM m""",
)
def related_turns(spark, d):
    """Whether a question goes on from the turn before it: a shared type code, or words of the topic in both."""
    w = Window.partitionBy("run_id").orderBy("generated_at", "report_id")
    rows = turns(spark, d).withColumn("prev_q", F.lag("question").over(w)).withColumn("prev_a", F.lag("answer").over(w)).filter("prev_q is not null")
    has = lambda c, words: F.col(c).rlike("|".join(words))
    tq, tp = type_codes(F.col("question")), type_codes(F.concat_ws(" ", "prev_q", "prev_a"))
    rows = rows.withColumn("shared", F.arrays_overlap(tq, tp)).withColumn("bare", F.size(tq) == 0)
    topic = has("question", DIALOG_KEYS) & has("prev_q", DIALOG_KEYS) & (F.col("shared") | F.col("bare")) & ((F.length("question") < 40) | has("question", FOLLOW_UPS))
    return rows.select("report_id", ((F.col("question") != "") & (F.col("prev_q") != "") & (F.col("shared") | topic)).alias("related"))


def stacks(rows, text="answer"):
    """``*, code, stack`` of every stack a text states; the last statement of a code counts."""
    group = lambda i: F.regexp_extract_all(text, F.lit("(?i)" + STACK), i)
    found = rows.withColumn("s", F.explode(F.arrays_zip(*[group(i).alias(f"g{i}") for i in range(1, 6)], F.sequence(F.lit(1), F.greatest(F.size(group(1)), F.lit(1))).alias("pos")))).filter("s.g1 is not null")
    stack = F.concat_ws("-", *[F.initcap(F.col(f"s.g{i}")) for i in range(2, 6)])
    return found.withColumn("code", F.upper("s.g1")).withColumn("stack", stack).withColumn("pos", F.col("s.pos")).drop("s")


def stack_contradictions(rows, back: int = 5):
    """Turns whose answer states another stack for a code than the latest of the ``back`` turns before it.

    ``rows(run_id, turn, answer)``. Only statements meet, by conversation and code, not whole turns.
    """
    stated = stacks(rows.select("run_id", "turn", "answer")).groupBy("run_id", "code", "turn").agg(F.max_by("stack", "pos").alias("stack"))
    before = stated.select("run_id", "code", F.col("turn").alias("old_turn"), F.col("stack").alias("old_stack"))
    pairs = stated.join(before, ["run_id", "code"]).filter((F.col("old_turn") < F.col("turn")) & (F.col("old_turn") >= F.col("turn") - back))
    latest = pairs.groupBy("run_id", "turn", "code").agg(F.max_by("old_stack", "old_turn").alias("old_stack"), F.first("stack").alias("stack"))
    return latest.filter("old_stack <> stack")


@query("r21_stack_contradictions")
def contradictions(spark, d):
    turn = F.row_number().over(Window.partitionBy("run_id").orderBy("generated_at", "report_id")).cast("long")
    return stack_contradictions(turns(spark, d).withColumn("turn", turn)).select("run_id", "turn", "code", "old_stack", "stack")
