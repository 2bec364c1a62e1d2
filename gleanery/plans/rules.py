"""Question rules, filters and text primitives over the question and document tables."""

from pyspark.sql import functions as F

from gleanery.functions import sqltext as S
from gleanery.functions import text as T
from gleanery.operators import rules
from gleanery.operators.lexical import rank_within
from gleanery.plans.registry import query
from gleanery.runtime import table

QUESTIONS = "qs AS (SELECT DISTINCT question AS q FROM (SELECT question FROM e2e_set UNION ALL SELECT query FROM qa_set UNION ALL SELECT question FROM e2e_report UNION ALL SELECT query FROM benchmark_results) WHERE question IS NOT NULL)"


def questions(spark, d):
    parts = [("e2e_set", "question"), ("qa_set", "query"), ("e2e_report", "question"), ("benchmark_results", "query")]
    out = None
    for name, column in parts:
        one = table(spark, d, name).select(F.col(column).alias("q"))
        out = one if out is None else out.unionByName(one)
    return out.filter("q is not null").distinct()


def _typed(sql, decision):
    return f"CAST({sql} AS DOUBLE)" if isinstance(decision.default, float) else sql


def _decision(name, **columns):
    """A query with one column per decision over all distinct questions."""
    sql = f"WITH {QUESTIONS} SELECT q, {', '.join(f'{_typed(c.sql(S.strip("q")), c)} AS {k}' for k, c in columns.items())} FROM qs"

    @query(name, sql)
    def run(spark, d):
        q = T.strip("q")
        return questions(spark, d).select("q", *[c.column(q).alias(k) for k, c in columns.items()])


_decision("r1_question_type", question_type=rules.question_type)
_decision("r3_retrieval_need", need=rules.retrieval_need)
_decision("r4_realtime", reason=rules.realtime)
_decision("r5_query_verdict", verdict=rules.query_verdict)
_decision("r6_intent", intent=rules.intent, intent_confidence=rules.intent_confidence, detail=rules.knowledge_intent, detail_confidence=rules.knowledge_confidence)
_decision("r11_tool_route", tool=rules.tool_route)


@query(
    "r1_sub_queries",
    f"""WITH {QUESTIONS}, t AS (SELECT {S.strip('q')} AS s, {rules.question_type.sql(S.strip('q'))} AS kind, {S.strip(f"regexp_replace({S.strip('q')}, '{rules.FILLER_WORDS}', '', 'g')")} AS r FROM qs)
SELECT s AS q, array_to_string(list_concat([CASE WHEN r = '' THEN s ELSE r END],
  CASE kind WHEN 'comparison' THEN list_filter(list_transform(regexp_split_to_array(s, '[和与vs对比比较]'), lambda p: {S.strip('p')}), lambda p: length(p) > 3)
            WHEN 'reasoning' THEN [r || ' 概念 定义', r || ' 原理 机制'] ELSE [] END)[1:3], ' | ') AS parts FROM t""",
)
def sub_queries(spark, d):
    s = T.strip("q")
    r = T.strip(F.regexp_replace(s, rules.FILLER_WORDS, ""))
    kind = rules.question_type.column(s)
    split = F.filter(F.transform(F.split(s, "[和与vs对比比较]"), lambda p: T.strip(p)), lambda p: F.length(p) > 3)
    extra = F.when(kind == "comparison", split).when(kind == "reasoning", F.array(F.concat(r, F.lit(" 概念 定义")), F.concat(r, F.lit(" 原理 机制")))).otherwise(F.array().cast("array<string>"))
    return questions(spark, d).select(s.alias("q"), F.array_join(F.slice(F.concat(F.array(F.when(r == "", s).otherwise(r)), extra), 1, 3), " | ").alias("parts"))


@query("r26_error_class", f"SELECT report_id, {rules.error_class.sql('error')} AS error_class FROM (SELECT DISTINCT report_id, error FROM e2e_report WHERE error IS NOT NULL)")
def error_class(spark, d):
    errors = table(spark, d, "e2e_report").filter("error is not null").select("report_id", "error").distinct()
    return errors.select("report_id", rules.error_class.column(F.col("error")).alias("error_class"))


# --- text primitives -------------------------------------------------------------------------------

DOCS = "documents"


@query("t2_mixed_tokens", f"SELECT doc_id, unnest({S.mixed_tokens('text')}) AS token FROM documents WHERE text IS NOT NULL")
def mixed_tokens(spark, d):
    return table(spark, d, DOCS).filter("text is not null").select("doc_id", F.explode(T.mixed_tokens("text")).alias("token"))


@query("t3_t4_keywords", f"SELECT doc_id, count(*) AS n_keywords, count(DISTINCT w) AS n_distinct FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array({S.strip('lower(text)')}, '{S.SPACE}+'), lambda w: length(w) > 1 AND NOT list_contains({S.values(T.KEYWORD_STOPS)}, w))) AS w FROM documents) GROUP BY doc_id")
def keyword_counts(spark, d):
    words = table(spark, d, DOCS).select("doc_id", F.explode(T.keywords("text")).alias("w"))
    return words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_keywords"), F.count_distinct("w").alias("n_distinct"))


@query("t5_pair_coverage", f"""WITH n AS (SELECT doc_id, regexp_replace(title, '{S.SPACE}+', '', 'g') AS a, regexp_replace(text, '{S.SPACE}+', '', 'g') AS b FROM documents WHERE title IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, CAST(i AS INTEGER), 2))) AS a, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, CAST(i AS INTEGER), 2))) AS b FROM n)
SELECT doc_id, round({S.coverage('a', 'b')}, 6) AS coverage FROM p""")
def pair_coverage(spark, d):
    docs = table(spark, d, DOCS).filter("title is not null and text is not null")
    return docs.select("doc_id", F.round(T.coverage(T.char_pairs("title"), T.char_pairs("text")), 6).alias("coverage"))


_SENT = "。\\n.！？"


@query("t6_sentences", f"SELECT doc_id, len({S.sentences('text', _SENT, 10)}) :: INTEGER AS n_sentences, list_max(list_transform({S.sentences('text', _SENT, 10)}, lambda s: length(s))) :: INTEGER AS longest FROM documents WHERE text IS NOT NULL")
def sentence_counts(spark, d):
    parts = T.sentences("text", _SENT, 10)
    return table(spark, d, DOCS).filter("text is not null").select("doc_id", F.size(parts).alias("n_sentences"), F.array_max(F.transform(parts, lambda s: F.length(s))).alias("longest"))


@query(
    "t7_c2_token_estimates",
    f"SELECT doc_id, floor(1.5 * {S.han_count('text')} + 0.25 * (length(text) - {S.han_count('text')})) :: BIGINT AS by_script, floor(length(text) * 1.3 :: DOUBLE + 1e-9) :: BIGINT AS by_length FROM documents WHERE text IS NOT NULL",
)
def token_estimates(spark, d):
    return table(spark, d, DOCS).filter("text is not null").select("doc_id", T.token_estimate_rounded("text").alias("by_script"), T.token_estimate_length("text").alias("by_length"))


@query("t9_clean_query", f"WITH {QUESTIONS} SELECT q, regexp_replace({S.strip(f"regexp_replace(q, '{S.SPACE}+', ' ', 'g')")}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s\\x{{4e00}}-\\x{{9fff}}]', ' ', 'g') AS cleaned FROM qs")
def clean_query(spark, d):
    return questions(spark, d).select("q", T.clean_query("q").alias("cleaned"))


@query(
    "s12_strip_html",
    f"""SELECT doc_id, md5({S.strip(f"regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '{S.SPACE}+', ' ', 'g')")}) AS plain_md5
FROM (SELECT DISTINCT doc_id, content FROM chunks WHERE content IS NOT NULL)""",
)
def strip_html(spark, d):
    return table(spark, d, "chunks").filter("content is not null").select("doc_id", "content").distinct().select("doc_id", F.md5(T.strip_html("content")).alias("plain_md5"))


@query(
    "id_rules",
    """SELECT doc_id, substr(md5(source || ':' || (page - 1) :: VARCHAR), 1, 12) AS chunk_id, substr(md5(source || ':' || (page - 1) :: VARCHAR || ':' || substr(content, 1, 50)), 1, 12) AS content_id,
CAST('0x' || substr(md5(doc_id), 1, 15) AS BIGINT) AS point_id, md5(content) AS content_hash FROM (SELECT DISTINCT doc_id, source, page, content FROM chunks) WHERE content IS NOT NULL AND source IS NOT NULL AND page IS NOT NULL""",
)
def id_rules(spark, d):
    rows = table(spark, d, "chunks").filter("content is not null and source is not null and page is not null").select("doc_id", "source", "page", "content").distinct()
    ordinal = (F.col("page") - 1).cast("string")
    return rows.select("doc_id", T.short_id("source", ordinal).alias("chunk_id"), T.short_id("source", ordinal, F.substring("content", 1, 50)).alias("content_id"), T.numeric_id("doc_id").alias("point_id"), F.md5("content").alias("content_hash"))


# --- filters and orderings -------------------------------------------------------------------------

_DENIED = " OR ".join(f"contains(lower(replace(source, chr(92), '/')), '{w}')" for w in ("draft", *rules.DENIED_SOURCES))


@query(
    "f3_source_filter",
    f"""WITH c AS (SELECT DISTINCT doc_id, source, collection FROM chunks), k AS (SELECT *, NOT ({_DENIED}) AS keep FROM c WHERE source IS NOT NULL)
SELECT doc_id, source, collection FROM (SELECT *, bool_or(keep) OVER (PARTITION BY collection) AS has_kept FROM k) WHERE keep OR NOT has_kept""",
)
def source_filter(spark, d):
    """Rows of denied sources go, unless that would leave the group empty."""
    rows = table(spark, d, "chunks").filter("source is not null").select("doc_id", "source", "collection").distinct()
    path = F.lower(F.replace("source", F.lit("\\"), F.lit("/")))
    denied = F.lit(False)
    for word in ("draft", *rules.DENIED_SOURCES):
        denied = denied | F.contains(path, F.lit(word))
    # Whether a group keeps any row is an aggregate of one row per group, joined back: no group is gathered.
    flagged = rows.withColumn("keep", ~denied)
    some = flagged.groupBy(F.col("collection").alias("grp")).agg(F.max("keep").alias("some"))
    return flagged.join(some, F.col("collection").eqNullSafe(F.col("grp"))).filter("keep or not some").select("doc_id", "source", "collection")


def _injected(space):
    return rf"(?i)ignore{space}+(?:all{space}+)?previous{space}+instructions|system{space}*:{space}*you{space}+are|<{space}*/?{space}*system{space}*>"


#: Characters of a question that are kept.
QUESTION_CHARS = 4000


def guarded(rows, limit=QUESTION_CHARS):
    """``q, kept, was_cut, suspicious, had_nul, is_blank``: trimmed, cut at ``limit``, searched for injections, freed of NULs."""
    s = T.strip("q")
    cut = F.substring(s, 1, limit)
    return rows.select("q", F.translate(cut, "\u0000", "").alias("kept"), (F.length(s) > limit).alias("was_cut"), cut.rlike(_injected(r"(?U:\s)")).alias("suspicious"), F.contains(cut, F.lit("\u0000")).alias("had_nul"), (s == "").alias("is_blank"))


@query(
    "f10_question_guard",
    f"WITH {QUESTIONS}, c AS (SELECT q, {S.strip('q')} AS s, substr({S.strip('q')}, 1, {QUESTION_CHARS}) AS cut FROM qs) SELECT q, replace(cut, chr(0), '') AS kept, length(s) > {QUESTION_CHARS} AS was_cut, regexp_matches(cut, '{_injected(S.SPACE)}') AS suspicious, contains(cut, chr(0)) AS had_nul, s = '' AS is_blank FROM c",
)
def question_guard(spark, d):
    return guarded(questions(spark, d))


@query(
    "f8_exact_ids",
    r"""WITH t AS (SELECT doc_id, unnest(list_distinct(list_concat(regexp_extract_all(text, '(?:ID|id|编号|版本|文档)[\s:：]*([A-Za-z0-9\-_]{2,})', 1), regexp_extract_all(text, '\b([A-Z]{2,}[\-_]\d{2,})\b', 1)))) AS found FROM documents)
SELECT t.doc_id, found, kb.source IS NOT NULL AS known FROM t LEFT JOIN kb_documents kb ON kb.id = t.found""",
)
def exact_ids(spark, d):
    pattern = r"(?:ID|id|编号|版本|文档)[\s:：]*([A-Za-z0-9\-_]{2,})"
    found = F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(pattern), 1), F.regexp_extract_all("text", F.lit(r"\b([A-Z]{2,}[\-_]\d{2,})\b"), 1)))
    ids = table(spark, d, DOCS).select("doc_id", F.explode(found).alias("found"))
    return ids.join(table(spark, d, "kb_documents").select(F.col("id").alias("found"), "source"), "found", "left").select("doc_id", "found", F.col("source").isNotNull().alias("known"))


@query(
    "o4_first_by_opening",
    "SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY substr(content, 1, 100) ORDER BY id) AS turn FROM kb_documents) WHERE turn = 1",
)
def first_by_opening(spark, d):
    """One row per opening of 100 characters: an aggregate, so equal openings combine before the shuffle."""
    rows = table(spark, d, "kb_documents").select("id", "source", F.substring("content", 1, 100).alias("opening"))
    first = rows.groupBy("opening").agg(F.min(F.struct("id", "source")).alias("r"))
    return first.select("r.id", "r.source")


@query("o9_latest_per_question", "SELECT report_id, id, generated_at FROM (SELECT report_id, id, any_value(generated_at) AS generated_at, row_number() OVER (PARTITION BY id ORDER BY any_value(generated_at) DESC, report_id DESC) AS turn FROM e2e_report WHERE id IS NOT NULL GROUP BY report_id, id) WHERE turn <= 3")
def latest_per_question(spark, d):
    rows = table(spark, d, "e2e_report").filter("id is not null").select("report_id", "id", "generated_at").dropDuplicates(["report_id"])
    return rank_within(rows, "id", [F.desc("generated_at"), F.desc("report_id")], 3).select("report_id", "id", "generated_at")


@query(
    "f12_question_search",
    f"WITH {QUESTIONS} SELECT q FROM qs WHERE contains(lower(q), '权重') OR contains(lower(q), 'cache')",
)
def question_search(spark, d):
    return questions(spark, d).filter(F.contains(F.lower("q"), F.lit("权重")) | F.contains(F.lower("q"), F.lit("cache")))
