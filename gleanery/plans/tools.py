"""Queries through the catalogue of tools: execution by name, its listing, strategies and bounded rounds."""

from pyspark.sql import functions as F

from gleanery.functions import sqltext as S
from gleanery.functions import text as T
from gleanery.operators import catalogue, lexical, rules
from gleanery.plans.registry import query
from gleanery.plans.retrieval import BM, documents, text_queries
from gleanery.plans.rules import QUESTIONS, questions
from gleanery.runtime import cut_lineage


def standard(spark, d) -> catalogue.Catalogue:
    """The search tools over one set of documents."""
    c = catalogue.Catalogue(resources={"documents": documents(spark, d)})

    @c.tool("BM25 over whole texts")
    def text_search(queries, documents, k: int = 5):
        return lexical.bm25(queries, documents, k)

    @c.tool("dot product of hashed term counts")
    def sparse_search(queries, documents, k: int = 5):
        return lexical.sparse_top(queries, documents, k)

    @c.tool("documents of the given ids", category="analysis")
    def fetch(queries, documents):
        return documents.join(queries.select(F.col("qid").alias("doc_id")), "doc_id", "left_semi")

    @c.tool("an empty set of documents", category="maintenance", risk="DANGEROUS")
    def drop_all(documents):
        return documents.limit(0)

    @c.strategy("router", "by_pattern")
    def by_pattern(question):
        return rules.tool_route.column(question)

    @c.strategy("router", "by_kind")
    def by_kind(question):
        return rules.question_type.column(question)

    @c.strategy("compressor", "opening")
    def opening(text):
        return F.substring(text, 1, 100)

    @c.strategy("compressor", "first_sentence")
    def first_sentence(text):
        return F.coalesce(F.get(T.sentences(text, "。\\n！？.!?", 0), F.lit(0)), F.lit(""))

    return c


@query("u1_executed_search", f"WITH {BM} SELECT qid, doc_id, rank FROM bm WHERE rank <= 3")
def executed_search(spark, d):
    """A tool run by its name, with a parameter."""
    return standard(spark, d).execute("text_search", text_queries(spark, d), k=3).select("qid", "doc_id", "rank")


@query("u2_tool_listing", "SELECT * FROM (VALUES ('text_search', 'retrieval', 'SAFE', '1.0', 1), ('sparse_search', 'retrieval', 'SAFE', '1.0', 1), ('fetch', 'analysis', 'SAFE', '1.0', 0), ('drop_all', 'maintenance', 'DANGEROUS', '1.0', 0)) t(name, category, risk, version, n_parameters)")
def tool_listing(spark, d):
    return standard(spark, d).listing(spark)


@query("u4_strategies", f"WITH {QUESTIONS} SELECT q, {rules.tool_route.sql('q')} AS by_pattern, {rules.question_type.sql('q')} AS by_kind, substr(q, 1, 100) AS opening, coalesce({S.sentences('q', '。\\n！？.!?', 0)}[1], '') AS first_sentence FROM qs")
def strategies(spark, d):
    """Routers and compressors picked by name: each is a column."""
    c = standard(spark, d)
    return questions(spark, d).select("q", *[c.pick(kind, name)(F.col("q")).alias(name) for kind, name in c.strategies])


@query(
    "u6_bounded_rounds",
    f"WITH {BM}, f AS (SELECT qid, doc_id, rank FROM bm WHERE rank <= 5 AND score > 14), x AS (SELECT qid, doc_id, rank FROM bm WHERE rank <= 5 AND qid NOT IN (SELECT qid FROM f)) SELECT *, 0 AS round_no FROM f UNION ALL SELECT *, 1 FROM x",
)
def two_rounds(spark, d):
    """Sure hits first; the questions still open take what the search has in a second round."""
    c = catalogue.Catalogue(resources={"hits": cut_lineage(lexical.bm25(text_queries(spark, d), documents(spark, d), 5))})

    @c.tool("hits over a score")
    def sure(queries, hits):
        return hits.join(queries.select("qid"), "qid", "left_semi").filter("score > 14").select("qid", "doc_id", "rank", F.lit(0).alias("round_no"))

    @c.tool("all hits")
    def every(queries, hits):
        return hits.join(queries.select("qid"), "qid", "left_semi").select("qid", "doc_id", "rank", F.lit(1).alias("round_no"))

    return catalogue.bounded_rounds(text_queries(spark, d), c, lambda asked, n: [(("sure", "every")[n], asked)], 2)
