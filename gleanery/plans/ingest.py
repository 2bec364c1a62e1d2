"""Chunking and store maintenance over the document and chunk tables."""

from pyspark.sql import functions as F

from gleanery.functions import sqltext as S
from gleanery.operators import ingest
from gleanery.plans.registry import query
from gleanery.runtime import table


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query(
    "c3_fixed_windows",
    """WITH s AS (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 800 THEN [0] ELSE range(0, greatest(0, CAST(ceil((length(text) - 100) / 700.0) AS INTEGER) - 1) * 700 + 1, 700) END) AS start FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(start / 700 AS INTEGER) + 1 AS page, start :: INTEGER AS start, substr(text, start :: INTEGER + 1, 800) AS chunk FROM s""",
)
def fixed_windows(spark, d):
    return ingest.fixed_windows(documents(spark, d))


@query(
    "c4_plain_blocks",
    f"""WITH s AS (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 500 + 1)) AS block FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, block :: INTEGER AS block, substr(text, (block * 500 + 1) :: INTEGER, 500) AS chunk FROM s) SELECT * FROM c WHERE length({S.strip('chunk')}) >= 50""",
)
def plain_blocks(spark, d):
    return ingest.plain_blocks(documents(spark, d))


@query("c1_recursive_chunks")
def recursive_chunks(spark, d):
    return ingest.recursive_chunks(documents(spark, d))


@query("s2_long_enough", "SELECT doc_id, md5(text) AS file_hash FROM documents WHERE length(text) >= 20")
def long_enough(spark, d):
    return documents(spark, d).filter(F.length("text") >= ingest.LEAST_CHARS).select("doc_id", F.md5("text").alias("file_hash"))


@query(
    "c6_best_per_name",
    """WITH f AS (SELECT source, sum(length(content)) AS size FROM (SELECT DISTINCT doc_id, source, content FROM chunks) WHERE source IS NOT NULL GROUP BY source)
SELECT lower(split_part(source, '/', -1)) AS name, source, size :: BIGINT AS size FROM (SELECT *, row_number() OVER (PARTITION BY lower(split_part(source, '/', -1)) ORDER BY starts_with(source, 'imports/') DESC, size DESC NULLS LAST, length(source), source DESC) AS t FROM f) WHERE t = 1""",
)
def best_per_name(spark, d):
    rows = table(spark, d, "chunks").filter("source is not null").select("doc_id", "source", "content").distinct()
    return ingest.best_per_name(rows.groupBy("source").agg(F.sum(F.length("content")).alias("size")), "imports/")


_OLD = "old AS (SELECT DISTINCT doc_id AS chunk_id, md5(content) AS file_hash FROM chunks WHERE page <= 3 AND content IS NOT NULL)"
_NEW = "new AS (SELECT DISTINCT doc_id AS chunk_id, CASE WHEN page = 2 THEN md5(content || '+') ELSE md5(content) END AS file_hash FROM chunks WHERE content IS NOT NULL)"


def _old_new(spark, d):
    rows = table(spark, d, "chunks").filter("content is not null")
    old = rows.filter("page <= 3").select(F.col("doc_id").alias("chunk_id"), F.md5("content").alias("file_hash")).distinct()
    new = rows.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("page") == 2, F.md5(F.concat("content", F.lit("+")))).otherwise(F.md5("content")).alias("file_hash")).distinct()
    return old, new


@query("k4_incremental_status", f"WITH {_OLD}, {_NEW} SELECT chunk_id, CASE WHEN old.file_hash IS NULL THEN 'added' WHEN new.file_hash <> old.file_hash THEN 'updated' ELSE 'skipped' END AS status FROM new LEFT JOIN old USING (chunk_id)")
def incremental_status(spark, d):
    return ingest.incremental_status(*_old_new(spark, d))


@query("k2_upsert", f"WITH {_OLD}, {_NEW}, part AS (SELECT new.* FROM new JOIN chunks c ON c.doc_id = new.chunk_id WHERE c.page >= 2 GROUP BY ALL) SELECT * FROM part UNION ALL SELECT * FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM part)")
def upsert(spark, d):
    old, new = _old_new(spark, d)
    part = new.join(table(spark, d, "chunks").filter("page >= 2").select(F.col("doc_id").alias("chunk_id")).distinct(), "chunk_id", "left_semi")
    return ingest.upsert(old, part, "chunk_id")


@query("k7_delete_ids", f"WITH {_OLD} SELECT * FROM old WHERE chunk_id NOT IN (SELECT doc_id FROM chunks WHERE page = 1)")
def delete_ids(spark, d):
    gone = table(spark, d, "chunks").filter("page = 1").select(F.col("doc_id").alias("chunk_id"))
    return ingest.delete_ids(_old_new(spark, d)[0], gone, "chunk_id")


@query("k3_replace_page", "SELECT DISTINCT doc_id, source, CASE WHEN content IS NULL THEN 0 ELSE page END AS page FROM chunks")
def replace_page(spark, d):
    """Rows that are written anew get page 0: delete and insert."""
    rows = table(spark, d, "chunks").select("doc_id", "source", "page", "content").distinct()
    renewed = rows.filter("content is null").withColumn("page", F.lit(0))
    return ingest.upsert(rows, renewed, "doc_id").select("doc_id", "source", "page").distinct()


@query("k9_a31_collections", "SELECT collection, count(DISTINCT doc_id) AS n_docs, count(DISTINCT source) AS n_sources FROM chunks GROUP BY ROLLUP (collection)")
def collections(spark, d):
    return table(spark, d, "chunks").rollup("collection").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("source").alias("n_sources"))


@query(
    "k11_resume_decisions",
    """WITH n AS (SELECT source, count(DISTINCT doc_id) AS total, count(DISTINCT doc_id) FILTER (page <= 3) AS existing, count(DISTINCT doc_id) FILTER (page <= 8) AS ckpt FROM chunks WHERE source IS NOT NULL GROUP BY source)
SELECT source, CASE WHEN existing > 1.15 * total THEN 'rebuild' WHEN existing >= greatest(1.0, 0.98 * total) THEN 'skip' WHEN existing < greatest(1.0, 0.05 * total) AND ckpt > 0 THEN 'reset' WHEN ckpt > 2 * existing AND existing > 0 THEN 'restart' ELSE 'resume' END AS decision FROM n""",
)
def resume_decisions(spark, d):
    counted = table(spark, d, "chunks").filter("source is not null").groupBy("source").agg(
        F.count_distinct("doc_id").alias("total"), F.count_distinct(F.when(F.col("page") <= 3, F.col("doc_id"))).alias("existing"), F.count_distinct(F.when(F.col("page") <= 8, F.col("doc_id"))).alias("ckpt")
    )
    return counted.select("source", ingest.resume_decision(F.col("existing"), F.col("total"), F.col("ckpt")).alias("decision"))


@query(
    "k17_new_paths",
    "WITH c AS (SELECT DISTINCT doc_id, source FROM chunks WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM kb_documents WHERE source IS NOT NULL)) SELECT * FROM c WHERE source IN (SELECT source FROM c GROUP BY source HAVING count(*) <= 12)",
)
def new_paths(spark, d):
    rows = table(spark, d, "chunks").filter("source is not null").select("doc_id", "source").distinct()
    return ingest.new_paths(rows, table(spark, d, "kb_documents").filter("source is not null"), 12)


@query("k13_block_lookup", "SELECT block, count(*) AS n_rows, min(doc_id) AS first_id FROM (SELECT doc_id, (doc_id - 1) // 100 AS block FROM documents) GROUP BY block")
def block_lookup(spark, d):
    """Metadata blocks of fixed size: the block number is the partition column point lookups prune on."""
    rows = table(spark, d, "documents").select("doc_id", F.floor((F.col("doc_id") - 1) / 100).alias("block"))
    return rows.groupBy("block").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_id"))


@query(
    "c11_question_split",
    """WITH k AS (SELECT id, md5(id :: VARCHAR || ':split') AS h FROM qa_set WHERE query IS NOT NULL AND length(query) > 5 AND category IS DISTINCT FROM 'chitchat'),
r AS (SELECT id, row_number() OVER (ORDER BY h, id) AS n, count(*) OVER () AS total FROM k) SELECT id, CASE WHEN n <= floor(0.8 * total) THEN 'train' ELSE 'test' END AS part FROM r""",
)
def question_split(spark, d):
    """80/20 split in hash order; the question set is a fixed, small table."""
    kept = table(spark, d, "qa_set").filter("query is not null and length(query) > 5 and not (category <=> 'chitchat')").select("id", F.md5(F.concat(F.col("id").cast("string"), F.lit(":split"))).alias("h"))
    n = F.floor(0.8 * F.col("total"))
    total = kept.agg(F.count(F.lit(1)).alias("total"))
    from pyspark.sql.window import Window

    ranked = kept.withColumn("n", F.row_number().over(Window.orderBy("h", "id")))
    return ranked.crossJoin(F.broadcast(total)).select("id", F.when(F.col("n") <= n, "train").otherwise("test").alias("part"))  # one row
