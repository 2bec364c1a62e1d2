"""Sources and sinks: files, JSON, feeds and reports written from the tables and read again, store maintenance."""

from pyspark.sql import functions as F

from gleanery.operators import ingest, lexical
from gleanery.plans.registry import query
from gleanery.plans.retrieval import BM, documents, text_queries
from gleanery.runtime import scratch, table
from gleanery.sources import files
from gleanery.streaming import stateful

# --- scans -----------------------------------------------------------------------------------------

#: A source's documents become one file; its name decides the folder and the extension.
_FILES = """fl AS (SELECT coalesce(source, 'none') AS source, length(coalesce(source, 'none')) AS n, sum(strlen(coalesce(text, '')) + 1) :: BIGINT AS bytes FROM documents GROUP BY ALL),
fk AS (SELECT source, bytes, (['md', 'txt', 'log', 'py'])[n % 4 + 1] AS ext, CASE WHEN n % 5 = 0 THEN 'node_modules' WHEN n % 7 = 0 THEN 'books' ELSE 'docs' END AS folder, CASE WHEN n % 6 = 0 THEN 'credentials_' ELSE '' END AS prefix FROM fl)"""


def source_files(spark, d):
    """Write the documents of each source to a text file and return the folder of all of them."""
    root = scratch(spark, "files")
    rows = table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("text", F.lit("")).alias("value"))
    rows.repartition(1).write.partitionBy("source").text(f"{root}/raw")  # one file a source: the small fixture of a scan
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in rows.select("source").distinct().collect():  # names of sources
        n = len(r["source"])
        folder = "node_modules" if n % 5 == 0 else "books" if n % 7 == 0 else "docs"
        name = ("credentials_" if n % 6 == 0 else "") + r["source"] + "." + ("md", "txt", "log", "py")[n % 4]
        fs.mkdirs(path(f"{root}/tree/{folder}"))
        part = next(s.getPath() for s in fs.listStatus(path(f"{root}/raw/source={r['source']}")) if s.getPath().getName().startswith("part-"))
        fs.rename(part, path(f"{root}/tree/{folder}/{name}"))
    return f"{root}/tree"


_LIMITS = {"least": 2000, "most": 40_000, "skip_dirs": ("node_modules",), "special": {"books": 400_000}}
_OUTCOME = "CASE WHEN prefix <> '' THEN 'secret' WHEN folder = 'node_modules' THEN 'directory' WHEN ext NOT IN ('md', 'txt', 'py') THEN 'extension' WHEN bytes < 2000 THEN 'too_small' WHEN bytes > CASE WHEN folder = 'books' THEN 400000 ELSE 40000 END THEN 'too_large' ELSE 'kept' END"


@query("s1_s3_scanned_files", f"WITH {_FILES} SELECT prefix || source || '.' || ext AS name, ext AS extension, bytes AS n_bytes, {_OUTCOME} AS outcome FROM fk")
def scanned_files(spark, d):
    """Extensions, hidden and secret names, folders and sizes decide; no content is read."""
    scanned = files.scan_files(spark, source_files(spark, d), **_LIMITS)
    return scanned.select("name", "extension", F.col("length").alias("n_bytes"), F.coalesce("skipped", F.lit("kept")).alias("outcome"))


@query("s3_s4_scan_counters", f"WITH {_FILES} SELECT {_OUTCOME} AS outcome, count(*) AS n_files, sum(bytes) :: BIGINT AS n_bytes FROM fk GROUP BY ALL")
def scan_counters(spark, d):
    return files.scan_counts(files.scan_files(spark, source_files(spark, d), **_LIMITS))


@query("s5_decoded_files", f"WITH {_FILES}, k AS (SELECT * FROM fk WHERE {_OUTCOME} = 'kept') SELECT prefix || source || '.' || ext AS name, bytes AS n_bytes FROM k")
def decoded_files(spark, d):
    """Contents of the kept files, of which only these were read."""
    kept = files.decode_files(files.read_files(spark, source_files(spark, d), **{k: v for k, v in _LIMITS.items() if k != "least"}, least=_LIMITS["least"]))
    return kept.select(F.element_at(F.split("source", "/"), -1).alias("name"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("s9_json_lines", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def json_lines(spark, d):
    """A log of one JSON object a line, written and scanned with its schema."""
    path = scratch(spark, "jsonl")
    table(spark, d, "events").select("event_id", "user_id", "event_type", "value").write.json(path)
    log = spark.read.schema("event_id long, user_id long, event_type string, value double").json(path)
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("user_id").alias("n_users"))


@query("s10_json_arrays", "SELECT id, query, len(expected_contains) :: INTEGER AS n_expected FROM qa_set")
def json_arrays(spark, d):
    """A file that is one JSON array (the fixed question set), read as a table."""
    path = scratch(spark, "array")
    rows = table(spark, d, "qa_set").select("id", "query", "expected_contains")
    rows.agg(F.to_json(F.collect_list(F.struct("id", "query", "expected_contains"))).alias("value")).coalesce(1).write.text(path)
    return spark.read.schema("id int, query string, expected_contains array<string>").option("multiLine", "true").json(path).select("id", "query", F.size("expected_contains").alias("n_expected"))


@query("s14_stored_vectors", "SELECT vec_id, label, round(embedding[1] :: DOUBLE, 6) AS first_value, len(embedding) :: INTEGER AS dims FROM embeddings")
def stored_vectors(spark, d):
    """A vector store written by label and read back."""
    path = scratch(spark, "vectors")
    table(spark, d, "embeddings").write.partitionBy("label").parquet(path)
    return spark.read.parquet(path).select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"), F.size("embedding").alias("dims"))


# --- sinks -----------------------------------------------------------------------------------------


def _kb(spark, d):
    return table(spark, d, "kb_documents").select("id", "source", F.md5(F.coalesce("content", F.lit(""))).alias("file_hash"))


_KB = "kb AS (SELECT id, source, md5(coalesce(content, '')) AS file_hash FROM kb_documents)"


@query("k1_appended", f"WITH {_KB} SELECT * FROM kb WHERE id < 'KB-0000000200' UNION ALL SELECT * FROM kb WHERE id >= 'KB-0000000200'")
def appended(spark, d):
    path = scratch(spark, "append")
    for part in ("id < 'KB-0000000200'", "id >= 'KB-0000000200'"):
        ingest.append(_kb(spark, d).filter(part), path)
    return spark.read.parquet(path)


@query("k5_indexed_once", f"WITH {_KB} SELECT * FROM kb")
def indexed_once(spark, d):
    """Filling a store a second time leaves it as it is."""
    path = scratch(spark, "once")
    if not ingest.index_once(_kb(spark, d), path) or ingest.index_once(_kb(spark, d), path):
        raise AssertionError("a store is filled once")
    return spark.read.parquet(path)


@query("k6_dual_store", f"WITH {_KB} SELECT * FROM kb")
def dual_store(spark, d):
    """Written to two stores; when the first is gone the second answers."""
    first, second = scratch(spark, "first"), scratch(spark, "second")
    ingest.write_both(_kb(spark, d), (first, second))
    return ingest.read_either(spark, (first + "-gone", second))


@query("k8_updated_collection", f"WITH {_KB}, ad AS (SELECT id, 'new' AS source, file_hash FROM kb WHERE id LIKE '%5' UNION ALL SELECT 'X' || id, source, file_hash FROM kb WHERE id LIKE '%7') SELECT * FROM kb WHERE id NOT LIKE '%9' AND id NOT IN (SELECT id FROM ad) UNION ALL SELECT * FROM ad")
def updated_collection(spark, d):
    kb = _kb(spark, d)
    additions = kb.filter("id like '%5'").withColumn("source", F.lit("new")).unionByName(kb.filter("id like '%7'").withColumn("id", F.concat(F.lit("X"), "id")))
    return ingest.update_collection(kb, additions, kb.filter("id like '%9'").select("id"), "id")


@query("k10_cleared", "SELECT 0 :: BIGINT AS n_rows, 3 :: INTEGER AS n_columns")
def cleared(spark, d):
    path = scratch(spark, "clear")
    kb = _kb(spark, d)
    ingest.append(kb, path)
    ingest.clear(spark, path, kb.schema)
    left = spark.read.parquet(path)
    return left.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(left.columns)))


@query("k12_stored_index_top20", f"WITH {BM} SELECT * FROM bm WHERE rank <= 20")
def stored_index_top20(spark, d):
    """The lexical index written, read back and searched: folders of the queries' terms only."""
    path = scratch(spark, "lexical")
    lexical.write_index(documents(spark, d), path)
    return lexical.search_index(text_queries(spark, d), path)


_CHANGED = BM.replace("FROM documents WHERE text IS NOT NULL)", "FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 3 THEN text || ' ' || coalesce(title, '') ELSE text END AS text FROM documents WHERE doc_id % 40 <> 7) WHERE text IS NOT NULL)", 1)


@query("l3_updated_index_top20", f"WITH {_CHANGED} SELECT * FROM bm WHERE rank <= 20")
def updated_index_top20(spark, d):
    """The index after documents were replaced and removed equals one made anew."""
    path, into = scratch(spark, "lexical"), scratch(spark, "lexical")
    docs = table(spark, d, "documents")
    lexical.write_index(docs.select("doc_id", "text"), path)
    changed = docs.filter("doc_id % 50 = 3 and doc_id % 40 <> 7").select("doc_id", F.concat_ws(" ", "text", F.coalesce("title", F.lit(""))).alias("text")).filter("text is not null")
    lexical.update_index(path, into, changed, docs.filter("doc_id % 40 = 7").select("doc_id"))
    return lexical.search_index(text_queries(spark, d), into)


@query("k13_point_lookups", "SELECT doc_id, source, n_chars, doc_id // 100 AS block FROM documents WHERE doc_id IN (3, 57, 250, 251, 999)")
def point_lookups(spark, d):
    """One and many ids out of blocks: only their folders are read."""
    path = scratch(spark, "blocks")
    ingest.write_blocks(table(spark, d, "documents").select("doc_id", "source", "n_chars"), path, "doc_id", 100)
    return ingest.lookup(spark, path, "doc_id", [3, 57, 250, 251, 999], 100).select("doc_id", "source", "n_chars", F.col("block").cast("long").alias("block"))


@query("k14_migrated", "SELECT count(*) AS before, count(*) AS after FROM chunks")
def migrated(spark, d):
    """A store copied to another, counted and compared by row hashes."""
    rows = table(spark, d, "chunks").withColumn("metadata", F.to_json("metadata"))
    n = ingest.migrate(rows, scratch(spark, "migrate"))
    return spark.createDataFrame([(n["before"], n["after"])], "before long, after long")


@query("k15_kept_history", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS t FROM events) WHERE t <= 10")
def kept_history(spark, d):
    """An audit log appended as JSON lines in two runs, rewritten to the last ten entries of each user."""
    path = scratch(spark, "audit")
    rows = table(spark, d, "events").select("event_id", "user_id", "ts")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        rows.filter(part).write.mode("append").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    log = spark.read.schema("event_id long, user_id long, ts timestamp_ntz").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return ingest.keep_last(log, "user_id", [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id")


@query("k16_report_export", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def report_export(spark, d):
    """A report written as CSV with a header, as a spreadsheet opens it, and read back."""
    path = scratch(spark, "report")
    report = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    report.coalesce(1).write.option("header", "true").csv(path)
    return spark.read.option("header", "true").schema("event_type string, n long, mean double").csv(path)


# --- streams ---------------------------------------------------------------------------------------


@query("st7_streamed_ingest", "SELECT id AS chunk_id, md5(coalesce(content, '')) AS file_hash, CASE WHEN id LIKE '%5' THEN 2 ELSE 1 END AS version FROM kb_documents WHERE content IS NOT NULL")
def streamed_ingest(spark, d):
    """Chunks arrive as files in two runs; a changed hash replaces the stored row, an equal one is skipped."""
    return stateful.hash_ingest(spark, table(spark, d, "kb_documents").filter("content is not null").select(F.col("id").alias("chunk_id"), F.coalesce("content", F.lit("")).alias("content")), F.col("chunk_id").like("%5"))


@query("st2_cached_sessions", "WITH e AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(*) AS lookups, count(*) FILTER (before IS NOT NULL AND ts - before <= INTERVAL 3600 SECOND) AS hits FROM e GROUP BY user_id")
def cached_sessions(spark, d):
    """Lookups of a cache whose entries live an hour after their last use."""
    return stateful.ttl_hits(table(spark, d, "events"), "user_id", 3600)


#: Base, factor and ceiling of the delay before a retry, in seconds.
BACKOFF = (1.0, 2.0, 10.0)


@query("st4_backoff_delays", "SELECT report_id, t AS retry, least(10.0, 1.0 * pow(2.0, t - 1)) AS delay_s FROM (SELECT DISTINCT report_id FROM e2e_report WHERE NOT ok), (VALUES (1), (2), (3), (4), (5)) v(t)")
def backoff_delays(spark, d):
    """Delays of the retries of failed calls; the retries themselves are Spark's."""
    base, factor, most = BACKOFF
    failed = table(spark, d, "e2e_report").filter(~F.col("ok")).select("report_id").distinct()
    rows = failed.select("report_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("retry"))
    return rows.select("report_id", "retry", F.least(F.lit(most), base * F.pow(F.lit(factor), F.col("retry") - 1)).alias("delay_s"))


@query("st6_topic_states", "SELECT event_type AS topic, count(*) AS n_messages, max_by(value, (ts, event_id)) AS last_value, max(ts) AS last_at FROM events GROUP BY event_type")
def topic_states(spark, d):
    """Shared state of a bus: what was published last under each topic."""
    return stateful.topic_states(table(spark, d, "events"))


@query("st8_paced_ingest", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def paced_ingest(spark, d):
    """Files taken a few at a time: the reader waits for the writer, and every row arrives once."""
    source, sink, mark = scratch(spark, "arrivals"), scratch(spark, "sink"), scratch(spark, "offsets")
    table(spark, d, "events").select("event_type", "value").repartition(6).write.parquet(source)
    stream = spark.readStream.schema("event_type string, value double").option("maxFilesPerTrigger", "2").parquet(source)
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
