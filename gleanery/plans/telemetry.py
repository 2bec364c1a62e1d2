"""Operational telemetry, graph lookups and event-time windows."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.operators import graph, rules
from gleanery.plans.evaluation import reports
from gleanery.plans.registry import query
from gleanery.runtime import table
from gleanery.streaming import stateful


def events(spark, d):
    return table(spark, d, "events")


def bench(spark, d):
    return table(spark, d, "benchmark_results").dropDuplicates(["bench_id"])


BENCH = "br AS (SELECT bench_id, any_value(model) AS model, any_value(latency) AS latency, any_value(success) AS success, any_value(input_tokens) AS input_tokens, any_value(output_tokens) AS output_tokens, any_value(finished_at) AS finished_at FROM benchmark_results GROUP BY bench_id)"
REPORTS = "rp AS (SELECT report_id, any_value(id) AS id, any_value(question) AS question, any_value(run_id) AS run_id, any_value(latency_ms) AS latency_ms, any_value(no_knowledge) AS no_knowledge, any_value(error) AS error, any_value(ok) AS ok, any_value(generated_at) AS generated_at FROM e2e_report GROUP BY report_id)"


def nearest_index(rows, group: str, value: str, probs: dict[str, float]):
    """sorted[int(n * p)] per group: values are counted first, then ranks run over distinct values only."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    return ranked.groupBy(group).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col(value))).alias(name) for name, p in probs.items()])


@query("a11_nearest_percentiles", f"WITH {REPORTS}, r AS (SELECT id, latency_ms, row_number() OVER (PARTITION BY id ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM rp WHERE latency_ms > 0 AND id IS NOT NULL) SELECT id, max(n) AS n, min(latency_ms) FILTER (i = floor(n * 0.5)) AS p50, min(latency_ms) FILTER (i = floor(n * 0.9)) AS p90, min(latency_ms) FILTER (i = floor(n * 0.99)) AS p99 FROM r GROUP BY id")
def nearest_percentiles(spark, d):
    return nearest_index(reports(spark, d).filter("latency_ms > 0 and id is not null"), "id", "latency_ms", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("a12_metric_stats", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, greatest(max(value), 0) AS high, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def metric_stats(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.greatest(F.max("value"), F.lit(0.0)).alias("high"), F.round(F.sum("value"), 4).alias("total"))


@query("a14_token_totals", f"WITH {BENCH} SELECT model, count(*) AS calls, sum(input_tokens) :: BIGINT AS input_tokens, sum(output_tokens) :: BIGINT AS output_tokens FROM br GROUP BY ROLLUP (model)")
def token_totals(spark, d):
    return bench(spark, d).rollup("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@query(
    "a15_provider_stats",
    f"WITH {BENCH} SELECT model, count(*) AS calls, round(100.0 * count(*) FILTER (success) / count(*), 1) AS success_rate, round(avg(latency) FILTER (success AND isfinite(latency)), 4) AS mean_latency, round(1.0 / avg(latency) FILTER (success AND isfinite(latency)), 4) AS per_second FROM br GROUP BY model",
)
def provider_stats(spark, d):
    good = F.when(F.col("success") & ~F.isnan("latency") & (F.abs("latency") < float("inf")), F.col("latency"))
    return bench(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(100 * F.count(F.when(F.col("success"), 1)) / F.count(F.lit(1)), 1).alias("success_rate"), F.round(F.avg(good), 4).alias("mean_latency"), F.round(1 / F.avg(good), 4).alias("per_second"))


@query(
    "a16_parallelism",
    f"""WITH {BENCH}, e AS (SELECT CAST(finished_at AS DATE) AS day, epoch_us(finished_at) / 1000000.0 :: DOUBLE AS fin, latency FROM br WHERE isfinite(latency) AND latency BETWEEN 0 AND 3600)
SELECT day, count(*) AS n, round(sum(latency), 3) AS serial_s, round(max(fin) - min(fin - latency), 3) AS wall_s, round(sum(latency) / (max(fin) - min(fin - latency)), 6) AS parallelism FROM e GROUP BY day""",
)
def parallelism(spark, d):
    rows = bench(spark, d).filter("latency between 0 and 3600").select(F.to_date("finished_at").alias("day"), (F.unix_micros(F.col("finished_at").cast("timestamp")) / 1e6).alias("fin"), "latency")
    wall = F.max("fin") - F.min(F.col("fin") - F.col("latency"))
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("latency"), 3).alias("serial_s"), F.round(wall, 3).alias("wall_s"), F.round(F.sum("latency") / wall, 6).alias("parallelism"))


@query("a19_route_distribution", f"WITH {REPORTS} SELECT {rules.tool_route.sql('question')} AS tool, count(*) AS n, count(*) FILTER (ok) AS n_ok FROM rp WHERE question IS NOT NULL GROUP BY ALL")
def route_distribution(spark, d):
    return reports(spark, d).filter("question is not null").groupBy(rules.tool_route.column(F.col("question")).alias("tool")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ok"), 1)).alias("n_ok"))


@query("a20_satisfaction", f"WITH {REPORTS} SELECT run_id, count(*) FILTER (ok) AS up, count(*) FILTER (NOT ok) AS down, round(100.0 * count(*) FILTER (ok) / greatest(count(ok), 1), 1) AS satisfaction FROM rp GROUP BY run_id")
def satisfaction(spark, d):
    up = F.count(F.when(F.col("ok"), 1))
    return reports(spark, d).groupBy("run_id").agg(up.alias("up"), F.count(F.when(~F.col("ok"), 1)).alias("down"), F.round(100 * up / F.greatest(F.count("ok"), F.lit(1)), 1).alias("satisfaction"))


@query("a22_metric_keys", "SELECT event_type, 'k' AS key, count(*) AS n, round(avg(TRY_CAST(props ->> '$.k' AS DOUBLE)), 6) AS mean FROM events WHERE props ->> '$.k' IS NOT NULL GROUP BY event_type")
def metric_keys(spark, d):
    """Mean of every key of a free-form JSON map."""
    pairs = events(spark, d).select("event_type", F.explode(F.from_json("props", "map<string,double>")).alias("key", "v"))
    return pairs.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query(
    "a23_daily_log_report",
    f"""WITH {REPORTS} SELECT CAST(generated_at AS DATE) AS day, count(*) AS total, count(*) FILTER (ok) AS n_ok, count(error) AS n_errors, round(avg(latency_ms) FILTER (latency_ms > 0), 3) AS mean_ms,
array_to_string(list_sort(list_distinct(list({rules.error_class.sql('error')}) FILTER (error IS NOT NULL))), ',') AS kinds FROM rp GROUP BY day""",
)
def daily_log_report(spark, d):
    kind = F.when(F.col("error").isNotNull(), rules.error_class.column(F.col("error")))
    out = reports(spark, d).groupBy(F.to_date("generated_at").alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("ok"), 1)).alias("n_ok"), F.count("error").alias("n_errors"), F.round(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), 3).alias("mean_ms"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds")
    )
    return out.withColumn("kinds", F.when(F.col("n_errors") > 0, F.col("kinds")))


@query("a28_errors_by_hour", f"WITH {REPORTS} SELECT date_trunc('hour', generated_at) AS hour, {rules.error_class.sql('error')} AS error_class, count(*) AS n FROM rp WHERE error IS NOT NULL GROUP BY ALL")
def errors_by_hour(spark, d):
    return reports(spark, d).filter("error is not null").groupBy(F.date_trunc("hour", "generated_at").alias("hour"), rules.error_class.column(F.col("error")).alias("error_class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a32_version_deltas",
    f"WITH {BENCH}, m AS (SELECT split_part(model, '-', 1) AS family, model, round(avg(latency) FILTER (isfinite(latency)), 6) AS mean_latency, round(avg(output_tokens), 6) AS mean_output FROM br GROUP BY ALL) SELECT a.model AS before, b.model AS after, round(b.mean_latency - a.mean_latency, 4) AS latency_delta, round(b.mean_output - a.mean_output, 4) AS output_delta FROM m a JOIN m b ON a.family = b.family AND a.model < b.model",
)
def version_deltas(spark, d):
    finite = F.when(~F.isnan("latency") & (F.abs("latency") < float("inf")), F.col("latency"))
    m = bench(spark, d).groupBy(F.split_part("model", F.lit("-"), F.lit(1)).alias("family"), "model").agg(F.round(F.avg(finite), 6).alias("lat"), F.round(F.avg("output_tokens"), 6).alias("out"))
    b = m.select("family", F.col("model").alias("after"), F.col("lat").alias("lat_b"), F.col("out").alias("out_b"))
    pairs = m.join(b, "family").filter("model < after")
    return pairs.select(F.col("model").alias("before"), "after", F.round(F.col("lat_b") - F.col("lat"), 4).alias("latency_delta"), F.round(F.col("out_b") - F.col("out"), 4).alias("output_delta"))


@query(
    "r7_domain_scores",
    """WITH k AS (SELECT DISTINCT category AS domain, unnest(expected_keywords) AS kw FROM e2e_set WHERE category IS NOT NULL), kk AS (SELECT DISTINCT domain, kw FROM k WHERE kw IS NOT NULL AND kw <> ''),
s AS (SELECT q.id, domain, sum(CASE WHEN regexp_matches(kw, '^[\\x00-\\x7f]+$') AND length(kw) > 4 THEN 1 ELSE 2 END) :: BIGINT AS score FROM qa_set q JOIN kk ON contains(lower(coalesce(q.query, '') || ' ' || coalesce(q.passage, '')), lower(kw)) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, domain) :: INTEGER AS place FROM s""",
)
def domain_scores(spark, d):
    """Keyword scores per domain; both sides are the fixed question tables."""
    words = table(spark, d, "e2e_set").filter("category is not null").select(F.col("category").alias("domain"), F.explode("expected_keywords").alias("kw")).filter("kw is not null and kw <> ''").distinct()
    asked = table(spark, d, "qa_set").select("id", F.lower(F.concat_ws(" ", F.coalesce("query", F.lit("")), F.coalesce("passage", F.lit("")))).alias("t"))
    weight = F.when(F.col("kw").rlike(r"^[\x00-\x7f]+$") & (F.length("kw") > 4), 1).otherwise(2)
    scores = asked.join(words, F.contains("t", F.lower("kw"))).groupBy("id", "domain").agg(F.sum(weight).alias("score"))
    return scores.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "domain")))


# --- graph and SQL ---------------------------------------------------------------------------------

_EDGES = """w AS (SELECT id, category, expected_keywords AS k, row_number() OVER (ORDER BY id) AS n FROM e2e_set WHERE len(expected_keywords) > 1),
e AS (SELECT k[i] AS src, k[i + 1] AS dst, coalesce(category, 'related') AS relation, n * 100 + i AS ord FROM (SELECT k, category, n, unnest(range(1, len(k))) AS i FROM w) WHERE k[i] IS NOT NULL AND k[i + 1] IS NOT NULL),
l AS (SELECT src, dst, max_by(relation, ord) AS relation, min(ord) AS ord FROM e GROUP BY ALL), nd AS (SELECT node, min(o) AS o FROM (SELECT src AS node, ord * 2 AS o FROM l UNION ALL SELECT dst, ord * 2 + 1 FROM l) GROUP BY node)"""


def edges(spark, d):
    """Keywords that follow each other in an expected answer, as a graph."""
    rows = table(spark, d, "e2e_set").filter("size(expected_keywords) > 1").withColumn("n", F.row_number().over(Window.orderBy("id")))  # a fixed, small table
    pairs = F.transform(F.sequence(F.lit(1), F.size("expected_keywords") - 1), lambda i: F.struct(F.get("expected_keywords", i - 1).alias("src"), F.get("expected_keywords", i).alias("dst"), i.alias("i")))
    out = rows.select("category", "n", F.explode(pairs).alias("p"))
    return out.select("p.src", "p.dst", F.coalesce("category", F.lit("related")).alias("relation"), (F.col("n") * 100 + F.col("p.i")).alias("ord")).filter("src is not null and dst is not null")


@query(
    "j7_edge_lookup",
    f"""WITH {_EDGES}, q AS (SELECT id AS qid, question FROM e2e_set WHERE question IS NOT NULL), f AS (SELECT qid, min_by(node, o) AS node FROM q JOIN nd ON contains(question, node) GROUP BY qid)
SELECT qid, node, relation, dst AS other, 'out' AS direction FROM f JOIN l ON node = src UNION ALL SELECT qid, node, relation, src, 'in' FROM f JOIN l ON node = dst""",
)
def edge_lookup(spark, d):
    return graph.edge_lookup(table(spark, d, "e2e_set").filter("question is not null").select(F.col("id").alias("qid"), "question"), edges(spark, d))


@query("f9_guarded_sql", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 GROUP BY o_orderpriority")
def guarded_sql(spark, d):
    statement = "SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 200000 GROUP BY o_orderpriority ORDER BY o_orderpriority LIMIT 500"
    return graph.guarded_query(spark, statement, orders=table(spark, d, "orders"))


@query("f1_metadata_filter", "SELECT DISTINCT doc_id FROM chunks WHERE metadata['ext'] = 'md' AND metadata['indexer'] = 'v6'")
def metadata_filter(spark, d):
    return graph.metadata_filter(table(spark, d, "chunks"), {"ext": "md", "indexer": "v6"}).select("doc_id").distinct()


@query("j12_semi_anti", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_anti(spark, d):
    orders = table(spark, d, "orders")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    rich = orders.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    partial = orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return customers.join(rich, "c_custkey", "left_semi").join(partial, "c_custkey", "left_anti")


@query(
    "grouping_report",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
)
def grouping_report(spark, d):
    rows = table(spark, d, "lineitem")
    keys = [F.col("l_returnflag"), F.col("l_linestatus")]
    return rows.groupingSets([keys, keys[:1], []], *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count_distinct("l_suppkey").alias("n_suppliers"))


# --- windows and state -----------------------------------------------------------------------------


@query("st10_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, d):
    return stateful.windowed(events(spark, d), "1 hour")


@query(
    "st10_sliding",
    "SELECT b + INTERVAL (s * 30) MINUTE AS start, b + INTERVAL (s * 30 + 60) MINUTE AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL '30 minutes', ts) AS b, unnest([0, -1]) AS s FROM events) GROUP BY ALL",
)
def sliding(spark, d):
    return stateful.windowed(events(spark, d), "1 hour", "30 minutes")


@query(
    "st10_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, no""",
)
def session_windows(spark, d):
    return stateful.sessions(events(spark, d))


def keyed_events(spark, d):
    rows = events(spark, d)
    return rows.select("event_id", F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") == "error").alias("failed"))


@query("st1_rate_limited")
def rate_limited(spark, d):
    return stateful.walk(keyed_events(spark, d), lambda: stateful.SlidingLimit(3, 86400.0))


@query("st3_circuit_breaker")
def circuit_breaker(spark, d):
    return stateful.walk(keyed_events(spark, d), lambda: stateful.Breaker(2, 86400.0))


@query(
    "st5_budget_states",
    """WITH r AS (SELECT event_id, user_id AS key, round((sum(CAST(coalesce(value, 0) AS DECIMAL(28,6))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) :: DOUBLE, 4) AS spent FROM events)
SELECT event_id, key, spent, CASE WHEN spent >= 500 THEN 'exceeded' WHEN spent >= 400 THEN 'warning' ELSE 'ok' END AS state FROM r""",
)
def budget_states(spark, d):
    rows = events(spark, d).select("event_id", F.col("user_id").alias("key"), "ts", "value")
    return stateful.budget_states(rows, 500.0)


@query("asof_last_purchase", "SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_last_purchase(spark, d):
    """As-of join by union and a running last value: one sort per user, no range join."""
    rows = events(spark, d).filter("event_type in ('error', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return rows.select("event_id", "event_type", last.alias("purchase_id")).filter("event_type = 'error' and purchase_id is not null").select("event_id", "purchase_id")
