"""SQL twins of the training-data queries that SQL can express on whole tables.

The percentiles hold exactly while no cell has outgrown its first compactor (384 values), as at the
scales SQL is run on; the other operators are tested against brute force.
"""

ORACLE = {
    "p1_day_percentiles": """
WITH cat AS (SELECT id, min(category) AS category FROM e2e_set GROUP BY id),
rep AS (SELECT report_id, any_value(id) AS id, any_value(generated_at) AS moment, any_value(latency_ms) AS v FROM e2e_report GROUP BY report_id),
ben AS (SELECT bench_id, any_value(model) AS model, any_value(finished_at) AS moment, any_value(latency) AS v FROM benchmark_results GROUP BY bench_id),
vals AS (
  SELECT 'e2e_latency_ms' AS metric, c.category AS grp, CAST(r.moment AS DATE) AS day, CAST(r.v AS DOUBLE) AS v FROM rep r LEFT JOIN cat c ON r.id = c.id
  UNION ALL
  SELECT 'bench_latency_s', model, CAST(moment AS DATE), v FROM ben),
cells AS (SELECT metric, grp, day, count(*) AS n_rows, count(*) FILTER (v > 0 AND isfinite(v)) AS n_measured FROM vals GROUP BY ALL),
ranked AS (SELECT metric, grp, day, v, row_number() OVER (PARTITION BY metric, grp, day ORDER BY v) AS rn FROM vals WHERE v > 0 AND isfinite(v)),
probs AS (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]) :: DOUBLE AS prob)
SELECT c.metric, c.grp, c.day, c.n_rows, c.n_measured, p.prob, r.v AS value
FROM cells c CROSS JOIN probs p
LEFT JOIN ranked r ON r.metric = c.metric AND r.grp IS NOT DISTINCT FROM c.grp AND r.day IS NOT DISTINCT FROM c.day
  AND r.rn = greatest(1, ceil(p.prob * c.n_measured - 1e-9))
""",
    "p1_rank_check": """
WITH cat AS (SELECT id, min(category) AS category FROM e2e_set GROUP BY id),
rep AS (SELECT report_id, any_value(id) AS id, any_value(latency_ms) AS v FROM e2e_report GROUP BY report_id),
ben AS (SELECT bench_id, any_value(model) AS model, any_value(latency) AS v FROM benchmark_results GROUP BY bench_id),
vals AS (
  SELECT 'e2e_latency_ms' AS metric, c.category AS grp, CAST(r.v AS DOUBLE) AS v FROM rep r LEFT JOIN cat c ON r.id = c.id
  UNION ALL SELECT 'bench_latency_s', model, v FROM ben),
cells AS (SELECT metric, grp, count(*) AS n_measured FROM vals WHERE v > 0 AND isfinite(v) GROUP BY ALL),
probs AS (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]) :: DOUBLE AS prob)
SELECT metric, grp, CAST(NULL AS DATE) AS day, prob, n_measured, true AS within FROM cells CROSS JOIN probs
""",
    "p4_found": "SELECT DISTINCT doc_id FROM chunks WHERE length(content) > 800",
    "p4_cover": "SELECT doc_id, length(content) :: BIGINT AS n_chars, md5(content) AS text_md5, true AS in_limits FROM (SELECT doc_id, any_value(content) AS content FROM chunks GROUP BY doc_id) WHERE content IS NOT NULL AND doc_id IS NOT NULL",
    "p8_within": "SELECT DISTINCT plan_id, source, true AS within FROM mix_plan WHERE source IS NOT NULL",
    "p5_found": """
WITH norm AS (SELECT id, trim(regexp_replace(lower(content), '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS t FROM kb_documents WHERE content IS NOT NULL),
grams AS (SELECT DISTINCT id, substr(t, CAST(i AS INTEGER), 5) AS g FROM norm, range(1, length(t) - 3) r(i)),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
common AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM common JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b WHERE c >= 0.7 * (x.n + y.n - c)
""",
    "p5_groups": """
WITH RECURSIVE norm AS (SELECT id, trim(regexp_replace(lower(content), '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS t FROM kb_documents WHERE content IS NOT NULL),
grams AS (SELECT DISTINCT id, substr(t, CAST(i AS INTEGER), 5) AS g FROM norm, range(1, length(t) - 3) r(i)),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
common AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
near AS (SELECT id_a, id_b, c = x.n AND c = y.n AS same FROM common JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b WHERE c >= 0.7 * (x.n + y.n - c)),
bi AS (SELECT id_a AS u, id_b AS v, same FROM near UNION ALL SELECT id_b, id_a, same FROM near),
class AS (SELECT s.id, least(s.id, coalesce(min(v), s.id)) AS class_id FROM sizes s LEFT JOIN bi ON u = s.id AND same GROUP BY s.id),
reach AS (SELECT id, id AS other FROM sizes UNION SELECT r.id, b.v FROM reach r JOIN bi b ON b.u = r.other),
grp AS (SELECT id, min(other) AS group_id FROM reach GROUP BY id),
deg AS (SELECT x.class_id, count(DISTINCT y.class_id) AS n_links FROM bi JOIN class x ON x.id = u JOIN class y ON y.id = v WHERE NOT same AND x.class_id <> y.class_id GROUP BY ALL)
SELECT class.id, class.class_id, group_id, coalesce(n_links, 0) AS n_links FROM class JOIN grp USING (id) LEFT JOIN deg ON deg.class_id = class.class_id
""",
}
