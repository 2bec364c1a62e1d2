"""Queries on schemas that drift between exported files."""

from gleanery.operators import schema_drift
from gleanery.plans.registry import query
from gleanery.runtime import table


_KIND = "CASE WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type = 'ARRAY' THEN 'array' WHEN type = 'OBJECT' THEN 'object' ELSE 'number' END"
#: Cells of all sound lines: a row per file, line and path. Paths inside arrays are values, not paths.
CELLS = f"""ln AS (SELECT DISTINCT series_id, file_id, line_no, payload FROM result_files WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
ce AS (SELECT file_id, line_no, TRY_CAST(payload ->> '$.case_id' AS BIGINT) AS case_id, replace(substr(fullkey, 3), '"', '') AS path, replace(substr(t.path, 3), '"', '') AS parent, {_KIND} AS kind, type = 'DOUBLE' AS is_float, CASE WHEN {_KIND} = 'number' THEN CAST(CAST(value AS DOUBLE) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS value
 FROM ln, json_tree(payload) t WHERE type <> 'NULL' AND fullkey <> '$' AND fullkey <> '$.case_id' AND NOT contains(fullkey, '[')),
nk AS (SELECT file_id, path, parent, kind, count(*) AS n FROM ce GROUP BY ALL),
sc AS (SELECT file_id, path, parent, arg_max(kind, (n, CASE kind WHEN 'string' THEN 5 WHEN 'number' THEN 4 WHEN 'boolean' THEN 3 WHEN 'array' THEN 2 ELSE 1 END)) AS kind FROM nk GROUP BY ALL)"""


@query(
    "p2_found",
    f"""WITH {CELLS}, fl AS (SELECT file_id, min(series_id) AS series_id, min(exported_at) AS moment FROM result_files GROUP BY file_id),
pr AS (SELECT * FROM (SELECT file_id, lag(file_id) OVER (PARTITION BY series_id ORDER BY moment, file_id) AS old_file FROM fl) WHERE old_file IS NOT NULL),
od AS (SELECT pr.file_id, old_file, path, parent, kind FROM pr JOIN sc ON sc.file_id = old_file), nw AS (SELECT pr.file_id, path, parent, kind FROM pr JOIN sc USING (file_id)),
bo AS (SELECT coalesce(od.file_id, nw.file_id) AS file_id, coalesce(od.path, nw.path) AS path, coalesce(od.parent, nw.parent) AS parent, od.kind AS old_kind, nw.kind AS new_kind, old_file FROM od FULL JOIN nw ON od.file_id = nw.file_id AND od.path = nw.path),
ch AS (SELECT * FROM bo WHERE old_kind IS DISTINCT FROM new_kind),
cp AS (SELECT g.file_id, g.old_file, g.path AS old_path, c.path AS new_path FROM ch g JOIN ch c ON g.file_id = c.file_id AND g.parent = c.parent AND g.old_kind = c.new_kind WHERE g.new_kind IS NULL AND c.old_kind IS NULL),
va AS (SELECT file_id, path, case_id, max(value) AS value FROM ce WHERE case_id IS NOT NULL GROUP BY ALL),
ma AS (SELECT cp.file_id, old_path, new_path, count(*) AS n_both, count(*) FILTER (a.value = b.value) AS n_equal FROM cp JOIN va a ON a.file_id = cp.old_file AND a.path = old_path JOIN va b ON b.file_id = cp.file_id AND b.path = new_path AND b.case_id = a.case_id GROUP BY ALL),
ok AS (SELECT *, row_number() OVER (PARTITION BY file_id, old_path ORDER BY n_equal / n_both DESC, n_equal DESC, old_path, new_path) AS a, row_number() OVER (PARTITION BY file_id, new_path ORDER BY n_equal / n_both DESC, n_equal DESC, old_path, new_path) AS b FROM ma WHERE n_equal >= 3 AND n_equal >= 0.8 * n_both),
re AS (SELECT file_id, old_path, new_path FROM ok WHERE a = 1 AND b = 1),
al AS (SELECT ch.file_id, ch.path, CASE WHEN re.new_path IS NULL THEN 'removed' ELSE 'renamed' END AS change_kind, coalesce(re.new_path, '') AS new_path FROM ch LEFT JOIN re ON re.file_id = ch.file_id AND re.old_path = ch.path WHERE new_kind IS NULL
 UNION ALL SELECT ch.file_id, ch.path, 'added', '' FROM ch WHERE old_kind IS NULL AND NOT EXISTS (SELECT 1 FROM re WHERE re.file_id = ch.file_id AND re.new_path = ch.path)
 UNION ALL SELECT file_id, path, 'type_changed', '' FROM ch WHERE old_kind IS NOT NULL AND new_kind IS NOT NULL),
ro AS (SELECT file_id, path AS root FROM al UNION SELECT file_id, new_path FROM al WHERE new_path <> '')
SELECT * FROM al WHERE NOT EXISTS (SELECT 1 FROM ro WHERE ro.file_id = al.file_id AND starts_with(al.path, ro.root || '.'))""",
)
def p2_found(spark, d):
    return schema_drift.schema_changes(table(spark, d, "result_files"))


@query(
    "p2_union_schema",
    f"""WITH {CELLS} SELECT path, CASE WHEN count(*) = count(*) FILTER (kind = 'number') THEN CASE WHEN bool_or(is_float) THEN 'double' ELSE 'long' END WHEN count(*) = count(*) FILTER (kind = 'boolean') THEN 'boolean' ELSE 'string' END AS data_type, count(DISTINCT file_id) AS n_files FROM ce GROUP BY path""",
)
def p2_union_schema(spark, d):
    return schema_drift.union_schema(table(spark, d, "result_files"))


@query("p2_unified")
def p2_unified(spark, d):
    return schema_drift.unified_table(table(spark, d, "result_files"))


@query("p2_cells_kept", f"WITH {CELLS} SELECT path, count(*) AS n_values FROM ce GROUP BY path")
def p2_cells_kept(spark, d):
    """Values of each path that stand in the one table: none is lost by the casts."""
    return schema_drift.kept_values(table(spark, d, "result_files"))


@query("p2_change_log")
def p2_change_log(spark, d):
    return schema_drift.change_log(table(spark, d, "result_files"))
