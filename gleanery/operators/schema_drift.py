"""Schemas that drift between exported files.

File-header schemas are read in parallel (each task counts the types of every path of its lines, the
counts are added up per file), folded through a type-promotion lattice, per file for the change log and
over all files for the union schema; all lines are cast to that schema, and each file is compared with
the one before it in its series to give an ordered change log.

Defined results for odd input: a payload that is null, blank, cut short or not a JSON object gives no
row; null members count as absent; a line that was loaded twice counts once, two sound payloads under one
line number are two rows; a file without a sound line has no paths; an empty table gives an empty report.
Integers beyond 64 bits make a decimal column, beyond 38 digits (or mixed with fractions beyond a double's
exact range) a text column, and never a null. Keys may hold any characters; keys that only differ by letter
case stay apart (the union table is keyed by column names with a numeric suffix then); of "a.b" and
{"a": {"b": ..}} in one object the first value is the cell's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.runtime import bounded_rows, cut_lineage

#: JSON kinds in the order that breaks ties.
KINDS = ("string", "number", "boolean", "array", "object")

#: Width limit of the union table; the list of columns is schema, not data.
MAX_COLUMNS = 5000

#: Numbers of a path, from narrow to wide: 64-bit integers, 38-digit integers, doubles, and text for the rest.
_SAFE, _LONG, _HUGE = 2**53, 2**63, 10**38

#: A file header: one row per path with how many values have each kind, and the widest numbers met.
_COUNTS = (*KINDS, "n_float", "n_unsafe", "n_big", "n_huge")
_HEADER_SCHEMA = "file_id long, path string, parent string, " + ", ".join(f"{c} long" for c in _COUNTS)
_VALUE_SCHEMA = "file_id long, case_id long, path string, value string"


def _kind(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def _canon(value) -> str:
    """Text that is equal exactly for equal JSON values (7 and 7.0 are the same number)."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        whole = isinstance(value, int) or (value == value and abs(value) < 1e15 and value == int(value))
        return str(int(value)) if whole else repr(float(value))
    if isinstance(value, str):
        return json.dumps(value)
    if isinstance(value, list):
        return "[" + ",".join("null" if v is None else _canon(v) for v in value) + "]"
    return "{" + ",".join(f"{json.dumps(k)}:{'null' if v is None else _canon(v)}" for k, v in sorted(value.items())) + "}"


def _walk(record: dict, parent: str = "") -> Iterator[tuple[str, str, object]]:
    for key, value in record.items():
        path = (f"{parent}.{key}" if parent else key).encode("utf-8", "replace").decode()
        if value is None or path == "case_id":
            continue
        yield path, parent, value
        if isinstance(value, dict):
            yield from _walk(value, path)


def _record(text: str | None) -> dict | None:
    """The object a payload holds; None for anything else."""
    try:
        record = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def _case(record: dict) -> int | None:
    case = record.get("case_id")
    return case if isinstance(case, int) and not isinstance(case, bool) and abs(case) < _LONG else None


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial headers of the lines of one task: a row per file and path, however many lines there are."""
    held: dict[tuple, list[int]] = {}
    for batch in batches:
        for f, text in zip(*(batch.column(c).to_pylist() for c in ("file_id", "payload")), strict=True):
            record = _record(text)
            if record is None:
                continue
            for path, parent, value in _walk(record):
                counts = held.get((f, path, parent))
                if counts is None:
                    counts = held[f, path, parent] = [0] * len(_COUNTS)
                kind = _kind(value)
                counts[KINDS.index(kind)] += 1
                if kind == "number":
                    size = abs(value)
                    counts[5] += isinstance(value, float)
                    counts[6] += isinstance(value, int) and size > _SAFE
                    counts[7] += isinstance(value, int) and not -_LONG <= value < _LONG
                    counts[8] += isinstance(value, int) and size >= _HUGE
        if len(held) > 200_000:
            yield _header_batch(held)
            held = {}
    yield _header_batch(held)


def _header_batch(held: dict[tuple, list[int]]) -> pa.RecordBatch:
    keys, counts = list(held), list(held.values())
    columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
    columns += [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(_COUNTS))]
    return pa.RecordBatch.from_arrays(columns, names=["file_id", "path", "parent", *_COUNTS])


#: Lines of a file that are read together; the lines of a longer file are dealt to several tasks.
LINE_BLOCK = 4096


def sound_lines(lines: DataFrame) -> DataFrame:
    """Lines that hold an object by the look of them; lines loaded twice come out once.

    The one exchange brings a file's lines together by blocks, so its header is counted where they meet.
    """
    held = lines.select("series_id", "file_id", "line_no", "payload").filter(F.col("payload").rlike(r"^\s*\{"))
    held = held.withColumn("block", F.floor(F.coalesce("line_no", F.lit(0)) / LINE_BLOCK)).repartition("file_id", "block")
    return held.dropDuplicates(["file_id", "block", "line_no", "payload"]).drop("block")


def file_headers(sound: DataFrame) -> DataFrame:
    """Header schema of every file, read in parallel: partial counts per task, added up per file and path."""
    return sound.mapInArrow(_headers, _HEADER_SCHEMA).groupBy("file_id", "path", "parent").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def typed(counts: DataFrame) -> DataFrame:
    """Counts with what the lattice makes of them: ``data_type``, and ``kind``, what most values are (ties: the order of KINDS).

    boolean; long < 38-digit decimal; long < double while no integer is beyond a double's exact range; text
    above all. Arrays and objects are JSON text.
    """
    total = sum((F.col(k) for k in KINDS), F.lit(0))
    number = F.when(F.col("n_float") > 0, F.when(F.col("n_unsafe") == 0, "double").otherwise("string")).when(F.col("n_huge") > 0, "string").when(F.col("n_big") > 0, "decimal(38,0)").otherwise("long")
    data_type = F.when(F.col("number") == total, number).when(F.col("boolean") == total, "boolean").otherwise("string")
    best = F.greatest(*KINDS)
    kind = F.coalesce(*[F.when(F.col(k) == best, F.lit(k)) for k in KINDS])
    return counts.withColumn("data_type", data_type).withColumn("kind", kind)


def promoted(headers: DataFrame, *keys: str) -> DataFrame:
    """Headers folded through the lattice over all rows of equal ``keys``: ``data_type``, ``kind`` and ``n_files``."""
    folded = headers.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _COUNTS], F.count_distinct("file_id").alias("n_files"))
    return typed(folded).select(*keys, "data_type", "kind", "n_files")


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of the paths in ``wanted`` only, cast to text that is equal exactly for equal values."""
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for f, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("file_id", "payload", "wanted")), strict=True):
            record = _record(text)
            case = _case(record) if record is not None else None
            if case is None:
                continue
            asked = set(wanted)
            for path, _, value in _walk(record):
                if path in asked:
                    for column, cell in zip(out, (f, case, path, _canon(value)), strict=True):
                        column.append(cell)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["file_id", "case_id", "path", "value"])


def files_in_order(lines: DataFrame) -> DataFrame:
    """Each file with the one before it in its series (by export time, then id) and its number there."""
    files = lines.groupBy("file_id").agg(F.min("series_id").alias("series_id"), F.min("exported_at").alias("exported_at"))
    # One small row per file and no payload: a series' files sort with spilling, in no task's memory at once.
    order = Window.partitionBy("series_id").orderBy("exported_at", "file_id")
    placed = files.select("series_id", "file_id", F.lag("file_id").over(order).alias("old_file"), F.row_number().over(order).alias("file_no"))
    return placed.filter("old_file is not null").select("series_id", "old_file", "file_id", "file_no")


def schema_changes(lines: DataFrame, share: float = 0.8, least: int = 3) -> DataFrame:
    """Ordered change log: ``file_id, path, change_kind, new_path``.

    A removed and an added path under one parent and of one kind are a rename if at least ``share``
    (and at least ``least``) of the cases with both values have equal ones; each path takes part in
    one rename, the best match first. Changes below a changed path are left out.
    """
    # The lines are parsed twice rather than kept exploded; what is kept (headers, pairs, changes) is schema-sized.
    sound = sound_lines(lines)
    headers = cut_lineage(file_headers(sound))
    schema = typed(headers).select("file_id", "path", "parent", "kind")
    pairs = files_in_order(lines)
    new = pairs.join(schema, "file_id").select("file_id", "path", "parent", F.col("kind").alias("new_kind"))
    old = pairs.join(schema.withColumnRenamed("file_id", "old_file"), "old_file").select("file_id", "old_file", "path", "parent", F.col("kind").alias("old_kind"))
    both = old.join(new, ["file_id", "path", "parent"], "full_outer").filter(~F.col("old_kind").eqNullSafe(F.col("new_kind")))
    both = cut_lineage(both)

    gone = both.filter("new_kind is null").select("file_id", "old_file", "parent", F.col("path").alias("old_path"), F.col("old_kind").alias("kind"))
    came = both.filter("old_kind is null").select("file_id", "parent", F.col("path").alias("new_path"), F.col("new_kind").alias("kind"))
    couples = cut_lineage(gone.join(came, ["file_id", "parent", "kind"]))
    # Only values of paths that may be renamed leave the lines: a file's list of them is part of its header.
    ends = couples.select(F.col("old_file").alias("file_id"), F.col("old_path").alias("path")).union(couples.select("file_id", F.col("new_path").alias("path")))
    wanted = ends.groupBy("file_id").agg(F.collect_set("path").alias("wanted"))
    asked = sound.join(wanted, "file_id").select("file_id", "payload", "wanted")
    values = asked.mapInArrow(_values, _VALUE_SCHEMA).groupBy("file_id", "path", "case_id").agg(F.max("value").alias("value"))
    old_values = couples.join(values.select(F.col("file_id").alias("old_file"), F.col("path").alias("old_path"), "case_id", F.col("value").alias("old_value")), ["old_file", "old_path"])
    matched = (
        old_values.join(values.select("file_id", F.col("path").alias("new_path"), "case_id", F.col("value").alias("new_value")), ["file_id", "new_path", "case_id"])
        .groupBy("file_id", "old_path", "new_path")
        .agg(F.count(F.lit(1)).alias("n_both"), F.count(F.when(F.col("old_value") == F.col("new_value"), 1)).alias("n_equal"))
        .filter((F.col("n_equal") >= least) & (F.col("n_equal") >= share * F.col("n_both") - 1e-9))
    )
    # A file's possible renames are schema, a bounded group; all files of a task are settled in one call.
    renames = cut_lineage(matched.groupBy("file_id").agg(F.collect_list(F.struct("old_path", "new_path", "n_both", "n_equal")).alias("options")).mapInArrow(_best_first, "file_id long, old_path string, new_path string"))

    removed = gone.select("file_id", F.col("old_path").alias("path")).join(renames.withColumnRenamed("old_path", "path"), ["file_id", "path"], "left")
    removed = removed.select("file_id", "path", F.when(F.col("new_path").isNull(), "removed").otherwise("renamed").alias("change_kind"), F.coalesce("new_path", F.lit("")).alias("new_path"))
    added = came.select("file_id", F.col("new_path").alias("path")).join(renames.select("file_id", F.col("new_path").alias("path")), ["file_id", "path"], "left_anti")
    added = added.select("file_id", "path", F.lit("added").alias("change_kind"), F.lit("").alias("new_path"))
    retyped = both.filter("old_kind is not null and new_kind is not null").select("file_id", "path", F.lit("type_changed").alias("change_kind"), F.lit("").alias("new_path"))
    changes = cut_lineage(removed.unionByName(added).unionByName(retyped).distinct())

    # Roots below which nothing is reported: every changed path and, of a rename, the new one too.
    roots = changes.select("file_id", F.explode(F.array_distinct(F.filter(F.array("path", "new_path"), lambda p: p != ""))).alias("root"))
    # The roots a path can lie below are its own proper prefixes, so this is an equi-join.
    parts = F.split("path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    below = changes.filter(F.col("path").contains(".")).select("file_id", "path", "change_kind", "new_path", F.explode(prefixes).alias("root"))
    hidden = below.join(roots, ["file_id", "root"], "left_semi").select("file_id", "path", "change_kind", "new_path").distinct()
    return changes.join(hidden, ["file_id", "path", "change_kind", "new_path"], "left_anti")


def _best_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Greedy one-to-one renames of each file, the best match first."""
    for batch in batches:
        keep: list[tuple] = []
        for file_id, options in zip(batch.column("file_id").to_pylist(), batch.column("options").to_pylist(), strict=True):
            used_old, used_new = set(), set()
            for r in sorted(options, key=lambda r: (-r["n_equal"] / r["n_both"], -r["n_equal"], r["old_path"], r["new_path"])):
                if r["old_path"] not in used_old and r["new_path"] not in used_new:
                    used_old.add(r["old_path"])
                    used_new.add(r["new_path"])
                    keep.append((file_id, r["old_path"], r["new_path"]))
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keep], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["file_id", "old_path", "new_path"])


def change_log(lines: DataFrame) -> DataFrame:
    """The changes in order: series, number of the file in it, then path; with the lattice's type before and after."""
    changes = schema_changes(lines)
    types = cut_lineage(typed(file_headers(sound_lines(lines))).select("file_id", "path", "data_type"))
    placed = changes.join(files_in_order(lines), "file_id")
    before = types.select(F.col("file_id").alias("old_file"), "path", F.col("data_type").alias("old_type"))
    after = types.select("file_id", F.col("path").alias("now_path"), F.col("data_type").alias("new_type"))
    now = F.when(F.col("change_kind") == "renamed", F.col("new_path")).when(F.col("change_kind") != "removed", F.col("path"))
    was = F.when(F.col("change_kind") != "added", F.col("path"))
    joined = placed.withColumn("now_path", now).withColumn("was_path", was)
    joined = joined.join(before.withColumnRenamed("path", "was_path"), ["old_file", "was_path"], "left").join(after, ["file_id", "now_path"], "left")
    order = Window.partitionBy("series_id").orderBy("file_no", "path", "change_kind")
    return joined.select("series_id", F.row_number().over(order).alias("change_no"), "file_no", "file_id", "path", "change_kind", "new_path", "old_type", "new_type")


def union_schema(lines: DataFrame) -> DataFrame:
    """All file headers folded into one schema: a row ``path, data_type, n_files`` per path."""
    return promoted(file_headers(sound_lines(lines)), "path").select("path", "data_type", "n_files")


_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "decimal(38,0)": pa.decimal128(38, 0)}


def _cast(value, data_type: str):
    """A value as the union column holds it; text columns keep strings as they are and the rest as JSON text."""
    if data_type == "string":
        return value.encode("utf-8", "replace").decode() if isinstance(value, str) else _canon(value)
    if data_type == "decimal(38,0)":
        return Decimal(value)
    return float(value) if data_type == "double" else value


def _casts(columns: list[tuple[str, str, str]]):
    """Lines as rows of the union schema; ``columns`` holds path, column name and type."""
    places = {path: i for i, (path, _, _) in enumerate(columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[list] = [[], [], [], []]
            cells: list[list] = [[] for _ in columns]
            for s, f, n, text in zip(*(batch.column(c).to_pylist() for c in ("series_id", "file_id", "line_no", "payload")), strict=True):
                record = _record(text)
                if record is None:
                    continue
                for column, key in zip(keys, (s, f, n, _case(record)), strict=True):
                    column.append(key)
                row: list = [None] * len(columns)
                for path, _, value in _walk(record):
                    at = places[path]
                    # A key with a dot and a nested one may spell the same path: the first value stays.
                    if row[at] is None:
                        row[at] = _cast(value, columns[at][2])
                for column, cell in zip(cells, row, strict=True):
                    column.append(cell)
            made = [pa.array(c, t) for c, t in zip(keys, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            made += [pa.array(c, _ARROW[t]) for c, (_, _, t) in zip(cells, columns, strict=True)]
            yield pa.RecordBatch.from_arrays(made, names=["series_id", "file_id", "line_no", "case_id", *[name for _, name, _ in columns]])

    return run


def unified_table(lines: DataFrame) -> DataFrame:
    """All sound lines of all files in one table: a column per path, cast to its promoted type.

    A narrow map after the one exchange that drops lines loaded twice; only the union schema, whose width
    is checked, goes to the driver and to the tasks.
    """
    columns = union_columns(lines)
    schema = "series_id long, file_id long, line_no int, case_id long" + "".join(f", `{name.replace('`', '``')}` {t}" for _, name, t in columns)
    return sound_lines(lines).mapInArrow(_casts(columns), schema)


def kept_values(lines: DataFrame) -> DataFrame:
    """``path, n_values`` of the one table: how many cells of each column hold a value."""
    columns = union_columns(lines)
    held = unified_table(lines)
    counts = F.array(*[F.struct(F.lit(path).alias("path"), F.count(F.col(f"`{name.replace('`', '``')}`")).alias("n_values")) for path, name, _ in columns])
    return held.agg(counts.alias("c")).select(F.explode("c").alias("c")).select("c.path", "c.n_values")


def union_columns(lines: DataFrame) -> list[tuple[str, str, str]]:
    """``(path, column, type)`` of the union table in order of paths."""
    rows = bounded_rows(union_schema(lines), MAX_COLUMNS, "columns of the union table")
    taken = {"series_id", "file_id", "line_no", "case_id"}
    columns = []
    for path, data_type in sorted((r["path"], r["data_type"]) for r in rows):
        name, n = path.replace(".", "__"), 1
        while name.lower() in taken:
            n += 1
            name = f"{path.replace('.', '__')}__{n}"
        taken.add(name.lower())
        columns.append((path, name, data_type))
    return columns
