"""Ingest: scans, chunking, identity, incremental updates and maintenance of a chunk store."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T

#: Where a text is split, the strongest place first.
SEPARATORS = ("\n## ", "\n### ", "\n\n", "\n", "。", ".", " ")
#: Characters a text needs to be chunked.
LEAST_CHARS = 20


# --- chunking --------------------------------------------------------------------------------------


def fixed_windows(documents: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """Windows of ``size`` characters, each starting ``overlap`` before the end of the last: no Python, no shuffle."""
    step = size - overlap
    n = F.length("text")
    last = F.greatest(F.lit(0), F.ceil((n - overlap) / step).cast("int") - 1) * step
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last.cast("int"), F.lit(step)))
    rows = documents.filter("text is not null").select("doc_id", "text", F.posexplode(starts).alias("n", "start"))
    return rows.select("doc_id", (F.col("n") + 1).alias("page"), "start", F.substring(F.col("text"), F.col("start") + 1, F.lit(size)).alias("chunk"))


def plain_blocks(documents: DataFrame, size: int = 500, least: int = 50) -> DataFrame:
    """Blocks without overlap; blocks with under ``least`` characters after trimming go, numbers keep their gaps."""
    n = F.length("text")
    rows = documents.filter(n > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), ((n - 1) / size).cast("int"))).alias("block"))
    chunk = F.substring(F.col("text"), F.col("block") * size + 1, F.lit(size))
    return rows.select("doc_id", "block", chunk.alias("chunk")).filter(F.length(T.strip("chunk")) >= least)


def estimate_tokens(text: str) -> int:
    han = sum("一" <= c <= "鿿" for c in text)
    return int(1.5 * han + 0.25 * (len(text) - han))


def recursive_pieces(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS, measure=estimate_tokens) -> list[str]:
    """Split at the first separator that occurs, go on with finer ones where a part is too large, then join neighbours.

    Separators stay with the part they open. Joined pieces repeat up to ``overlap`` of the one before.
    """
    mark = next((s for s in separators if s in text), "")
    finer = separators[separators.index(mark) + 1 :] if mark else ()
    if mark:
        parts = [p for p in re.split(f"(?={re.escape(mark)})", text) if p]
    else:
        parts = list(text)
    out: list[str] = []
    fitting: list[str] = []
    for part in parts:
        if measure(part) < size:
            fitting.append(part)
            continue
        out += _joined(fitting, size, overlap, measure)
        fitting = []
        out += recursive_pieces(part, size, overlap, finer, measure) if len(part) > 1 and (finer or mark) else [part]
    return out + _joined(fitting, size, overlap, measure)


def _joined(parts: list[str], size: int, overlap: int, measure) -> list[str]:
    out, held, total = [], [], 0
    sizes: list[int] = []
    for part in parts:
        n = measure(part)
        if held and total + n > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + n > size):
                total -= sizes.pop(0)
                held.pop(0)
        held.append(part)
        sizes.append(n)
        total += n
    if held:
        out.append("".join(held).strip())
    return [x for x in out if x]


def recursive_chunks(documents: DataFrame, size: int = 500, overlap: int = 50, measure=estimate_tokens) -> DataFrame:
    """``doc_id, page, chunk`` from the recursive splitter, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pages, chunks = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for page, piece in enumerate(recursive_pieces(text or "", size, overlap, measure=measure), 1):
                    at.append(row)
                    pages.append(page)
                    chunks.append(piece)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(pages, pa.int32()), pa.array(chunks, pa.string())], names=["doc_id", "page", "chunk"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, page int, chunk string")


def best_per_name(files: DataFrame, first_folder: str = "") -> DataFrame:
    """One file per base name (any case): one below ``first_folder``, then the largest, then the shortest path; an aggregate, not a window."""
    name = F.lower(F.element_at(F.split("source", "/"), -1))
    key = F.struct(F.col("source").startswith(first_folder).alias("inside"), F.col("size").alias("size"), (-F.length("source")).alias("short"), F.col("source").alias("source"))
    best = files.groupBy(name.alias("name")).agg(F.max(key).alias("b"))
    return best.select("name", F.col("b.source").alias("source"), F.col("b.size").alias("size"))


# --- store maintenance -----------------------------------------------------------------------------


def incremental_status(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``chunk_id, status`` of each incoming chunk: added, updated (other non-empty hash) or skipped."""
    old = stored.select("chunk_id", F.col("file_hash").alias("old_hash"), F.lit(1).alias("there"))
    joined = incoming.select("chunk_id", "file_hash").join(old, "chunk_id", "left")
    changed = (F.col("file_hash") != "") & ~F.col("file_hash").eqNullSafe(F.col("old_hash"))
    return joined.select("chunk_id", F.when(F.col("there").isNull(), "added").when(changed, "updated").otherwise("skipped").alias("status"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows without an incoming counterpart, and all incoming rows."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def delete_ids(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return stored.join(ids.select(key), key, "left_anti")


def resume_decision(existing: Column, total: Column, checkpoint: Column) -> Column:
    """What a resumed build does, from three counts."""
    return (
        F.when(existing > 1.15 * total, "rebuild")
        .when(existing >= F.greatest(F.lit(1.0), 0.98 * total), "skip")
        .when((existing < F.greatest(F.lit(1.0), 0.05 * total)) & (checkpoint > 0), "reset")
        .when((checkpoint > 2 * existing) & (existing > 0), "restart")
        .otherwise("resume")
    )


def new_paths(incoming: DataFrame, stored_paths: DataFrame, most_chunks: int) -> DataFrame:
    """Chunks of files that are not stored yet and have at most ``most_chunks`` chunks."""
    fresh = incoming.join(stored_paths.select("source").distinct(), "source", "left_anti")
    fitting = fresh.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most_chunks).select("source")
    return fresh.join(fitting, "source", "left_semi")


def write_store(chunks: DataFrame, path: str) -> None:
    """One Parquet folder per collection; rewriting a collection leaves the others alone."""
    (chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path))


def append(chunks: DataFrame, path: str) -> None:
    """Add rows to a store; a failed task is tried again by Spark and its output committed once."""
    chunks.write.mode("append").parquet(path)


def index_once(chunks: DataFrame, path: str) -> bool:
    """Fill a store unless it already holds rows; says whether it was filled."""
    if not is_empty(chunks.sparkSession, path):
        return False
    append(chunks, path)
    return True


def is_empty(spark: SparkSession, path: str) -> bool:
    """Whether a store holds no row; a store that does not exist holds none."""
    try:
        return spark.read.parquet(path).limit(1).isEmpty()
    except AnalysisException:
        return True


def clear(spark: SparkSession, path: str, schema) -> None:
    """An empty store of the same columns."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def update_collection(stored: DataFrame, additions: DataFrame, deletions: DataFrame, key: str) -> DataFrame:
    """Stored rows without the deleted ids, with new ones added and known ones replaced."""
    return upsert(delete_ids(stored, deletions, key), additions, key)


def write_both(chunks: DataFrame, paths: tuple[str, str]) -> None:
    """The same rows to two stores."""
    for path in paths:
        append(chunks, path)


def read_either(spark: SparkSession, paths: tuple[str, str]) -> DataFrame:
    """The first store that can be read."""
    try:
        return spark.read.parquet(paths[0])
    except AnalysisException:
        return spark.read.parquet(paths[1])


def write_blocks(rows: DataFrame, path: str, key: str, per_block: int = 10_000) -> None:
    """Metadata in blocks of ids, each a folder, and sorted inside: a lookup reads its ids' blocks only."""
    blocks = rows.withColumn("block", F.floor(F.col(key) / per_block))
    blocks.repartition("block").sortWithinPartitions("block", key).write.mode("overwrite").partitionBy("block").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, ids: list[int], per_block: int = 10_000) -> DataFrame:
    """Rows of the given ids (one or many); folders of other blocks are pruned before the scan."""
    blocks = sorted({i // per_block for i in ids})
    return spark.read.parquet(path).filter(F.col("block").isin(blocks) & F.col(key).isin(ids))


def keep_last(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each group, as a history that is rewritten keeps them."""
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.filter(F.col("turn") <= n).drop("turn")


def migrate(source: DataFrame, path: str) -> dict[str, int]:
    """Copy to Parquet; counts of both sides and of rows that differ, by a sum of row hashes."""
    source.write.mode("overwrite").parquet(path)
    copied = source.sparkSession.read.parquet(path)
    digest = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("h")).first()
    a, b = digest(source), digest(copied)
    if (a["n"], a["h"]) != (b["n"], b["h"]):
        raise ValueError(f"the copy differs: {a['n']} rows before, {b['n']} after")
    return {"before": a["n"], "after": b["n"]}
