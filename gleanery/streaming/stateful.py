"""Time-driven state per key: rate limiting and circuit breaking, as batch scans and as streams.

The batch form sorts each key's events inside its partition and walks them once with the state of one
key in memory, so a hot key costs time but no memory. The stream form keeps the same state per key in
Structured Streaming's state store. Both run the same transition functions.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.operators import ingest
from gleanery.runtime import scratch


class SlidingLimit:
    """At most ``most`` accepted events per trailing ``seconds``; refused events are not counted."""

    def __init__(self, most: int = 60, seconds: float = 60.0, kept: list[float] | None = None):
        self.most, self.seconds, self.kept = most, seconds, deque(kept or ())

    def step(self, at: float, failed: bool = False) -> bool:
        while self.kept and self.kept[0] < at - self.seconds:
            self.kept.popleft()
        if len(self.kept) >= self.most:
            return False
        self.kept.append(at)
        return True


class Breaker:
    """Closed until ``most`` failures in a row, then open for ``seconds``, then one trial."""

    def __init__(self, most: int = 3, seconds: float = 30.0, failures: int = 0, opened: float = 0.0, state: str = "closed"):
        self.most, self.seconds, self.failures, self.opened, self.state = most, seconds, failures, opened, state

    def step(self, at: float, failed: bool) -> bool:
        if self.state == "open":
            if at - self.opened < self.seconds:
                return False
            self.state = "half_open"
        if failed:
            self.failures += 1
            if self.failures >= self.most:
                self.state, self.opened = "open", at
        else:
            self.failures, self.state, self.opened = 0, "closed", 0.0
        return True


def walk(events: DataFrame, make: Callable[[], SlidingLimit | Breaker]) -> DataFrame:
    """``event_id, key, allowed`` for ``events(event_id, key, at, failed)``, at in seconds, in order of (at, event_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, times, failed = (batch.column(c).to_pylist() for c in ("key", "at", "failed"))
            allowed = np.zeros(len(keys), bool)
            for i, (k, t, f) in enumerate(zip(keys, times, failed, strict=True)):
                if state is None or k != key:
                    key, state = k, make()
                allowed[i] = state.step(t, bool(f))
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column("key"), pa.array(allowed)], names=["event_id", "key", "allowed"])

    rows = events.select("event_id", "key", F.col("at").cast("double").alias("at"), "failed").filter("at is not null")
    return rows.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInArrow(run, "event_id long, key long, allowed boolean")


def limit_stream(events: DataFrame, most: int = 60, seconds: float = 60.0, late: str = "1 minute") -> DataFrame:
    """The rate limit on a stream of ``event_id, key, ts``; a key's state goes once the watermark has left its window."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limit = SlidingLimit(most, seconds, list(state.get[0]) if state.exists else None)
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        rows["allowed"] = [limit.step(t) for t in rows["at"]]
        state.update((list(limit.kept),))
        state.setTimeoutTimestamp(max(int((rows["at"].iloc[-1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows[["event_id", "key", "allowed"]]

    timed = events.withWatermark("ts", late).select("event_id", "key", "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    return timed.groupBy("key").applyInPandasWithState(run, "event_id long, key long, allowed boolean", "kept array<double>", "append", "EventTimeTimeout")


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type in tumbling or sliding windows; on a stream, state is dropped behind the watermark."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    frame = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.groupBy(frame.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per user: built-in session windows, merged without a Python loop."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def budget_states(events: DataFrame, limit: float, warn: float = 0.8) -> DataFrame:
    """Running spend per key and whether it warns or exceeds: day totals are accumulated first, then events within a day."""
    from pyspark.sql.window import Window

    rows = events.select("event_id", "key", "ts", F.to_date("ts").alias("day"), F.coalesce("value", F.lit(0.0)).cast("decimal(28,6)").alias("value"))
    days = rows.groupBy("key", "day").agg(F.sum("value").alias("spent"))
    before = days.select("key", "day", (F.sum("spent").over(Window.partitionBy("key").orderBy("day")) - F.col("spent")).alias("before"))
    within = F.sum("value").over(Window.partitionBy("key", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    spent = rows.withColumn("within", within).join(before, ["key", "day"]).withColumn("spent", (F.col("within") + F.col("before")).cast("double"))
    return spent.select("event_id", "key", F.round("spent", 4).alias("spent"), F.when(F.col("spent") >= limit, "exceeded").when(F.col("spent") >= warn * limit, "warning").otherwise("ok").alias("state"))


# --- ingest, caches and topics ---------------------------------------------------------------------


def hash_ingest(spark: SparkSession, chunks: DataFrame, changed) -> DataFrame:
    """A stream of chunk files into a store: new chunks are added, chunks of another hash replaced, others skipped.

    The rows arrive in two runs, in the first of which the ``changed`` ones still have other contents; each micro-batch
    is compared with the store by an equi-join on the id and the store written anew beside the old one.
    """
    source, stores, mark = scratch(spark, "arrivals"), scratch(spark, "store"), scratch(spark, "offsets")
    schema = "chunk_id string, content string"
    current: dict[str, str] = {}

    def merge(batch: DataFrame, number: int) -> None:
        incoming = batch.select("chunk_id", F.md5("content").alias("file_hash")).dropDuplicates(["chunk_id"])
        if "path" in current:
            stored = spark.read.parquet(current["path"])
            status = ingest.incremental_status(stored, incoming).filter("status <> 'skipped'")
            fresh = incoming.join(status.select("chunk_id"), "chunk_id", "left_semi").join(stored.select("chunk_id", "version"), "chunk_id", "left").select("chunk_id", "file_hash", (F.coalesce("version", F.lit(0)) + 1).alias("version"))
            out = ingest.upsert(stored, fresh, "chunk_id")
        else:
            out = incoming.withColumn("version", F.lit(1))
        out.write.mode("overwrite").parquet(f"{stores}/{number}")
        current["path"] = f"{stores}/{number}"

    early = chunks.withColumn("content", F.when(changed, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    for rows in (early, chunks):
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", mark).trigger(availableNow=True).start()
        stream.awaitTermination()
    return spark.read.parquet(current["path"]).select("chunk_id", "file_hash", "version")


def ttl_hits(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Lookups and hits of a cache: a key's entry lives ``seconds`` after its last use."""
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "event_id"))
    rows = events.select(key, "ts", before.alias("before"))
    alive = F.col("before").isNotNull() & (F.col("ts") <= F.col("before") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("lookups"), F.count(F.when(alive, 1)).alias("hits"))


def topic_states(events: DataFrame) -> DataFrame:
    """Messages and the last value of each topic; the same aggregate runs on a stream in complete mode."""
    return events.groupBy(F.col("event_type").alias("topic")).agg(F.count(F.lit(1)).alias("n_messages"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), F.max("ts").alias("last_at"))
