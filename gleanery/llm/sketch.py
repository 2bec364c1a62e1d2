"""Percentiles of very large numeric columns with relative-rank compactors.

A sketch is a stack of compactors. Level h holds values that stand for 2**h rows each. A compactor
that is full sorts its buffer, keeps the values next to the protected tail (here the top one, where
latency percentiles lie) and halves a run of sections at the other end; how many sections depends on
the trailing ones of its compaction counter, so values far from the tail are thinned most often. The
rank error at quantile q is therefore proportional to 1 - q: with section size ``k`` it stays, with
the usual three standard deviations, within ``rank_error(k) * (1 - q) * n`` rows.

Sketches merge, so a day's sketch is made once and any set of days is answered from day sketches.

Defined results for odd input: null, NaN, infinite, zero and negative values are counted as not
measured and kept out; values on another unit are kept as they stand (a median is not moved by a few;
the top percentiles are); groups and days that are null keep a row of their own; an empty table gives
no rows; a group without measured values gives null percentiles.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Section size; rank_error(64) is about 0.6 % of the distance to the top.
K = 64
PROBS = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)
#: Tasks the partial sketches of one cell are dealt to, and the most the last round merges.
FAN_IN = 64


def rank_error(k: int = K, sections: int = 3) -> float:
    """Three standard deviations of the rank error at quantile q, as a share of (1 - q) * n."""
    return 3 * math.sqrt(0.0512 / sections) / k


class _Level:
    """One compactor: ``sections`` sections of ``size`` values may be compacted, as many are protected."""

    __slots__ = ("buffer", "coin", "sections", "size", "state")

    def __init__(self, size: int, sections: int = 3, state: int = 0, coin: int = 0, buffer: np.ndarray | None = None):
        self.size, self.sections, self.state, self.coin = size, sections, state, coin
        self.buffer = np.empty(0) if buffer is None else buffer

    def capacity(self) -> int:
        return 2 * self.sections * self.size

    def compact(self) -> np.ndarray:
        """Halve the low end of the buffer; returns the survivors, which weigh twice as much."""
        if self.state >= 1 << (self.sections - 1) and (smaller := 2 * round(self.size / math.sqrt(2) / 2)) >= 4:
            self.size, self.sections = smaller, 2 * self.sections
        trailing_ones = ((~self.state & (self.state + 1)) - 1).bit_count() if self.state else 0
        protected = self.capacity() // 2 + (self.sections - min(trailing_ones + 1, self.sections)) * self.size
        values = np.sort(self.buffer, kind="stable")
        cut = max(0, len(values) - protected)
        cut -= cut % 2
        low, self.buffer = values[:cut], values[cut:]
        # Every second compaction draws a coin (from the values, so a rerun gives the same) and the next takes its opposite.
        middle = int(low[len(low) // 2 : len(low) // 2 + 1].view(np.uint64).sum())
        self.coin = 1 - self.coin if self.state % 2 else (middle * 0x9E3779B97F4A7C15 >> 63) & 1
        self.state += 1
        return low[self.coin :: 2]


class RelativeSketch:
    """Mergeable sketch of a number column; the top of the distribution is the exact end."""

    def __init__(self, k: int = K):
        self.k, self.n = k, 0
        self.levels: list[_Level] = [_Level(k)]

    def update(self, values: np.ndarray) -> RelativeSketch:
        """Add finite values; bulk input goes in by blocks so that the buffers stay small."""
        values = np.ascontiguousarray(values, dtype=np.float64)
        self.n += len(values)
        step = max(4 * self.levels[0].capacity(), 4096)
        for at in range(0, len(values), step):
            self.levels[0].buffer = np.concatenate([self.levels[0].buffer, values[at : at + step]])
            self._compress()
        return self

    def merge(self, other: RelativeSketch) -> RelativeSketch:
        self.n += other.n
        for h, theirs in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(_Level(theirs.size, theirs.sections, theirs.state, theirs.coin, theirs.buffer))
                continue
            mine = self.levels[h]
            if theirs.sections > mine.sections:
                mine.sections, mine.size = theirs.sections, theirs.size
            mine.state |= theirs.state
            mine.buffer = np.concatenate([mine.buffer, theirs.buffer])
        self._compress()
        return self

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            if len(self.levels[h].buffer) >= self.levels[h].capacity():
                up = self.levels[h].compact()
                if len(up):
                    if h + 1 == len(self.levels):
                        self.levels.append(_Level(self.k))
                    self.levels[h + 1].buffer = np.concatenate([self.levels[h + 1].buffer, up])
            h += 1

    def quantiles(self, probs) -> list[float | None]:
        """Values at ranks ceil(p * n): exact while nothing was compacted."""
        if not self.n:
            return [None for _ in probs]
        values = np.concatenate([level.buffer for level in self.levels])
        weights = np.concatenate([np.full(len(level.buffer), 1 << h, dtype=np.int64) for h, level in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        cumulated = np.cumsum(weights[order])
        ranks = np.clip(np.ceil(np.asarray(probs) * cumulated[-1] - 1e-9), 1, cumulated[-1])
        return [float(v) for v in values[order][np.searchsorted(cumulated, ranks)]]

    def rank(self, value: float) -> int:
        """About how many values are at most ``value``."""
        return int(sum((1 << h) * np.count_nonzero(level.buffer <= value) for h, level in enumerate(self.levels)))

    def to_bytes(self) -> bytes:
        head = struct.pack("<iqi", self.k, self.n, len(self.levels))
        parts = [struct.pack("<iiqii", v.size, v.sections, v.state, v.coin, len(v.buffer)) + v.buffer.astype("<f8").tobytes() for v in self.levels]
        return head + b"".join(parts)

    @classmethod
    def from_bytes(cls, blob: bytes) -> RelativeSketch:
        k, n, count = struct.unpack_from("<iqi", blob)
        sketch, at = cls(k), struct.calcsize("<iqi")
        sketch.n, sketch.levels = n, []
        for _ in range(count):
            size, sections, state, coin, length = struct.unpack_from("<iiqii", blob, at)
            at += struct.calcsize("<iiqii")
            sketch.levels.append(_Level(size, sections, state, coin, np.frombuffer(blob, "<f8", length, at).copy()))
            at += 8 * length
        return sketch


CELL = ["metric", "grp", "day"]
_SKETCH_SCHEMA = "metric string, grp string, day date, n_rows long, n_measured long, sketch binary"
_ARROW_TYPES = (pa.string(), pa.string(), pa.date32(), pa.int64(), pa.int64(), pa.binary())
_NAMES = ["metric", "grp", "day", "n_rows", "n_measured", "sketch"]


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _ARROW_TYPES, strict=True)], names=_NAMES)


def _partial(k: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            metric, grp = batch.column("metric").dictionary_encode(), batch.column("grp").dictionary_encode()
            day = batch.column("day").cast(pa.int32()).fill_null(-(2**31)).to_numpy(zero_copy_only=False).astype(np.int64)
            m = metric.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            g = grp.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            value = batch.column("value").cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            code = (m * (len(grp.dictionary) + 1) + g) * 2**33 + day + 2**31
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
            good = np.isfinite(value) & (value > 0)
            for a, b in zip(starts, np.r_[starts[1:], len(order)], strict=True):
                at = order[a:b]
                key = (metric[int(at[0])].as_py(), grp[int(at[0])].as_py(), int(day[at[0]]))
                cell = cells.setdefault(key, [0, [], 0, None])
                cell[0] += b - a
                measured = value[at[good[at]]]
                cell[1].append(measured)
                cell[2] += len(measured)
                if cell[2] > 8192:  # keep memory bounded: fold what has gathered into the sketch
                    cell[3] = (cell[3] or RelativeSketch(k)).update(np.concatenate(cell[1]))
                    cell[1], cell[2] = [], 0
        rows = []
        for (metric, grp, day), (n_rows, rest, _, sketch) in cells.items():
            sketch = (sketch or RelativeSketch(k)).update(np.concatenate(rest) if rest else np.empty(0))
            rows.append((metric, grp, None if day == -(2**31) else day, n_rows, sketch.n, sketch.to_bytes()))
        yield _record(rows)

    return build


def _merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge neighbours of equal cell; the partition is sorted by cell, so one sketch is open at a time."""
    key, n_rows, sketch, done = None, 0, None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in _NAMES]
        for metric, grp, day, rows, _, blob in zip(*columns, strict=True):
            if sketch is not None and key == (metric, grp, day):
                n_rows += rows
                sketch.merge(RelativeSketch.from_bytes(blob))
                continue
            if sketch is not None:
                done.append((*key, n_rows, sketch.n, sketch.to_bytes()))
            key, n_rows, sketch = (metric, grp, day), rows, RelativeSketch.from_bytes(blob)
        if len(done) > 500:
            yield _record(done)
            done = []
    if sketch is not None:
        done.append((*key, n_rows, sketch.n, sketch.to_bytes()))
    yield _record(done)


def merge_sketches(partials: DataFrame) -> DataFrame:
    """One sketch per cell, merged in two rounds.

    A hot cell has a partial from every partition of the scan, a number known only at run time, so its
    partials are first dealt to ``FAN_IN`` tasks; the last round merges at most ``FAN_IN`` sketches a cell.
    """
    salted = partials.withColumn("salt", F.pmod(F.xxhash64("sketch"), F.lit(FAN_IN))).repartition(*CELL, "salt").sortWithinPartitions(*CELL, "salt")
    first = salted.drop("salt").mapInArrow(_merge_sorted, _SKETCH_SCHEMA)
    return first.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(_merge_sorted, _SKETCH_SCHEMA)


def cell_sketches(values: DataFrame, k: int = K) -> DataFrame:
    """Sketch per (metric, grp, day) of ``values(metric, grp, day, value)``.

    Each partition sends one bounded sketch per cell, however many rows a hot group has.
    """
    return merge_sketches(values.select(*CELL, F.col("value").cast("double").alias("value")).mapInArrow(_partial(k), _SKETCH_SCHEMA))


def roll_up(sketches: DataFrame, day) -> DataFrame:
    """Sketches of longer spans (``day`` is an expression of the day) from day sketches alone."""
    return merge_sketches(sketches.withColumn("day", day))


_QUANTILE_SCHEMA = "metric string, grp string, day date, n_rows long, n_measured long, prob double, value double"


def quantile_rows(sketches: DataFrame, probs=PROBS) -> DataFrame:
    """Long table of percentiles, one row per cell and probability."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [RelativeSketch.from_bytes(blob).quantiles(probs) for blob in batch.column("sketch").to_pylist()]
            at = pa.array(np.repeat(np.arange(batch.num_rows), len(probs)))
            kept = [batch.column(c).take(at) for c in _NAMES[:5]]
            prob = pa.array(list(probs) * batch.num_rows, pa.float64())
            value = pa.array([v for row in answers for v in row], pa.float64())
            yield pa.RecordBatch.from_arrays([*kept, prob, value], names=[*_NAMES[:5], "prob", "value"])

    return sketches.mapInArrow(read, _QUANTILE_SCHEMA)


def rank_check(values: DataFrame, sketches: DataFrame, probs=PROBS, k: int = K) -> DataFrame:
    """Every percentile of ``sketches`` against the exact ranks of ``values``: ``within`` the stated error or not.

    Of ties any rank is right, so an answer's distance is that of the wanted rank to its range of ranks.
    """
    answers = quantile_rows(sketches, probs).filter("n_measured > 0")
    good = values.filter((F.col("value") > 0) & (F.col("value") < F.lit(float("inf"))))
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"a.{c}")) for c in CELL]
    # Answers are a few rows a cell; the values are counted against them, cell by cell, with map-side sums.
    met = answers.alias("a").join(good.alias("v"), same)
    ranks = met.groupBy(*[F.col(f"a.{c}").alias(c) for c in CELL], "prob", F.col("a.n_measured").alias("n_measured")).agg(
        F.count(F.when(F.col("v.value") < F.col("a.value"), 1)).alias("below"), F.count(F.when(F.col("v.value") <= F.col("a.value"), 1)).alias("upto")
    )
    wanted = F.greatest(F.ceil(F.col("prob") * F.col("n_measured") - 1e-9), F.lit(1))
    off = F.greatest(F.col("below") + 1 - wanted, wanted - F.col("upto"), F.lit(0))
    return ranks.select(*CELL, "prob", "n_measured", (off <= rank_error(k) * (1 - F.col("prob")) * F.col("n_measured") + 1).alias("within"))
