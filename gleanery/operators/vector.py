"""Vector search: exact top-k in blocks of queries, quantised codes and inverted lists.

The stored vectors are scanned once per block of queries. A block is a broadcast matrix of bounded
size; every task keeps its k best per query in memory while it scans, so only k rows per query and task
are sent and shuffled, whatever the size of the store. Searches on codes compare codes alone; the exact
distance is taken of the survivors only, which are fetched by their ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.lexical import rank_within
from gleanery.runtime import bounded_rows, cut_lineage

#: Queries per broadcast block (4096 * 1024 dimensions * 8 bytes = 32 MB at most in practice).
QUERY_BLOCK = 4096
#: Rows a codebook or centroid set is fitted on: a bounded, hash-ordered sample; every row is indexed.
FIT_SAMPLE = 20_000
SEED = 42

_HITS = "qid long, vec_id long, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix, without a Python object per value where that is possible."""
    n = len(column)
    if not n:
        return np.empty((0, 0))
    flat = column.flatten()
    if column.null_count == 0 and flat.null_count == 0 and len(flat) % n == 0:
        lengths = np.diff(column.offsets.to_numpy())
        if (lengths == lengths[0]).all():
            return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return np.array(column.to_pylist(), dtype=np.float64).reshape(n, -1)


def _hits(qids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["qid", "vec_id", "score"])


def similarity(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Larger is nearer: cosine, inner product, or negative Euclidean distance (by the expanded square)."""
    if metric == "ip":
        return queries @ rows.T
    if metric == "l2":
        square = (queries**2).sum(1)[:, None] - 2 * queries @ rows.T + (rows**2).sum(1)
        return -np.sqrt(np.maximum(square, 0))
    a, b = np.linalg.norm(queries, axis=1, keepdims=True), np.linalg.norm(rows, axis=1, keepdims=True)
    return (queries / np.where(a == 0, 1, a)) @ (rows / np.where(b == 0, 1, b)).T


#: Scores this close to the k-th best are judged on their rounded values and ids.
NEAR = 2e-6


def near_best(scores: np.ndarray, k: int, slack: float = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of all scores not worse than the k-th best of their query, but for ``slack``."""
    if scores.shape[1] <= k:
        return tuple(np.indices(scores.shape).reshape(2, -1))
    limit = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return np.nonzero(scores >= (limit - slack)[:, None])


class Best:
    """The k best rows of each query of a block while a task scans: larger scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k = k
        self.query, self.id, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = np.r_[self.query, query], np.r_[self.id, ids], np.r_[self.score, score]
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        first = np.flatnonzero(np.r_[True, np.diff(query) != 0]) if len(query) else np.empty(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        keep = place < self.k
        self.query, self.id, self.score = query[keep], ids[keep], score[keep]

    def batch(self, qids: np.ndarray) -> pa.RecordBatch:
        return _hits(qids[self.query] if len(self.query) else self.query, self.id, self.score)


def _exact(matrix: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray, rough: np.ndarray, metric: str) -> np.ndarray:
    """Rounded scores of chosen pairs; the expanded square loses digits for close vectors, so these are taken anew."""
    if metric != "l2":
        return np.round(rough[q, r], 6)
    out = np.empty(len(q))
    for at in range(0, len(q), 65_536):
        part = slice(at, at + 65_536)
        out[part] = -np.sqrt(((matrix[q[part]] - rows[r[part]]) ** 2).sum(1))
    return np.round(out, 6)


#: Rows compared with a block of queries at once.
ROW_BLOCK = 2048


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The query set in blocks of bounded size: (ids, matrix)."""
    parts = max(1, math.ceil(queries.count() / block))
    for part in range(parts):
        chosen = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part) if parts > 1 else queries
        rows = bounded_rows(chosen.select("qid", "embedding"), 2 * block, "queries of one block")
        if rows:
            yield np.array([r["qid"] for r in rows], np.int64), np.array([r["embedding"] for r in rows], np.float64)


def exact_top(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """``qid, vec_id, score, rank`` by full scan of ``vectors(vec_id, embedding)``."""
    spark, result = vectors.sparkSession, None
    for qids, matrix in query_blocks(queries):
        shared = spark.sparkContext.broadcast((qids, matrix))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, matrix = shared.value
            best = Best(k)
            for batch in batches:
                ids, rows = batch.column("vec_id").to_numpy(), _matrix(batch.column("embedding"))
                for at in range(0, len(ids), ROW_BLOCK):
                    part = rows[at : at + ROW_BLOCK]
                    rough = similarity(matrix, part, metric)
                    q, r = near_best(rough, k, 1e-4 if metric == "l2" else NEAR)
                    best.add(q, ids[at : at + ROW_BLOCK][r], _exact(matrix, part, q, r, rough, metric))
            yield best.batch(qids)

        found = vectors.filter("embedding is not null").select("vec_id", "embedding").mapInArrow(scan, _HITS)
        result = found if result is None else result.unionByName(found)
    if result is None:
        result = vectors.sparkSession.createDataFrame([], _HITS)
    return rank_within(result, "qid", [F.desc("score"), F.col("vec_id")], k)


#: Survivors of a search on codes whose ids are broadcast to fetch their vectors (24 bytes each).
BROADCAST_SURVIVORS = 1_000_000


def measured(survivors: DataFrame, queries: DataFrame, vectors: DataFrame, metric: str, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The k best of ``survivors(qid, vec_id, *keep)`` by exact distance: their vectors alone are fetched and measured."""
    survivors = cut_lineage(survivors)
    few = F.broadcast(survivors) if survivors.count() <= BROADCAST_SURVIVORS else survivors
    pairs = vectors.filter("embedding is not null").select("vec_id", "embedding").join(few, "vec_id")
    asked = queries.select("qid", F.col("embedding").alias("asked"))
    names = ["qid", "vec_id", *keep]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, rows = _matrix(batch.column("asked")), _matrix(batch.column("embedding"))
            if not len(rows):
                score = np.empty(0)
            elif metric == "l2":
                score = -np.sqrt(((q - rows) ** 2).sum(1))
            else:
                a, b = np.linalg.norm(q, axis=1), np.linalg.norm(rows, axis=1)
                score = (q * rows).sum(1) / np.where(a * b == 0, 1, a * b)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(np.round(score, 6), pa.float64())], names=[*names, "score"])

    schema = ", ".join(f"{c} long" for c in names) + ", score double"
    scored = pairs.join(asked, "qid").select(*names, "asked", "embedding").mapInArrow(measure, schema)
    return rank_within(scored, "qid", [F.desc("score"), F.col("vec_id")], k)


def binary_codes(vectors: DataFrame) -> DataFrame:
    """``vec_id, code``: one bit a dimension, its sign."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("embedding"))
            codes = [c.tobytes() for c in np.packbits(rows > 0, axis=1)] if len(rows) else []
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(codes, pa.binary())], names=["vec_id", "code"])

    return vectors.filter("embedding is not null").select("vec_id", "embedding").mapInArrow(encode, "vec_id long, code binary")


def _code_matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)


def binary_top(queries: DataFrame, vectors: DataFrame, k: int = 10, rerank: int = 100, codes: DataFrame | None = None) -> DataFrame:
    """Two stages: the ``rerank`` nearest sign patterns by Hamming distance, then exact cosine among them.

    ``codes`` is a stored table of ``binary_codes``; without it the codes are made from the vectors.
    """
    codes = binary_codes(vectors) if codes is None else codes
    spark, result = vectors.sparkSession, None
    for qids, matrix in query_blocks(queries):
        shared = spark.sparkContext.broadcast((qids, np.packbits(matrix > 0, axis=1)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, asked = shared.value
            best = Best(rerank)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, rows = batch.column("vec_id").to_numpy(), _code_matrix(batch.column("code"))
                for at in range(0, len(ids), ROW_BLOCK):
                    part = rows[at : at + ROW_BLOCK]
                    distance = np.stack([np.bitwise_count(part ^ a).sum(1) for a in asked]).astype(np.float64)
                    q, r = near_best(-distance, rerank, 0.0)
                    best.add(q, ids[at : at + ROW_BLOCK][r], -distance[q, r])
            yield best.batch(qids)

        found = codes.mapInArrow(scan, _HITS)
        result = found if result is None else result.unionByName(found)
    if result is None:
        result = spark.createDataFrame([], _HITS)
    near = rank_within(result, "qid", [F.desc("score"), F.col("vec_id")], rerank, "coarse_rank").select("qid", "vec_id", (-F.col("score")).cast("long").alias("hamming"))
    return measured(near, queries, vectors, "cosine", k, ("hamming",))


# --- scalar codes ----------------------------------------------------------------------------------


def dimension_ranges(vectors: DataFrame) -> DataFrame:
    """``dim, low, high`` per dimension (0-based); a constant dimension gets a hair of width."""
    flat = vectors.select(F.posexplode("embedding").alias("dim", "v")).groupBy("dim").agg(F.min(F.col("v").cast("double")).alias("low"), F.max(F.col("v").cast("double")).alias("high"))
    return flat.select("dim", "low", F.when(F.col("high") == F.col("low"), F.col("low") + 1e-6).otherwise(F.col("high")).alias("high"))


def scalar_codes(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, code, decoded``: eight-bit codes in -127..127, truncated toward zero, and what they stand for."""
    ranges = F.broadcast(dimension_ranges(vectors))  # one row per dimension
    flat = vectors.select("vec_id", F.posexplode("embedding").alias("dim", "v")).join(ranges, "dim")
    code = ((F.col("v").cast("double") - F.col("low")) * 254.0 / (F.col("high") - F.col("low")) - 127.0).cast("int")
    return flat.select("vec_id", "dim", code.alias("code"), ((code + 127) * (F.col("high") - F.col("low")) / 254.0 + F.col("low")).alias("decoded"), F.col("v").cast("double").alias("v"))


# --- fitted indexes --------------------------------------------------------------------------------


def fit_sample(vectors: DataFrame, size: int = FIT_SAMPLE) -> np.ndarray:
    """A bounded sample in hash order: the same rows whatever the partitioning."""
    rows = vectors.filter("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).select("embedding").collect()
    return np.array([r["embedding"] for r in rows], np.float64)


def k_means(points: np.ndarray, k: int, rounds: int = 15, seed: int = SEED) -> np.ndarray:
    """Lloyd's iterations from distinct random points."""
    rng = np.random.default_rng(seed)
    unique = np.unique(points, axis=0)
    centers = unique[rng.choice(len(unique), min(k, len(unique)), replace=False)]
    for _ in range(rounds):
        nearest = nearest_center(points, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(centers))[:, None]
        centers = np.where(counts > 0, sums / np.maximum(counts, 1), centers)
    return centers


def nearest_center(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((points**2).sum(1)[:, None] - 2 * points @ centers.T + (centers**2).sum(1)).argmin(1)


class Codebooks:
    """Product codes (one layer) or residual codes (several): each layer quantises parts of what is left."""

    def __init__(self, sample: np.ndarray, parts: int, codes: int, layers: int = 1):
        self.parts, self.layers = parts, []
        rest = sample.copy()
        for layer in range(layers):
            books = [k_means(p, codes, seed=SEED + layer) for p in np.split(rest, parts, axis=1)]
            self.layers.append(books)
            rest = rest - self._decode_layer(self._encode_layer(rest, books), books)

    @staticmethod
    def _encode_layer(points, books):
        return np.stack([nearest_center(p, b) for p, b in zip(np.split(points, len(books), axis=1), books, strict=True)], axis=1)

    @staticmethod
    def _decode_layer(codes, books):
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(books)], axis=1)

    def encode(self, points: np.ndarray) -> np.ndarray:
        rest, out = points.copy(), []
        for books in self.layers:
            codes = self._encode_layer(rest, books)
            out.append(codes)
            rest = rest - self._decode_layer(codes, books)
        return np.concatenate(out, axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self._decode_layer(codes[:, i * self.parts : (i + 1) * self.parts], books) for i, books in enumerate(self.layers))


def code_table(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, code``: a byte for each part and layer."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("embedding"))
            codes = [c.tobytes() for c in shared.value.encode(rows).astype(np.uint8)] if len(rows) else []
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(codes, pa.binary())], names=["vec_id", "code"])

    return vectors.filter("embedding is not null").select("vec_id", "embedding").mapInArrow(encode, "vec_id long, code binary")


def coded_top(queries: DataFrame, vectors: DataFrame, books: Codebooks, k: int = 10, rerank: int = 100, codes: DataFrame | None = None) -> DataFrame:
    """The ``rerank`` nearest decoded vectors, found on codes alone; the best of them by exact Euclidean distance."""
    codes = code_table(vectors, books) if codes is None else codes
    spark, result = vectors.sparkSession, None
    for qids, matrix in query_blocks(queries):
        shared = spark.sparkContext.broadcast((qids, matrix, books))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, matrix, books = shared.value
            best = Best(rerank)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, rows = batch.column("vec_id").to_numpy(), _code_matrix(batch.column("code"))
                for at in range(0, len(ids), ROW_BLOCK):
                    rough = similarity(matrix, books.decode(rows[at : at + ROW_BLOCK].astype(np.int64)), "l2")
                    q, r = near_best(rough, rerank)
                    best.add(q, ids[at : at + ROW_BLOCK][r], rough[q, r])
            yield best.batch(qids)

        found = codes.mapInArrow(scan, _HITS)
        result = found if result is None else result.unionByName(found)
    if result is None:
        result = spark.createDataFrame([], _HITS)
    near = rank_within(result, "qid", [F.desc("score"), F.col("vec_id")], rerank, "coarse_rank").select("qid", "vec_id")
    return measured(near, queries, vectors, "l2", k)


def inverted_lists(vectors: DataFrame, centers: np.ndarray, copies: int = 4) -> DataFrame:
    """``vec_id, list_no, embedding``: every vector under each of its ``copies`` nearest centers.

    A vector near a border stands on both sides of it, so few lists hold a query's neighbours.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("embedding"))
            near = np.argsort(-similarity(rows, shared.value, "l2"), axis=1, kind="stable")[:, :copies] if len(rows) else np.empty((0, 1), np.int64)
            at = pa.array(np.repeat(np.arange(len(rows)), near.shape[1]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), pa.array(near.ravel(), pa.int32()), batch.column("embedding").take(at)], names=["vec_id", "list_no", "embedding"])

    return vectors.filter("embedding is not null").select("vec_id", "embedding").mapInArrow(assign, "vec_id long, list_no int, embedding array<float>")


def write_lists(vectors: DataFrame, centers: np.ndarray, path: str, copies: int = 4) -> None:
    """Inverted lists as a store with a folder for each list."""
    inverted_lists(vectors, centers, copies).repartition("list_no").write.mode("overwrite").partitionBy("list_no").parquet(path)


def list_top(queries: DataFrame, lists: DataFrame, centers: np.ndarray, probes: int, k: int = 10, copies: int = 4) -> DataFrame:
    """``qid, vec_id, score, rank, n_read``: search of the ``probes`` lists whose centers are nearest to the query.

    Folders of lists that no query of a block probes are pruned; a list is compared with the queries that
    probe it only. ``n_read`` is the number of rows a query was compared with.
    """
    spark, result = lists.sparkSession, None
    for qids, matrix in query_blocks(queries):
        near = np.argsort(-similarity(matrix, centers, "l2"), axis=1, kind="stable")[:, :probes]
        wanted = {int(n): np.flatnonzero((near == n).any(1)) for n in np.unique(near)}
        shared = spark.sparkContext.broadcast((qids, matrix, wanted))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, matrix, wanted = shared.value
            best, read = Best(k * copies), np.zeros(len(qids), np.int64)
            for batch in batches:
                ids, numbers, rows = batch.column("vec_id").to_numpy(), batch.column("list_no").to_numpy(), _matrix(batch.column("embedding"))
                for number in np.unique(numbers):
                    asked, here = wanted[int(number)], np.flatnonzero(numbers == number)
                    read[asked] += len(here)
                    for at in range(0, len(here), ROW_BLOCK):
                        part = rows[here[at : at + ROW_BLOCK]]
                        rough = similarity(matrix[asked], part, "l2")
                        q, r = near_best(rough, k * copies, 1e-4)
                        best.add(asked[q], ids[here[at : at + ROW_BLOCK]][r], _exact(matrix[asked], part, q, r, rough, "l2"))
            at = np.flatnonzero(read)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[qids[best.query], qids[at]].astype(np.int64), pa.int64()), pa.array([*best.id.tolist(), *[None] * len(at)], pa.int64()), pa.array([*best.score.tolist(), *[None] * len(at)], pa.float64()), pa.array([*[0] * len(best.id), *read[at].tolist()], pa.int64())], names=["qid", "vec_id", "score", "n_read"])

        chosen = lists.filter(F.col("list_no").isin(sorted(wanted))).select("vec_id", "list_no", "embedding")
        found = chosen.mapInArrow(scan, "qid long, vec_id long, score double, n_read long")
        result = found if result is None else result.unionByName(found)
    if result is None:
        result = spark.createDataFrame([], "qid long, vec_id long, score double, n_read long")
    result = cut_lineage(result)
    read = result.groupBy("qid").agg(F.sum("n_read").alias("n_read"))
    once = result.filter("vec_id is not null").groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
    return rank_within(once, "qid", [F.desc("score"), F.col("vec_id")], k).join(read, "qid")


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of each query's true neighbours that were found."""
    hits = truth.select("qid", "vec_id").join(found.select("qid", "vec_id"), ["qid", "vec_id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    return truth.select("qid").distinct().join(hits, "qid", "left").select("qid", F.round(F.coalesce("hits", F.lit(0)) / k, 6).alias("recall"))


def tiered(hot: DataFrame, cold: DataFrame, k: int) -> DataFrame:
    """Hot hits first; cold hits fill what is missing. A vector in both tiers may come twice."""
    both = hot.select("qid", "vec_id", "score", "rank", F.lit(1).alias("tier")).unionByName(cold.select("qid", "vec_id", "score", "rank", F.lit(2).alias("tier")))
    return rank_within(both.withColumnRenamed("rank", "tier_rank"), "qid", [F.col("tier"), F.col("tier_rank")], k)
