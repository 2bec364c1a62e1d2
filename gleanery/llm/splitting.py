"""Splitting oversized items at natural boundaries with balanced targets.

The smallest possible number of pieces is computed, equal-length targets are placed, and each target
is snapped to the strongest boundary near it (headings and blank lines before line ends, sentence
ends, clause marks and spaces). Each piece then starts up to ``overlap`` characters before the cut,
at a boundary if there is one. If a piece breaks the limit, one more piece is planned.

Defined results for odd input: null content gives no pieces; empty or short content (at most
``limit``) is one piece, blank or not; text without any boundary is cut at the targets, but never inside
a surrogate pair, before a combining mark or at a joiner. Lengths are code points. A document sent twice is
split once; documents without an id are all kept. Pieces cover the text without gaps: dropping each piece's overlap and joining gives it back.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.runtime import once

LIMIT, OVERLAP = 800, 100

#: Boundary strengths, strongest first; the position is where the next piece may begin.
_BOUNDARIES = (
    (6.0, re.compile(r"\n(?=#{1,6} )")),
    (5.0, re.compile(r"\n[ \t\r]*\n\s*")),
    (4.0, re.compile(r"\n")),
    (3.0, re.compile(r"[。！？；…][”’」』）】\"']*|[.!?;][\"')\]]*(?=\s)\s?")),
    (2.0, re.compile(r"[，、：]|[,:](?=\s)\s?")),
    (1.0, re.compile(r"[ \t]+")),
)


def boundaries(text: str) -> dict[int, float]:
    """Cut positions with the strength of the boundary that ends there."""
    found: dict[int, float] = {}
    for strength, pattern in reversed(_BOUNDARIES):
        for match in pattern.finditer(text):
            if 0 < match.end() < len(text):
                found[match.end()] = strength
    return found


def _whole(text: str, at: int) -> int:
    """The nearest position at or before ``at`` that does not part a character from its marks."""
    low = max(at - 32, 1)
    while at > low and (unicodedata.combining(text[at]) or text[at] in "‍️︎" or text[at - 1] == "‍"):
        at -= 1
    return at


def _snap(positions: list[int], strength: dict[int, float], target: float, low: int, high: int) -> int | None:
    """The best boundary in [low, high]: its strength, less up to two grades for the distance."""
    best, best_score = None, float("-inf")
    reach = max(target - low, high - target, 1)
    for p in positions[bisect_left(positions, low) : bisect_right(positions, high)]:
        score = strength[p] - 2 * abs(p - target) / reach
        if score > best_score:
            best, best_score = p, score
    return best


def split_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece, at most ``limit`` long, sharing at most ``overlap`` with the one before."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    strength = boundaries(text)
    positions = sorted(strength)
    fewest = -(-(n - overlap) // (limit - overlap))
    # A fixed number of plans, so that the work grows with the text only, however many cuts must be forced.
    counts = sorted({fewest, fewest + 1, fewest + 2, -(-9 * fewest // 8), -(-5 * fewest // 4), -(-3 * fewest // 2)})
    best, least = None, n
    for count in counts:
        pieces = _plan(text, positions, strength, n / count, count, limit, overlap)
        if not pieces:
            continue
        forced = sum(end not in strength for _, end in pieces[:-1])
        # A cut inside running text is worth more pieces, the fewest that avoid it.
        if forced < least:
            best, least = pieces, forced
        if not forced:
            break
    return best or _hard(text, limit, overlap)


def _hard(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Full-length pieces wherever no plan holds; characters are only parted from their marks where nothing else fits."""
    pieces, start, at = [], 0, 0
    while True:
        end = min(len(text), start + limit)
        if end < len(text) and (whole := _whole(text, end)) > at:
            end = whole
        pieces.append((start, end))
        if end == len(text):
            return pieces
        low = max(end - overlap, start + 1)
        near = next((p for p in range(low, min(low + 32, end)) if _whole(text, p) == p), low)
        start, at = near, end


def _plan(text, positions, strength, size, count, limit, overlap):
    n, cuts, at = len(text), [], 0
    for i in range(1, count):
        # The end of this piece must leave room for the overlap that comes before it and for the pieces after it.
        high = min(n - 1, at + limit - (overlap if at else 0))
        low = max(at + 1, n - (count - i) * (limit - overlap))
        if low > high:
            return None
        target = min(max(i * size, low), high)
        slack = max(size / 2, 1)
        cut = _snap(positions, strength, target, int(max(low, target - slack)), int(min(high, target + slack)))
        at = cut if cut is not None else max(_whole(text, int(target)), at + 1)
        cuts.append(at)
        if at >= n - 1:
            break
    pieces = [(0, cuts[0])]
    for begin, end in zip(cuts, [*cuts[1:], n], strict=True):
        earliest = max(begin - overlap, pieces[-1][0] + 1, end - limit)
        if earliest > begin:
            return None
        start = _snap(positions, strength, earliest, earliest, begin - 1) if overlap and earliest < begin else None
        if start is None:
            start = max(_whole(text, earliest), end - limit, pieces[-1][0] + 1, begin - overlap)
        if end - start > limit or start > begin:
            return None
        pieces.append((start, end))
    return pieces


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, starts, ends, texts = [], [], [], [], []
            for row, text in enumerate(batch.column("content").to_pylist()):
                if text is None:
                    continue
                for piece, (start, end) in enumerate(split_points(text, limit, overlap), 1):
                    at.append(row)
                    number.append(piece)
                    starts.append(start)
                    ends.append(end)
                    texts.append(text[start:end])
                if len(at) > 5000:
                    yield _pieces(batch, at, number, starts, ends, texts)
                    at, number, starts, ends, texts = [], [], [], [], []
            yield _pieces(batch, at, number, starts, ends, texts)

    return run


def _pieces(batch, at, number, starts, ends, texts):
    rows = pa.array(at, pa.int64())
    kept = [batch.column(c).take(rows) for c in ("doc_id", "source", "page")]
    made = [pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(kept + made, names=["doc_id", "source", "page", "piece_no", "start_pos", "end_pos", "piece"])


def split_documents(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces ``doc_id, source, page, piece_no, start_pos, end_pos, piece`` of every document.

    A narrow map: no shuffle but the one that drops records sent twice. Documents within the limit
    pass through unchanged as one piece.
    """
    single = once(chunks.select("doc_id", "source", "page", "content"), "doc_id")
    schema = "doc_id string, source string, page int, piece_no int, start_pos long, end_pos long, piece string"
    short = single.filter(F.length("content") <= limit).select("doc_id", "source", "page", F.lit(1).alias("piece_no"), F.lit(0).cast("long").alias("start_pos"), F.length("content").cast("long").alias("end_pos"), F.col("content").alias("piece"))
    long = single.filter(F.length("content") > limit).mapInArrow(_split(limit, overlap), schema)
    return short.unionByName(long)


def oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id`` of the documents the splitter had to cut."""
    cut = chunks.select("doc_id", "source", "page", "content").mapInArrow(_split(limit, overlap), "doc_id string, source string, page int, piece_no int, start_pos long, end_pos long, piece string")
    return cut.filter(F.col("piece_no") == 2).select("doc_id").distinct()


def cover(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_chars, text_md5, in_limits`` of the documents the pieces make when their overlaps are dropped.

    A document's pieces are put together in one row, as it was one row before.
    """
    parts = pieces.filter("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", "piece"))).alias("p"))
    shared = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("p", i - 1)["end_pos"] - F.get("p", i)["start_pos"]))
    rows = parts.withColumn("shared", shared)
    whole = F.array_join(F.zip_with("p", "shared", lambda x, n: F.substring(x["piece"], (n + 1).cast("int"), F.lit(limit))), "")
    fits = F.forall("p", lambda x: (F.length(x["piece"]) <= limit) & (F.length(x["piece"]) == x["end_pos"] - x["start_pos"])) & F.forall("shared", lambda n: n.between(0, overlap))
    return rows.select("doc_id", F.length(whole).cast("long").alias("n_chars"), F.md5(whole).alias("text_md5"), fits.alias("in_limits"))
