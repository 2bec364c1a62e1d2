"""Evaluation texts leaking into training text.

The test passages form a BM25 inverted index over 8-character windows of the normalised text (letters
and digits after NFKC and lower-casing). Every training document is cut into overlapping passages, each
passage is a query, and block-max WAND walks the posting lists of its windows: postings are skipped
while the block maxima cannot reach the threshold. The threshold of an item is the smallest BM25 score
that any run of ``RUN`` shared characters gives, so no leak can lie below it; the weights of an item are
taken in units of its threshold, so that each is pruned by its own. What is retrieved
is checked exactly for a shared run; overlap with the item's question and answer is reported.

Test items are read in blocks of bounded size, each a broadcast index against all documents; documents
are only scanned, never shuffled. Long passages are indexed as parts that overlap by a run less one.

Defined results for odd input: items without an id, with a null passage or one under ``RUN`` letters and digits leak
nothing; null, empty and short texts contain nothing; very long texts are queried whole, passage by
passage; equal documents each come out under their own id, equal rows once; equal passages leak
together; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.runtime import bounded_rows, cut_lineage, spread

RUN, WIDTH = 40, 8
#: Query passages: any run of RUN characters lies whole in one of them.
PASSAGE, STRIDE = 512, 512 - RUN + 1
#: Characters of passages per broadcast index (about 100 MB there); more take more rounds over the documents.
BLOCK_CHARS = 2_000_000
#: Characters of a passage that are one entry of the index.
PART = 2048
#: Leaks whose documents are looked up by a broadcast of their ids (16 bytes each); more are joined by shuffle.
FEW_LEAKS = 500_000
K1, B = 1.2, 0.75
POSTING_BLOCK = 32

_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    """Letters and digits after NFKC and lower-casing."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text or "").lower())


def windows(text: str, width: int = WIDTH) -> np.ndarray:
    """Hashes of the character windows, in text order."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(chars) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            h = (h ^ chars[i : i + n]) * _MIX
            h ^= h >> np.uint64(29)
    return h


class ItemIndex:
    """Impact-ordered BM25 postings of the test items with block maxima."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN):
        self.run = run
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        grams = [windows(t) for t in self.texts]
        counts = [np.unique(g, return_counts=True) for g in grams]
        n_items = len(items)
        average = sum(map(len, grams)) / max(n_items, 1) or 1.0
        vocabulary, df = np.unique(np.concatenate([c[0] for c in counts]), return_counts=True) if n_items else (np.empty(0, np.uint64), np.empty(0, int))
        idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
        postings: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
        self.threshold = np.full(n_items, np.inf)
        for item, (gram, (term, tf)) in enumerate(zip(grams, counts, strict=True)):
            at = np.searchsorted(vocabulary, term)
            weight = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(gram) / average))
            for t, w in zip(at.tolist(), weight.tolist(), strict=True):
                postings[t].append((item, w))
            span = run - WIDTH + 1
            if len(gram) >= span:
                # Least score of a shared run: repeats inside the run count once, as in a query.
                place = np.searchsorted(term, gram)
                low = math.inf
                for a in range(len(gram) - span + 1):
                    low = min(low, float(weight[np.unique(place[a : a + span])].sum()))
                self.threshold[item] = low * (1 - 1e-9)
            for t in at.tolist():
                postings[t][-1] = (item, postings[t][-1][1] / self.threshold[item])
        self.vocabulary = vocabulary
        self.lists = [([p[0] for p in ps], [p[1] for p in ps]) for ps in postings]
        self.blocks = [[(items_[min(b + POSTING_BLOCK, len(items_)) - 1], max(weights[b : b + POSTING_BLOCK])) for b in range(0, len(items_), POSTING_BLOCK)] for items_, weights in self.lists]
        self.best = np.array([max(w) for _, w in self.lists]) if len(self.lists) else np.empty(0)
        self.runs = [{t[i : i + run] for i in range(len(t) - run + 1)} for t in self.texts]

    def candidates(self, terms: np.ndarray) -> list[int]:
        """Items whose BM25 score for the query terms reaches their threshold (1 in their units), by block-max WAND."""
        if not len(terms) or float(self.best[terms].sum()) < 1:
            return []
        return [item for item, _ in block_max_wand([self.lists[t] for t in terms], [self.blocks[t] for t in terms], self.best[terms].tolist(), 1.0)]

    def leaks(self, text: str) -> set[int]:
        """Positions of the items of which ``text`` (normalised) contains a run."""
        if len(text) < self.run or not len(self.vocabulary):
            return set()
        grams = windows(text)
        at = np.searchsorted(self.vocabulary, grams)
        at[at == len(self.vocabulary)] = 0
        hit = self.vocabulary[at] == grams
        if int(hit.sum()) < 1:
            return set()
        found: set[int] = set()
        for start in range(0, max(len(text) - self.run, 0) + 1, STRIDE):
            inside = slice(start, start + PASSAGE - WIDTH + 1)
            terms = np.unique(at[inside][hit[inside]])
            for item in self.candidates(terms):
                if item not in found and self.shares_run(text[start : start + PASSAGE], item):
                    found.add(item)
        return found

    def shares_run(self, text: str, item: int) -> bool:
        runs = self.runs[item]
        return any(text[i : i + self.run] in runs for i in range(len(text) - self.run + 1))


def block_max_wand(lists, blocks, best, threshold) -> list[tuple[int, float]]:
    """All (item, score) with score >= threshold; lists are (sorted items, weights), blocks their (last item, maximum)."""
    out: list[tuple[int, float]] = []
    cursor = [0] * len(lists)
    alive = [i for i in range(len(lists)) if lists[i][0]]
    head = {i: lists[i][0][0] for i in alive}
    while alive:
        alive.sort(key=head.__getitem__)
        bound, pivot = 0.0, -1
        for p, i in enumerate(alive):
            bound += best[i]
            if bound >= threshold:
                pivot = p
                break
        if pivot < 0:
            break
        item = head[alive[pivot]]
        while pivot + 1 < len(alive) and head[alive[pivot + 1]] == item:
            pivot += 1
        # Bound by the maxima of the blocks that may hold the pivot item.
        local, border = 0.0, math.inf
        for i in alive[: pivot + 1]:
            b = cursor[i] // POSTING_BLOCK
            while b < len(blocks[i]) and blocks[i][b][0] < item:
                b += 1
            if b < len(blocks[i]):
                local += blocks[i][b][1]
                border = min(border, blocks[i][b][0] + 1)
        target = item
        if local >= threshold:
            if head[alive[0]] == item:
                score = 0.0
                for i in alive[: pivot + 1]:
                    score += lists[i][1][cursor[i]]
                if score >= threshold:
                    out.append((item, score))
                target = item + 1
        else:
            # No item before the nearest block border can reach the threshold; lists after the pivot come first otherwise.
            after = head[alive[pivot + 1]] if pivot + 1 < len(alive) else math.inf
            target = max(item + 1, min(border, after))
        still = []
        for p, i in enumerate(alive):
            if p <= pivot and head[i] < target:
                items = lists[i][0]
                cursor[i] = bisect_left(items, target, cursor[i]) if target != math.inf else len(items)
                if cursor[i] >= len(items):
                    continue
                head[i] = items[cursor[i]]
            still.append(i)
        alive = still
    return out


def _scan(index, run: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for batch in batches:
            docs, items = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for item in sorted(held.leaks(normal(text))):
                    docs.append(doc)
                    items.append(held.ids[item])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int32())], names=["doc_id", "item_id"])

    return search


def parts_of(items: list[tuple[int, str]], run: int) -> list[tuple[int, str]]:
    """Entries of the index: a run of a passage lies whole in one of its parts."""
    return [(i, t[a : a + PART]) for i, t in items for a in range(0, max(len(t) - run, 0) + 1, PART - run + 1) if len(t) - a >= run]


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id`` of every document that contains a run of a test passage."""
    spark = documents.sparkSession
    usable = items.filter("passage is not null and id is not null").select("id", "passage").distinct()
    sizes = usable.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("passage")), F.lit(0)).alias("chars")).first()
    parts = max(1, math.ceil(sizes["chars"] / block_chars))
    result = None
    for part in range(parts):
        chosen = usable.filter(F.pmod(F.xxhash64("id", "passage"), F.lit(parts)) == part) if parts > 1 else usable
        rows = bounded_rows(chosen, 2 * math.ceil(sizes["n"] / parts) + 1000, "items of one index block")
        pairs = [(r["id"], t) for r in rows if len(t := normal(r["passage"])) >= run]
        index = spark.sparkContext.broadcast(ItemIndex(parts_of(sorted(pairs), run), run))
        found = spread(documents.select("doc_id", "text")).mapInArrow(_scan(index, run), "doc_id long, item_id int")
        result = found if result is None else result.unionByName(found)
    return result.distinct()


_OVERLAP = "doc_id long, item_id int, longest_run int, question_overlap double, answer_overlap double"


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs, questions, answers = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("text", "passage", "query", "expected_contains")]
        for text, passage, query, expected in zip(*columns, strict=True):
            text, passage, query = normal(text), normal(passage), normal(query)
            runs.append(longest_run(text, passage))
            grams = {query[i : i + 3] for i in range(len(query) - 2)}
            questions.append(sum(g in text for g in grams) / len(grams) if grams else 0.0)
            wanted = [w for w in map(normal, expected or []) if w]
            answers.append(sum(w in text for w in wanted) / len(wanted) if wanted else 0.0)
        made = [pa.array(runs, pa.int32()), pa.array(questions, pa.float64()), pa.array(answers, pa.float64())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), *made], names=["doc_id", "item_id", "longest_run", "question_overlap", "answer_overlap"])


def longest_run(text: str, passage: str) -> int:
    """Length of the longest common substring: runs of a length either all extend a shorter shared one or none exists."""
    low, high = 0, min(len(text), len(passage))
    while low < high:
        middle = (low + high + 1) // 2
        grams = {passage[i : i + middle] for i in range(len(passage) - middle + 1)}
        if any(text[i : i + middle] in grams for i in range(len(text) - middle + 1)):
            low = middle
        else:
            high = middle - 1
    return low


def leak_details(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """Every leak with its longest run and the overlap of question and expected answer words."""
    found = cut_lineage(leaks(documents, items, run))
    # Texts of the few documents that leak are found by a broadcast of ids; only many leaks are worth a shuffle.
    found = F.broadcast(found) if found.count() <= FEW_LEAKS else found
    joined = documents.select("doc_id", "text").join(found, "doc_id").join(items.select(F.col("id").alias("item_id"), "passage", "query", "expected_contains"), "item_id")
    return joined.select("doc_id", "item_id", "text", "passage", "query", "expected_contains").mapInArrow(_overlaps, _OVERLAP)
