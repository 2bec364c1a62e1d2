"""Per-document text statistics, and texts that are no natural prose.

Each text gives a row of statistics (words, mean word length, shares of symbols, of lines with closing
punctuation, of common words, of list and table lines, of odd characters, of repeats, ...). Statistics
are gathered per language in mergeable quantile sketches; every value then becomes a robust z-score
against the median and the half spreads of its language, and texts in a tail are flagged.
What kind a flagged text is follows from which tail and a check that what shows there is most of the text.

How usual a text's character pairs are is a statistic too; it is taken against the pairs of the whole
corpus, counted per language in a fixed-size table.

Defined results for odd input: null and empty texts have zero statistics and no kind; texts under
``LEAST`` characters have statistics but no kind; very long texts are read whole; a language that is
null, wrong or spelt otherwise is taken from the text; a document sent twice counts once in results; one without an id keeps a null id;
an empty table gives no rows. A text has at most one kind, junk before table before list.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.runtime import cut_lineage, spread

LEAST = 20

#: Frequent words per language, as plain lists.
COMMON = {
    "en": frozenset("the of and to in a is that it as was for with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people mr how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()),
    "de": frozenset("der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wenn allein keine lässt schwer danach sollte zuerst meisten fällen ab umgekehrt geblieben deutlich vergleich tagen verglichen bedeutet fehlt".split()),
    "es": frozenset("de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada e vida otro después te otros aunque esa eso hace otra gobierno tan durante siempre día tanto ella tres sí dijo sido gran país según menos mucho comparó significa conviene revisar primero luego frente mantuvo depende todo revés".split()),
    "zh": frozenset("的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经十三之进着等部度家电力里如水化高自二理起小物现实加量都两体制机当使点从业本去把性好应开它合还因由其些然前外天政四日那社义事平形相全表间样与关各重新线内数正心反你明看原又么利比或但质气第向道命此变条只没结解问意建月公无系军很情者最立代想已通并提直题党程展五果料象员革位入常文总"),
}
_SPELLINGS = {"zh": "zh", "cn": "zh", "chinese": "zh", "中文": "zh", "en": "en", "eng": "en", "english": "en", "de": "de", "ger": "de", "deu": "de", "german": "de", "deutsch": "de", "es": "es", "spa": "es", "spanish": "es", "español": "es"}

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CJK = re.compile(r"[㐀-鿿]")
_LATIN = re.compile(r"[^\W\d_㐀-鿿]+(?:['’][^\W\d_㐀-鿿]+)?")
_MOJIBAKE = re.compile(r"[À-ÿ][-¿ŒœŠšŽžŸƒˆ˜–-—‘-„†-•…‰‹›€™]")
_CLOSING = ".!?。！？…:：;；\"”’」』)）"
_BULLET = re.compile(r"^\s*(?:[-*•·▪◦‣●○–]\s+|[-*•·▪◦‣●○]|\[[ xX✓]?\]\s*|[（(]?(?:\d{1,3}|[a-zA-Z]|[一二三四五六七八九十]{1,3}|[ivxIVX]{1,4})[)）.、．]\s*)(?=\S)")
_LEADER = re.compile(r"(?:\.\s?){4,}\s*\d*\s*$|…{2,}\s*\d*\s*$|\s{3,}\d{1,4}\s*$|(?:·\s?){4,}\s*\d*\s*$")
_RULE = re.compile(r"^[\s|+:=\-_*~]+$")
_SENTENCE_END = re.compile(r"[。！？!?]|[.](?=\s|$)")
_HEADING = re.compile(r"^\s{0,3}#{1,6}\s")


_VOWELS = "aeiouyäöüáéíóúà-ÿ"
#: Words (between single spaces) without a vowel, or with five and more consonants in a row.
_HARD = re.compile(rf"(?<!\S)(?:[^{_VOWELS}\s]+|\S*?[^{_VOWELS}\s]{{5}}\S*)(?!\S)")
#: Letters around a symbol, or case and digits mixed inside a word.
_MIXED = re.compile(r"[^\W\d_][^\w\s'’\-.·/@:（）()，。、：；]+[^\W\d_]|[a-z][A-Z0-9]|[0-9][a-z]")
_HEX = re.compile(r"[0-9a-fA-F]+\Z")


#: Classes of characters, one byte for each code of the basic plane; the rest are looked up singly.
LETTER, DIGIT, ODD, HAN, COMMON_HAN = 1, 2, 4, 8, 16


def _classes(code: int) -> int:
    kind = unicodedata.category(chr(code))
    han = 0x3400 <= code <= 0x9FFF
    marks = LETTER * (kind[0] in "LM") + DIGIT * (kind[0] == "N") + ODD * (kind in ("Cc", "Co", "Cn") or code == 0xFFFD)
    return marks + HAN * han + COMMON_HAN * (han and chr(code) in COMMON["zh"])


@lru_cache(maxsize=1)
def _plane() -> np.ndarray:
    return np.fromiter(map(_classes, range(0x10000)), np.uint8, 0x10000)


class Characters:
    """What the characters of a text are, counted without looking at them one by one."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        marks = _plane()[np.minimum(codes, 0xFFFF)]
        beyond = np.flatnonzero(codes > 0xFFFF)
        if len(beyond):
            marks[beyond] = [_classes(c) for c in codes[beyond].tolist()]
        self.counts = np.bincount(marks, minlength=32)
        self.marks = np.arange(len(self.counts))

    def of(self, mark: int) -> int:
        return int(self.counts[self.marks & mark > 0].sum())


def language(lowered: str, words: list[str], letters: int, han: int, said: str | None) -> str:
    """Language from script and function words; what is said only breaks a draw."""
    said = _SPELLINGS.get((said or "").strip().lower().split("-")[0].split("_")[0], "other")
    if letters < 3:
        return said
    if han >= 0.2 * letters:
        return "zh"
    hits = {code: sum(map(COMMON[code].__contains__, words)) for code in ("en", "de", "es")}
    best = max(hits, key=lambda c: (hits[c], c == said))
    return best if hits[best] >= max(2, 0.05 * len(words)) else said


def _cells(line: str) -> int:
    """Cells of a table row written with bars, tabs, quoted fields, commas or aligned blanks; 0 for other lines."""
    body = line.strip()
    if body.count("|") >= 2 or (body.startswith("+-") and body.endswith("+")):
        return body.strip("|").count("|") + 1
    if body.count("\t") >= 1:
        return body.count("\t") + 1
    if '";"' in body or '","' in body:
        return len(re.split(r'"[;,]"', body))
    gaps = len(re.findall(r"\S(?: {3,}|　{2,})(?=\S)", body)) if "   " in body or "　　" in body else 0
    if gaps >= 1 and not _LEADER.search(body):
        return gaps + 1
    for mark in (";", ",", "，"):
        if body.count(mark) < 2:
            continue
        fields = [f.strip() for f in body.split(mark)]
        if len(fields) >= 3 and max(map(len, fields)) <= 48 and not _SENTENCE_END.search(body):
            return len(fields)
    return 0


def _line_kinds(lines: list[str]) -> list[str]:
    """'table', 'list', 'prose' or 'blank' for each line; tables need neighbours of as many cells."""
    cells = [_cells(x) for x in lines]
    kinds = []
    for i, line in enumerate(lines):
        body = line.strip()
        if not body:
            kinds.append("blank")
            continue
        near = [cells[j] for j in range(max(0, i - 3), min(len(lines), i + 4)) if j != i and cells[j]]
        if (cells[i] and cells[i] in near and (cells[i] >= 3 or "|" in body or "\t" in body or '";"' in body or '","' in body or "   " in body)) or (_RULE.match(body) and len(body) >= 3 and near):
            kinds.append("table")
        elif _HEADING.match(line):
            kinds.append("heading")
        elif _LEADER.search(body):
            kinds.append("list")
        elif _BULLET.match(line):
            item = _BULLET.sub("", line).strip()
            kinds.append("prose" if _is_sentence(item) else "list")
        else:
            kinds.append("prose" if _is_sentence(body) or _is_running(body) else "entry")
    # Wrapped prose: a line without an end belongs to the sentence that ends in a later line.
    width = max((len(x.strip()) for x in lines), default=0)
    for i in range(len(lines) - 1, -1, -1):
        if kinds[i] == "entry" and len(lines[i].strip()) >= 0.72 * width and width >= 25 and not re.search(r"[:：]", lines[i][-40:]):
            after = next((k for k in kinds[i + 1 : i + 2]), "blank")
            before = kinds[i - 1] if i else "blank"
            if after == "prose" or before == "prose" or any(_SENTENCE_END.search(x) for x in lines[max(0, i - 2) : i + 3]):
                kinds[i] = "prose"
    return kinds


def _is_sentence(item: str) -> bool:
    """A full sentence, or long enough running text with inner punctuation."""
    item = item.rstrip(";；,，、")
    bare = item.rstrip("🙂 \t*_”’\"')）]】")
    if re.search(r"[。！？!?.…]$", bare) and (len(_CJK.findall(item)) >= 8 or len(_WORD.findall(item)) >= 5):
        return True
    inner = len(re.findall(r"[，。；！？]|[,.;!?](?=\s)", item))
    return (len(_CJK.findall(item)) >= 18 and inner >= 1) or (len(_WORD.findall(item)) >= 12)


def _is_running(line: str) -> bool:
    """Part of a wrapped sentence: function words, or sentence marks inside."""
    words = [w.lower() for w in _WORD.findall(line)]
    if len(words) >= 5 and sum(w in COMMON["en"] or w in COMMON["de"] or w in COMMON["es"] for w in words) >= 0.2 * len(words):
        return True
    return len(_CJK.findall(line)) >= 8 and bool(re.search(r"[，。！？](?=.)", line))


def _inline_list(text: str) -> float:
    """Share of the text in one-line enumerations: many short items between equal separators."""
    share = 0
    for line in text.split("\n"):
        for mark in (" / ", "、", " | ", " · ", " • ", "；", "; ", ", ", "，"):
            items = line.split(mark)
            if len(items) >= 6 and sum(len(x) <= 70 and not _SENTENCE_END.search(x[:-1]) for x in items) >= 0.9 * len(items) and np.median([len(x) for x in items]) <= 45:
                if mark in ("，", ", ") and (_SENTENCE_END.search(line.rstrip()[:-1]) or sum(w.lower() in COMMON["en"] for w in _WORD.findall(line)) > 0.1 * len(_WORD.findall(line))):
                    continue
                share += len(line)
                break
    return share / max(len(text), 1)


#: Characters of the runs by whose next occurrence periods are found, and the least stretch that counts as repeated.
RUN, STRETCH = 8, 24


def _periods(codes: np.ndarray) -> list[int]:
    """Distances at which runs of the text come again, if a twentieth of them or more do; at most twenty."""
    n = len(codes) - RUN + 1
    keys = np.zeros(n, np.uint64)
    for i in range(RUN):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n].astype(np.uint64) + np.uint64(1)
    order = np.argsort(keys, kind="stable")
    again = keys[order][1:] == keys[order][:-1]
    gaps = (order[1:] - order[:-1])[again]
    if len(gaps) < 0.05 * n:
        return []
    size, times = np.unique(gaps, return_counts=True)
    return size[(times >= 0.05 * n) & (3 * size <= len(codes))].tolist()


def _repeated(codes: np.ndarray, solid: np.ndarray, period: int) -> float:
    """Share of the text that goes on as it did one period before, in phrases that come three times running.

    A text that is one phrase from some place on may differ in a tenth; else phrases must be equal, and
    letters and digits alone count, so that leaders and rules are no phrase.
    """
    same = codes[period:] == codes[:-period]
    total = np.r_[0, np.cumsum(same)]
    twice = np.flatnonzero(total[period:] - total[:-period] == period)
    whole = 0.0
    if len(twice) and len(codes) - twice[0] >= 3 * period:
        first = int(twice[0])
        hits = int(total[-1] - total[first])
        if hits >= 0.9 * (len(same) - first) and (first == 0 or solid[first : first + period].any()):
            whole = hits / len(same)
    width = max(2 * period, STRETCH)
    if len(same) < width:
        return whole
    starts = np.flatnonzero(total[width:] - total[:-width] == width)
    edge = np.zeros(len(same) + 1, np.int64)
    edge[starts] += 1
    edge[starts + width] -= 1
    covered = (np.cumsum(edge[:-1]) > 0) & solid[period:]
    return max(whole, int(covered.sum()) / max(int(solid[period:].sum()), 1) if solid.sum() >= 0.5 * len(codes) else 0.0)


def _repeats(text: str) -> float:
    """Share of the text that repeats one phrase of any length, wherever the repetition starts."""
    body = "".join(text.split())
    if len(body) < 40:
        return 0.0
    codes = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)
    periods = _periods(codes)
    best = 0.0
    if periods:
        solid = np.fromiter(map(str.isalnum, body), bool, len(body))
        best = max(_repeated(codes, solid, p) for p in periods)
    # The same phrase between other words: parts between any marks, and whole sentences with the marks inside.
    for ends in (_PART_ENDS, _SENTENCE_ENDS):
        units = [u for u in map(str.strip, ends.split(text)) if u]
        if len(units) < 6:
            break
        top, times = Counter(units).most_common(1)[0]
        if times < 5:
            break  # a sentence that comes five times has parts that do
        best = max(best, times * len(top) / max(sum(map(len, units)), 1))
    return best


_PART_ENDS, _SENTENCE_ENDS = re.compile(r"[，。！？,.!?;；\n]+"), re.compile(r"[。！？.!?\n]+")
STATS = ("n_chars", "n_words", "mean_word", "symbol_share", "closed_lines", "common_share", "list_share", "table_share", "odd_share", "repeat_share", "digit_share", "vowel_gap", "mixed_words", "type_ratio", "hex_share", "pair_gain")


#: Han characters and their pairs are counted in tables of this many slots, whatever the corpus.
SLOTS = 1 << 18
_HAN_RUNS = re.compile(r"[㐀-鿿]{2,}")


def _pairs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of first and second character and of the pair, for neighbouring Han characters (of a text without blanks)."""
    joined = " ".join(_HAN_RUNS.findall(text))
    c = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    a, b = c[:-1], c[1:]
    keep = (a > 32) & (b > 32)
    a, b = a[keep], b[keep]
    return a % SLOTS, b % SLOTS, (a * 40503 + b) % SLOTS


class PairTable:
    """Counts of Han characters and their pairs over the corpus."""

    def __init__(self, singles: np.ndarray, pairs: np.ndarray):
        total = float(max(pairs.sum(), 1))
        self.alone = np.log2((singles + 0.5) / total).astype(np.float32)
        self.joint = np.log2((pairs + 0.05) / total).astype(np.float32)

    def gain(self, text: str) -> float:
        """Mean bits by which the text's Han pairs are more usual in the corpus than chance; NaN under 20 pairs."""
        a, b, p = _pairs(text)
        if len(p) < 20:
            return math.nan
        return float((self.joint[p] - self.alone[a] - self.alone[b]).mean(dtype=np.float64))


def statistics(text: str, said: str | None, table: PairTable) -> tuple[str, list[float]]:
    """Language and the STATS of one text; shares are of visible characters, words or non-blank lines."""
    n_chars = float(len(text))
    text = unicodedata.normalize("NFKC", text.replace("…", "\x85")).replace("\x85", "…") if "�" not in text else text
    visible = "".join(text.split())
    n = len(visible)
    found = Characters(visible)
    letters, han = found.of(LETTER), found.of(HAN)
    lowered = text.lower()
    latin = _LATIN.findall(lowered)
    lang = language(lowered, latin, letters, han, said)
    if not n:
        return lang, [n_chars] + [0.0] * (len(STATS) - 1)
    words = len(latin) + han
    if lang == "zh":
        common = (found.of(COMMON_HAN) + sum(map(COMMON["en"].__contains__, latin))) / max(words, 1)
    else:
        common = sum(map(COMMON.get(lang, COMMON["en"]).__contains__, latin)) / max(words, 1)
    digits = found.of(DIGIT)
    odd = found.of(ODD) + 2 * len(_MOJIBAKE.findall(visible))
    lines = text.split("\n")
    kinds = _line_kinds(lines)
    sizes = [len("".join(x.split())) for x in lines]
    listed = sum(s for s, k in zip(sizes, kinds, strict=True) if k in ("list", "entry")) / n
    entries = sum(k in ("list", "entry") for k in kinds)
    tabled = sum(s for s, k in zip(sizes, kinds, strict=True) if k == "table") / n
    filled = [x.rstrip() for x in lines if x.strip()]
    closed = sum(x.rstrip("🙂 ")[-1:] in _CLOSING for x in filled) / max(len(filled), 1)
    inline = _inline_list(text)
    long_words = [w for w in latin if len(w) >= 4]
    hard = len(_HARD.findall(" ".join(long_words))) / max(len(long_words), 1)
    tokens = text.split()
    mixed = sum(map(bool, map(_MIXED.search, tokens))) / max(len(tokens), 1)
    han_kinds = len(_CJK.findall("".join(set(visible)))) if han else 0
    return lang, [
        n_chars,
        float(words),
        sum(map(len, latin)) / len(latin) if latin else 1.0 if han else 0.0,
        1 - (letters + digits) / n,
        closed,
        common,
        max(listed if entries >= 3 else 0.0, inline),
        tabled,
        odd / n,
        _repeats(text),
        digits / n,
        hard,
        mixed,
        (len(set(latin)) + han_kinds) / max(words, 1),
        sum(len(t) for t in tokens if len(t) in (2, 4, 8, 16) and _HEX.match(t)) / n,
        table.gain(visible),
    ]


_COUNTED = "table_no int, block int, counts binary"


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    singles, pairs = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text:
                a, _, p = _pairs("".join(text.split()))
                np.add.at(singles, a, 1)
                np.add.at(pairs, p, 1)
    numbers, blocks, counts = [], [], []
    for number, table in enumerate((singles, pairs)):
        for block, part in enumerate(np.split(table, 32)):
            if part.any():
                numbers.append(number)
                blocks.append(block)
                counts.append(zlib.compress(part.tobytes(), 1))
    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blocks, pa.int32()), pa.array(counts, pa.binary())], names=["table_no", "block", "counts"])


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for number, block, raw in zip(*[batch.column(c).to_pylist() for c in ("table_no", "block", "counts")], strict=True):
            part = np.frombuffer(zlib.decompress(raw), np.int64)
            total[number, block] = total[number, block] + part if (number, block) in total else part
    keys = list(total)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([zlib.compress(total[k].tobytes(), 1) for k in keys], pa.binary())], names=["table_no", "block", "counts"])


def pair_tables(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all documents; two tables of SLOTS counters (4 MB), so they may go to every task."""
    summed = spread(documents.select("text")).mapInArrow(_count_pairs, _COUNTED).repartition(8, "table_no", "block").mapInArrow(_add_blocks, _COUNTED)
    tables = np.zeros((2, 32, SLOTS // 32), np.int64)
    for row in summed.collect():
        tables[row["table_no"], row["block"]] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return tables[0].reshape(-1), tables[1].reshape(-1)


def _stat_rows(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tables.value
        for batch in batches:
            langs, values = [], []
            for text, said in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                lang, row = statistics(text or "", said, table)
                langs.append(lang)
                values.append(row)
            columns = np.array(values, dtype=np.float64).reshape(-1, len(STATS)).T
            made = [pa.array(column, pa.float64(), from_pandas=True) for column in columns]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), *made], names=["doc_id", "lang", *STATS])

    return run


def document_stats(documents: DataFrame) -> DataFrame:
    """``doc_id, lang`` (found from the text) and the STATS of every document; a narrow map over whole texts."""
    tables = documents.sparkSession.sparkContext.broadcast(PairTable(*pair_tables(documents)))
    schema = "doc_id long, lang string, " + ", ".join(f"{s} double" for s in STATS)
    return spread(documents.select("doc_id", "text", "lang")).mapInArrow(_stat_rows(tables), schema)


#: Smallest spread a statistic is measured with, so that a constant column does not make every value a tail.
SPREAD = {"mean_word": 0.3, "pair_gain": 0.3, "type_ratio": 0.05, "n_chars": 50.0, "n_words": 10.0}
#: Statistics that are turned into z-scores for the tails.
SCORED = tuple(s for s in STATS if s not in ("n_chars", "n_words"))


def language_sketches(stats: DataFrame, k: int = 400) -> DataFrame:
    """One quantile sketch per language and statistic: partial sketches merge map-side, a few rows come out."""
    solid = stats.filter(F.col("n_chars") >= LEAST)
    return solid.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), *[F.kll_sketch_agg_double(s, F.lit(k)).alias(s) for s in SCORED])


def language_norms(sketches: DataFrame) -> DataFrame:
    """Median and both half spreads of each statistic per language, blended with the whole corpus.

    ``_below`` is the spread of the half under the median and ``_above`` of the half over it (the distance of
    the quartile / 0.6745). A language counts by its share of the texts, not their number, so a corpus of any
    size gives like norms; the spread of a corpus of few texts is widened, as its quartiles say little.
    """
    whole = sketches.agg(*[F.kll_merge_agg_double(s).alias(f"{s}_all") for s in SCORED])
    columns = []
    for s in SCORED:
        n, total = (F.coalesce(F.kll_sketch_get_n_double(c), F.lit(0)) for c in (s, f"{s}_all"))
        weight = F.try_divide(n, n + BLEND * total)

        def blended(value, s=s, n=n, total=total, weight=weight):
            return F.when(n > 0, weight * value(s) + (1 - weight) * value(f"{s}_all")).when(total > 0, value(f"{s}_all"))

        q = lambda c, p: F.kll_sketch_get_quantile_double(c, F.lit(p))
        wide = F.sqrt(1 + F.try_divide(F.lit(float(FEW)), total))
        least = F.lit(SPREAD.get(s, 0.02))
        below = F.greatest(blended(lambda c: (q(c, 0.5) - q(c, 0.25)) / 0.6745), least) * wide
        above = F.greatest(blended(lambda c: (q(c, 0.75) - q(c, 0.5)) / 0.6745), least) * wide
        columns += [blended(lambda c: q(c, 0.5)).alias(f"{s}_mid"), below.alias(f"{s}_below"), above.alias(f"{s}_above")]
    # One row of sketches of fixed size beside at most six of languages.
    return sketches.crossJoin(F.broadcast(whole)).select("lang", "n_docs", *columns)


def scored(stats: DataFrame) -> DataFrame:
    """STATS with a robust z-score ``<stat>_z`` for each scored one.

    What lies over the median is measured by the spread of the half under it, and the other way round, so
    the texts of a tail never widen the measure they are judged by, though they be nearly half of a language.
    """
    # Texts are read once: norms and scores both start from the few numbers written here.
    stats = cut_lineage(stats)
    # One row per language found by language(): at most six rows, so the broadcast is bounded.
    norms = F.broadcast(language_norms(language_sketches(stats)))
    joined = stats.join(norms, "lang")
    away = lambda s: F.col(s) - F.col(f"{s}_mid")
    z = lambda s: F.when(away(s) >= 0, away(s) / F.col(f"{s}_below")).otherwise(away(s) / F.col(f"{s}_above"))
    return joined.select("doc_id", "lang", "n_docs", *STATS, *[z(s).alias(f"{s}_z") for s in SCORED])


#: Robust z-scores at which a statistic lies in the tail of its language: junk, tables and lists show in these.
TAILS = {
    "odd_share": 2.0, "repeat_share": 3.0, "hex_share": 3.0, "digit_share": 1.0, "symbol_share": 3.0,
    "vowel_gap": 3.0, "mean_word": 6.0, "pair_gain": 8.0, "table_share": 3.0, "list_share": 3.0,
}


def non_prose(stats: DataFrame) -> DataFrame:
    """``doc_id, kind`` of the texts that are mostly junk, table or list.

    A text comes into question by a tail of its language; the check of its shares then says whether what
    shows there makes up most of it.
    """
    rows = scored(stats).filter(F.col("n_chars") >= LEAST)
    c = F.col
    in_tail = lambda s: F.coalesce(F.abs(c(f"{s}_z")) if s == "pair_gain" else c(f"{s}_z"), F.lit(0.0)) >= TAILS[s]
    rows = rows.withColumns({f"{s}_tail": in_tail(s) for s in TAILS}).filter(F.greatest(*[c(f"{s}_tail") for s in TAILS]))
    tail = lambda s: c(f"{s}_tail")
    structured = (c("table_share") >= 0.3) | (c("list_share") >= 0.5)
    broken = (tail("odd_share") & (c("odd_share") >= 0.05)) | (tail("repeat_share") & (c("repeat_share") >= 0.6)) | (tail("hex_share") & tail("digit_share") & (c("hex_share") >= 0.5))
    # Texts without any language have no usual pairs.
    shuffled = tail("pair_gain") & (c("lang") != "other")
    noisy = tail("symbol_share") & ((c("symbol_share") >= 0.45) | ((c("mixed_words") >= 0.4) & (c("symbol_share") >= 0.15)))
    strange = (tail("vowel_gap") & (c("vowel_gap") >= 0.2) & (c("common_share") < 0.2)) | (tail("mean_word") & (c("mean_word") > 15))
    junk = broken | shuffled | (~structured & (noisy | strange))
    table = tail("table_share") & (c("table_share") >= 0.5)
    listed = tail("list_share") & (c("list_share") >= 0.5)
    both = (tail("table_share") | tail("list_share")) & (c("table_share") + c("list_share") >= 0.6)
    kind = F.when(junk, "junk").when(table, "table").when(listed, "list").when(both, F.when(c("table_share") > c("list_share"), "table").otherwise("list"))
    return rows.select("doc_id", kind.alias("kind")).filter("kind is not null").distinct()


#: Share of the corpus a language has when its own norm counts as much as the corpus's.
BLEND = 0.05
#: Texts in a corpus by which its spreads widen by the root of two.
FEW = 50
