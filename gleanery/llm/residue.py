"""Template residue, stand-in wording, error pages and script notices.

Four kinds of evidence meet in each record.

* Address slug, title and section are compared with the body: a body that holds none of their terms is a
  mismatch.
* Bodies of little information (few different terms) are cut into sentences, reduced to skeletons (digits and
  hex ids masked). Skeletons are counted over the corpus: a body is duplicated as far as its sentences come
  back in other records, and those count by how many of these records are mismatches too (the company a
  sentence keeps), so that boilerplate of knowledge weighs nothing.
* The share of mismatched, duplicated bodies among a host's records is evidence on each of its bodies.
* Detectors find placeholders (code taken out), stand-in texts and the wording of notices.

The evidence on a body is weighed by a logistic model, fitted once on the labelled records below (a fixed
list in this module, no table data). A body over the threshold has the kind its own wording or else its
sentences have in the other records they stand in. Text and code that merely deal with such things
agree with their titles and are covered by such wording only in part, so they stay under it.

Defined results for odd input: null or blank content is no case by itself (metadata still counts);
null metadata or null values are skipped; records without an id are judged one by one; very long texts are
read whole; a record sent twice counts once; each record has at most one kind: that of its body, else
placeholder, else filler in its metadata.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.runtime import cut_lineage, once, spread

_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]+`", re.S)

_NAME = r"[A-Za-z][\w.\- ]{0,40}"
#: Unfilled template fields of common template languages, and what templates print for a missing value.
_PLACEHOLDERS = re.compile(
    rf"(?=[{{$#%@_＿<\[&【（(｛])(?:\{{\{{\s*[\w.\-\[\]|: ]+?\s*\}}\}}|[$#]\{{\s*[\w.\-]+\s*\}}|(?<![A-Za-z0-9_$#{{%])\{{\s*[A-Za-z_][\w.]*\s*\}}(?!\}})|\{{%[^%\n]{{1,60}}%\}}|<%=?[^%\n]{{1,60}}%>"
    rf"|%\([A-Za-z_][\w.]*\)[sdrf]|%%[A-Za-z_][\w.]*%%|@@[A-Za-z_][\w.]*@@|(?<![A-Za-z0-9_])__(?!(?:init|main|name|file|call|dict|class|str|repr|len|iter|next|enter|exit|doc|all)__)[A-Za-z][A-Za-z.]*(?:_[A-Za-z.]+)*__(?![A-Za-z0-9_])|＿＿[^＿\n]{{1,30}}＿＿"
    rf"|<<\s*{_NAME}?\s*>>|\[\[\s*[A-Za-z_][\w.]*\s*\]\]|<(?:your|insert|enter) {_NAME}>|&lt;\s*[A-Za-z_][\w. ]*\s*&gt;"
    rf"|\[(?:INSERT|ENTER|YOUR|ADD) {_NAME}(?: HERE)?\]|\[{_NAME} (?:goes|go) here\]|\[object Object\]"
    r"|[\[【（(｛]\s*(?:待填写|请填写|此处填写|在此填写|请在此输入|请输入|此处输入|待补充|占位)[^\]】）)｝\n]{0,30}[\]】）)｝])"
)
#: What a template prints where the whole slot value is missing.
_MISSING = re.compile(
    r"(?:本节由|更新于|亲爱的|作者：|\bDear |\bLast changed on |\bWritten by |^In |^About )\s*(?:undefined|null|None|NaN|nil|N/A|\(null\))(?=整理|的|[，,。.：:；;!！]|$)", re.M
)
_EMPTY_VALUE = re.compile(r"^(?:About |Notes on |关于)?(?:undefined|null|None|NaN|nil)(?: \| \w+)?$")

_SCRIPT = r"(?:java\s?script|\bjs\b|(?:client[- ]side )?script(?:s|ing)?\b|脚本)"
#: A script notice asks the reader to allow scripts or says that without them nothing is shown.
_SCRIPT_LINE = re.compile(
    rf"(?:(?:enable|turn on|switch on|activ\w*|allow\w*|detect|blocks?|requires?|requiere|benötigt|works only with|need\w*|disabled|blocked)\b.{{0,60}}?{_SCRIPT}|{_SCRIPT}.{{0,50}}(?:disabled|blocked|enabled|must be|required|allowed|turned off))"
    r"|(?:启用|打开|开启|依赖|支持|禁用|允许|需要|拦截|关闭).{0,8}(?:脚本|java\s?script|\bjs\b)|(?:脚本|java\s?script|\bjs\b).{0,10}(?:拦截|禁用|未开启|关闭|启用|才能)",
    re.I | re.M,
)
#: Sentences that only stand beside a notice; they never make a case alone.
_POLITE = re.compile(
    r"then try again|如已开启，请尝试更换浏览器|menu\s+search\s+login|^©.{0,40}$|返回首页|点击重试|back to the start page|sorry about this|给您带来不便|敬请谅解|^oops!?$|温馨提示|系统提示|出错了|if it keeps happening"
    r"|try reloading|^(?:ray|reference|incident|请求编号|错误代码|request id)[:： ]*[\w\-]*$|^webfront/[\d.]+$|checking your browser|without it nothing can be shown|请检查设置|内容未能加载|否则无法显示|^please wait|^loading",
    re.I | re.M,
)
_ERROR_LINE = re.compile(
    r"^(?:#+\s*)?(?:http[/ ]?[\d.]*\s*)?(?:error|错误)?\s*[:：]?\s*[45]\d\d(?:\s*[-–—:]?\s*[A-Za-z][A-Za-z \-]{0,40})?[.。]?$"
    r"|^(?:#+\s*)?(?:http \d{3} - )?(?:(?:page )?not found|bad request|unauthori[sz]ed|forbidden|gone|too many requests|internal server error|bad gateway|service unavailable|gateway time-?out|request time-?out|access denied)[.!]?$"
    r"|could not be delivered|can't find that page|cannot find (?:that|the) page|moved or deleted|no longer available|session has expired|sign in again|too many requests in|(?:has been|was) denied|down for maintenance|broken or out of date|something went wrong|page you (?:asked|requested|are looking)"
    r"|不存在或已被删除|暂不可见|重新登录后查看|登录状态已失效|访问过于频繁|没有查看权限|设为私密|系统维护中|服务器开小差|网络异常|加载失败|链接已过期|无法打开|恢复访问|请稍后重试|页面找不到|拒绝访问"
    r"|^fatal:|out of memory \(tried|^database connection failed|upstream connect error|^traceback \(most recent|^file \"[^\"]+\", line \d+|^\w*(?:error|exception): |^\{\"ok\": ?false|\"(?:error|code)\": ?[45]\d\d",
    re.I | re.M,
)
_FILLER_LINE = re.compile(
    r"heading goes here|caption placeholder|副标题占位|段落占位|sample paragraph|(?:goes here|has not been written yet|to be supplied by|is a stand-in|will be replaced|only there to check the layout)|^(?:coming soon|do not publish|replace before release|to be (?:done|written)|tbd|todo)[.!]?$"
    r"|(?:正文|段落|章节|内容|文字|本页|此处|以下).{0,8}(?:待补充|尚未撰写|暂缺|仅作占位|占位|待定|待编辑|正在建设|建设中|正在编写|编写中)|^[（(]?(?:敬请期待|请勿发布|定稿后替换|稍后由编辑更新)|这里是占位|此处为正文|示例文本",
    re.I | re.M,
)
_LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris".split())
_WORDS = re.compile(r"[a-zà-ÿ]+|[一-鿿]", re.I)
_TERMS = re.compile(r"[a-z]{4,}|[一-鿿]+")


def terms(text: str) -> set[str]:
    """Words of four letters up and pairs of Han characters."""
    out: set[str] = set()
    for run in _TERMS.findall(text.lower()):
        out.update({run[i : i + 2] for i in range(len(run) - 1)} if run[0] >= "一" else (run,))
    return out


def skeleton(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\b(?=[0-9a-f]*\d)[0-9a-f]{5,}\b|\d+", "0", text.lower())).strip()


def is_filler_text(text: str) -> bool:
    """Pseudo-Latin, or a few words repeated over and over."""
    if len(text) < 5:
        return False
    words = [w.lower() for w in _WORDS.findall(text)]
    if len(words) < 5 or len(set(words)) > max(30, 0.2 * len(words)):
        return False
    if sum(w in _LATIN for w in words) >= 0.8 * len(words) and any(w in ("lorem", "ipsum", "adipiscing", "eiusmod", "consectetur") for w in words):
        return True
    squeezed = re.sub(r"[\s。，,.;；、]+", "", text.lower())
    for unit in range(1, 13):
        if len(squeezed) >= 4 * unit and len(squeezed) >= 12:
            turns = squeezed[unit:] == squeezed[:-unit]
            if turns and re.search(r"^(?:xxx?|x|blah|foobarbaz|text|test|测试|示例文本|这里是占位文字|此处为正文内容|占位|示例|文本|内容|样例|asdf|qwerty)+", squeezed[: 4 * unit + 12]):
                return True
    return False


def _sentences(text: str) -> list[str]:
    parts = re.split(r"\n+|(?<=[。！？!?])\s*|(?<=[a-z]\.)\s+(?=[A-Z])|(?<=[…])", text)
    return [p.strip().strip("*_#> （）()<>/").strip() for p in parts if p and p.strip().strip("*_#> （）()<>/").strip()]


KINDS = ("script_notice", "error_page", "filler")
_WORDING = (_SCRIPT_LINE, _ERROR_LINE, _FILLER_LINE)
#: Different terms up to which a body can be a mere notice; knowledge of a few sentences has more.
FEW_TERMS = 60
_TERM = re.compile(r"[a-z]{4,}|[一-鿿]{1,2}")


def is_brief(lowered: str) -> bool:
    """Few different terms, however long the text is; reading stops at the first term too many."""
    seen: set[str] = set()
    for match in _TERM.finditer(lowered):
        seen.add(match.group())
        if len(seen) > FEW_TERMS:
            return False
    return True


def describe(body: str) -> tuple[list[float], list[str]]:
    """Shares of the body covered by the wording of each kind (or company of it), and its sentences."""
    text = re.sub(r"</?noscript>", "", body.strip())
    sentences = _sentences(text)
    total = max(sum(map(len, sentences)), 1)
    hits = [[bool(p.search(x)) for x in sentences] for p in _WORDING]
    polite = [bool(_POLITE.search(x)) for x in sentences] if any(map(any, hits)) else [False] * len(sentences)
    shares = [sum(len(x) for x, h, c in zip(sentences, hit, polite, strict=True) if h or c) / total if any(hit) else 0.0 for hit in hits]
    if is_filler_text(text) or sum(len(x) for x in sentences if is_filler_text(x)) >= 0.8 * total:
        shares[2] = 1.0
    return shares, sentences


def mismatch(about: set[str], lowered: str) -> float:
    """1 if the body holds no term of slug, title and section, 0 if it holds a quarter of them; between where these have none."""
    return max(0.0, 1.0 - sum(t in lowered for t in about) / (0.25 * len(about))) if about else 0.5


FEATURES = ("bias", "cover", "full_cover", "mismatch", "mismatched_cover", "duplicated", "duplicated_mismatch", "host")


def features(cover, mismatched, duplicated, host):
    """The evidence on a body as the model weighs it; numbers, arrays or column expressions."""
    return (cover * 0 + 1, cover, cover * cover * cover * cover, mismatched, mismatched * cover, duplicated, duplicated * mismatched, host)


#: Labelled records: (title, body, residue). Notices come back under several titles or stand alone; so do
#: knowledge, its boilerplate and texts about errors.
_TITLES = ("Notes on sail making", "关于潮汐的几点观察", "Bread ovens", "果树修剪概述", "Canal locks in brief", "织布机笔记")
_NOTICES = (
    "Something went wrong. Please wait", "Access denied.", "页面找不到。请稍后重试", "HTTP 503 - Service Unavailable", "Please enable JavaScript to go on.", "请启用脚本，否则无法显示",
    "This page has not been written yet.", "正文待补充。敬请期待", "lorem ipsum dolor sit amet consectetur adipiscing elit sed do", "系统维护中，请稍后重试。",
)
#: Notices without any known wording: only mismatch and return give them away.
_UNKNOWN = ("Our hamsters are resting, come back after lunch", "小站打烊啦，明天再来", "The stork is looking for your parcel")
_KNOWLEDGE = (
    ("Sail making", "Sail making begins with the cloth. The seams are sewn twice."), ("潮汐观察", "潮汐随月相变化，记录要按日比较。"), ("Bread ovens", "Bread ovens hold their heat for hours."),
    ("果树修剪", "果树修剪在冬末进行，先去枯枝。"), ("Canal locks", "Canal locks lift boats by filling a chamber."), ("织布机", "织布机的经线要先绷紧。"), ("Tea harvest", "Leaves are picked by hand at dawn."),
    ("Rope walks", "Hemp is twisted over a long floor."), ("灯塔", "守夜人每两小时上一次发条。"), ("", "A short remark without any title."), ("", "没有标题的一句话。"),
)
_ABOUT_ERRORS = (
    ("Gateway errors", "Gateway errors such as 502 Bad Gateway mean that the upstream is down. Check the logs of the proxy before anything else, then its timeouts."),
    ("Script settings", "Script settings differ between browsers. Where scripts are blocked, pages that need JavaScript stay empty, so offer plain pages as well and test them."),
    ("错误代码说明", "错误代码说明：系统维护中会返回 503，客户端应当按指数退避重试，并记录每一次失败的原因。"), ("Drafts", "Drafts carry the line to be written until an editor has replaced it with text of their own."),
)
_BOILERPLATE = "These entries were kept by volunteers"


def labelled_records() -> list[tuple[str, str, bool]]:
    out = []
    for i, body in enumerate(_NOTICES):
        # Some notices come back, some stand alone, some have no title to compare with, some carry other words.
        out += [(_TITLES[(i + k) % 6], body, True) for k in range(3 if i % 2 else 1)]
        out.append(("", f"{body} {i}00 and {i}", True))
        out.append((_TITLES[i % 6], f"{body}\n© the portal of the harbour {i}" if body[0] < "z" else f"{body}\n港口门户{i}", True))
    for i, body in enumerate(_UNKNOWN):
        out += [(_TITLES[(i + k) % 6], body, True) for k in range(4)]
    for i, (title, body) in enumerate(_KNOWLEDGE):
        out.append((title, body, False))
        out.append((_TITLES[(i + 2) % 6], f"{body} {chr(97 + i) * 5}", False))
        if title:
            out += [(f"{title} {k}", f"{_BOILERPLATE}.\n{title}: {body} {k * 'a'}", False) for k in range(2)]
            out += [(title, body, False)] * (i % 3)
    for title, body in _ABOUT_ERRORS:
        out += [(title, body, False), (title, body, False), (_TITLES[0], body + " Others agree.", False)]
    return out


@lru_cache(maxsize=1)
def weights() -> np.ndarray:
    """Weights of FEATURES: logistic regression on the labelled records, the same in every run."""
    records = labelled_records()
    about = [terms(title) for title, _, _ in records]
    off = [mismatch(a, body.lower()) for a, (_, body, _) in zip(about, records, strict=True)]
    described = [describe(body) for _, body, _ in records]
    stands, strange = Counter(), Counter()
    for (_, sentences), m in zip(described, off, strict=True):
        for key in {skeleton(x) for x in sentences}:
            stands[key] += 1
            strange[key] += m
    rows = []
    for (shares, sentences), m in zip(described, off, strict=True):
        keys = [(len(x), skeleton(x)) for x in sentences]
        again = sum(n * strange[k] / stands[k] for n, k in keys if stands[k] > 1) / max(sum(n for n, _ in keys), 1)
        rows.append(features(max(shares), m, again, 0.0))
    x, y = np.array(rows, dtype=np.float64), np.array([r[2] for r in records], dtype=np.float64)
    # A host whose records are notices: the same bodies with the evidence set.
    x = np.vstack([x, np.where(np.arange(len(FEATURES)) == 7, 0.5, x)[y == 1]])
    y = np.r_[y, np.ones(int(y.sum()))]
    w = np.zeros(len(FEATURES))
    for _ in range(400):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return w


_MISSING_WORDS = ("undefined", "null", "None", "NaN", "nil", "N/A")


def has_placeholder(text: str, value: bool = False) -> bool:
    bare = _CODE.sub(" ", text) if "`" in text or "~~~" in text else text
    if _PLACEHOLDERS.search(bare):
        return True
    return any(w in bare for w in _MISSING_WORDS) and bool(_MISSING.search(bare) or (value and _EMPTY_VALUE.match(bare.strip())))


@lru_cache(maxsize=4096)
def is_placeholder_value(value: str) -> bool:
    return has_placeholder(value, True)


@lru_cache(maxsize=4096)
def is_filler_value(value: str) -> bool:
    """A metadata value that is stand-in wording from end to end."""
    if not _FILLER_LINE.search(value):
        return is_filler_text(value)
    sentences = _sentences(value)
    total = max(sum(map(len, sentences)), 1)
    return sum(len(x) for x in sentences if _FILLER_LINE.search(x) or _POLITE.search(x)) >= 0.75 * total or is_filler_text(value)


_SIGNAL = "doc_id string, host string, mismatch double, script double, error double, filler double, sentences array<long>, sizes array<int>, other string"


def host_of(source: str | None) -> str:
    """Folder of the address; its site where it has a scheme."""
    parts = (source or "").split("/")
    return parts[2] if len(parts) > 2 and parts[0].endswith(":") else "/".join(parts[:-1])


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Evidence of every record that has any: brief bodies with their sentences, placeholders, stand-in values."""
    for batch in batches:
        out: list[list] = [[] for _ in range(9)]
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "content", "source", "metadata")]
        for doc_id, content, source, metadata in zip(*columns, strict=True):
            values = {k: v for k, v in metadata or [] if v}
            body = content or ""
            other = None
            if has_placeholder(body) or any(map(is_placeholder_value, values.values())):
                other = "placeholder"
            elif any(is_filler_value(v) for v in values.values()):
                other = "filler"
            lowered = body.lower()
            shares, sentences, off = [0.0] * 3, {}, 0.0
            if body.strip() and is_brief(lowered):
                slug = re.sub(r"[\W_\d]+", " ", (source or "").rsplit("/", 1)[-1].rsplit(".", 1)[0])
                off = mismatch(terms(f"{values.get('title', '')} {values.get('section', '')} {slug}"), lowered)
                shares, found = describe(body)
                for x in found:
                    key = _hash(skeleton(x))
                    sentences[key] = sentences.get(key, 0) + len(x)
            elif other is None:
                continue
            row = (doc_id, host_of(source), off, *shares, list(sentences), list(sentences.values()), other)
            for column, cell in zip(out, row, strict=True):
                column.append(cell)
        types = (pa.string(), pa.string(), *[pa.float64()] * 4, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[c.split()[0] for c in _SIGNAL.split(", ")])


def judged(chunks: DataFrame) -> DataFrame:
    """Every record with evidence: its features, score and kind (null for knowledge).

    One narrow pass over all texts; what goes on are hashes and shares of brief bodies, a small part of the
    corpus. Sentences are counted with map-side sums, so one that a third of all records share is no hot key.
    """
    held = once(spread(chunks.select("doc_id", "content", "source", "metadata")).mapInArrow(_signals, _SIGNAL), "doc_id")
    found = cut_lineage(held.withColumn("row", F.monotonically_increasing_id()))
    # Host of a record as host_of() has it; records per host over the whole table.
    parts = F.split(F.coalesce("source", F.lit("")), "/")
    site = F.when((F.size(parts) > 2) & F.get(parts, F.lit(0)).endswith(":"), F.get(parts, F.lit(2))).otherwise(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    hosts = chunks.select(site.alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("host_rows"))

    standing = found.select("row", "mismatch", "script", "error", "filler", F.explode(F.arrays_zip("sentences", "sizes")).alias("s"))
    standing = standing.select("row", "mismatch", "script", "error", "filler", F.col("s.sentences").alias("sentence"), F.col("s.sizes").alias("size"))
    worded = [(F.col(c) > 0.5).cast("int") for c in ("script", "error", "filler")]
    counted = standing.groupBy("sentence").agg(F.count(F.lit(1)).alias("stands"), F.sum("mismatch").alias("strange"), *[F.sum(w).alias(f"as_{i}") for i, w in enumerate(worded)])
    company = standing.select("row", "sentence", "size").join(counted.filter("stands > 1"), "sentence")
    again = company.groupBy("row").agg(F.sum(F.col("size") * F.col("strange") / F.col("stands")).alias("again"), *[F.sum(F.col("size") * F.col(f"as_{i}") / F.col("stands")).alias(f"vote_{i}") for i in range(3)])
    size = F.greatest(F.aggregate("sizes", F.lit(0), lambda a, b: a + b), F.lit(1))
    seen = found.join(again, "row", "left").withColumn("duplicated", F.coalesce(F.col("again") / size, F.lit(0.0))).withColumn("body", F.size("sentences") > 0)
    seen = cut_lineage(seen.select("row", "doc_id", "host", "mismatch", "script", "error", "filler", "other", "body", "duplicated", *[F.coalesce(F.col(f"vote_{i}") / size, F.lit(0.0)).alias(f"vote_{i}") for i in range(3)]))
    notices = seen.filter("body and mismatch > 0.5 and duplicated > 0.5").groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    # One row per host that has notices; Spark broadcasts or shuffles it by size.
    shares = notices.join(hosts, "host").select("host", F.least(F.col("n") / F.col("host_rows"), F.lit(1.0)).alias("host_share"))
    seen = seen.join(shares, "host", "left").withColumn("host_share", F.coalesce("host_share", F.lit(0.0))).withColumn("cover", F.greatest("script", "error", "filler"))
    terms_of = features(F.col("cover"), F.col("mismatch"), F.col("duplicated"), F.col("host_share"))
    score = sum((float(w) * f for w, f in zip(weights(), terms_of, strict=True)), F.lit(0.0))
    own = F.when(F.col("script") == F.col("cover"), KINDS[0]).when(F.col("error") == F.col("cover"), KINDS[1]).otherwise(KINDS[2])
    top = F.greatest("vote_0", "vote_1", "vote_2")
    voted = F.when(top <= 0, KINDS[1]).when(F.col("vote_0") == top, KINDS[0]).when(F.col("vote_1") == top, KINDS[1]).otherwise(KINDS[2])
    body_kind = F.when(F.col("body") & (F.col("score") > 0), F.when(F.col("cover") > 0, own).otherwise(voted))
    return seen.withColumn("score", score).withColumn("kind", F.coalesce(body_kind, F.col("other")))


def residue(chunks: DataFrame) -> DataFrame:
    """``doc_id, kind`` of the records to keep out."""
    return judged(chunks).filter("kind is not null").select("doc_id", "kind")


def evidence(chunks: DataFrame) -> DataFrame:
    """``evidence, n_with, n_decided``: records kept out that have each evidence, and those that stay in without it."""
    rows = judged(chunks).filter("kind is not null")
    without = {
        "wording": features(F.lit(0.0), F.col("mismatch"), F.col("duplicated"), F.col("host_share")),
        "mismatch": features(F.col("cover"), F.lit(0.0), F.col("duplicated"), F.col("host_share")),
        "duplicates": features(F.col("cover"), F.col("mismatch"), F.lit(0.0), F.col("host_share")),
        "host": features(F.col("cover"), F.col("mismatch"), F.col("duplicated"), F.lit(0.0)),
    }
    has = {"wording": F.col("cover") > 0, "mismatch": F.col("mismatch") > 0.5, "duplicates": F.col("duplicated") > 0, "host": F.col("host_share") > 0}
    by_body = F.col("body") & (F.col("score") > 0)
    cells = []
    for name, terms_of in without.items():
        left = sum((float(w) * f for w, f in zip(weights(), terms_of, strict=True)), F.lit(0.0))
        cells.append(F.struct(F.lit(name).alias("evidence"), (by_body & has[name]).alias("has"), (by_body & (left <= 0) & F.col("other").isNull()).alias("decides")))
    cells.append(F.struct(F.lit("detectors").alias("evidence"), F.col("other").isNotNull().alias("has"), (F.col("other").isNotNull() & ~by_body).alias("decides")))
    split = rows.select(F.explode(F.array(*cells)).alias("e"))
    return split.groupBy("e.evidence").agg(F.count(F.when(F.col("e.has"), 1)).alias("n_with"), F.count(F.when(F.col("e.decides"), 1)).alias("n_decided"))


def clean(chunks: DataFrame) -> DataFrame:
    """The records that are left when all residue is kept out; a record without an id goes by its contents."""
    contents = F.sha2(F.concat_ws("\u0001", F.coalesce("content", F.lit("")), F.coalesce("source", F.lit("")), F.coalesce(F.to_json("metadata"), F.lit(""))), 256)
    keyed = chunks.withColumn(_KEY, F.coalesce("doc_id", F.concat(F.lit("\u0001"), contents)))
    found = residue(keyed.select(F.col(_KEY).alias("doc_id"), "content", "source", "metadata")).select(F.col("doc_id").alias(_KEY))
    return keyed.join(found, _KEY, "left_anti").drop(_KEY)


_KEY = "__record_key"
