"""Broken prompt and response pairs.

A response is cut into clauses. A linear-chain conditional random field tags each clause as answer,
refusal, echo of the question, foreign (another language than the question), unfinished, courtesy,
error text or empty; the share of the response each tag covers, and for truncation the tag of its last
clause, give the pair's defect. The field is trained here on the labelled clauses below (a fixed set of
662 sequences, no table data), in seconds.

Clauses are split and described with Arrow's vectorised string kernels, a whole batch at a time, and
all sequences of a batch are decoded together.

Defined results for odd input: a null or blank response, or one that holds only marks, markup, empty
tags, invisible characters or a word for "no value", is ``empty``; a null question can't be copied or
contradicted in language; very long responses are read whole; equal records come out once, and records without an id
all stay, as they can't be told apart; a
pair has at most one defect, the first of empty, error_text, copy, refusal, other_language, truncated.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.crf import LinearChain
from gleanery.runtime import once, spread

LABELS = ("answer", "refusal", "echo", "foreign", "unfinished", "courtesy", "error", "empty")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED, COURTESY, ERROR, EMPTY = range(len(LABELS))

#: Words for "no value", and wrappers that may stand around a copied question or an error.
NO_VALUE = frozenset("none null nil nan na n/a undefined empty 无 暂无 空 没有 无内容 no answer keine ninguno".split() + ["no answer", "（无）"])
_WRAPPERS = ("question", "问题", "提问", "您问的是", "你问的是", "您的问题是", "请回答", "请问", "回答", "answer the question", "you asked", "you ask", "your question", "the question is", "q", "问", "frage", "pregunta")
_ERROR_WRAPPERS = ("error", "错误", "系统提示", "系统错误", "提示", "异常", "warning", "fehler")

# RE2 patterns (Arrow kernels): character classes by script, no look-around.
_INVISIBLE = "[​-‏⁠﻿­]"
_FENCE = r"(?s)```.*?(?:```|$)"
_QUOTED = "“[^”\n]*”|\"[^\"\n]*\"|「[^」\n]*」|『[^』\n]*』|`[^`\n]*`|《[^》\n]*》"
_SPLIT = r"[。！？!?\n]+|\.(?:\s+|$)|…+"
_DECLINE = (
    r"(?i)\bI (?:can ?not|can't|could not|am unable|am not able|would rather not|won't|will not|must decline|do not|don't) (?:to )?(?:help|answer|respond|say|tell|provide|assist|know|have|comment|discuss|continue|comply|give)"
    r"|\bunable to (?:answer|respond|help|assist|provide|comply)|\brather not answer|\bwon't continue|not enough (?:information|evidence|material|context)|no (?:relevant|suitable|usable) (?:information|material|documents?|passages?)|none of the (?:retrieved |found |available )?(?:passages|documents|sources|results)|(?:against|outside|beyond) (?:the|my|our) (?:usage |content )?(?:rules|policy|policies|guidelines|scope|abilities|remit|capabilities|competence)|cannot be answered|have no (?:answer|information|idea)|nothing (?:I|we) can say|no answer is possible|says? nothing about|have no opinion|(?:do not|don't) know anything|outside (?:of )?what I|beyond what I|(?:does|do) not (?:mention|cover|say anything about)|(?:makes?|is) no mention of|no way to (?:answer|tell|respond)|can't help with"
    r"|(?:我|这里|暂时|目前|恕|暂)(?:们)?(?:实在|确实|暂时|目前|也)?(?:无法|不能|难以|没法|不便|不予|不作|不做|给不出)(?:给出|提供)?(?:回答|作答|答复|解答|回应|答案|协助|帮助)?|给不出答案|不作回答|恕难(?:答复|奉告|从命)|超出(?:了)?(?:我|本)的?(?:能力|权限|知识|职责)?(?:范围)?|信息不足以|不足以(?:支持|回答|得出)|没有可用的(?:材料|资料|信息|文档)|(?:与|和)提问无关|不符合使用规范|我不会继续|并不了解|说不出什么|没有找到(?:相关|有关)|无从(?:作答|回答|得知|判断)|没有提到|没有提及|爱莫能助|无可奉告|拒绝(?:回答|作答)"
    r"|(?:kann|darf|möchte) (?:ich )?(?:diese Frage |das |hier )?(?:leider )?nicht (?:beantworten|helfen)|keine ausreichenden Informationen|no puedo (?:responder|ayudar|contestar)|no hay información suficiente|no dispongo de"
)
_HEDGE = r"(?i)不过思路如下|不过|但是?可以|大致|yet the reasoning|\bbut here|however,|nevertheless|确切数字|exact figure"
_ABOUT = r"(?i)请求会被|系统(?:应|会|将)|审计日志|should say that|a system that|a model that|用户(?:会|可能)|requests? (?:is|are|will be)"
_SORRY = r"(?i)抱歉|对不起|很遗憾|不好意思|感谢提问|\bsorry\b|apologi[sz]e|unfortunately|thank you for asking|es tut mir leid|lo siento|leider"
_CLOSING = r"(?i)请换一个问题|如有其他需要|欢迎继续提问|请补充文档|咨询专业人士|久等|an expert may|ask something else|try again|sorry for the wait|feel free to|let me know|add documents|祝您|希望对您"
_HAN = r"[\p{Han}]"
_LETTER = r"[A-Za-zÀ-ÿ]"
_EN = r"(?i)\b(?:the|of|and|to|is|that|in|it|for|not|on|with|as|has|be|are|than|from|at|by|this|when|one|but|more|first|then|there|most|so|only|will|an|a)\b"
_DE = r"(?i)\b(?:der|die|das|und|ist|nicht|den|dem|des|ein|eine|sich|mit|auf|zu|nach|wurde|wenn|vom|zum|ab|allein|keine|dass|lässt|sollte|im|am|von)\b"
_ES = r"(?i)\b(?:el|la|los|las|que|de|del|se|una?|con|por|para|no|es|al|lo|luego|como|sobre|todo|cuando|después|esto|y|en)\b"
_ASKS_LANGUAGE = re.compile(r"(?:用|以|翻译成|译成|译为)\s*(?:中文|英文|英语|德语|德文|西班牙语|西语|汉语|日语|法语)|\b(?:answer|reply|respond|write|translate\w*)\b.{0,30}\b(?:in|into) (?:chinese|english|german|spanish|french|japanese)|auf (?:deutsch|englisch|chinesisch|spanisch)|en (?:inglés|español|chino|alemán)", re.I)

FEATURES = ("bias", "decline", "hedge", "about", "sorry", "closing", "echo", "other_script", "other_words", "open_fence", "error", "short", "after_decline", "wrapper", "first", "last", "open_row", "open_item", "open_sentence", "no_value", "closed")


def plain(text: str | None) -> str:
    """Letters and digits after NFKC, lower case."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text or "").lower())


_PLAIN = re.compile(r"[\W_]+")


def _plain_fast(text: str) -> str:
    return _PLAIN.sub("", text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def _matches(clauses: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(clauses, pattern).to_numpy(zero_copy_only=False)


def _count(clauses: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(clauses, pattern).to_numpy(zero_copy_only=False)


def _script_words(texts: pa.Array) -> np.ndarray:
    """Columns: Han characters (doubled, a character says more than a letter), en, de and es evidence, letters."""
    letters = _count(texts, _LETTER)
    return np.stack([2 * _count(texts, _HAN), _count(texts, _EN), _count(texts, _DE), _count(texts, _ES), letters], axis=1).astype(np.float64)


def _language_of(evidence: np.ndarray) -> np.ndarray:
    """0 zh, 1 en, 2 de, 3 es, -1 unclear."""
    han, letters = evidence[:, 0], evidence[:, 4]
    words = evidence[:, 1:4]
    latin = np.where(words.max(1) >= 2, words.argmax(1) + 1, np.where(letters >= 3, 1, -1))
    tie = (words.max(1) < 2) & (letters >= 3)
    latin = np.where(tie & (words.max(1) > 0), words.argmax(1) + 1, latin)
    return np.where((han > 0) & (han >= 0.4 * letters), 0, np.where(letters >= 3, latin, -1)).astype(np.int64)


class Clauses:
    """A batch's responses cut into clauses, with the feature matrix of all of them.

    ``endings`` holds for each response how it ends (see ``ending``). A response without any clause, as one
    that is blank or all code, has one clause without text.
    """

    def __init__(self, questions: list[str | None], responses: list[str | None], errors: list[str | None], endings: np.ndarray):
        answer = pa.array([r or "" for r in responses], pa.string())
        answer = pc.replace_substring_regex(answer, "(?s)<[^<>]{0,40}>|" + _INVISIBLE, "")
        self.prose = pc.replace_substring_regex(answer, _FENCE, "\n")
        split = pc.split_pattern_regex(self.prose, _SPLIT)
        flat = pc.utf8_trim(split.flatten(), " \t\r\n*_#>|-~•（）()　")
        row = np.repeat(np.arange(len(responses)), np.diff(split.offsets.to_numpy()))
        sizes = pc.utf8_length(flat).to_numpy(zero_copy_only=False)
        keep = sizes > 0
        # The first part of a response (an empty string at least) stays where no other does.
        bare = np.bincount(row[keep], minlength=len(responses)) == 0
        keep[split.offsets.to_numpy()[:-1][bare]] = True
        self.text = flat.filter(pa.array(keep))
        self.row, self.size = row[keep], np.maximum(sizes[keep], 1).astype(np.int64)
        self.lengths = np.bincount(self.row, minlength=len(responses))
        n = len(self.row)
        x = np.zeros((n, len(FEATURES)))
        self.features = x
        if not n:
            return
        first = np.r_[True, np.diff(self.row) != 0]
        last = np.r_[np.diff(self.row) != 0, True]
        unquoted = pc.replace_substring_regex(self.text, _QUOTED, " ")
        x[:, 0] = 1
        x[:, 1] = _matches(unquoted, _DECLINE)
        x[:, 2] = _matches(unquoted, _HEDGE)
        x[:, 3] = _matches(unquoted, _ABOUT)
        x[:, 4] = _matches(unquoted, _SORRY)
        x[:, 5] = _matches(unquoted, _CLOSING)
        words = self.text.to_pylist()
        asked = [_plain_fast(q or "") for q in questions]
        failed = [_plain_fast(e or "") for e in errors]
        echo, wrong, wrap, none = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        at = self.row.tolist()
        for i, (w, r) in enumerate(zip(words, at, strict=True)):
            q, e = asked[r], failed[r]
            p = _plain_fast(w)
            if q and (p in q or _unwrapped(p, q, _WRAPPERS_PLAIN)):
                echo[i] = p not in _NO_VALUE_PLAIN
            if e and p and (p in e or _unwrapped(p, e, _ERRORS_PLAIN)):
                wrong[i] = True
            wrap[i] = p in _WRAPPERS_PLAIN or p in _ERRORS_PLAIN
            none[i] = p in _NO_VALUE_PLAIN
        # A response that is all code has nothing to read in its prose, but is not empty.
        coded = _matches(answer, _READABLE)[self.row] & bare[self.row]
        x[:, 6], x[:, 10], x[:, 13], x[:, 19] = echo, wrong, wrap, none & ~coded
        said = _script_words(unquoted)
        want = _language_of(_script_words(pc.replace_substring_regex(pa.array([q or "" for q in questions], pa.string()), _QUOTED, " ")))[self.row]
        tongue = _language_of(said)
        differs = (want >= 0) & (tongue >= 0) & (tongue != want)
        x[:, 7] = differs & ((want == 0) | (tongue == 0))
        evidence = np.take_along_axis(said[:, 1:4], np.clip(tongue - 1, 0, 2)[:, None], 1)[:, 0]
        x[:, 8] = differs & (want > 0) & (tongue > 0) & (evidence >= 2)
        for place, kind in ((9, OPEN_FENCE), (16, OPEN_ROW), (17, OPEN_ITEM), (18, OPEN_SENTENCE), (20, CLOSED)):
            x[:, place] = last & (endings[self.row] == kind)
        x[:, 11] = self.size <= 6
        x[1:, 12] = x[:-1, 1] * ~first[1:]
        x[:, 14], x[:, 15] = first, last
        self.words = words

    def tags(self, field: LinearChain) -> np.ndarray:
        return field.decode(self.features, self.lengths[self.lengths > 0]) if len(self.row) else np.empty(0, np.int8)


def _unwrapped(text: str, core: str, wrappers: frozenset[str]) -> bool:
    """``text`` is ``core`` between wrapper words only, or the core over and over."""
    if core not in text:
        return False
    rest = text.replace(core, "")
    return not rest or rest in wrappers


_WRAPPERS_PLAIN = frozenset(plain(w) for w in _WRAPPERS)
_NO_VALUE_PLAIN = frozenset(plain(w) for w in NO_VALUE) | {""}
_READABLE = r"[\p{L}\p{N}]"
_ERRORS_PLAIN = frozenset(plain(w) for w in _ERROR_WRAPPERS)


# ---------------------------------------------------------------------------------------------------
# Labelled training clauses. Letters: a answer, r refusal, e echo, f foreign, u unfinished, c courtesy, x error, n empty.

_ANSWERS = {
    0: ("索引在夜间重建", "这一步要先检查缓存", "两者的差别在于更新方式", "因此需要调低阈值", "测试显示召回率提高了百分之三", "它由三个部分组成", "先写入日志再通知用户"),
    1: ("The index is rebuilt every night", "This step has to check the cache first", "The two differ in how they are updated", "So the threshold has to be lowered", "Tests show that recall went up by three percent", "It is made of three parts"),
    2: ("Der Index wird jede Nacht neu gebaut", "Das liegt an der Größe des Speichers", "Die Werte sind mit dem Bericht verglichen worden"),
    3: ("El índice se reconstruye cada noche", "Esto depende de la memoria y no del disco", "Los valores se comparan con el informe"),
}
_QUESTIONS = {0: "缓存为什么要定期清理？", 1: "Why does the cache have to be cleared?", 2: "Warum wird der Speicher geleert und nicht erweitert?", 3: "¿Por qué se vacía la memoria y no se amplía?"}
_REFUSALS = (
    "抱歉，我无法回答这个问题", "这超出了我的能力范围", "没有可用的材料，恕难答复", "资料中的信息不足以支持任何结论", "该请求不符合使用规范，我不会继续", "暂时给不出答案", "检索结果与提问无关，这里不作回答", "我对这件事并不了解，说不出什么", "资料里没有提到这件事，无从作答",
    "I cannot answer this question", "I'm sorry, but I can't help with that", "There is not enough information to respond", "None of the passages cover it", "This is outside my scope", "I would rather not answer this", "Sorry, I am unable to respond to this request", "I apologise; the sources say nothing about that, so no answer is possible", "As a language model I have no opinion on it, I'm afraid",
)
_COURTESIES = ("抱歉让您久等了", "请换一个问题", "如有其他需要，欢迎继续提问", "请补充文档后再试", "Sorry for the wait", "Please ask something else", "Add documents and try again", "An expert may know more")
_NEAR_MISSES = (
    "虽然我无法给出确切数字，不过思路如下", "超出权限的请求会被系统拒绝回答，并写入审计日志", "证据不足时系统会拒绝回答", "I cannot name an exact figure, yet the reasoning is as follows", "A system that has no evidence should say that it cannot answer", "Requests against the usage rules are logged",
)
_ERRORS = ("TimeoutError: no reply after 300 ms", "向量服务没有响应", "HTTP 502 from gateway")


#: How a response ends: in order, or inside a code block, a table row, a list item or a sentence.
CLOSED, OPEN_FENCE, OPEN_ROW, OPEN_ITEM, OPEN_SENTENCE = range(5)
_BLANKS = ("", "N/A", "无", "None", "null", "暂无", "**", "<p></p>", "no answer")


def training_sequences() -> list[tuple[str, str, str, int, str]]:
    """(question, response, error, ending, labels): every combination of kinds that occurs in practice."""
    out = []
    for code, answers in _ANSWERS.items():
        q = _QUESTIONS[code]
        dot = "。" if code == 0 else ". "
        for i, a in enumerate(answers):
            b = answers[(i + 1) % len(answers)]
            out.append((q, f"{a}{dot}{b}{dot}", "", CLOSED, "aa"))
            out.append((q, f"{q}\n{a}{dot}{b}{dot}", "", CLOSED, "eaa"))
            out.append((q, f"{a}{dot}{b[: len(b) // 2]}", "", OPEN_SENTENCE, "au"))
            out.append((q, b[: len(b) // 2], "", OPEN_SENTENCE, "u"))
            # The end of a preview tells nothing.
            out.append((q, f"{a}{dot}{b[: 1 + i % 5]}", "", CLOSED, "aa"))
            out.append((q, f"{a}{dot}\n{b[: 1 + i % 5]}", "", (OPEN_ITEM, OPEN_SENTENCE, OPEN_ROW)[i % 3], "au"))
            out.append((q, f"{a}{dot}\n3", "", OPEN_ITEM, "au"))
            out.append((q, f"{a}{dot}\n{b[: len(b) // 2]}", "", (OPEN_FENCE, OPEN_ROW, OPEN_ITEM)[i % 3], "au"))
            out.append((q, f"{a}{dot}", _ERRORS[i % len(_ERRORS)], CLOSED, "a"))
        # Each other language, the near and the far ones alike.
        for c, group in _ANSWERS.items():
            if c != code:
                end = "。" if c == 0 else ". "
                for i, a in enumerate(group):
                    out.append((q, f"{a}{end}{group[(i + 1) % len(group)]}{end}", "", CLOSED, "ff"))
                    out.append((q, f"{a}{end}", "", CLOSED, "f"))
                    out.append((q, f"{a}{end}[1][3]", "", CLOSED, "fa"))
                    out.append((q, f"{a}{end}\n| 8 | 5 |", "", CLOSED, "fa"))
                    out.append((q, f"{a}{end}{group[(i + 1) % len(group)][:-4]}", "", (OPEN_SENTENCE, OPEN_FENCE)[i % 2], "fu"))
        out.append((q, q, "", CLOSED, "e"))
        out.append((q, q[:-1], "", OPEN_SENTENCE, "e"))
        out.append((q, f"{'请回答' if code == 0 else 'Question'}: {q[:-1]}", "", OPEN_SENTENCE, "e"))
        out.append((q, f"{q}{q}", "", CLOSED, "ee"))
        out.append((q, f"{q} {q} {q}", "", CLOSED, "eee"))
        out.append((q[:7] + q[-1], f"{q[:7]}{q[-1]} " * 3, "", CLOSED, "eee"))
        out.append((q[:5] + q[-1], f"{q[:5]}{q[-1]}", "", CLOSED, "e"))
        out.append((q, f"{answers[0]}{dot}\n无\n{answers[1]}{dot}", "", CLOSED, "ana"))
        for blank in _BLANKS:
            out.append((q, blank, "", CLOSED, "n"))
        out.append((q, "```python\nprint(1)\n```", "", CLOSED, "a"))
        out.append((q, "```python\nprint(1", "", OPEN_FENCE, "u"))
    for i, r in enumerate(_REFUSALS):
        code = 0 if r[0] > "z" else 1
        dot = "。" if code == 0 else ". "
        q, c = _QUESTIONS[code if i % 4 else 1 - code], _COURTESIES[i % len(_COURTESIES)]
        out.append((q, f"{r}{dot}", "", CLOSED, "r"))
        out.append((q, f"{r}{dot}{c}{dot}", "", CLOSED, "rc"))
        out.append((q, f"{_REFUSALS[(i + 3) % len(_REFUSALS)]}{dot}{r}{dot}", "", CLOSED, "rr"))
    for i, m in enumerate(_NEAR_MISSES):
        code = 0 if m[0] > "z" else 1
        dot = "。" if code == 0 else ". "
        a = _ANSWERS[code][i % 6]
        out.append((_QUESTIONS[code], f"{m}{dot}{a}{dot}", "", CLOSED, "aa"))
        out.append((_QUESTIONS[code], f"{a}{dot}{m}{dot}", "", CLOSED, "aa"))
    for i, c in enumerate(_COURTESIES):
        code = 0 if c[0] > "z" else 1
        dot = "。" if code == 0 else ". "
        out.append((_QUESTIONS[code], f"{c}{dot}{_ANSWERS[code][i % 6]}{dot}", "", CLOSED, "ca"))
        out.append((_QUESTIONS[code], f"{_ANSWERS[code][i % 6]}{dot}{c}{dot}", "", CLOSED, "ac"))
    for e in _ERRORS:
        for q in _QUESTIONS.values():
            out.append((q, e, e, CLOSED, "x"))
            out.append((q, f"错误：{e}", e, CLOSED, "x"))
            out.append((q, f"[ERROR] {e}。", e, CLOSED, "x"))
            out.append((q, e, e, OPEN_SENTENCE, "x"))
    return out


@lru_cache(maxsize=1)
def clause_field() -> LinearChain:
    """The trained field; fitting the labelled clauses takes a second and always gives the same weights."""
    sequences = training_sequences()
    batch = Clauses([s[0] for s in sequences], [s[1] for s in sequences], [s[2] for s in sequences], np.array([s[3] for s in sequences], np.int64))
    xs, ys, at = [], [], 0
    letters = {"a": ANSWER, "r": REFUSAL, "e": ECHO, "f": FOREIGN, "u": UNFINISHED, "c": COURTESY, "x": ERROR, "n": EMPTY}
    for s, length in zip(sequences, batch.lengths, strict=True):
        if length == len(s[4]):
            xs.append(batch.features[at : at + length])
            ys.append(np.array([letters[c] for c in s[4]]))
        at += length
    return LinearChain(len(FEATURES), len(LABELS)).fit(xs, ys)


# ---------------------------------------------------------------------------------------------------
# Ends of responses.

#: Slots of the table of response-final and other words.
SLOTS = 1 << 17
_TOKEN = re.compile(r"[一-鿿]+|[^\W\d_]+")


def _tokens(text: str) -> Iterator[str]:
    """Latin words and Han pairs."""
    for run in _TOKEN.findall(text):
        if run[0] >= "一" and run[0] <= "鿿":
            yield from (run[i : i + 2] for i in range(len(run) - 1))
        else:
            yield run.lower()


def _slot(token: str) -> int:
    return zlib.crc32(token.encode()) % SLOTS


def _last_token(text: str) -> str | None:
    runs = _TOKEN.findall(text[-60:])
    if not runs:
        return None
    return runs[-1][-2:] if "一" <= runs[-1][-1] <= "鿿" else runs[-1].lower()


_ITEM = re.compile(r"^\s*(?:[-*•·]|\d{1,3}[.)、．]|[（(]\d{1,3}[）)])\s*")
_DONE = re.compile(r"(?:[。！？!?.…]|[。！？!?.…][”’\"'）)】\]*_`]+|\[\d+\]|[（(](?:见第\s*\d+\s*块|see block \d+|[^()（）\n]{1,40})[)）]|[”’\"」』》])[*_\s]*$")
_TRAIL = re.compile(r"[\s\U0001F300-\U0001FAFF☀-➿️]+$")


def ending(text: str | None, final: np.ndarray | None = None, anywhere: np.ndarray | None = None) -> int:
    """How the response ends: CLOSED, or open inside a code block, table row, list item or sentence."""
    body = re.sub(_INVISIBLE, "", text or "")
    if body.count("```") % 2:
        return OPEN_FENCE
    bare = body.rstrip()
    done = _TRAIL.sub("", bare)
    if not done or done.endswith("```"):
        return CLOSED
    emoji = done != bare
    lines = [x for x in done.split("\n") if x.strip()]
    line = lines[-1]
    if line.lstrip().startswith("|"):
        head = next((x for x in lines if x.lstrip().startswith("|")), line)
        return OPEN_ROW if not line.rstrip().endswith("|") or line.count("|") != head.count("|") or re.fullmatch(r"[\s|:\-]+", line) else CLOSED
    if emoji:
        return CLOSED
    item = _ITEM.match(line)
    if not item:
        return CLOSED if _DONE.search(line) else OPEN_SENTENCE
    rest = line[item.end() :].strip()
    if not rest or re.search(r"[，、：；,:;（(“「]$", rest):
        return OPEN_ITEM
    if _DONE.search(rest):
        return CLOSED
    before = [x[m.end() :].strip() for x in lines[:-1] if (m := _ITEM.match(x))]
    if rest.endswith("-") or (before and sum(bool(_DONE.search(x)) for x in before) > 0.5 * len(before)):
        return OPEN_ITEM
    token = _last_token(rest)
    if token is None or final is None:
        return CLOSED
    # A word that hardly ever ends an item or sentence anywhere else: the item was cut.
    seen, ends = int(anywhere[_slot(token)]), int(final[_slot(token)])
    return OPEN_ITEM if ends < max(2, 0.02 * seen) else CLOSED


_ENDS = "block int, final_counts binary, all_counts binary"


def _count_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    final, anywhere = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    slots: dict[str, int] = {}
    for batch in batches:
        for text in batch.column("response").to_pylist():
            if not text:
                continue
            # The very end of a response is what is in question, so only ends inside it count.
            inner = text.rstrip().rsplit("\n", 1)
            closed = re.findall(r"[^\n。！？!?.，,：:；;|“”\"（）()]+(?=[。！？!?\n.|])", inner[0] + "\n" if len(inner) > 1 else text)
            for part in closed:
                token = _last_token(part)
                if token:
                    final[slots.setdefault(token, _slot(token))] += 1
            for token in _tokens(text):
                at = slots.get(token)
                if at is None:
                    at = slots[token] = _slot(token)
                    if len(slots) > 200_000:
                        slots.clear()
                anywhere[at] += 1
    for block, (f, a) in enumerate(zip(np.split(final, 16), np.split(anywhere, 16), strict=True)):
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(f.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(a.tobytes(), 1)], pa.binary())], names=["block", "final_counts", "all_counts"])


def _add_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, *raw in zip(*[batch.column(c).to_pylist() for c in ("block", "final_counts", "all_counts")], strict=True):
            parts = [np.frombuffer(zlib.decompress(r), np.int64) for r in raw]
            total[block] = [a + b for a, b in zip(total[block], parts, strict=True)] if block in total else parts
    packed = [[zlib.compress(v[i].tobytes(), 1) for v in total.values()] for i in range(2)]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *[pa.array(p, pa.binary()) for p in packed]], names=["block", "final_counts", "all_counts"])


def ending_tables(responses: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each word ends a clause and how often it occurs, over all responses; two tables of fixed size (2 MB)."""
    rows = spread(responses.select("response")).mapInArrow(_count_ends, _ENDS).repartition(4, "block").mapInArrow(_add_ends, _ENDS).collect()
    tables = np.zeros((2, 16, SLOTS // 16), np.int64)
    for row in rows:
        for i, column in enumerate(("final_counts", "all_counts")):
            tables[i, row["block"]] = np.frombuffer(zlib.decompress(row[column]), np.int64)
    return tables[0].reshape(-1), tables[1].reshape(-1)


# ---------------------------------------------------------------------------------------------------

_FOUND = "table_name string, pair_id long, defect string"


def classify(questions: list, responses: list, errors: list, whole: np.ndarray, field: LinearChain, ends=(None, None)) -> list[str | None]:
    """Defect of each pair of a batch; ``whole`` is False for previews, whose cut end is no defect."""
    endings = np.array([ending(r, *ends) if w else CLOSED for r, w in zip(responses, whole, strict=True)], np.int64)
    clauses = Clauses(questions, responses, errors, endings)
    tags = clauses.tags(field)
    n = len(responses)
    cover = np.zeros((n, len(LABELS)))
    cut = np.zeros(n, bool)
    if len(tags):
        np.add.at(cover, (clauses.row, tags), clauses.size)
        cut = tags[np.cumsum(clauses.lengths) - 1] == UNFINISHED
    foreign_marks = np.zeros(n)
    native_marks = np.zeros(n)
    if len(tags):
        x = clauses.features
        other = (x[:, 7] + x[:, 8]) > 0
        np.add.at(foreign_marks, clauses.row[other], clauses.size[other])
        own = ~other & (clauses.size > 6)
        np.add.at(native_marks, clauses.row[own], clauses.size[own])
    total = np.maximum(cover.sum(1), 1)
    out: list[str | None] = []
    for i in range(n):
        c = cover[i] / total[i]
        if c[EMPTY] >= 0.9:
            out.append("empty")
        elif c[ERROR] >= 0.7 and c[ANSWER] + c[FOREIGN] <= 0.1:
            out.append("error_text")
        elif c[ECHO] >= 0.7 and c[ANSWER] + c[FOREIGN] + c[UNFINISHED] + c[REFUSAL] <= 0.1:
            out.append("copy")
        elif c[REFUSAL] > 0 and c[ANSWER] + c[FOREIGN] + c[UNFINISHED] <= 0.2 and c[REFUSAL] + c[COURTESY] >= 0.6:
            out.append("refusal")
        elif c[FOREIGN] >= 0.6 and foreign_marks[i] >= 0.6 * (foreign_marks[i] + native_marks[i]) and not (questions[i] and _ASKS_LANGUAGE.search(questions[i])):
            out.append("other_language")
        elif whole[i] and cut[i]:
            out.append("truncated")
        else:
            out.append(None)
    return out


def _tag_pairs(field: LinearChain, tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = tables.value if tables is not None else (None, None)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("question", "response", "error", "whole")]
            defects = classify(columns[0], columns[1], columns[2], np.array(columns[3], bool), field, ends)
            at = pa.array([i for i, d in enumerate(defects) if d], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("table_name").take(at), batch.column("pair_id").take(at), pa.array([d for d in defects if d], pa.string())], names=["table_name", "pair_id", "defect"])

    return run


def broken_pairs(evaluations: DataFrame, reports: DataFrame) -> DataFrame:
    """``table_name, pair_id, defect`` of every unusable pair of both tables: one scan of each, one small shuffle."""
    whole = evaluations.select(F.lit("evaluation_results").alias("table_name"), F.col("result_id").alias("pair_id"), F.col("query").alias("question"), "response", F.lit(None).cast("string").alias("error"), F.lit(True).alias("whole"))
    previews = reports.select(F.lit("e2e_report").alias("table_name"), F.col("report_id").alias("pair_id"), "question", F.col("answer_preview").alias("response"), "error", F.lit(False).alias("whole"))
    field = clause_field()
    tables = evaluations.sparkSession.sparkContext.broadcast(ending_tables(whole))
    # Only defects are shuffled: equal records have equal ones, so the ids can be told apart afterwards.
    tagged = [once(spread(rows).mapInArrow(_tag_pairs(field, tables), _FOUND), "pair_id") for rows in (whole, previews)]
    return tagged[0].unionByName(tagged[1])
