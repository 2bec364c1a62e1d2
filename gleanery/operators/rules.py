"""Declarative text rules: ordered predicates that compile to one CASE column, and to SQL for the twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@dataclass(frozen=True)
class Predicate:
    """A condition on a text column, in both languages."""

    column: Callable[[Column], Column]
    sql: Callable[[str], str]

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate(lambda c: self.column(c) & other.column(c), lambda s: f"({self.sql(s)} AND {other.sql(s)})")

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate(lambda c: self.column(c) | other.column(c), lambda s: f"({self.sql(s)} OR {other.sql(s)})")

    def __invert__(self) -> Predicate:
        return Predicate(lambda c: ~self.column(c), lambda s: f"(NOT {self.sql(s)})")


def hits(words: tuple[str, ...], lower: bool = False) -> tuple[Callable[[Column], Column], Callable[[str], str]]:
    """How many of the words occur in the text."""

    def column(c: Column) -> Column:
        text = F.lower(c) if lower else c
        return reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in words])

    def sql(s: str) -> str:
        text = f"lower({s})" if lower else s
        return "(" + " + ".join(f"(CASE WHEN contains({text}, {_quote(w)}) THEN 1 ELSE 0 END)" for w in words) + ")"

    return column, sql


def any_word(words, lower: bool = False, least: int = 1) -> Predicate:
    count, sql = hits(tuple(words), lower)
    return Predicate(lambda c: count(c) >= least, lambda s: f"({sql(s)} >= {least})")


def pattern(*patterns: str, ignore_case: bool = True) -> Predicate:
    """Any of the patterns is found; patterns keep to what Java and RE2 share."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    flag = "(?i)" if ignore_case else ""
    return Predicate(lambda c: c.rlike(flag + joined), lambda s: f"regexp_matches({s}, {_quote(flag + joined)})")


def length(compare: str, n: int) -> Predicate:
    ops = {"<": lambda x: x < n, "<=": lambda x: x <= n, ">": lambda x: x > n, ">=": lambda x: x >= n}
    return Predicate(lambda c: ops[compare](F.length(c)), lambda s: f"(length({s}) {compare} {n})")


def one_of(words, lower: bool = False) -> Predicate:
    return Predicate(lambda c: (F.lower(c) if lower else c).isin(*words), lambda s: f"({'lower(' + s + ')' if lower else s} IN ({', '.join(map(_quote, words))}))")


@dataclass(frozen=True)
class Decision:
    """Rules in order of priority and the value when none holds."""

    rules: tuple[tuple[Predicate, object], ...]
    default: object

    def column(self, c: Column) -> Column:
        chain = F
        for predicate, value in self.rules:
            chain = chain.when(predicate.column(c), F.lit(value))
        return chain.otherwise(F.lit(self.default))

    def sql(self, s: str) -> str:
        show = lambda v: _quote(v) if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)
        return "CASE " + " ".join(f"WHEN {p.sql(s)} THEN {show(v)}" for p, v in self.rules) + f" ELSE {show(self.default)} END"


# Words and patterns of the question rules.

REASONING = ("为什么", "怎么", "如何", "原因", "why", "how")
COMPARISON = ("区别", "对比", "和", "vs", "比较", "哪个")
OPEN_ENDED = ("建议", "看法", "你觉得", "推荐")
FILLER_WORDS = "(请问|请|帮我|我想知道|能不能告诉我)"

question_type = Decision(((any_word(REASONING), "reasoning"), (any_word(COMPARISON), "comparison"), (any_word(OPEN_ENDED), "open_ended")), "factual")

UNANSWERABLE = ("火星", "不存在的", "门牌号", "宇宙总部", "昨天中午.*吃", "量子纠缠.*设备", "本知识库里有没有", "知识库.*有没有介绍", "虚构的公司", "编一个.*地址")
CHAT = (
    "你是谁", "你叫什么", "你的名字", "你是AI吗", "你是机器人", "你好", "您好", "hi", "hello", "hey", "嗨", "谢谢", "感谢", "thanks", "thank you", "多谢", "再见", "bye", "拜拜", "晚安",
    "你能做什么", "你的功能", "帮助", "help", "怎么用你", "你是怎么工作的", "你的原理", "介绍一下你自己", "在吗", "有人吗", "测试", "今天.*几号", "今天.*星期", "现在.*几点", "你.*能.*联网", "你.*能.*搜索", "你.*会.*什么",
)
COMMON_KNOWLEDGE = (
    r"1\s*\+\s*1\s*等于", r"\d+\s*[\+\-×÷\*/]\s*\d+\s*等于", "中国的首都", "北京是.*首都", "美国的首都", "太阳从.*升起", "太阳从.*落下", "一年有.*天", "一天有.*小时", "一小时有.*分", "水的化学式", "H2O", "二氧化碳.*化学式",
    "什么是.*引力", "牛顿.*苹果", "地球.*太阳", "月亮.*地球", "光速.*多少", "光速.*公里", "圆周率", "π.*等于", "pi.*=", "勾股定理", "毕达哥拉斯定理", "DNA.*全称", "脱氧核糖核酸", "光合作用.*是什么", "什么是.*AI", "什么是.*人工智能",
    "python.*print", "hello world", "什么是.*JSON", "什么是.*HTTP", "长城.*在哪", "黄河.*多长", "长江.*多长", "九九乘法", "英文字母.*几个", "26个字母",
)
ACRONYMS = ("rag", "llm", "ai", "gpu", "cpu", "api", "sql", "css", "dns")

retrieval_need = Decision(
    (
        (length("<=", 0) | pattern(*UNANSWERABLE), "unanswerable"),
        (length("<=", 3) & ~any_word(("?", "？")) & ~one_of(ACRONYMS, lower=True), "chat"),
        (pattern(*CHAT), "chat"),
        (pattern(*COMMON_KNOWLEDGE), "common_knowledge"),
        (pattern(r"^[\d\s\+\-×÷\*/=\.\(\)]+$") & length("<", 30), "arithmetic"),
    ),
    "retrieve",
)

REALTIME = ("今日新闻", "今天新闻", "今日要闻", "今日头条", "热点新闻", "实时新闻", "最新新闻", "新闻联播", "今日资讯", "今日.*消息", "今天.*新闻", "最近新闻", "国内外新闻", r"breaking\s*news", r"today'?s\s*news", r"what'?s\s*new\s*today")
REALTIME_WEAK = "(新闻|要闻|资讯|头条).{0,6}(今日|今天|实时|最新|现在)|(今日|今天|实时|最新).{0,6}(新闻|要闻|资讯|头条)"
REALTIME_SHORT = ("新闻", "今日新闻", "今天新闻", "要闻", "热点")

realtime = Decision(tuple((pattern(p), f"realtime:{p}") for p in REALTIME) + ((pattern(REALTIME_WEAK), "realtime:weak"), (one_of(REALTIME_SHORT), "realtime:short")), "")

MALICIOUS = ("忽略上述指令", "forget all", "ignore previous", "system prompt", "泄露密码", "获取密码")
CHITCHAT = ("你好", "谢谢", "再见", "天气", "你是谁", "几点了", "吃饭", "怎么样", "好的", "嗯")
TECHNICAL = ("如何", "怎么", "什么是", "为什么", "能否", "配置", "安装", "使用", "报错", "问题")

query_verdict = Decision(
    (
        (length("<", 3), "unclear_short"),
        (length(">", 500), "unclear_long"),
        (any_word(MALICIOUS, lower=True), "malicious"),
        (any_word(CHITCHAT, least=2) | one_of(CHITCHAT), "chitchat"),
        (any_word(TECHNICAL), "knowledge"),
    ),
    "knowledge_unsure",
)
VERDICT_CONFIDENCE = {"unclear_short": 1.0, "unclear_long": 1.0, "malicious": 1.0, "chitchat": 0.8, "knowledge": 0.9, "knowledge_unsure": 0.6}

EXACT_PATTERNS = (r"用户ID[\s:：]?\w+", r"订单号[\s:：]?\w+", r"版本[\s:：]?[vV]?\d+", r"ID为\s*\w+", r"编号[\s:：]?\w+")
RELATION_PATTERNS = ("之间的关系", "和.*的关系", "依赖", "继承自", "调用关系", "关联", "上下游", "调用链", "依赖图")
RECENT_WORDS = ("最新", "近期", "今年", "刚刚", "目前", "现在的", "2026", "2025年下半年", "this week", "latest")

tool_route = Decision(((pattern(*EXACT_PATTERNS, ignore_case=False), "exact_match"), (pattern(*RELATION_PATTERNS, ignore_case=False), "graph_search"), (any_word(RECENT_WORDS), "web_search")), "vector_search")

INTENT_KNOWLEDGE = ("是什么", "怎么用", "如何", "怎样", "区别", "对比", "实现", "设计", "原理", "为什么", "有什么", "怎么做", "怎么", "什么", "哪些", "能不能", "可以", "如何使用", "怎么设置", "怎么配置", "怎么实现")
INTENT_REALTIME = ("最新", "现在", "当前", "最近", "新版本", "版本号", "issue", "#", "修了", "修复了", "更新了", "有没有更新")
INTENT_REFUSAL = ("训练gpt", "破解", "盗版", "写作业", "代写", "帮我写")

_kb, _rt = any_word(INTENT_KNOWLEDGE), any_word(INTENT_REALTIME)
_INTENT = (
    (any_word(INTENT_REFUSAL, lower=True), "refusal", 0.95),
    (_kb & _rt, "mixed_query", 0.9),
    (_rt, "realtime_query", 0.85),
    (any_word(INTENT_KNOWLEDGE, least=2), "knowledge_query", 0.85),
    (_kb, "knowledge_query", 0.75),
    (any_word(("?", "？")), "knowledge_query", 0.6),
)
intent = Decision(tuple((p, v) for p, v, _ in _INTENT), "knowledge_query")
intent_confidence = Decision(tuple((p, c) for p, _, c in _INTENT), 0.5)

SECOND_LEVEL = (
    ("error_debug", ("报错", "错误", "失败", "不工作", "bug", "不生效")),
    ("version_compare", ("对比", "版本", "差异", "0.2", "0.3")),
    ("code_example", ("示例", "例子", "demo", "完整代码", "sample", "完整示例")),
    ("api_usage", ("怎么用", "如何使用", "用法", "调用", "接口", "怎么设置", "怎么配置", "怎么做", "如何集成", "如何配置")),
    ("concept", ("是什么", "定义", "含义", "解释", "理解", "vs", "和...的区别")),
    ("architecture", ("设计", "架构", "系统", "流程")),
    ("performance", ("优化", "提升", "加速", "慢", "性能", "速度")),
    ("best_practice", ("最佳实践", "生产", "部署", "坑", "注意")),
)
_DEFAULTS = ((any_word(("怎么", "如何")), "api_usage", 0.65), (any_word(("是什么", "什么是")), "concept", 0.65))
knowledge_intent = Decision(tuple((any_word(words), name) for name, words in SECOND_LEVEL) + tuple((p, v) for p, v, _ in _DEFAULTS), "error_debug")
knowledge_confidence = Decision(tuple(x for _, words in SECOND_LEVEL for x in ((any_word(words, least=2), 0.9), (any_word(words), 0.8))) + tuple((p, c) for p, _, c in _DEFAULTS), 0.6)

error_class = Decision(
    (
        (any_word(("timeout", "timed out", "超时", "no reply"), lower=True), "timeout"),
        (any_word(("connection", "network", "连接"), lower=True), "network"),
        (any_word(("rate limit", "ratelimited", "429"), lower=True), "rate_limit"),
        (any_word(("503", "unavailable"), lower=True), "unavailable"),
        (any_word(("sql", "syntax"), lower=True), "syntax"),
        (any_word(("permission", "denied"), lower=True), "permission"),
    ),
    "unknown",
)

#: Source substrings that are kept out of results.
DENIED_SOURCES = ("chat_history.json", "test_results", "evaluation_reports", "__pycache__", ".venv", "node_modules", "build_kb", "htmlcov", "pytest_cache")
