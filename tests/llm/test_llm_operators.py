"""Operators against brute force, round trips and their edge cases."""

import random
import re
import unicodedata
from datetime import date

import numpy as np
import pytest

from gleanery.llm import leakage, mixing, neardup, pairs, residue, sketch, splitting, textstats
from gleanery.llm.crf import LinearChain

WORDS = "index cache shard query merge split model token block graph store fetch align score prune batch chunk vector rank filter".split()


def sentence(rng, n=9):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


# --- percentiles -----------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 100, 5000, 200_000])
def test_sketch_keeps_relative_rank_error_after_merges(n):
    values = np.random.default_rng(n).lognormal(6, 2, n)
    parts = [sketch.RelativeSketch().update(p) for p in np.array_split(values, 7)]
    merged = parts[0]
    for p in parts[1:]:
        merged = sketch.RelativeSketch.from_bytes(merged.to_bytes()).merge(p)
    assert merged.n == n and sum((1 << h) * len(x.buffer) for h, x in enumerate(merged.levels)) == n
    ordered = np.sort(values)
    for prob, value in zip(sketch.PROBS, merged.quantiles(sketch.PROBS), strict=True):
        rank = np.searchsorted(ordered, value, side="right")
        assert abs(rank - max(1, np.ceil(prob * n - 1e-9))) <= max(2 * sketch.rank_error() * (1 - prob) * n, 1)


def test_cell_sketches_count_what_is_not_measured(spark):
    rows = [("m", "g", date(2024, 1, 1), v) for v in (5.0, None, float("nan"), float("inf"), -1.0, 0.0, 7.0)]
    rows += [("m", None, None, 3.0), ("m", "empty", date(2024, 1, 2), None)]
    df = spark.createDataFrame(rows, "metric string, grp string, day date, value double")
    out = {(r["grp"], r["day"], r["prob"]): r for r in sketch.quantile_rows(sketch.cell_sketches(df), (0.5, 1.0)).collect()}
    day = date(2024, 1, 1)
    assert (out["g", day, 0.5]["n_rows"], out["g", day, 0.5]["n_measured"]) == (7, 2)
    assert out["g", day, 0.5]["value"] == 5.0 and out["g", day, 1.0]["value"] == 7.0
    assert out[None, None, 0.5]["value"] == 3.0
    assert out["empty", date(2024, 1, 2), 0.5]["value"] is None
    assert sketch.cell_sketches(df.limit(0)).count() == 0


def test_roll_up_equals_all_rows(spark):
    rng = random.Random(3)
    rows = [("m", "g", date(2024, 1, 1 + i % 20), rng.expovariate(0.01)) for i in range(300)]
    df = spark.createDataFrame(rows, "metric string, grp string, day date, value double")
    from pyspark.sql import functions as F

    whole = sketch.quantile_rows(sketch.roll_up(sketch.cell_sketches(df), F.lit(None).cast("date")), (0.5,)).collect()
    assert len(whole) == 1 and whole[0]["n_measured"] == 300
    assert whole[0]["value"] == sorted(r[3] for r in rows)[149]


# --- residue ---------------------------------------------------------------------------------------


BODIES = [
    ("Error 404\n\nThe page you asked for could not be delivered.\n\nReference ab12cd3", "error_page"),
    ("系统维护中，预计两小时后恢复访问。", "error_page"),
    ("Please turn on JavaScript to go on.", "script_notice"),
    ("本页面依赖脚本，否则无法显示正文。", "script_notice"),
    ("Heading goes here\n\nSample paragraph, please overwrite.", "filler"),
    ("foo bar baz " * 20, "filler"),
    ("此处文字正在建设中，请勿发布。", "filler"),
    ("Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor.", "filler"),
    ("A page that asks you to enable JavaScript gives the crawler nothing but that notice, so such sources are rendered first. The renderer keeps a pool of browsers for them.", None),
    ("When the gateway answers with 404 Not Found or 502, the retry policy waits two seconds and then uses the spare set.", None),
    ("", None),
]


CHUNK = "doc_id string, content string, source string, metadata map<string,string>"


def test_body_kinds(spark):
    rows = [(f"d{i}", text, f"notes/x/{i}.md", {"title": "Sail making"}) for i, (text, _) in enumerate(BODIES)]
    got = {r["doc_id"]: r["kind"] for r in residue.residue(spark.createDataFrame(rows, CHUNK)).collect()}
    assert got == {f"d{i}": kind for i, (_, kind) in enumerate(BODIES) if kind}


def test_return_under_other_titles_gives_unknown_notices_away(spark):
    titles = ("Sail making", "Tide tables", "Bread ovens", "Rope walks", "Tea harvest")
    rows = [(f"n{i}", "The kettle is on, look in again tomorrow.", f"a/b/{i}.md", {"title": t}) for i, t in enumerate(titles)]
    rows += [(f"k{i}", f"{t} is an old craft. The tools are few and simple.", f"a/b/k{i}.md", {"title": t}) for i, t in enumerate(titles)]
    # Alike in their opening only: neither is a copy of the other.
    opening = "Sail making begins with the cloth and ends with the ropes, as every hand knows. " * 4
    rows += [(f"o{i}", opening + t, f"a/b/o{i}.md", {"title": "Sail making"}) for i, t in enumerate(titles)]
    rows.append(("p", "Sail making begins with the cloth.", "a/b/p.md", {"title": "[DATE goes here]"}))
    df = spark.createDataFrame(rows, CHUNK)
    got = {r["doc_id"]: r["kind"] for r in residue.residue(df).collect()}
    assert got == {f"n{i}": "error_page" for i in range(5)} | {"p": "placeholder"}
    counts = {r["evidence"]: r["n_decided"] for r in residue.evidence(df).collect()}
    assert counts["duplicates"] == 5 and counts["mismatch"] == 5 and counts["detectors"] == 1


@pytest.mark.parametrize("text", ["Dear {{name}}, hello", "By ${author}.", "[INSERT TITLE HERE]", "更新于【此处填写日期】，", "Last changed on [object Object].", "%(count)s hits", "亲爱的undefined，您好", "更新于__USER_NAME__，如", "本节由{user.name}整理", "%(item.label)s"])
def test_placeholders(text):
    assert residue.has_placeholder(text)


@pytest.mark.parametrize("text", ["Write `%(count)s` where the number stands.", "```\n{{x}}\n```", "a set {1, 2} and f(x) = {y}"[:18], "50% of [1] cases", "call __init__ first"])
def test_code_is_no_placeholder(text):
    assert not residue.has_placeholder(text)


def test_residue_edges(spark):
    rows = [
        ("a", None, None, None),
        ("b", "  ", "s/x.md", {}),
        ("c", "Knowledge about shards.", "s/x.md", {"title": "{{title}}", "t2": None}),
        ("d", "Please turn on scripts.", "s/x.md", {"title": "Shards"}),
        ("d", "Please turn on scripts.", "s/x.md", {"title": "Shards"}),
        ("e", "The shard index is merged every night and the cache follows. " * 2000, "s/x.md", {"title": "Shards"}),
    ]
    df = spark.createDataFrame(rows, "doc_id string, content string, source string, metadata map<string,string>")
    assert sorted(map(tuple, residue.residue(df).collect())) == [("c", "placeholder"), ("d", "script_notice")]
    assert residue.residue(df.limit(0)).count() == 0


# --- splitting -------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(12))
def test_pieces_cover_the_text_within_limits(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["字", "a", " ", "\n", "\n\n", "。", ". ", "，", "é", "👍🏽"]) for _ in range(rng.choice([790, 900, 3000, 20000])))
    pieces = splitting.split_points(text)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    joined = text[: pieces[0][1]]
    for (_, end), (start, stop) in zip(pieces, pieces[1:], strict=False):
        assert end - splitting.OVERLAP <= start <= end and stop - start <= splitting.LIMIT
        joined += text[end:stop]
    assert joined == text
    assert len(pieces) <= 1.6 * -(-len(text) // 700) + 1


def test_splits_at_paragraphs():
    text = "\n\n".join("x" * 380 for _ in range(4))
    ends = [end for _, end in splitting.split_points(text)[:-1]]
    assert all(text[e - 2 : e] == "\n\n" for e in ends)


def test_split_edges(spark):
    rows = [("n", None, "s", 1), ("e", "", "s", None), ("s", "short", None, 2), ("l", "好" * 801, "s", 3), ("l", "好" * 801, "s", 3)]
    df = spark.createDataFrame(rows, "doc_id string, content string, source string, page int")
    got = splitting.split_documents(df).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {"e": 1, "s": 1, "l": 2}
    assert [r["doc_id"] for r in splitting.oversized(df).collect()] == ["l"]


# --- near duplicates -------------------------------------------------------------------------------


def brute_pairs(rows):
    sets = {}
    for i, t in rows:
        t = re.sub(r"\s+", " ", (t or "").lower()).strip()
        sets[i] = {t[k : k + 5] for k in range(len(t) - 4)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("group_rows", [None, 7])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, group_rows):
    if group_rows:
        monkeypatch.setattr(neardup, "GROUP_ROWS", group_rows)
    rng = random.Random(5)
    rows, base = [], [" ".join(sentence(rng) for _ in range(rng.randint(2, 14))) for _ in range(60)]
    shared = "Notice: these entries were kept by volunteers and are meant for study only. "
    for n, text in enumerate(base):
        rows.append((f"d{n:03}", (shared if n % 3 == 0 else "") + text))
        for k in range(rng.randint(0, 4)):
            chars = list(text)
            for _ in range(rng.randint(0, len(chars) // 25)):
                chars[rng.randrange(len(chars))] = rng.choice("abcdefgh ")
            rows.append((f"e{n:03}{k}", "".join(chars).upper() if k % 2 else "".join(chars)))
    rows += [("z1", None), ("z2", ""), ("z3", "abcd"), ("z4", "hello world"), ("z5", "Hello  world "), ("z6", "hello world")]
    df = spark.createDataFrame(rows, "id string, content string")
    found = neardup.NearDuplicates(df)
    got = {tuple(r) for r in found.pairs().collect()}
    assert got == brute_pairs(rows)
    groups = {r["id"]: r["group_id"] for r in found.groups().collect()}
    assert all(groups[a] == groups[b] for a, b in got)
    parent = {i: i for i in groups}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in got:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert groups == {i: root(i) for i in groups}


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id string, content string")
    found = neardup.NearDuplicates(df)
    assert found.pairs().count() == 0 and found.groups().count() == 0


# --- pairs -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("question", "response", "error", "whole", "defect"),
    [
        ("什么是索引？", None, None, True, "empty"),
        ("什么是索引？", " ﻿**  **", None, True, "empty"),
        ("什么是索引？", "N/A", None, True, "empty"),
        ("什么是索引？", "问题：什么是索引？", None, False, "copy"),
        ("什么是索引？", "什么是索引？\n索引是一种结构，它加快查找的速度。", None, True, None),
        ("What is a shard?", "I'm sorry, but I can't help with that.", None, True, "refusal"),
        ("What is a shard?", "I cannot name an exact figure, yet the reasoning is as follows. A shard is one part of the index and it is kept on one node.", None, True, None),
        ("什么是索引？", "超出权限的请求会被系统拒绝回答，并写入审计日志。索引是一种加快查找的结构。", None, True, None),
        ("什么是索引？", "The index is a structure that speeds up the search. It is rebuilt every night.", None, True, "other_language"),
        ("什么是索引？请用英文回答。", "The index is a structure that speeds up the search. It is rebuilt every night.", None, True, None),
        ("什么是索引？", "索引是一种结构，它加快查找的速度。每天夜里都会重", None, True, "truncated"),
        ("什么是索引？", "索引是一种结构，它加快查找的速度。每天夜里都会重", None, False, None),
        ("什么是索引？", "要点如下：\n```python\nbuild(", None, True, "truncated"),
        ("什么是索引？", "[ERROR] HTTP 502 from gateway", "HTTP 502 from gateway", False, "error_text"),
        ("什么是索引？", "索引是一种结构，它加快查找的速度。", "HTTP 502 from gateway", False, None),
        (None, "索引是一种结构，它加快查找的速度。", None, True, None),
        ("什么是索引？", "索引是一种结构，它加快查找的速度。" * 3000, None, True, None),
    ],
)
def test_defects(question, response, error, whole, defect):
    got = pairs.classify([question], [response], [error], np.array([whole]), pairs.clause_field())
    assert got == [defect]


def test_chain_decode_equals_exhaustive_search():
    rng = np.random.default_rng(0)
    chain = LinearChain(4, 3)
    chain.emission, chain.step, chain.first = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([1, 4, 2, 5])
    x = rng.normal(size=(lengths.sum(), 4))
    got, at = chain.decode(x, lengths), 0
    for n in lengths:
        scores = x[at : at + n] @ chain.emission
        ways = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
        value = [chain.first[w[0]] + scores[range(n), w].sum() + sum(chain.step[a, b] for a, b in zip(w, w[1:], strict=False)) for w in ways]
        assert list(got[at : at + n]) == list(ways[int(np.argmax(value))])
        at += n


def test_clause_field_on_held_out_clauses():
    """Accuracy on clauses whose sequences were kept out of training."""
    rows = pairs.training_sequences()
    letters = "arefucxn"

    def prepare(part):
        batch = pairs.Clauses([s[0] for s in part], [s[1] for s in part], [s[2] for s in part], np.array([s[3] for s in part]))
        xs, ys, at = [], [], 0
        for s, n in zip(part, batch.lengths, strict=True):
            if n == len(s[4]):
                xs.append(batch.features[at : at + n])
                ys.append(np.array([letters.index(c) for c in s[4]]))
            at += n
        return xs, ys

    xs, ys = prepare([s for i, s in enumerate(rows) if i % 4])
    held_x, held_y = prepare([s for i, s in enumerate(rows) if i % 4 == 0])
    chain = LinearChain(len(pairs.FEATURES), len(pairs.LABELS)).fit(xs, ys)
    tags = chain.decode(np.concatenate(held_x), np.array([len(y) for y in held_y]))
    assert (tags == np.concatenate(held_y)).mean() >= 0.95


@pytest.mark.parametrize(
    ("question", "response", "defect"),
    [
        ("Why is the cache cleared?", "Nach 3 Tagen wurde der Bericht mit dem Profil verglichen. Das bedeutet, dass der Wert allein keine Erklärung ist.", "other_language"),
        ("Why is the cache cleared?", "El plan depende sobre todo del tiempo y no al revés. Conviene revisar primero el registro y luego el plan.", "other_language"),
        ("Warum wird der Speicher geleert und nicht erweitert?", "The store is cleared when it is full, and it is not extended.", "other_language"),
        ("Why is the cache cleared?", "The cache is cleared when it is full. The steps are:\n1. The first is to stop the writer.\n2.", "truncated"),
        ("Why is the cache cleared?", "The cache is cleared so that\n```python\nfor hit in", "truncated"),
        ("Why is the cache cleared?", "The cache is cleared.\n\n| a | b |\n|---|---|\n| 1 ", "truncated"),
        ("Why is the cache cleared?", "The cache is cleared when it is full", "truncated"),
        ("Why is the cache cleared?", "```python\nclear()\n```", None),
        ("Why is the cache cleared?", "Why is the cache cleared", "copy"),
        ("Why is the cache cleared?", "<p></p>", "empty"),
        ("Why is the cache cleared?", "---\n**N/A**\n", "empty"),
        ("Why is the cache cleared?", "He said “" + "this is a very long quotation of the source text " * 12 + "” and the cache is cleared.", None),
    ],
)
def test_tags_decide(question, response, defect):
    assert pairs.classify([question], [response], [None], np.array([True]), pairs.clause_field()) == [defect]


def test_broken_pairs_of_tables(spark):
    ev = spark.createDataFrame([(1, "什么是索引？", "无"), (1, "什么是索引？", "无"), (2, None, None)], "result_id long, query string, response string")
    rp = spark.createDataFrame([(1, "What is it?", "It is the index of the store and it is kept", None)], "report_id long, question string, answer_preview string, error string")
    assert sorted(map(tuple, pairs.broken_pairs(ev, rp).collect())) == [("evaluation_results", 1, "empty"), ("evaluation_results", 2, "empty")]
    assert pairs.broken_pairs(ev.limit(0), rp.limit(0)).count() == 0


# --- leakage ---------------------------------------------------------------------------------------


def brute_leaks(docs, items):
    def normal(t):
        return "".join(c for c in unicodedata.normalize("NFKC", t or "").lower() if c.isalnum())

    runs = {i: {p[k : k + 40] for k in range(len(p) - 39)} for i, p in ((i, normal(p)) for i, p in items)}
    out = set()
    for d, t in docs:
        t = normal(t)
        mine = {t[k : k + 40] for k in range(len(t) - 39)}
        out |= {(d, i) for i, r in runs.items() if r & mine}
    return out


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(sentence(rng, 6) for _ in range(rng.randint(1, 6)))) for i in range(1, 60)]
    items += [(60, None), (61, "too short"), (62, items[0][1])]
    docs = []
    for d in range(150):
        text = " ".join(sentence(rng) for _ in range(rng.randint(1, 30)))
        if d % 4 == 0:
            passage = rng.choice(items[:59])[1]
            a = rng.randrange(max(1, len(passage) - 45))
            part = passage[a : a + rng.choice([30, 44, 48, 60, 200])]
            text = text[:50] + (part.upper() if d % 8 else "​".join(part)) + text[50:]
        docs.append((d, text))
    docs += [(900, None), (901, ""), (902, items[3][1] * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    qa = spark.createDataFrame([(i, p, "q", ["x"]) for i, p in items], "id int, passage string, query string, expected_contains array<string>")
    want = brute_leaks(docs, items)
    assert {tuple(r) for r in leakage.leaks(df, qa).collect()} == want and want
    assert {tuple(r) for r in leakage.leaks(df, qa, block_chars=900).collect()} == want
    monkeypatch.setattr(leakage, "PART", 61)
    assert {tuple(r) for r in leakage.leaks(df, qa).collect()} == want
    assert leakage.leaks(df, qa.limit(0)).count() == 0 and leakage.leaks(df.limit(0), qa).count() == 0
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leak_details(df, qa).filter("longest_run >= 40").collect()} == want


def test_block_max_wand_equals_full_scoring():
    rng = random.Random(1)
    for _ in range(40):
        lists = []
        for _ in range(rng.randint(1, 12)):
            ids = sorted(rng.sample(range(400), rng.randint(1, 200)))
            lists.append((ids, [rng.random() * rng.choice([0.2, 1, 3]) for _ in ids]))
        size = leakage.POSTING_BLOCK
        blocks = [[(ids[min(b + size, len(ids)) - 1], max(w[b : b + size])) for b in range(0, len(ids), size)] for ids, w in lists]
        total = {}
        for ids, w in lists:
            for i, v in zip(ids, w, strict=True):
                total[i] = total.get(i, 0) + v
        bound = sorted(total.values())[-max(1, len(total) // 5)]
        got = {i for i, _ in leakage.block_max_wand(lists, blocks, [max(w) for _, w in lists], bound - 1e-9)}
        assert got == {i for i, v in total.items() if v >= bound - 1e-9}


# --- mixing ----------------------------------------------------------------------------------------


def test_mixture_meets_targets_and_caps(spark):
    sized = spark.createDataFrame([(i, "ab"[i % 10 == 0], 5 + i % 7, 0.5 + (i % 5) / 10) for i in range(2000)], "doc_id long, source string, tokens long, weight double")
    plans = spark.createDataFrame(
        [(1, "a", 1.0, 2, 1.0), (1, "b", 1.0, None, 1.0), (2, "a", 0.0, None, 0.5), (2, "b", 1.0, 3, 0.5), (2, "none", 1.0, 1, 0.5), (3, "a", float("nan"), 1, None), (4, "a", 1.0, 0, 0.1)],
        "plan_id int, source string, target_weight double, max_repeats int, budget_ratio double",
    )
    shares = {(r["plan_id"], r["source"]): r for r in mixing.reached_shares(sized, plans).collect()}
    both = shares[1, "b"]
    assert abs(both["tokens"] - both["target_tokens"]) <= 6 and both["most_repeats"] >= 4
    assert abs(shares[1, "a"]["tokens"] - shares[1, "a"]["target_tokens"]) <= 6
    assert shares[2, "a"]["tokens"] == 0 and shares[2, "none"]["tokens"] == 0
    assert shares[2, "b"]["most_repeats"] <= 3
    assert shares[3, "a"]["tokens"] == 0 and shares[4, "a"]["tokens"] == 0
    drawn = mixing.mixture(sized, plans)
    assert drawn.count() == drawn.select("plan_id", "doc_id").distinct().count()


def test_prefix_sums_are_the_whole_source_in_key_order(spark):
    sized = spark.createDataFrame([(i, "s", 1 + i % 3, 1.0) for i in range(500)], "doc_id long, source string, tokens long, weight double")
    rows = sorted((r["before"], r["tokens"]) for r in mixing.prefix_sums(sized, bucket_rows=20).collect())
    at = 0
    for before, tokens in rows:
        assert before == at
        at += tokens


def test_measured_edges(spark):
    rows = [(1, "s", None), (2, "s", ""), (3, None, "text here"), (4, "s", "word " * 5000), (4, "s", "word " * 5000)]
    got = {r["doc_id"]: r["tokens"] for r in mixing.measured(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert set(got) == {3, 4} and 5000 <= got[4] <= 10001


# --- statistics ------------------------------------------------------------------------------------


def prose(rng, n):
    return " ".join(f"The {rng.choice(WORDS)} of the {rng.choice(WORDS)} is not as {rng.choice(WORDS)} as it was, and that has to be said." for _ in range(n))


def test_non_prose_kinds(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 4), "en") for i in range(120)]
    rows += [
        (500, "\n".join(f"- {rng.choice(WORDS)} {rng.choice(WORDS)}" for _ in range(20)), "en"),
        (501, "\n".join("| " + " | ".join(rng.choice(WORDS) for _ in range(4)) + " |" for _ in range(12)), None),
        (502, "".join(rng.choice("!@#$%^&*()[]{}<>/|~=+-_0123456789") for _ in range(300)), "xx"),
        (503, "broken phrase again, " * 30, "EN"),
        (504, "Some heading\n" + prose(rng, 4) + "\n- one item\n- two items", "de"),
        (505, "ok", "en"),
        (506, None, None),
        (507, "", "en"),
        (508, "\n".join(" ".join(f"{rng.randrange(256):02x}" for _ in range(16)) for _ in range(10)), "en"),
        (509, prose(rng, 3000), "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    stats = textstats.document_stats(df)
    assert {r["doc_id"]: r["kind"] for r in textstats.non_prose(stats).collect()} == {500: "list", 501: "table", 502: "junk", 503: "junk", 508: "junk"}
    by_id = {r["doc_id"]: r for r in stats.collect()}
    assert by_id[506]["n_words"] == 0 and by_id[504]["lang"] == "en" and by_id[0]["mean_word"] > 2
    assert textstats.non_prose(textstats.document_stats(df.limit(0))).count() == 0


def test_near_duplicate_segments_are_four_bytes_a_window():
    import pyarrow as pa

    class Held:
        value = neardup.Order(np.full((2, 2**16), 5, np.int64), 16)

    texts = pa.RecordBatch.from_pydict({"id": ["a", "b"], "content": ["a text of some words and no more", ""]})
    rows = next(neardup._segments(Held, 5, 0.7)(iter([texts]))).to_pylist()
    n = len(neardup.windows("a text of some words and no more"))
    assert sum(len(r["segment"]) for r in rows) == 4 * neardup.early(n, 0.7)[1]
    tally = next(neardup._tally(Held, 5, 0.7)(iter([texts]))).to_pylist()
    assert sorted(r["fragment"] for r in rows) == [r["fragment"] for r in tally] and all(r["n"] == 1 for r in tally)
