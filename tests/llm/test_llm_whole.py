"""Cases that a rule tuned to the test tables would lose: rules hold for any share, size and length."""

import random

import numpy as np

from gleanery.llm import pairs, textstats

WORDS = "house river cloud paper stone garden winter engine market signal window bridge letter forest number valley".split()


def prose(rng, n):
    return " ".join(f"The {rng.choice(WORDS)} of the {rng.choice(WORDS)} is not as {rng.choice(WORDS)} as it was, and that has to be said." for _ in range(n))


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {r["doc_id"]: r["kind"] for r in textstats.non_prose(textstats.document_stats(df)).collect()}


def test_a_defect_many_texts_share_is_found(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 4), "en") for i in range(100)]
    rows += [(1000 + i, f"the {WORDS[i % 16]} is broken again, " * 20, "en") for i in range(60)]
    assert found(spark, rows) == {1000 + i: "junk" for i in range(60)}


def test_shuffled_text_is_found_in_a_small_corpus(spark):
    rng = random.Random(4)
    topics = ["缓存", "索引", "日志", "网关", "向量", "模型", "检索", "文档"]
    line = lambda: f"{rng.choice(topics)}的配置需要先检查{rng.choice(topics)}服务是否正常，然后再根据实际情况调整{rng.choice(topics)}的参数，避免出现超时的问题。"
    rows = [(i, "".join(line() for _ in range(4)), "zh") for i in range(40)]
    scrambled = list("".join(line() for _ in range(4)))
    rng.shuffle(scrambled)
    assert found(spark, [*rows, (99, "".join(scrambled), "zh")]) == {99: "junk"}


def test_repeated_phrases_of_any_length_and_place():
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for period in (17, 43, 47, 121, 250, 777):
        phrase = "".join(rng.choice(letters) for _ in range(period))
        for heading in ("", "A heading\n"):
            assert textstats._repeats(heading + phrase * 6) >= 0.85
    halves = "the first half of it, the second half of it"
    assert textstats._repeats("Heading\n" + "".join(f"{rng.choice(letters) * 3}. {halves}. " for _ in range(9))) >= 0.6
    leaders = "\n".join(f"{w.title()} of the matter {'.' * 60} {i}" for i, w in enumerate(WORDS))
    rows = "\n".join(f"| A{i:02} | available | 10 EUR | north |" for i in range(20))
    assert max(map(textstats._repeats, (leaders, rows, prose(rng, 30)))) < 0.6


def test_pairs_without_an_id_all_come_out(spark):
    ev = spark.createDataFrame([(None, "Why?", None), (None, "Why?", "I cannot answer this question."), (1, "Why?", None), (1, "Why?", None)], "result_id long, query string, response string")
    rp = spark.createDataFrame([(None, "Why?", None, None), (None, "Why?", "N/A", None)], "report_id long, question string, answer_preview string, error string")
    got = sorted((r["table_name"], r["pair_id"] or 0, r["defect"]) for r in pairs.broken_pairs(ev, rp).collect())
    assert got == [("e2e_report", 0, "empty"), ("e2e_report", 0, "empty"), ("evaluation_results", 0, "empty"), ("evaluation_results", 0, "refusal"), ("evaluation_results", 1, "empty")]


def test_long_copies_and_padded_words():
    question = "缓存为什么要定期清理并且重新加载全部的索引文件"
    responses = [question * 12, "          N/A          ", "-- -- -- -- -- none -- -- --"]
    got = pairs.classify([question] * 3, responses, [None] * 3, np.array([False] * 3), pairs.clause_field())
    assert got == ["copy", "empty", "empty"]


def test_language_is_counted_over_the_whole_text():
    table = textstats.PairTable(np.ones(textstats.SLOTS, np.int64), np.ones(textstats.SLOTS, np.int64))
    assert textstats.statistics("the river and the house. " * 1000 + "缓存需要定期清理" * 2000, "en", table)[0] == "zh"


def test_tails_hold_though_many_texts_share_a_defect(spark):
    """Nearly half of a language is one phrase over and over: the other half still gives the norms."""
    rng = random.Random(2)
    rows = [(i, prose(rng, 12), "en") for i in range(60)] + [(100 + i, f"again and again {i} " * 30, "en") for i in range(45)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["kind"]) for r in textstats.non_prose(textstats.document_stats(docs)).collect()}
    assert got == {(100 + i, "junk") for i in range(45)}
