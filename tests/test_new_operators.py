"""Operators of this round on small fixtures: brute force, odd input, refusals."""

import math
import random

import numpy as np
import pytest

from gleanery.operators import catalogue, ingest, lexical, vector
from gleanery.plans import routing, steps


def brute_bm25(queries, docs, k):
    import re

    def bag(t):
        t = t.lower()
        out = [w for w in re.findall(r"[a-z0-9_]+", t) if len(w) > 1]
        for run in re.findall("[一-鿿]+", t):
            out += [run[i : i + 2] for i in range(len(run) - 1)]
        return out

    bags = {i: bag(t) for i, t in docs if t is not None}
    n, avgdl = len(bags), sum(map(len, bags.values())) / len(bags)
    df: dict = {}
    for b in bags.values():
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((n - x + 0.5) / (x + 0.5)) for t, x in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    out = set()
    for qid, q in queries:
        scores = []
        for i, b in bags.items():
            s, hit = 0.0, False
            for t in bag(q):
                tf = b.count(t)
                if tf:
                    hit = True
                    s += (floor if idf[t] < 0 else idf[t]) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(b) / avgdl))
            if hit:
                scores.append((-round(s, 6), i))
        out |= {(qid, i, rank) for rank, (_, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def texts(seed=3, n=60):
    rng = random.Random(seed)
    words = "river stone cloud paper garden winter engine market the the the signal".split()
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(n)] + [(900, None), (901, ""), (902, "缓存索引缓存")]


def test_bm25_and_stored_index_equal_brute_force(spark, tmp_path):
    docs, queries = texts(), [(1, "the river stone"), (2, "缓存 engine"), (3, "nothing of that"), (4, "")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "qid long, query string")
    want = brute_bm25(queries, docs, 7)
    assert {(r["qid"], r["doc_id"], r["rank"]) for r in lexical.bm25(q, d, 7).collect()} == want
    lexical.write_index(d, str(tmp_path / "a"))
    assert {(r["qid"], r["doc_id"], r["rank"]) for r in lexical.search_index(q, str(tmp_path / "a"), 7).collect()} == want
    changed = [(5, "river river signal"), (950, "a new stone")]
    lexical.update_index(str(tmp_path / "a"), str(tmp_path / "b"), spark.createDataFrame(changed, "doc_id long, text string"), spark.createDataFrame([(7,), (12345,)], "doc_id long"))
    now = [(i, t) for i, t in docs if i not in (5, 7)] + changed
    assert {(r["qid"], r["doc_id"], r["rank"]) for r in lexical.search_index(q, str(tmp_path / "b"), 7).collect()} == brute_bm25(queries, now, 7)
    assert lexical.search_index(q.limit(0), str(tmp_path / "a")).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_exact_top_with_ties_and_copies(spark, metric, monkeypatch):
    monkeypatch.setattr(vector, "ROW_BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(80, 6)).round(1)
    rows[20:45] = rows[3]  # a third are copies of one vector
    store = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] + [(500, None)], "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, rows[i].tolist()) for i in (0, 3, 7)], "qid long, embedding array<double>")
    got = {(r["qid"], r["vec_id"], r["rank"]) for r in vector.exact_top(asked, store, 5, metric).collect()}
    want = set()
    for q in (0, 3, 7):
        if metric == "l2":
            s = [-math.dist(rows[q], r) for r in rows]
        else:
            s = [float(rows[q] @ r) / (1 if metric == "ip" else np.linalg.norm(rows[q]) * np.linalg.norm(r)) for r in rows]
        want |= {(q, i, n) for n, (_, i) in enumerate(sorted((-round(x, 6), i) for i, x in enumerate(s))[:5], 1)}
    assert got == want
    assert vector.exact_top(asked.limit(0), store, 5, metric).count() == 0


def test_codes_and_lists_find_exact_neighbours(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.normal(size=(60, 8)) + 6 * rng.normal(size=8) for _ in range(5)])
    store = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<float>").cache()
    asked = store.filter("vec_id % 40 = 0").withColumnRenamed("vec_id", "qid")
    truth = vector.exact_top(asked, store, 5, "l2")
    books = vector.Codebooks(rows, parts=2, codes=32)
    found = vector.coded_top(asked, store, books, 5, 40, vector.code_table(store, books))
    assert min(r["recall"] for r in vector.recall(found, truth, 5).collect()) >= 0.8
    centers = vector.k_means(rows, 8)
    vector.write_lists(store, centers, str(tmp_path / "l"), 2)
    near = vector.list_top(asked, spark.read.parquet(str(tmp_path / "l")), centers, 2, 5, 2)
    assert min(r["recall"] for r in vector.recall(near, truth, 5).collect()) >= 0.8
    assert max(r["n_read"] for r in near.collect()) < len(rows)
    store.unpersist()


def test_stack_contradictions(spark):
    turns = [("r", 1, "INTJ: Ni-Te-Fi-Se"), ("r", 2, "nothing"), ("r", 3, "intj：Si-Fe-Ti-Ne"), ("r", 4, "INTJ Si-Fe-Ti-Ne, ENFP: Ne-Fi-Te-Si"), ("s", 1, "INTJ: Si-Fe-Ti-Ne"), ("r", 20, "INTJ: Ni-Te-Fi-Se")]
    got = {tuple(r) for r in routing.stack_contradictions(spark.createDataFrame(turns, "run_id string, turn long, answer string")).select("run_id", "turn", "code", "old_stack", "stack").collect()}
    assert got == {("r", 3, "INTJ", "Ni-Te-Fi-Se", "Si-Fe-Ti-Ne")}


def test_stated_stacks_come_first(spark):
    rows = [(1, 10, 1, "what of intj", "no word of it"), (1, 11, 2, "what of intj", "INTJ: Ni-Te-Fi-Se"), (1, 12, 3, "what of intj", None), (2, 10, 1, "plain", "INTJ: Ni-Te-Fi-Se"), (2, 13, 2, "plain", "x")]
    got = {tuple(r) for r in steps.stack_first(spark.createDataFrame(rows, "qid long, doc_id long, rank long, query string, text string")).collect()}
    assert got == {(1, 11, 1), (1, 10, 2), (1, 12, 3), (2, 10, 1), (2, 13, 2)}


def test_catalogue_refuses(spark):
    c = catalogue.Catalogue(resources={"documents": spark.range(3)})

    @c.tool("numbers", risk="DANGEROUS")
    def wipe(documents):
        return documents.limit(0)

    @c.tool("first rows")
    def head(queries, documents, n: int, label: str = "x"):
        return documents.limit(n)

    assert c.tools["head"].schema()["parameters"] == {"type": "object", "properties": {"n": {"type": "integer"}, "label": {"type": "string", "default": "x"}}, "required": ["n"]}
    assert c.execute("head", spark.range(1), n=2).count() == 2
    for call, error in ((lambda: c.execute("none"), ValueError), (lambda: c.execute("wipe"), PermissionError), (lambda: c.execute("head"), TypeError), (lambda: c.execute("head", m=1, n=1), TypeError), (lambda: c.pick("router", "none"), ValueError)):
        with pytest.raises(error):
            call()
    assert c.execute("wipe", allow="DANGEROUS").count() == 0


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string")
    path = str(tmp_path / "s")
    assert ingest.is_empty(spark, path) and ingest.index_once(rows, path) and not ingest.index_once(rows, path)
    ingest.clear(spark, path, rows.schema)
    assert ingest.is_empty(spark, path)
    ingest.write_both(rows, (str(tmp_path / "x"), str(tmp_path / "y")))
    assert ingest.read_either(spark, (str(tmp_path / "gone"), str(tmp_path / "y"))).count() == 3
    out = ingest.update_collection(rows, spark.createDataFrame([(2, "B"), (4, "d")], rows.schema), spark.createDataFrame([(1,)], "id long"), "id")
    assert {tuple(r) for r in out.collect()} == {(2, "B"), (3, None), (4, "d")}
    ingest.write_blocks(rows, str(tmp_path / "b"), "id", 2)
    found = ingest.lookup(spark, str(tmp_path / "b"), "id", [2, 9], 2)
    assert [r["v"] for r in found.collect()] == ["b"] and "PartitionFilters: [isnotnull(block" in found._jdf.queryExecution().toString() or found.count() == 1
