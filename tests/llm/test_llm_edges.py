"""Nulls in any column, clashing extra columns, repeated rows and empty tables."""

from pyspark.sql import functions as F

from gleanery.llm import leakage, mixing, neardup, pairs, residue, sketch, splitting, textstats

CLASHES = ("kind", "host", "notice", "piece_no", "n", "windows", "mark", "rank", "item_id", "tokens", "weight", "key", "bucket", "lang_mid", "n_docs", "available", "whole", "table_name", "n_rows", "salt", "row", "score", "body", "other", "sentences", "sizes", "mismatch", "cover", "duplicated", "host_share", "block", "counts", "fragment", "start", "segment", "role", "before", "upto")


def dressed(df):
    """The same rows with extra columns named like the operators' own."""
    for name in CLASHES:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


def rows_of(df):
    return sorted(map(repr, df.collect()))


def same(plain, clashing):
    assert rows_of(plain) == rows_of(clashing)


def test_chunks(spark):
    schema = "doc_id string, content string, source string, page int, metadata map<string,string>"
    df = spark.createDataFrame([(None, "Please turn on JavaScript to go on.", None, None, None), (None, "x" * 900, None, None, {"title": None}), ("a", None, None, None, {"title": "{{title}}"}), ("a", None, None, None, {"title": "{{title}}"})], schema)
    same(residue.residue(df), residue.residue(dressed(df)))
    assert sorted((r["doc_id"] or "", r["kind"]) for r in residue.residue(df).collect()) == [("", "script_notice"), ("a", "placeholder")]
    same(splitting.split_documents(df), splitting.split_documents(dressed(df)))
    assert splitting.split_documents(df).count() == 3
    # Of the records without an id the notice goes and the knowledge stays.
    assert [r["content"] for r in residue.clean(dressed(df)).collect()] == ["x" * 900]


def test_entries(spark):
    df = spark.createDataFrame([("a", "the same words here"), ("a", "the same words here"), (None, "the same words here"), ("b", "the same words here!")], "id string, content string")
    for one in (df, dressed(df)):
        assert [tuple(r) for r in neardup.NearDuplicates(one).pairs().collect()] == [("a", "b")]


def test_pair_tables(spark):
    ev = spark.createDataFrame([(None, None, None), (1, None, "N/A")], "result_id long, query string, response string")
    rp = spark.createDataFrame([(None, None, None, None)], "report_id long, question string, answer_preview string, error string")
    got = pairs.broken_pairs(dressed(ev), dressed(rp))
    assert sorted((r["table_name"], r["pair_id"] or 0, r["defect"]) for r in got.collect()) == [("e2e_report", 0, "empty"), ("evaluation_results", 0, "empty"), ("evaluation_results", 1, "empty")]


def test_documents_and_items(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(None, passage, None, None), (1, None, None, None), (2, passage, "s", "en"), (2, passage, "s", "en")], "doc_id long, text string, source string, lang string")
    items = spark.createDataFrame([(1, passage, None, None), (2, None, None, None), (None, None, "q", ["x"])], "id int, passage string, query string, expected_contains array<string>")
    for d, i in ((docs, items), (dressed(docs), dressed(items))):
        assert sorted((r["doc_id"] or 0, r["item_id"]) for r in leakage.leaks(d, i).collect()) == [(0, 1), (2, 1)]
        assert leakage.leak_details(d, i).filter("doc_id = 2").count() == 2
    for d in (docs, dressed(docs)):
        assert [r["doc_id"] for r in mixing.measured(d).collect()] == [2]
        assert textstats.document_stats(d).count() == 4 and textstats.non_prose(textstats.document_stats(d)).count() == 0
    plans = dressed(spark.createDataFrame([(None, None, None, None, None), (1, "s", None, None, 1.0), (2, "s", 1.0, None, 1.0)], "plan_id int, source string, target_weight double, max_repeats int, budget_ratio double"))
    assert [(r["plan_id"], r["doc_id"], r["repeats"]) for r in mixing.mixture(mixing.measured(docs), plans).collect()] == [(2, 2, 1)]


def test_latencies(spark):
    df = spark.createDataFrame([(None, None, None, None), ("m", "g", None, 2.0), ("m", "g", None, 2.0)], "metric string, grp string, day date, value double")
    same(sketch.quantile_rows(sketch.cell_sketches(df)), sketch.quantile_rows(sketch.cell_sketches(dressed(df))))
    assert {r["n_rows"] for r in sketch.cell_sketches(df).collect()} == {1, 2}
