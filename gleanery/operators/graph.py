"""Graph lookup by mentioned node, guarded SQL and metadata filters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edge_lookup(questions: DataFrame, edges: DataFrame, relation: str | None = None) -> DataFrame:
    """Out- and in-edges of the first node (in node order) a question mentions.

    ``edges(src, dst, relation, ord)``: the last write of an edge wins. Mentions are found by cutting each
    question into substrings of the lengths nodes have and joining on equality, so no nested loop over
    all nodes is needed.
    """
    latest = edges.groupBy("src", "dst").agg(F.max_by("relation", "ord").alias("relation"), F.min("ord").alias("ord"))
    nodes = latest.select(F.col("src").alias("node"), (F.col("ord") * 2).alias("node_ord")).union(latest.select(F.col("dst").alias("node"), (F.col("ord") * 2 + 1).alias("node_ord"))).groupBy("node").agg(F.min("node_ord").alias("node_ord"))
    lengths = nodes.select(F.length("node").alias("n")).distinct().agg(F.collect_list("n").alias("ns"))  # distinct lengths: a few numbers
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("question") - n + 1, F.lit(1))), lambda i: F.substring("question", i, n))
    parts = questions.crossJoin(F.broadcast(lengths)).select("qid", F.explode(F.array_distinct(F.flatten(F.transform("ns", lambda n: cut(n))))).alias("node"))
    first = parts.join(nodes, "node").groupBy("qid").agg(F.min_by("node", "node_ord").alias("node"))
    out = first.join(latest, F.col("node") == F.col("src")).select("qid", "node", "relation", F.col("dst").alias("other"), F.lit("out").alias("direction"))
    into = first.join(latest, F.col("node") == F.col("dst")).select("qid", "node", "relation", F.col("src").alias("other"), F.lit("in").alias("direction"))
    found = out.unionByName(into)
    return found.filter(F.col("relation") == relation) if relation else found


#: What a guarded statement may not contain, and its row limit.
FORBIDDEN = ("insert", "update", "delete", "drop", "truncate", "alter", "create", "replace", "merge", "exec", "execute", "call", "grant", "revoke", "into", "set")
ROW_LIMIT = 100


def guarded(statement: str) -> str:
    """The statement with its row limit in force; raises ValueError for anything but a plain SELECT."""
    text = statement.strip().rstrip(";").strip()
    if ";" in text or not re.match(r"(?i)select\b", text):
        raise ValueError("only a single SELECT is allowed")
    found = [w for w in FORBIDDEN if re.search(rf"(?i)\b{w}\b", text)]
    if found:
        raise ValueError(f"not allowed: {', '.join(found)}")
    limits = re.findall(r"(?i)\blimit\s+(\d+)", text)
    if not limits:
        return f"{text} LIMIT {ROW_LIMIT}"
    return re.sub(r"(?i)\blimit\s+(\d+)", lambda m: f"LIMIT {min(int(m[1]), ROW_LIMIT)}", text)


def guarded_query(spark: SparkSession, statement: str, **tables: DataFrame) -> DataFrame:
    """Run a guarded statement over named tables (Spark substitutes them; nothing is registered)."""
    return spark.sql(guarded(statement), **tables)


def metadata_filter(rows: DataFrame, must: dict[str, str]) -> DataFrame:
    """Rows whose metadata map has every wanted value; maps do not push down, so promote hot keys to columns."""
    condition = F.lit(True)
    for key, value in must.items():
        condition = condition & F.coalesce(F.element_at("metadata", F.lit(key)) == value, F.lit(False))
    return rows.filter(condition)
