"""Time the headline queries: one JSON line with seconds per query and rates comparable to published ones."""

from __future__ import annotations

import json
import os
import sys
import time

from gleanery.operators import vector
from gleanery.plans import load
from gleanery.runtime import build_session, scratch, table

#: Retrieval, indexing and reporting queries every user runs; the training-data queries follow if present.
HEADLINE = ("c3_fixed_windows", "t8_sparse_vectors", "l1_bm25_top20", "v1_cosine_top10", "v4_binary_top10", "v7_ivf_recall", "j1_weighted_rrf", "k4_incremental_status", "a8_case_scores", "a9_report_rollup", "a10_latency_percentiles", "g1_graded_hits", "p2_found", "st10_tumbling", "st1_rate_limited")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "12g"})
    chosen = {name: load()[0][name] for name in HEADLINE}
    try:
        from gleanery.llm.queries import queries

        chosen |= {k: v for k, v in queries().items() if k.endswith("_found") or k in ("p1_day_percentiles", "p8_mixture")}
    except ImportError:
        pass
    run(table(spark, folder, "nation"))
    seconds = {}
    for name, query in chosen.items():
        began = time.time()
        run(query(spark, folder))
        seconds[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()

    # Rates: vectors written per second, and exact and quantised search per query.
    store = table(spark, folder, "embeddings").select("vec_id", "embedding")
    n_vectors, out = store.count(), scratch(spark, "bench")
    began = time.time()
    store.repartition(int(cpus)).write.mode("overwrite").parquet(out)
    write_s = time.time() - began
    asked = store.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid")
    n_queries = asked.count()
    began = time.time()
    run(vector.exact_top(asked, store))
    search_s = time.time() - began
    rates = {"vectors_written_per_s": round(n_vectors / write_s), "exact_search_ms_per_query": round(1000 * search_s / max(n_queries, 1), 2), "vectors": n_vectors}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rates": rates, "sf": os.path.basename(folder.rstrip("/"))}), flush=True)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
