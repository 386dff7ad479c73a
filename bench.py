"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from lectern import catalog
from lectern.session import build_session

HEADLINE = (
    "slice_cited_evidence", "t1_normalize_text", "t11_chunk_documents", "t19_find_literal", "r1_embed", "r2_vector_topk",
    "r5_term_index", "r7_bm25_topk", "r8_keyword_scan", "r9_hybrid_topk", "r16_grep_lines", "w1_merge_ranges", "w4_budgeted_windows",
    "w6_compare_windows", "w10_budget_trim", "w15_citations", "d4_scan_raw", "g1_ingestion_progress", "g2_session_summaries",
    "g7_latency_summary", "k5_request_metrics_tumbling", "j8_validate_index", "s10_upsert", "d1_ingest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", int(cpus),
        {"spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    docs, chars = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("count(*)", "sum(octet_length(text))").first()
    asked = spark.read.parquet(f"{folder}/benchmark.parquet").count()
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    rates = {
        "d1_docs_per_s": round(docs / times["d1_ingest"], 1), "r2_queries_per_s": round(vectors / 50 / times["r2_vector_topk"], 1),
        "r9_queries_per_s": round(asked / times["r9_hybrid_topk"], 2), "d4_mb_per_s": round(chars / 1e6 / times["d4_scan_raw"], 2),
    }
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rates": rates,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
