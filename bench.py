"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all cores) are read
from the environment. Each query is run once to warm up and once timed; the result is
written to the no-op sink, so the full result is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docloom.plans.catalog import QUERIES  # noqa: E402
from docloom.session import build_session  # noqa: E402

HEADLINE = [
    "chunk_semantic",
    "chunk_word_windows",
    "store_sharded_records",
    "dense_topk",
    "dense_sharded_topk",
    "bm25_topk",
    "tfidf_topk",
    "hybrid_two_way",
    "multi_vector_fusion",
    "multi_vector_reranked",
    "expanded_retrieval",
    "parent_context",
    "query_router",
    "answer_validation",
    "entity_extraction",
    "entity_summary",
    "relation_patterns",
    "relation_graph_nodes",
    "relation_entity_pairs",
    "relation_svo",
    "document_summary",
    "collection_analysis",
    "ingest_statistics",
    "context_compression",
    "conversation_context",
    "cache_lookup",
    "performance_stats",
    "running_response_time",
    "html_to_text",
    "json_source",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        for timed in (False, True):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if timed:
                times[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
