"""Times headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and threads."""

from __future__ import annotations

import json
import os
import time

QUERIES = (
    "node_stats_batch", "graph_breakdown", "template_usage", "join_edges_same_source", "connected_nodes", "source_stats", "llm_metrics_summary", "quality_source",
    "search_vector", "search_keyword", "search_hybrid", "similarity_join", "graph_components", "graph_pagerank", "graph_clustering", "graphrag_search",
    "er_exact", "rel_dedup", "rel_limits", "text_web_basic", "normalize_pipeline", "rank_rrf", "context_budget", "page_scan", "anti_orphan_edges_dst",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from graphloom import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # starts the executors
    times = {}
    for name in QUERIES:
        began = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
