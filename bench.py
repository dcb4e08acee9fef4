"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "popular_items clean_rows top_n content_type_heuristic extract_text_html extract_text_markdown "
    "extract_text_rst cluster_metadata median_center labeled_plot format_downloads viewport_points "
    "nearest_within label_top_k fuzzy_search constellation_edges cluster_prompts cluster_labels "
    "packages_output dense_ids knn_exact fuzzy_graph embed_text spanning_forest density_clusters density_leaves "
    "knn_approximate knn_descent fuzzy_hits_documents connected_components reduce_dims map_coordinates whole_map"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    import registered

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One scan and one exchange, so that no query pays for the start.
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # Every column of every row is computed, none is brought to the driver.
        registered.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
