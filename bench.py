"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
Each query is run once to warm up on the smallest data, then timed writing its
whole result to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from cellweft import queries as own

HEADLINE = [
    "fragment_counts", "clean_cells", "count_thresholds", "whitelist_semi", "cell_feature_counts", "fixed_bins", "region_scores", "peak_counts", "log1p_norm", "overlap_join",
    "window_distance_join", "nearest_k_per_bin", "guidance_edges", "tfidf", "gene_score_product", "knn_topk", "label_transfer", "silhouette", "rank_average", "nb2_dispersion", "evidence_support", "pileup",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    took = {}
    for name in HEADLINE:
        f = own.QUERIES[name]
        f(spark, small if os.path.isdir(small) else folder).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        f(spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
