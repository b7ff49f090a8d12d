"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the data folder (default /root/testdata/sf0.1), BENCH_CPUS the number of cores.
`catalog`, `feature_extraction` and `all_pairs_and_store` are the three parts of a build, timed one
after the other; the serving queries then read what the build stored.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from suite import fixture as fx  # noqa: E402
from suite.queries import QUERIES  # noqa: E402

BUILD = {
    "catalog": fx.stored_catalog,
    "feature_extraction": fx.stored_features,
    "all_pairs_and_store": fx.stored_similarities,
    "metadata": fx.stored_metadata,
}
HEADLINES = (
    "prepare_catalog",
    "quality_report",
    "describe_numeric",
    "value_counts",
    "histogram",
    "enrich_with_children",
    "tokenize",
    "term_vocab",
    "tfidf",
    "combined_features",
    "text_similarity",
    "hybrid_similarity",
    "similarity_topn",
    "component_topn",
    "weight_sweep",
    "similarity_stats",
    "pair_histogram",
    "store_similarities",
    "replace_neighbours",
    "reweight_stored_pairs",
    "similar_items",
    "recommend_with_metadata",
    "recommend_json",
    "full_build",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("akin-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = session(cpus)
    seconds: dict[str, float] = {}
    for name, make in BUILD.items():
        start = time.perf_counter()
        make(spark, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("/sf", 1)[-1],
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
