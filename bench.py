"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local threads, BENCH_QUERIES a comma list of other queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from sightline.session import build_session
from sightline_queries import QUERIES

HEADLINE = ["overview", "describe_numeric", "describe_extended", "describe_categorical", "missing_summary",
            "suggest_types", "detect_missing_data", "detect_type_mismatches", "detect_outliers_iqr",
            "detect_duplicate_rows", "detect_inconsistent_categories", "detect_class_imbalance", "detect_skewed",
            "detect_low_variance", "detect_multicollinearity", "detect_invalid_values", "issue_summary",
            "quality_score", "correlation_matrix", "group_mean", "value_counts", "crosstab", "hierarchy_rollup",
            "kpi", "histogram", "box_stats_by_group", "kde", "violin_data", "density_2d", "impute_median",
            "drop_duplicates", "cap_outliers", "clean_default", "data_readiness", "pca", "kmeans", "lag_features"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(f"local[{cpus}]", partitions=int(cpus))
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start-up cost apart
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
