"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Every query runs end to end from the parquet files (fixture build included) and is
forced with a no-op write, so the whole result is computed without collecting it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "S1_load_table",
    "D1_profile",
    "C4_fit_apply_scaler",
    "P1_stratified_kfold",
    "P2_undersample",
    "P3_knn",
    "P4_smote",
    "P5_near_miss",
    "E3_binary_metrics",
    "E11_curve_comparison",
    "G1_correlation_matrix",
    "M1_logistic",
    "M2_linear_svm",
    "M5_random_forest",
    "M6_boosted_trees",
    "V3_cross_validate_many",
    "V5_grid_search",
    "V5_grid_search_model",
    "L5_drop_one_cv",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from rarebird.catalog import QUERIES
    from rarebird.session import cleanup_scratch, get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM and executor start-up, not a query
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
        spark.catalog.clearCache()  # each query starts from the files
    cleanup_scratch(spark)  # the scratch tables the queries wrote
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
