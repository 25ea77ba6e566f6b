"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tesserae.plans import registry
from tesserae.session import local_session

QUERIES = ["describe_numeric", "profile_columns", "correlation_pairs", "describe_categorical", "vif", "kruskal_wallis", "anova", "test_battery", "standard_scale", "target_encode", "regression_metrics", "roc_auc", "subgroup_errors", "drift_report", "structural_break", "forecast_ses", "association_itemsets", "fit_linear_regression", "fit_kmeans", "anomaly_iqr", "sensitivity_run"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    have = registry.queries()
    have["scan_parquet"](spark, sf).collect()  # the session's own start is not a query's time
    took = {}
    for name in QUERIES:
        began = time.time()
        have[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
