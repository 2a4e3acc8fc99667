"""Times the headline queries: one warm-up, then the median of three runs, each written to a sink that keeps nothing."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from threadlens.plans import registry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "exchange_pairs", "thread_roots", "anchored_replies", "merged_messages", "filter_funnel", "language_confusion", "template_repeats",
    "top_terms", "exact_duplicates", "near_duplicate_max", "prior_sessions", "time_split", "signal_codes", "weak_outcome",
    "keyword_routing", "policy_decisions", "topk_diverse", "classification_report", "weighted_kappa", "bootstrap_ci", "scorecard",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, failed = {}, {}
    for name in HEADLINE:
        times = []
        try:
            for _ in range(4):
                began = time.time()
                registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
                times.append(time.time() - began)
        except Exception as error:  # the others are measured all the same, and the failure is printed
            failed[name] = str(error)[:200]
            continue
        found[name] = round(median(times[1:]), 3)
    total = round(sum(found.values()), 3)
    line = {"metric": "headline_seconds", "value": total, "unit": "sec", "queries": found, "sf": os.path.basename(SF_DIR)}
    print(json.dumps(line | ({"failed": failed} if failed else {})))


if __name__ == "__main__":
    main()
