"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print ONE JSON line with seconds per query (full materialisation via a
no-op write, so every row is computed but nothing is pulled to the driver)."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.plans.registry import load_all  # noqa: E402
from ledgerlens.session import get_session  # noqa: E402

HEADLINE = [
    "trust_score", "risk_profile", "merchant_profile", "merchant_insights", "catalog_tagger",
    "fuzzy_catalog_match", "parity_features", "analytic_features", "advanced_features", "user_stats",
    "merchant_stats", "txn_velocity", "spending_summary", "psych_profile", "nudge_ranking",
    "text_analysis", "spending_mentions", "rolling_user_features", "fs_store_latest", "fs_asof_join",
    "ensemble_blend", "amount_percentile", "stream_velocity", "stream_tagging", "stream_last_txn_features",
    "dataset_summary", "merchant_competition", "nudge_analytics", "rolling_merchant_features", "amount_outliers",
    "train_tagger", "score_transactions", "fs_compaction", "label_store", "advice_log",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys_env = os.environ.get("BENCH_QUERIES")
    spark = get_session(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")),
                        app="ledgerlens-bench")
    qs, _ = load_all()
    keys = keys_env.split(",") if keys_env else [k for k in HEADLINE if k in qs]
    # warm-up: start the executors and JIT on a tiny job (not timed)
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for k in keys:
        t0 = time.time()
        qs[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
