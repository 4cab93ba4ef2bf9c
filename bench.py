"""Times headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tendersift.plans import load_all
from tendersift.plans.registry import QUERIES
from tendersift.session import local_session
from tendersift.sources import mapping

# Stage tables are written by the first query that needs them, so each line carries its own real cost.
HEADLINE = (
    "r022_wide_bid_disparity", "r057_bid_rotation", "agg_buyer_portrait", "agg_pair_portrait", "agg_global_quantile",
    "rule_quick_scan", "rule_detect", "rule_summary", "stat_detect", "net_cobid_edges", "net_clustering", "net_detect",
    "ml_lof", "ml_detect_buyers", "ml_iforest", "ens_combine_five", "ens_summary", "eda_rates",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    load_all()
    times: dict[str, float] = {}

    def run(name: str, action) -> None:
        start = time.time()
        action()
        times[name] = round(time.time() - start, 3)

    run("stage_tenders", lambda: mapping.tenders(spark, folder))
    run("stage_bids", lambda: mapping.bids(spark, folder))
    for name in HEADLINE:
        run(name, lambda n=name: QUERIES[n](spark, folder).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
