"""Headline queries timed on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from parcelgrid.queries import QUERIES
from parcelgrid.queries.registry import forget_shared
from parcelgrid.session import build_session

HEADLINE = [
    "A7_trades", "B32_focus_windows", "C1_lot_lookup", "C2_points_in_zones", "C4_adjacency", "C6_price_target",
    "C7_comparable_newbuild", "C8_nearest_station_as_of", "C10_building_snapshot", "D1_old_ratio_by_parcel",
    "D11_neighbour_features", "D12_cluster_metrics", "D15_score_distribution", "E9_scoring_agreement",
    "G3_candidate_clusters", "M1_label_table", "M2_node_features", "R1_assessments", "T1_screener", "T2_cosine_topk",
    "V1_verify_attribute", "W1_land_percentile",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        forget_shared()
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
