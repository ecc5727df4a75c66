"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

import json
import os
import time

from plotwise import catalog
from plotwise.session import build_session

HEADLINE = [
    "flagship_farm_profile",  # union, clean, farm sums, trim, profile
    "D23_measurement_quality",  # measured against reported areas
    "C14_attach_admin",
    "D15_correlation_pairs",
    "D4_profile_with_total",
    "B15_trim_by_quantile",
    "D2_farm_area",
    "D18_gini",
    "E2_share_curves",
    "E16_build_trajectory_features",
    "L1_ks_two_sample",
    "L6_expand_population",
    "L11_size_classes",
    "L15_zone_farm_stats",
    "L16_threshold_shares",
    "R11_rollup_dekads",
    "R12_zonal_stats",
    "R16_compare_products",
    "R19_morans_i",
    "K14_quantile_forest",
    "K17_evaluate_logo",
    "K18_transfer_matrix",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load()
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    times = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
