"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from siterank.plans import catalogue, climate_queries, resample_queries, score_queries  # noqa: E402
from siterank.session import local_session  # noqa: E402

HEADLINE = [
    "r1_fixed_scores", "r1_fixed_scores_by_supplier", "r5_factor_ablation", "r8_scenario_stability", "m6_m8_beta_weights", "m13_leader_intervals",
    "a12_w5_w6_annual_metrics", "a18_a19_product_agreement", "j5_a22_lag_features", "a24_a26_theil_sen", "m1_block_bootstrap",
    "a7_p7_p8_median_composite", "a1_neighbourhood_summary", "a1_neighbourhood_summary_bucketed", "a4_a6_r13_convergence",
    "m3_independent_block_bootstrap", "m4_w7_shared_block_bootstrap", "m5_j4_point_displacement", "m7_m8_joint_summary", "m10_j9_rank_acceptability",
    "g1_roughness", "g4_flow_accumulation", "g6_j13_drainage_distance", "l7_l8_model_metrics", "m14_block_bootstrap_f1", "v9_secret_scan",
]


#: Draws of the bench alone; the registered queries take the full numbers.
SMALL = [(score_queries, "DRAWS", 400), (climate_queries, "BOOT_DRAWS", 60), (resample_queries, "DRAWS", 40), (resample_queries, "STATES", 10), (resample_queries, "DECISIONS", 6), (resample_queries, "STEPS", 20), (resample_queries, "BLOCK_DRAWS", 30)]


def main() -> None:
    for module, name, value in SMALL:
        setattr(module, name, value)
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:]
    spark = local_session()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    timings = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
                      "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
