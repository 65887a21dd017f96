"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from geotransfer.queries import REGISTRY  # noqa: E402
from geotransfer.session import build_session  # noqa: E402

HEADLINE = [
    "quality_filter", "qa_cascade_table", "qa_by_year", "capped_sample", "strata_audit", "sample_distortion",
    "distribution_summary", "greedy_folds", "fold_totals", "label_draws", "common_sample", "exclusion_counts",
    "validated_join", "common_intersection", "stage_survivors", "outer_compare", "metrics_by_fold",
    "metrics_pooled", "contrast_summary", "run_summary", "label_thresholds", "decile_bias", "residual_bins",
    "response_curve", "drift_table", "total_variation", "spearman", "auroc_rank_sum", "calibrated_runs",
    "annual_median_composite", "qa_histogram", "timing_shares", "albers_blocks", "utm_block_table",
    "points_in_polygon", "point_to_pixel", "terrain_slope_aspect", "norm_audit", "nearest_source",
    "distance_deciles", "radar_features", "spectral_indices", "freeze_summary", "ordered_row_hashes",
    "table_fingerprint", "local_few_shot", "ridge_cv", "ingest_restart", "source_components", "logistic_by_fold",
    "boosted_stump_cv",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    REGISTRY["metrics_overall"].run(spark, sf).collect()  # start the JVM workers
    times = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28s} {times[name]:7.3f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf).name}))
    spark.stop()


if __name__ == "__main__":
    main()
