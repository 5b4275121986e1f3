"""Time the headline queries; prints one JSON line.

Each query is run ``BENCH_WARM`` + 1 times to a no-op sink: the first run is
reported as cold, the best of the rest as its time.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "w1_climatology",
    "w4_lane_days",
    "w7_run_summary",
    "a30_station_consistency",
    "j1_orthorectify",
    "j5_bracket_interpolation",
    "j11_wedge_join",
    "j13_point_in_polygon",
    "j15_match_detections",
    "a1_matched_filter",
    "a3_loo_shrinkage",
    "a9_quantify_plume",
    "a14_split_statistics",
    "w12_gaussian",
    "w14_segment_plume",
    "g1_label_regions",
    "w18_band_response",
    "w19_saturating_response",
    "a34_day_means",
    "a39_factor_diagnostics",
    "t1_ranked_candidates",
    "h4_factor_hypotheses",
    "p16_constraint_violations",
    "s11_dedupe_latest",
    "f21_structural_diff",
]


def main() -> None:
    from skyledger.session import local_session
    from skyledger.workload import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm = int(os.environ.get("BENCH_WARM", "1"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = local_session(cpus, "bench")
    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(warm + 1):
            t = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        cold[name] = round(runs[0], 3)
        times[name] = round(min(runs[1:] or runs), 3)
        print(name, cold[name], times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "cold": cold,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
