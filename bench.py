"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line. Median of three runs after a warm-up."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
HEADLINES = [
    "delta_t", "delta_t_tracking", "rolling_stats", "burstiness", "cusum_two_sided", "kalman_reset", "ewma_adaptive", "unified_tracking", "dead_time", "phase_fold",
    "phase_outliers", "normalize_robust", "cfar_detect", "threshold_peaks", "time_metrics", "detection_pivot", "descriptors12", "ablation", "roc_auc", "energy_detector",
    "ljung_box", "kruskal_h", "mann_whitney_u", "spectral_metrics", "wavelet_denoise", "sensitivity_grid", "group_summary",
]


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pulseloom.plans import catalog
    from pulseloom.session import build_session

    spark = build_session("bench", f"local[{CPUS}]", int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    for name in HEADLINES:
        runs = []
        for _ in range(REPEATS + 1):
            if sum(runs[1:]) > 15:  # a slow query isn't repeated
                break
            begin = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(runs[1:] or runs), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
