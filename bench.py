"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is written to Spark's no-op sink, so whole results are computed. One small
query warms the JVM and the Python workers first; times are single runs after that.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "gated_pairs", "match_points", "detection_metrics_by_sequence", "track_sequences", "tracking_sweep", "track_metrics",
    "fit_velocity_frames", "extrapolate_frames", "frame_summary", "near_duplicates", "exact_duplicates", "hash_split",
    "component_features", "aperture_features", "translation_consensus", "assess",
)


def main() -> None:
    from trackframe.plans import QUERIES
    from trackframe.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_CPUS", "8")))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    run = lambda n: QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("tracked_detections")
    times = {}
    for n in names:
        start = time.perf_counter()
        run(n)
        times[n] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
