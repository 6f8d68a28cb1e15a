"""Headline queries on one machine; prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_QUERIES (comma
list, optional). Every query is run once to warm up on the same data and then timed; rows
are counted through a no-op sink, so the whole result is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from voxelmill.plans import catalog  # noqa: E402
from voxelmill.session import local_session  # noqa: E402

HEADLINE = [
    "voxel_mean", "dynamic_voxelize", "hard_voxelize", "dynamic_scatter", "bev_pool", "pillar_decorate",
    "points_in_range_3d", "frustum_filter", "read_multi_sweeps", "history_sweeps", "lidar_sweep_chain",
    "points_in_boxes_all", "object_database", "ball_query", "knn", "bev_iou_rotated", "rotated_nms", "circle_nms",
    "map_iou", "masked_map_metrics", "rasterize_semantics", "observed_rays", "depth_map", "semantic_boundary",
    "latency_summary", "sequence_check", "degrade_region", "class_balanced_sample", "farthest_point_sample", "read_points",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cores, app="voxelmill-bench")
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        for attempt in ("warm", "timed"):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
