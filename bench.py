"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the list below).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from footfall.catalog import QUERIES  # noqa: E402
from footfall.session import release_scratch, session  # noqa: E402

HEADLINE = [
    "tread_traffic", "mesh_bounds", "axis_inference", "tread_segmentation", "triangle_wear_volume", "plane_candidates",
    "plane_inlier_count", "robust_plane", "bootstrap_planes", "depth_grid", "legacy_volume", "lateral_profile", "gmm_bic",
    "longitudinal_regions", "temporal_drift", "archard_traffic", "traffic_warnings", "simultaneity", "distribution_summary",
    "spearman_squared", "mc_volume", "mc_nosing", "mc_propagation", "wear_analysis",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["mesh_bounds"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the workers
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    release_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
