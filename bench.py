"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "range_query", "join_auto", "join_broadcast", "join_pbsm", "join_sj1d", "join_dj", "join_repj", "closest_pairs", "nearest_places", "stay_points", "self_join", "join_within_distance", "summary", "gridded_summary", "uniform_histogram",
    "prefix_histogram", "euler_histogram", "box_counting", "partition_rsgrove", "tile_counts", "trajectory_features", "dissolve_groups", "overlay_intersection", "polygon_measures",
]


def main() -> None:
    from pyspark.sql import SparkSession

    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from cartospark.operators import generators, join
    from cartospark.queries import QUERIES

    def workload(name: str):
        """The published workload definitions: points against polygons, seed 1229, sizes up to 0.1, up to 10 segments."""
        n, m, method = {"exp_points_polygons": (100_000, 1_000, "auto"), "exp_points_polygons_pbsm": (100_000, 1_000, "pbsm"), "exp_partition": (10_000, 10_000, "pbsm")}[name]
        points = generators.generate(spark, "uniform", n, 1229)
        polygons = generators.generate(spark, "uniform", m, 1230, shape="polygon", max_size=(0.1, 0.1), segments=(3, 10))
        return join.spatial_join(points, polygons, "intersects", method)

    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        took[name] = round(min(times), 3)
    for name in ("exp_points_polygons", "exp_points_polygons_pbsm", "exp_partition"):
        start = time.time()
        workload(name).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
