"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINES = (
    "distance_semi_join", "points_in_polygons", "routes_in_polygons", "paths_by_thirds", "area_metrics", "line_measures", "visited_features", "user_status", "streaks", "active_days",
    "last_write_wins", "retracted_facts", "snapshot_diff", "consolidated_facts", "nearest_discovery", "page_text", "compact_dates",
)


def main() -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = root + os.pathsep + os.environ.get("PYTHONPATH", "")
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from geocairn.plans import QUERIES

    seconds = {}
    QUERIES["full_scan"](spark, sf_dir).count()
    for name in HEADLINES:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    out = {"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    out["vertices_per_sec_distance_semi_join"] = round(events / seconds["distance_semi_join"])
    # the ways to find candidates for the distance semi-join, over a tenth of the routes
    from geocairn.operators import spatial
    from geocairn.plans.registry import place, routes

    def table(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    lines = routes(table).where("route_id % 10 = 0").cache()
    points = table("supplier").selectExpr("s_suppkey as point_id").select("point_id", *place("point_id")).cache()
    lines.count(), points.count()
    out["strategies"] = {}
    for strategy in ("all", "box", "tiles"):
        start = time.perf_counter()
        spatial.points_near_routes_by(strategy, points, lines, 1500.0).write.format("noop").mode("overwrite").save()
        out["strategies"][strategy] = round(time.perf_counter() - start, 3)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
