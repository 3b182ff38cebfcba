"""Stored tiles by key: what a fetch reads, ranges, preferences among rows of one id, pointers met by a place."""

import random
import re

from pyspark.sql import functions as F

from geocairn.functions import geo
from geocairn.operators import tile_store


def interleaved(x, y):
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(31))


def test_keys_make_parents_ranges(spark):
    r = random.Random(2)
    tiles = [(r.randrange(1 << 20), r.randrange(1 << 20)) for _ in range(200)] + [(0, 0), ((1 << 30) - 1, (1 << 30) - 1)]
    got = spark.createDataFrame(tiles, "x int, y int").select("x", "y", geo.tile_key(F.col("x"), F.col("y")).alias("key"), geo.parent_key(geo.tile_key(F.col("x"), F.col("y")), 3).alias("up")).collect()
    assert all(g["key"] == interleaved(g["x"], g["y"]) and g["up"] == interleaved(g["x"] >> 3, g["y"] >> 3) for g in got)


def test_ranges_hold_the_tiles_below_and_no_others(spark):
    tiles = [(2, 2), (3, 2), (2, 3), (3, 3), (9, 9), (0, 0)]
    ranges = [tuple(x) for x in tile_store.key_ranges(spark.createDataFrame(tiles + tiles[:2], "x int, y int"), 2).collect()]
    assert len(ranges) == 3  # the four of one parent are one range
    below = {interleaved(x, y) for x in range(64) for y in range(64) if (x >> 2, y >> 2) in tiles}
    assert {k for a, b in ranges for k in range(a, b + 1)} == below
    many = spark.createDataFrame([(7 * i, 5 * i) for i in range(200)], "x int, y int")
    rows = spark.range(200).select(geo.tile_key((F.col("id") * 7).cast("int"), (F.col("id") * 5).cast("int")).alias("k"))
    assert rows.where(tile_store.within_ranges(F.col("k"), tile_store.key_ranges(many))).count() == 200
    assert rows.where(tile_store.within_ranges(F.col("k"), tile_store.key_ranges(many.limit(0)))).count() == 0


def leaves(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = plan.collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def test_a_fetch_reads_few_row_groups_and_no_geometry(spark, tmp_path):
    n = 40_000
    side = 1 << 11
    rows = spark.range(n).select(((F.col("id") * 7919) % side).cast("int").alias("x"), ((F.col("id") * 104729) % side).cast("int").alias("y"), F.concat(F.lit("peak:"), "id").alias("id"))
    centre = geo.tile_centre(F.col("x"), F.col("y"), 11)
    rows = rows.select("id", F.lit(None).cast("string").alias("feature_id"), F.lit("peak").alias("kind"), F.lit(11).alias("zoom"), "x", "y", centre["lng"].alias("lng"), centre["lat"].alias("lat"), F.lit(None).cast("string").alias("stored_id"), F.lit(False).alias("is_empty"), F.array_repeat(centre, 5).alias("geometry"))
    tile_store.write_features(rows, f"{tmp_path}/store", 8, 64 << 10)
    store = spark.read.parquet(f"{tmp_path}/store")
    assert len(store.inputFiles()) == 8
    parents = spark.createDataFrame([(5, 6), (5, 7), (20, 3)], "x int, y int")
    keep = tile_store.within_ranges(F.col("tile_key"), tile_store.key_ranges(parents, 6))
    scan = leaves(store.where(keep).select("id"))[0]
    read, hit = scan.metrics().apply("numOutputRows").value(), rows.where("(x >> 6 = 5 and y >> 6 in (6, 7)) or (x >> 6 = 20 and y >> 6 = 3)").count()
    assert 0 < hit <= read < n / 4 and "tile_key" in str(scan.metadata().apply("PushedFilters"))
    fetched = tile_store.fetch_at_zoom(store, parents, "peak", 5, 11, columns=[])
    assert fetched.count() == hit and "geometry" not in fetched.columns
    schemas = re.findall("ReadSchema: struct<[^\n]*", fetched._jdf.queryExecution().executedPlan().toString())
    assert schemas and not any("geometry" in x for x in schemas)
    below = spark.createDataFrame([(0, 0), (8 * 7919 % (4 * side), 1)], "x int, y int")  # lower than stored: by the centroid's tile
    one = rows.where("id = 'peak:77'").first()
    deeper = spark.createDataFrame([one], rows.schema).select(geo.tile_x(F.col("lng"), 13).alias("x"), geo.tile_y(F.col("lat"), 13).alias("y")).union(below)
    assert "peak:77" in {r["id"] for r in tile_store.fetch_at_zoom(store, deeper, "peak", 13, 11).collect()}


SCHEMA = "id string, feature_id string, kind string, zoom int, x int, y int, lng double, lat double, stored_id string, is_empty boolean"


def test_stored_rows_come_before_pointers_of_their_id(spark):
    at = lambda id_, feature=None, stored=None, empty=False, zoom=11, lng=10.0, lat=59.0: (id_, feature, "peak", zoom, None, None, lng, lat, stored, empty)
    rows = [at("peak:1"), at("peak:a", "1", "peak:9"), at("peak:b", " ", "peak:8"), at("empty-1", empty=True), at("peak:8", lng=50.0), at("peak:9", zoom=8, lng=50.0), at("peak:c", "x"), at("peak:d", "x"), at("peak:e", None, "peak:none")]
    rows += [at("peak:z", zoom=8), at("peak:far", lng=11.5, zoom=8)]
    df = spark.createDataFrame(rows, SCHEMA)
    tile = lambda f, c: F.when(F.col("zoom") == 8, f(F.col(c), 8)).otherwise(f(F.col(c), 11))
    df = df.withColumns({"x": tile(geo.tile_x, "lng"), "y": tile(geo.tile_y, "lat")}).withColumn("tile_key", geo.tile_key(F.col("x"), F.col("y")))
    asked = df.where("id = 'peak:z'").select("x", "y")
    held = lambda **o: {r["logical_id"]: r["id"] for r in tile_store.fetch_at_zoom(df, asked, "peak", 8, 11, **o).collect()}
    assert held() == {"1": "peak:1", "8": "peak:8", "9": "peak:9", "x": "peak:c", "z": "peak:z"}
    assert held(follow_pointers=False) == {"1": "peak:1", "b": "peak:b", "e": "peak:e", "x": "peak:c", "z": "peak:z"}


def test_bulk_fetch_gives_rows_and_report(spark):
    ring = [[(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0), (0.0, 0.0)]]
    schema = "code string, polygon_id long, rings array<array<struct<lng:double,lat:double>>>"
    answers = spark.createDataFrame([("aa", 1, ring), ("AA", 7, None), ("bb", 2, None), ("cc", 3, ring)], schema)
    asked = spark.createDataFrame([("AA",), ("bb",), ("cc",), ("dd",), ("aa",)], "code string")
    rows, report = tile_store.bulk_fetch(spark, asked, asked.where("code = 'cc'"), answers, 8)
    assert report == {"skipped": 1, "fetched": 1, "failed": 1, "missing": 1, "pointers": rows.where("x is not null").count()}
    assert report["pointers"] > 4 and [r["polygon_id"] for r in rows.where("rings is not null").collect()] == [1]
    assert {r["border"] for r in rows.where("x is not null").select("border").distinct().collect()} >= {True}
