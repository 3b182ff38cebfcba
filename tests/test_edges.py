"""Dates of two-digit years and of ranges, the 180th meridian, ties among stored rows, hashes of rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from geocairn.functions import geo, text
from geocairn.operators import features, merge, spatial


@pytest.mark.parametrize("said,day", [("12.5.26", None), ("5/12/26", None), ("12.5.2026", "2026-05-12"), ("12-14 juni 2026", "2026-06-14"), ("12. – 14. juni 2026", "2026-06-14"), ("den 3 maj 2026", "2026-05-03")])
def test_dates(spark, said, day):
    assert spark.range(1).select(text.iso_date(F.lit(said), F.lit("2026-01-01").cast("date"))).first()[0] == day


def line(*points):
    return [{"lng": float(a), "lat": float(b)} for a, b in points]


def test_every_strategy_finds_points_across_the_meridian(spark):
    points = spark.createDataFrame([(1, 179.9999, 60.0), (2, -179.9999, 60.0), (3, 0.0, 60.0), (4, None, 60.0)], "point_id int, lng double, lat double")
    lines = "route_id int, line array<struct<lng:double,lat:double>>"
    rows = [(1, line((179.99995, 60), (179.9998, 60))), (2, line((-179.99995, 60), (-179.9997, 60))), (3, line((179.9999, 60), (-179.9999, 60)))]
    routes = spark.createDataFrame(rows, lines)
    found = [sorted(tuple(r) for r in spatial.points_near_routes_by(s, points, routes, 50.0).collect()) for s in ("tiles", "box", "all")]
    assert found[0] == found[1] == found[2] == [(r, p) for r in (1, 2, 3) for p in (1, 2)]


@pytest.mark.parametrize("zoom", [3, 6, 8])
def test_polygons_may_cross_the_meridian(spark, zoom):
    ring = [line((178, 10), (-177, 10), (-177, 14), (178, 14), (178, 10))]
    usual = [line((-10, 10), (10, 10), (10, 14), (-10, 14), (-10, 10))]
    polygons = spark.createDataFrame([(1, ring), (2, usual)], "polygon_id int, rings array<array<struct<lng:double,lat:double>>>")
    places = [(0, 179.0, 12.0), (1, -178.0, 12.0), (2, -176.0, 12.0), (3, 177.0, 12.0), (4, 0.0, 12.0), (5, 180.0, 12.0), (6, -180.0, 12.0), (7, 179.0, 15.0)]
    points = spark.createDataFrame(places, "point_id int, lng double, lat double")
    got = {tuple(r) for r in spatial.points_in_polygons(points, polygons, zoom).collect()}
    assert got == {(0, 1), (1, 1), (5, 1), (6, 1), (4, 2)}
    tiles = {(r["x"], r["y"]) for r in spatial.polygon_tiles(polygons.where("polygon_id = 1"), zoom).collect()}
    n = 1 << zoom
    assert tiles and all(x <= n * 3 // 360 or x >= n * 357 // 360 for x, _ in tiles)


def test_rows_of_one_id_on_one_tile_are_told_apart(spark):
    schema = "id int, kind string, x int, y int, stored_id int, is_empty boolean, name string, tags map<string,string>"
    rows = [(1, "peak", 1, 1, None, False, n, {"a": n}) for n in ("b", "a", "c")] + [(1, "peak", 0, 9, 4, False, "p", {}), (2, "peak", 1, 1, None, None, None, None)]
    tiles = spark.createDataFrame([(1, 1)], "x int, y int")
    for parts in (1, 3, 5):
        got = features.fetch_tiles(spark.createDataFrame(rows, schema).repartition(parts), tiles, "peak").orderBy("id").collect()
        assert [(r["id"], r["name"]) for r in got] == [(1, "a"), (2, None)]


def test_row_hashes_depend_on_values_alone(spark):
    schema = "id int, a string, b double, at timestamp"
    at = datetime.datetime(2024, 1, 1)
    old = spark.createDataFrame([(1, None, 1.0, at), (2, "x", None, at), (3, "x", 2.0, None), (4, "y", 1e-7, at)], schema)
    new = spark.createDataFrame([(1, "x", None, at), (2, "x", None, at), (3, "x", 2.0, at), (5, "", 0.0, at)], schema)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert {tuple(r) for r in merge.snapshot_diff(old, new, ["id"]).collect()} == {(1, "update"), (2, "unchanged"), (3, "update"), (4, "delete"), (5, "insert")}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_all_vertices_or_a_sample(spark):
    box = [line((10, 10), (11, 10), (11, 11), (10, 11), (10, 10))]
    boundaries = spark.createDataFrame([(1, box), (2, [line((11, 10), (12, 10), (12, 11), (11, 11), (11, 10))])], "polygon_id int, rings array<array<struct<lng:double,lat:double>>>")
    route = [(10.5, 10.5)] * 5 + [(11.5, 10.5)] + [(10.5, 10.5)] * 6
    routes = spark.createDataFrame([(1, line(*route))], "route_id int, line array<struct<lng:double,lat:double>>")
    held = lambda n: {r["polygon_id"] for r in features.route_regions(routes, boundaries, 8, n).collect()}
    assert held(None) == {1, 2} and held(120) == {1, 2} and held(3) == {1}
    assert spark.range(1).select(geo.contains_round(F.struct(F.lit(179.0).alias("min_lng"), F.lit(0.0).alias("min_lat"), F.lit(181.0).alias("max_lng"), F.lit(1.0).alias("max_lat")), F.lit(-179.5), F.lit(0.5))).first()[0]


def test_places_shared_across_the_meridian(spark):
    """Routes and points that share places on either side of the 180th meridian meet through their places."""
    points = spark.range(6).select(F.col("id").alias("point_id"), F.when(F.col("id") % 2 == 0, 179.9999).otherwise(-179.9999).alias("lng"), F.lit(10.0).alias("lat"))
    routes = spark.range(4).select(F.col("id").alias("route_id"), F.array(geo.point(F.lit(-179.9998), F.lit(10.0))).alias("line"))
    df = spatial.points_near_routes(points, routes, 40.0)
    assert sorted(map(tuple, df.collect())) == [(r, p) for r in range(4) for p in range(6)]
    assert any("ATAN2" in x and "__vlng" in x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines())
