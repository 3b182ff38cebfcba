"""Pointers, GeoJSON rows, upserts, partition replacement and places per cluster on small tables."""

import json

from pyspark.sql import functions as F

from geocairn.functions import geo
from geocairn.operators import features, merge, races
from geocairn.sources import tables


def test_pointers_and_geojson(spark):
    rows = spark.createDataFrame([("a", None), ("p", "a"), ("q", "gone")], "id string, stored_id string")
    assert [r["id"] for r in tables.resolve_pointers(rows).collect()] == ["a"]
    p = lambda *v: F.array(*[geo.point(F.lit(float(x)), F.lit(float(y))) for x, y in v])
    shapes = spark.range(1).select(F.lit("w1").alias("id"), F.lit("LineString").alias("kind"), F.array(p((1, 2), (3, 4))).alias("rings"), F.lit("Up").alias("name"))
    feature = json.loads(tables.geojson_features(shapes, "id", "kind", "rings", ["name"]).first()["value"])
    assert feature == {"type": "Feature", "id": "w1", "properties": {"name": "Up"}, "geometry": {"type": "LineString", "coordinates": [[1.0, 2.0], [3.0, 4.0]]}}


def test_upserts_and_partition_replacement(spark, tmp_path):
    schema = "user_id long, feature_id long, name string, activity_ids array<long>"
    old = spark.createDataFrame([(1, 1, "old", [3])], schema)
    new = spark.createDataFrame([(1, 1, "new", [2, 3]), (1, 2, "more", [4])], schema)
    got = {r["feature_id"]: (r["name"], r["activity_ids"]) for r in merge.upsert_facts(old, new, ["user_id", "feature_id"]).collect()}
    assert got == {1: ("old", [2, 3]), 2: ("more", [4])}
    folder = str(tmp_path / "t")
    tables.replace_slice(spark.createDataFrame([(1, "a"), (2, "b")], "v long, k string"), folder, "k")
    tables.replace_slice(spark.createDataFrame([(9, "b")], "v long, k string"), folder, "k")
    assert sorted((r["v"], r["k"]) for r in spark.read.parquet(folder).collect()) == [(1, "a"), (9, "b")]


def test_places_per_cluster(spark):
    routes = spark.createDataFrame([(1, "o", 10.0, "2025", True), (2, "o", 10.0, "2026", False), (3, "o", None, None, False), (4, "o", 20.0, "2020", True)], "route_id long, organizer string, canon double, date string, has_geometry boolean")
    places = spark.createDataFrame([("o", 10.0, 1)], "organizer string, canon double, places int")
    assert sorted(r["route_id"] for r in races.top_per_cluster(routes, places).collect()) == [2, 3, 4]


def test_entries_that_say_a_distance_anew(spark):
    entries = [("o", 1, [10.0, 21.1]), ("o", 2, [10.3]), ("o", 3, [21.1]), ("o", 4, [50.0]), ("o", 5, [10.3, 50.5]), ("p", 6, [10.3]), ("o", 7, []), ("o", 8, None), ("o", 9, [10.0, 10.0])]
    entries = spark.createDataFrame(entries, "organizer string, entry long, km array<double>")
    # 4 says 5's 50.5 anew; 2 is first met by 1, which lists 10 only, though 5 lists the same
    assert sorted(r["entry"] for r in races.remeasured(entries).collect()) == [2, 4]
    clusters = spark.createDataFrame([("o", 10.0), ("o", 21.1), ("o", 50.0), ("p", 10.0), ("p", None)], "organizer string, canon double")
    assert {tuple(r) for r in races.places_per_cluster(clusters, entries).collect()} == {("o", 10.0, 3), ("o", 21.1, 2), ("o", 50.0, 1), ("p", 10.0, 1), ("p", None, 1)}


def test_country_names(spark):
    rows = spark.createDataFrame([(1, "se"), (2, "XX"), (3, None)], "id long, code string")
    names = spark.createDataFrame([("SE", "Sweden"), ("SE", "Svea"), (None, "Nowhere"), ("NO", None)], "country_code string, name string")
    assert {tuple(r) for r in features.with_country_names(rows, "code", names).select("id", "country").collect()} == {(1, "Svea"), (2, "XX"), (3, None)}
