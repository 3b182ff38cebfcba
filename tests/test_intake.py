"""Answers of event sources, names, work items, layers, events entered by hand, boundaries due, merged places and distances."""

import json
from datetime import date

from pyspark.sql import functions as F

from geocairn.operators import intake, races
from geocairn.streaming import feeds

TODAY = date(2026, 1, 1)
SOURCES = {
    "a": {"items": "$.races", "name": ["$.title", "$.name"], "date": "$.startDate", "country": "$.place.country", "race_type": "$.types[0]", "lat": "$.gps[0]", "lng": "$.gps[1]", "distance": "$.km", "urls": ["$.web", "$.page", "$.old"]},
    "b": {"items": "$.hits.list", "name": "$.n"},
}


def test_jobs_by_a_table_of_paths(spark):
    first = {"races": [
        {"title": " ", "name": "Fjell ", "startDate": "24th April 2026", "place": {"country": "Norge"}, "types": ["terrengløp"], "gps": ["59.5", 10], "km": 42.2, "web": "https://www.fjell.no/x", "page": "HTTPS://www.FJELL.no/x ", "old": "http://old.no"},
        {"title": "Odd", "startDate": "soon", "place": {"country": "Atlantis"}, "types": [], "gps": "none"}, {"title": None}, 7,
    ]}
    rows = [("a", json.dumps(first)), ("a", "{cut"), ("a", json.dumps({"races": {}})), ("a", None), ("b", json.dumps({"hits": {"list": [{"n": "B"}]}})), ("c", json.dumps(first))]
    got = {(r["source"], r["name"]): r for r in intake.jobs_from(spark.createDataFrame(rows, "source string, value string"), SOURCES, F.lit(TODAY)).collect()}
    assert set(got) == {("a", "Fjell"), ("a", "Odd"), ("b", "B")}
    r = got["a", "Fjell"]
    assert (r["pos"], r["date"], r["country"], r["race_type"], r["lat"], r["lng"], r["distance"]) == (0, "2026-04-24", "NO", "cross country", 59.5, 10.0, "42.2")
    assert r["urls"] == ["https://www.fjell.no/x", "http://old.no"] and r["key"] == "fjell.no"
    odd = got["a", "Odd"]
    assert (odd["date"], odd["country"], odd["race_type"], odd["lat"], odd["urls"], odd["key"]) == ("soon", "Atlantis", None, None, [], None)


def test_names_and_work_items(spark):
    features = spark.createDataFrame([(3, "Top"), (2, "top "), (5, "Hill"), (6, None)], "id int, name string")
    names = spark.createDataFrame([("TOP",), ("hill",), ("none",), (None,), ("TOP",)], "name string")
    assert {tuple(r) for r in intake.ids_of_names(names, features).collect()} == {("TOP", 2, 2), ("hill", 5, 1), ("none", None, 0), (None, None, 0)}
    ids = spark.createDataFrame([(1,), (2,), (1,), (None,)], "id int")
    first = intake.work_items(ids, "peaks", F.lit(7))
    again, later = intake.work_items(ids, "peaks", F.lit(7)), intake.work_items(ids, "peaks", F.lit(8))
    assert first.count() == 2 and intake.add_items(first, again).count() == 0 and intake.add_items(first, later).count() == 2


def test_layers_and_events_by_hand(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, None, False), (2, 4, None, None), (3, 4, "x", False), (4, 4, None, True), (5, 9, None, False), (6, None, None, False)], "id int, admin_level int, stored_id string, is_empty boolean")
    layers = intake.by_layer(rows, {2: "countries", 4: "regions"})
    assert {(r["id"], r["layer"]) for r in layers.collect()} == {(1, "countries"), (2, "regions")}
    intake.write_layers(layers.select("layer", F.col("id").cast("string").alias("value")), f"{tmp_path}/layers")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/layers/layer=regions").collect()] == ["2"]
    events = spark.createDataFrame([(" https://www.run.se/a ", " Run ", "3 maj 2026", "10 km"), ("nothing", "x", None, None), (None, None, None, None)], "url string, name string, date string, distance string")
    got = intake.manual_events(events, F.lit(TODAY)).collect()
    assert [(r["organizer"], r["source"], *r["discovery"]) for r in got] == [("run.se", "manual", "Run", "2026-05-03", "10 km", "https://www.run.se/a")]


def test_due_boundaries_of_a_feed_come_once(spark, tmp_path):
    schema = "feature_id string, kind string, stored_id string, centroid struct<lng:double,lat:double>, version string"
    ring = [[{"lng": a, "lat": b} for a, b in ((10.0, 59.0), (11.0, 59.0), (11.0, 60.0), (10.0, 60.0), (10.0, 59.0))]]
    boundaries = spark.createDataFrame([(7, ring)], "polygon_id int, rings array<array<struct<lng:double,lat:double>>>")
    at, out = {"lng": 10.5, "lat": 59.5}, f"{tmp_path}/out"
    batches = [
        [("p1", "peak", None, at, None), ("b1", "adminBoundary", None, at, "1"), ("b2", "adminBoundary", None, at, "2"), ("b3", "adminBoundary", "x", at, "1")],
        [("p2", "protectedArea", None, at, None), ("b1", "adminBoundary", None, at, "x"), ("f2", "adminBoundary", None, at, "2"), ("p3", "peak", None, None, None), ("q", "path", None, at, None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):  # the second run finds nothing new
            feeds.keep_due(feeds.read_changes(spark, f"{tmp_path}/in", schema, 1), boundaries, out, f"{tmp_path}/c", 2, F.col("feature_id").startswith("f")).awaitTermination()
    assert {tuple(r) for r in feeds.current_due(spark, out).collect()} == {("7", "within"), ("b1", "own"), ("f2", "own")}


def test_longest_places_and_places_of_clusters(spark):
    schema = "id int, organizer string, name string, urls array<string>, km array<double>, date string, location string, county string, p int"
    rows = [(1, "o", "Run", ["a"], [10.0], "2026-01-01", "Oslo", "A", 2), (2, "o", "run ", ["b"], [5.0], "2026-02-01", "Oslo, Nordmarka", "B", 1), (3, "o", "RUN", ["a"], [5.0], None, None, None, 3)]
    got = races.merge_discoveries(spark.createDataFrame(rows, schema), ["location", "county"], F.col("p"), ("location",)).collect()
    assert [(r["location"], r["county"], r["date"], r["km"]) for r in got] == [("Oslo, Nordmarka", "B", "2026-02-01", [5.0, 10.0])]
    clusters = spark.createDataFrame([("o", 10.0), ("o", 21.1), ("o", 50.0), ("p", 10.0)], "organizer string, canon double")
    entries = spark.createDataFrame([("o", 1, [10.0, 10.2]), ("o", 2, [10.3, 21.0]), ("o", 3, []), ("p", 4, [99.0])], "organizer string, entry int, km array<double>")
    assert {tuple(r) for r in races.places_per_cluster(clusters, entries).collect()} == {("o", 10.0, 2), ("o", 21.1, 1), ("o", 50.0, 1), ("p", 10.0, 1)}
    text_of = lambda *a: spark.range(1).select(races.unclaimed_labels(*a)).first()[0]
    arrays = [F.array(F.lit(42.2), F.lit(10.0)), F.array(F.lit(10.1)), F.array(F.lit("Backyard"), F.lit("kids "), F.lit("KIDS")), F.array(F.lit("backyard"))]
    assert text_of(*arrays) == ["42.2 km", "kids"]
