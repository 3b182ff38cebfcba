"""Expressions and kernels against golden values and plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geocairn.functions import geo, kernels, text
from geocairn.operators import merge, races, spatial
from geocairn.sources import tables


def as_of():
    return F.lit("2026-01-10").cast("date")


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def line(*points):
    return F.array(*[geo.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def test_distances_and_shifts(spark):
    d = lambda a, b: geo.haversine_m(*[F.lit(v) for v in (*a, *b)])
    got = one(spark, d((63.40324, 13.08618), (63.40324, 13.086179)), d((63.39677, 13.09363), (63.40841, 13.11212)), geo.max_gap_m(line((14, 13), (14.001, 13))), geo.max_gap_m(line((1, 1), (1, 1))), geo.max_gap_m(line((1, 1))))
    assert round(got[0], 4) == 0.1112 and 2350 < got[1] < 2450 and round(got[2], 2) == 108.35 and got[3:] == (0.0, 0.0)
    p = geo.shift(F.lit(63.39677), F.lit(13.09363), F.lit(50.0), F.lit(0.0))
    assert round(one(spark, geo.haversine_m(F.lit(63.39677), F.lit(13.09363), p["lng"], p["lat"]))[0], 1) == 50.0
    far = one(spark, geo.distance_to_line_m(geo.point(F.lit(2.0), F.lit(0.0)), line((0, 0), (1, 0), (2, 0))))
    assert far[0] > 100_000  # the last vertex is left out


@pytest.mark.parametrize("lng,lat,zoom,x,y", [(0.0, 0.0, 0, 0, 0), (26.48928, 46.36592, 5, 18, 11), (-60.2608, -18.1308, 7, 42, 70), (-60.05624, -8.33317, 4, 5, 8), (-72.62454, -6.16263, 13, 2443, 4236)])
def test_tiles(spark, lng, lat, zoom, x, y):
    assert one(spark, geo.tile_x(F.lit(lng), zoom), geo.tile_y(F.lit(lat), zoom)) == (x, y)


def test_tile_zooms(spark):
    up, down = one(spark, geo.tiles_at(F.lit(20), F.lit(40), 12, 11), geo.tiles_at(F.lit(10), F.lit(20), 10, 11))
    assert [tuple(t) for t in up] == [(10, 20)] and {tuple(t) for t in down} == {(20, 40), (20, 41), (21, 40), (21, 41)}


def test_decode(spark):
    coded = "o_}aKcq|nAAASZU`@Yt@OVu@nBSRIo@Me@"
    got = one(spark, kernels.decode_polyline(F.lit(coded)), kernels.decode_polyline(F.lit("")), kernels.decode_polyline(F.lit(None).cast("string")))
    points = [(round(p["lng"], 5), round(p["lat"], 5)) for p in got[0]]
    assert len(points) == 10 and points[0] == (13.09474, 63.39592) and points[-1] == (13.09382, 63.39684) and got[1] == [] and got[2] is None
    points_ = spark.createDataFrame([(1, 13.09259, 63.39672)], "point_id int, lng double, lat double")
    routes = spark.range(1).select(F.col("id").alias("route_id"), kernels.decode_polyline(F.lit(coded)).alias("line"))
    assert spatial.points_near_routes(points_, routes, 50).count() == 1 and spatial.points_near_routes(points_, routes, 20).count() == 0


def test_polygons(spark):
    square = line((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))
    inside = lambda x, y: geo.in_ring(F.lit(float(x)), F.lit(float(y)), square)
    assert one(spark, inside(1, 1), inside(3, 1), inside(-1, 1), geo.in_ring(F.lit(1.0), F.lit(1.0), F.array().cast("array<struct<lng:double,lat:double>>"))) == (True, False, False, False)
    c = geo.centroid(F.lit("Polygon"), F.array(square))
    m = geo.centroid(F.lit("LineString"), F.array(line((0, 0), (1, 1), (3, 3), (9, 9))))
    assert one(spark, c["lng"], m["lng"]) == (0.8, 2.0)
    assert len(one(spark, geo.decimate_ring(line(*[(i, i * i) for i in range(9)], (0, 0)), 4))[0]) == 4


def test_simplify_clip_and_rings(spark):
    flat = line((0, 0), (1, 0.001), (2, 0), (3, 5))
    box = F.struct(F.lit(0.5).alias("min_lng"), F.lit(-1.0).alias("min_lat"), F.lit(1.5).alias("max_lng"), F.lit(1.0).alias("max_lat"))
    kept, pieces, rings = one(spark, kernels.simplify_line(flat, F.lit(0.01)), kernels.clip_line(line((0, 0), (1, 0), (2, 0), (2, 3), (1, 0.5)), box), kernels.assemble_rings(F.array(line((0, 0), (1, 0), (1, 1)), line((0, 0), (0, 1), (1, 1)), line((5, 5), (6, 6)))))
    assert [p["lng"] for p in kept] == [0, 2, 3]
    assert [[p["lng"] for p in x] for x in pieces][0] == [0.5, 1.0, 1.5] and len(pieces) == 2
    assert len(rings) == 1 and len(rings[0]) == 5


def test_polygon_join_is_brute_force(spark):
    r = np.random.default_rng(0)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(0, 4, (300, 2)))]
    points = spark.createDataFrame(rows, "point_id long, lng double, lat double")
    shape = line((0.5, 0.5), (3.3, 0.9), (2.1, 1.7), (3.5, 3.6), (0.7, 2.9), (0.5, 0.5))
    polygons = spark.range(1).select(F.col("id").alias("polygon_id"), F.array(shape).alias("rings"))
    want = {v[0] for v in points.where(geo.in_ring(F.col("lng"), F.col("lat"), shape)).select("point_id").collect()}
    for zoom in (5, 9):
        assert {v["point_id"] for v in spatial.points_in_polygons(points, polygons, zoom).collect()} == want


def test_paths_by_thirds(spark):
    at = lambda *xs: F.array(*[geo.point(F.lit(x), F.lit(x)) for x in xs])
    paths = spark.range(1).select(F.col("id").alias("path_id"), at(0.0001, 0.0002, 0.0031, 0.0032, 0.0061, 0.0062).alias("line"))
    all_, ends = (spark.range(1).select(F.col("id").alias("route_id"), x.alias("line")) for x in (at(0.0001, 0.0031, 0.0061), at(0.0001, 0.0061)))
    assert spatial.paths_by_thirds(all_, paths).count() == 1 and spatial.paths_by_thirds(ends, paths).count() == 0


@pytest.mark.parametrize("value,km", [("33 km", 33), ("50 km, 33 km", 50), ("0,8 km, 5,3 km", 0.8), ("400m", 0.4), ("500 m", 0.5), ("1000 meters", 1.0), ("750 metres", 0.75), ("10M", 16.0934), ("Marathon", 42), ("x", None), ("", None), ("12", 12)])
def test_primary_distance(spark, value, km):
    assert one(spark, text.primary_km(F.lit(value)))[0] == (None if km is None else pytest.approx(km))


def test_distance_lists(spark):
    got = one(spark, text.distances_km(F.lit("Marathon, 10 km, 6 mi, 10M")), text.verbose_distances(F.lit("100k, 50k, 25k")), text.verbose_distances(F.lit("10K, Marathon, soon")), text.nearest_distance(F.lit(35.0), F.lit("34.2 km, 12.9 km, Marathon")))
    assert got[0] == pytest.approx([42, 10, 9.65604, 16.0934]) and got[1:] == ("100 km, 50 km, 25 km", "10 km, 42 km, soon", "34.2 km")
    assert one(spark, *[text.format_km(F.lit(v)) for v in (5.0, 10.1, 100.0, 42.195)]) == ("5 km", "10.1 km", "100 km", "42.2 km")
    assert one(spark, text.roughly_equal(F.lit(509.0), F.lit(511.0)), text.roughly_equal(F.lit(45.0), F.lit(50.0))) == (True, False)


@pytest.mark.parametrize(
    "value,day",
    [("20250914", "2025-09-14"), ("söndag 5 september 2026 kl. 10:00", "2026-09-05"), ("2026-02-03", "2026-02-03"), ("12th June 2026", "2026-06-12"), ("den 24. mai 2026", "2026-05-24"), ("September 11", "2026-09-11"), ("3 januari", "2027-01-03"), ("1.2.2026", "2026-02-01"), ("no date", None), ("", None)],
)
def test_dates(spark, value, day):
    assert one(spark, text.iso_date(F.lit(value), as_of()))[0] == day


def test_date_ranges_types_countries(spark):
    assert one(spark, text.range_start(F.lit("15.-20.04.2026"), as_of()), text.range_start(F.lit("18.04.-04.05.2026"), as_of())) == ("2026-04-15", "2026-04-18")
    assert one(spark, *[text.country_code(F.lit(c)) for c in ("se", "SWE", "france", "suède", "allemagne", "nowhere")]) == ("SE", "SE", "FR", "SE", "DE", None)
    assert one(spark, *[text.race_type(F.lit(c)) for c in ("Trail", "RandoTrail", "terräng; urban trail", "marathon")]) == ("trail", "trail", "trail, cross country, urban trail", None)
    assert one(spark, text.infer_race_type(F.lit("Swimrun Cup"), F.lit(None)), text.infer_race_type(F.lit("Duathlon run"))) == ("swimrun", None)


@pytest.mark.parametrize(
    "url,key",
    [
        ("https://www.facebook.com/profile.php?a=1&id=77&b=2", "facebook.com~profile.php?id=77"), ("https://facebook.com/my/club?x=1", "facebook.com~my~club"), ("https://instagram.com/club/", "instagram.com~club"),
        ("https://runsignup.com/Race/Events/MN/City/Run", "runsignup.com~Race~MN~City~Run"), ("https://runsignup.com/Race/a/b/c/d", "runsignup.com~Race~b~c~d"), ("https://ultrasignup.com/register.aspx?did=5", "ultrasignup.com~register.aspx?did=5"),
        ("https://raceroster.com/events/2026/1/name/more", "raceroster.com~events~2026~1~name"), ("https://sites.google.com/view/race/home", "sites.google.com~view~race"), ("https://sites.google.com/race/home", "sites.google.com~race"),
        ("https://docs.google.com/forms/d/abc/edit", "docs.google.com~forms~d~abc"), ("https://mittlopp.se/x/anm/12/y", "mittlopp.se~anm~12"), ("https://mittlopp.se/x/y", "mittlopp.se~x"), ("https://betrail.run/en/race/trail/2026", "betrail.run~race~trail"),
        ("https://itra.run/Races/RaceDetails/9/x", "itra.run~Races~RaceDetails~9"), ("https://nestelop.no/a/b", "nestelop.no~a~b"), ("https://klikego.com/en/inscription/r/1", "klikego.com~inscription~r"),
    ],
)
def test_organizers_on_shared_hosts(spark, url, key):
    assert one(spark, text.organizer_key(F.lit(url)))[0] == key


def test_names_ids_urls(spark):
    assert one(spark, text.sanitize_name(F.lit("10 Sätila Trail 85km"), F.lit(42.0)), text.sanitize_name(F.lit("50 km Trail"), F.lit(50.0)), text.sanitize_name(F.lit("Run 43.0"), F.lit(None).cast("double"))) == ("Sätila Trail", "50 km Trail", "Run")
    assert one(spark, text.organizer_key(F.lit("https://www.facebook.com/my/club/")), text.organizer_key(F.lit("https://WWW.Example.org/a")), text.organizer_key(F.lit("https://bit.ly/a/b"))) == ("facebook.com~my~club", "example.org", "bit.ly~a")
    assert one(spark, text.may_crawl(F.lit("https://x.itra.run/a")), text.may_crawl(F.lit("https://facebook.com/")), text.may_crawl(F.lit("https://a.org/"))) == (False, False, True)
    assert one(spark, text.comparable_stem(F.lit("www.my-race.co.uk")), text.feature_id(F.lit("adminBoundary:4:relation:7"), "adminBoundary"), text.prefixed_id(F.lit("7"), "peak")) == ("myrace", "relation:7", "peak:7")
    assert one(spark, kernels.unescape(text.strip_tags(kernels.unescape(F.lit("&lt;strong&gt;Ultra&lt;/strong&gt;")))), text.elevation(F.lit("1234,5 m")), text.lowest_price(F.lit("from 450 kr, later 1 200 kr"))) == ("Ultra", 1234.5, 450)
    assert one(spark, text.text_distances(F.lit("our 10 km, 10.2 km and 900 km or 5 miles")))[0] == pytest.approx([10, 8.0467])


@pytest.mark.parametrize("way,seen,sac,zoom", [("tertiary", None, None, 10), ("service", None, None, 12), ("residential", None, None, 13), ("busway", None, None, 14), ("path", "bad", None, 9), ("track", None, "demanding_alpine_hiking", 9), ("moat", None, None, None)])
def test_way_zoom(spark, way, seen, sac, zoom):
    assert one(spark, text.least_zoom(*[F.lit(v).cast("string") for v in (way, None, seen, sac)]))[0] == zoom


def test_distance_clusters(spark):
    kms = [0.8, 2, 3, 5, 6, 8, 9, 10, 10.5, 15, 15.2, 21, 21.2]
    got = races.canonical_distances(spark.createDataFrame([("a", float(k)) for k in kms], "organizer string, km double"), "organizer", "km")
    assert sorted({r["canon"] for r in got.collect()}) == [0.8, 2, 3, 5, 6, 8, 9, 10, 15, 21]


def test_event_groups_and_merges(spark):
    rows = [(1, "o", "Race", [10.0], ["u"], "2026"), (2, "o", "race ", [10.5, 30.0], ["v"], None), (3, "o", "race", [50.0], None, "2027"), (4, "o", None, [10.0], ["w"], None)]
    df = spark.createDataFrame(rows, "id long, organizer string, name string, km array<double>, urls array<string>, date string")
    assert {r["id"]: r["group"] for r in races.same_event_groups(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    merged = {r["id"]: r for r in races.merge_discoveries(df, ["name"], F.col("id")).collect()}
    assert merged[1]["km"] == [10.0, 10.5, 30.0, 50.0] and merged[1]["date"] == "2027" and merged[1]["urls"] == ["u", "v"] and set(merged) == {1, 4}


def test_retraction_and_last_write(spark):
    facts = spark.createDataFrame([(1, ["a1"]), (2, ["a1", "a2", "a3"]), (3, ["a1", "a2", "a2"]), (4, ["b"]), (5, None)], "id int, activity_ids array<string>")
    got = {r["id"]: (r["action"], r["activity_ids"]) for r in merge.retract(facts, F.array(F.lit("a1"))).collect()}
    assert got == {1: ("delete", []), 2: ("patch", ["a2", "a3"]), 3: ("patch", ["a2"])}
    schema = "key string, updated_at long, deleted boolean, value string"
    out = merge.last_write_wins(spark.createDataFrame([("a", 5, False, "old"), ("b", 9, False, "kept")], schema), spark.createDataFrame([("a", 5, False, "new"), ("b", 1, False, "late"), ("c", 2, True, "gone")], schema), ["key"])
    assert {r["key"]: (r["value"], r["deleted"]) for r in out.collect()} == {"a": ("new", False), "b": ("kept", False), "c": (None, True)}
    chain = spark.createDataFrame([("A", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "source string, target string")
    assert {r["key"]: r["target"] for r in merge.resolve_redirects(spark.createDataFrame([("a",), ("x",), ("z",)], "key string"), chain).collect()} == {"a": "c", "x": "y", "z": "z"}


def test_gpx_and_map_answers(spark):
    gpx = '<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><name>Up</name><trkseg><trkpt lat="1.5" lon="2"/><trkpt lat="1.6" lon="2.5"/></trkseg></trk></gpx>'
    rows = tables.tracks(spark.createDataFrame([(gpx,), ("<gpx><wpt lat='1' lon='2'/></gpx>",)], "value string")).collect()
    assert rows[0]["name"] == "Up" and [(p["lng"], p["lat"]) for p in rows[0]["line"]] == [(2.0, 1.5), (2.5, 1.6)] and rows[1]["line"] is None
    answer = '{"elements":[{"type":"node","id":1,"lat":1.0,"lon":2.0,"tags":{"natural":"peak"}},{"type":"way","id":2,"geometry":[{"lat":1.0,"lon":2.0}]}]}'
    e = tables.overpass_elements(spark.createDataFrame([(answer,)], "value string")).collect()
    assert e[0]["tags"] == {"natural": "peak"} and len(e[1]["line"]) == 1


def test_feeds_replace_reprocessed_activities(spark, tmp_path):
    from geocairn.streaming import feeds

    schema = "user_id long, activity_id long, feature_id long"
    for i, rows in enumerate([[(1, 10, 5), (1, 11, 5)], [(1, 10, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = feeds.read_changes(spark, str(tmp_path / "in"), schema)
        feeds.keep_facts(stream, lambda b: b.where("feature_id is not null"), str(tmp_path / "facts"), str(tmp_path / "c")).awaitTermination()
    got = feeds.fact_sets(feeds.current_facts(spark, str(tmp_path / "facts"))).collect()
    assert [(r["feature_id"], r["activity_ids"]) for r in got] == [(5, [11])]


def test_circles_cross_the_180th_meridian(spark):
    at = lambda x, y: geo.point(F.lit(x), F.lit(y))
    tiles = one(spark, geo.tiles_in_radius(F.lit(179.9999), F.lit(10.0), 500.0, 8), geo.tiles_in_radius(F.lit(-179.9999), F.lit(10.0), 500.0, 8), geo.tiles_in_radius(F.lit(0.0), F.lit(10.0), 5e7, 2))
    assert {t["x"] for t in tiles[0]} == {t["x"] for t in tiles[1]} == {0, 255} and {t["x"] for t in tiles[2]} == {0, 1, 2, 3}
    points = spark.createDataFrame([(1, 179.99, 0.0), (2, -179.99, 0.0), (3, 170.0, 0.0), (4, 180.0, 0.0)], "point_id long, lng double, lat double")
    for lng in (179.99, -179.99, 180.0):
        assert {r["point_id"] for r in spatial.points_within(points, lng, 0.0, 2500.0).collect()} == {1, 2, 4}
    routes = spark.range(1).select(F.lit(7).alias("route_id"), F.array(at(179.9999, 0.0)).alias("line"))
    assert {r["point_id"] for r in spatial.points_near_routes(points, routes, 2500.0).collect()} == {1, 2, 4}
    assert {r["point_id"] for r in spatial.points_within(spark.createDataFrame([(1, 20.0, 89.99), (2, -160.0, 89.99), (3, 0.0, 80.0)], "point_id long, lng double, lat double"), 0.0, 90.0, 5000.0).collect()} == {1, 2}


def test_strategies_find_the_same_pairs(spark):
    r = np.random.default_rng(2)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(0, 0.2, (60, 2)))] + [(99, None, 0.0)], "point_id long, lng double, lat double")
    routes = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in r.uniform(0.05 * k, 0.05 * k + 0.05, (20, 2))]) for k in range(4)] + [(9, None)], "route_id long, line array<struct<lng:double,lat:double>>")
    found = {s: {tuple(x) for x in spatial.points_near_routes_by(s, points, routes, 900.0).collect()} for s in ("tiles", "box", "all")}
    assert found["tiles"] == found["box"] == found["all"] and len(found["all"]) > 5


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://http//www.example.com/", "http://www.example.com/"), ("https://http://a.se/x//y", "http://a.se/x//y"), ("https://ultrasignuphttp//www.example.com/", "http://www.example.com/"), ("HTTP://https//a.se", "https://a.se"),
        ("https://a.se/http//b", "https://a.se/http//b"), ("https://a.se", "https://a.se"), ("x", "x"), (None, None),
    ],
)
def test_repaired_url(spark, url, want):
    assert one(spark, text.repaired_url(F.lit(url).cast("string"))) == (want,)


def test_slugs_and_event_keys(spark):
    s = lambda v: F.lit(v).cast("string")
    urls = ["https://julianalps.utmb.world/races/120K", "https://www.vmxtreme.se/", "https://tracedetrail.fr/trace/getTraceItra/12345", "nothing"]
    assert one(spark, *[text.address_slug(s(u)) for u in urls]) == ("julianalps.utmb.world-races-120K", "vmxtreme.se", "tracedetrail.fr-trace-getTraceItra-12345", None)
    assert one(spark, text.address_slug(s(urls[1]), F.lit(3)), text.name_slug(s("Åre Ultra!"), s(" 50 km")), text.name_slug(s(" - "), s(None))) == ("vmxtreme.se-3", "åre-ultra-50-km", None)
    key = lambda *u, name=None, km=None: text.event_key([s(x) for x in u], s(name), s(km))
    got = one(spark, key(None, " ", "https://http//www.a.se/x", name="n"), key("https://www.test.com/a", "https://b.se"), key(None, name="Big Run", km="10 km"), key(None, km=" "), key("https://c.se", "https://d.se"))
    assert [tuple(g) if g else None for g in got] == [("a.se", "http://www.a.se/x"), None, ("big-run-10-km", "name://big-run-10-km"), None, ("c.se", "https://c.se")]


def test_points_near_routes_at_shared_places(spark):
    """Distances are found between places; ids that stand twice, on either side, still give a pair once."""
    points = spark.createDataFrame([(1, 10.0, 60.0), (1, 10.001, 60.0), (2, 10.0, 60.0), (3, 10.0, 60.5), (None, 10.0, 60.0), (4, None, 60.0)], "point_id int, lng double, lat double")
    rows = [(1, [(10.0, 60.0), (10.001, 60.0), (10.0, 60.0)], 0), (1, [(10.0, 60.0)], 1), (2, [(10.0, 60.0)], 0), (3, [], 0), (4, None, 0)]
    routes = spark.createDataFrame(rows, "route_id int, line array<struct<lng:double,lat:double>>, kind int")
    df = spatial.points_near_routes(points, routes, 200.0)
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=str) == sorted([(r, p) for r in (1, 2) for p in (1, 2, None)], key=str)
    assert sorted(map(tuple, spatial.points_near_routes(points, routes, 200.0, where=F.col("kind") + F.col("point_id") < 2).collect())) == [(1, 1), (2, 1)]
    # the distance is a condition between places, not between a route's vertex and a point
    tests = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "ATAN2" in x and "Join" in x]
    assert tests and all("__vlat" in x and "__plat" in x for x in tests)
