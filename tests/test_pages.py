"""Pages, jobs, merging of features and vector tiles against golden values."""

import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geocairn.functions import geo, pages
from geocairn.operators import jobs, races, tiles, vector_tiles

BASE = "https://www.example.org/races/2026/index.html?x=1#top"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    "link,want",
    [
        ("a.gpx", "https://www.example.org/races/2026/a.gpx"), ("../b?q=1", "https://www.example.org/races/b?q=1"), ("/c/./d/", "https://www.example.org/c/d/"),
        ("//cdn.example.net/e", "https://cdn.example.net/e"), ("?y=2", "https://www.example.org/races/2026/index.html?y=2"), ("mailto:a@b.c", None), ("javascript:void(0)", None),
        ("http://x.org/../../f", "http://x.org/f"), ("http://x.org", "http://x.org/"), (None, None),
    ],
)
def test_addresses(spark, link, want):
    assert one(spark, pages.absolute(F.lit(BASE), F.lit(link).cast("string"))) == (want,)


def test_links(spark):
    html = """<a href="#top">map</a><a href='map/long'>The <b>long</b> one</a><a href="/results?map">Results</a><a class=x href="/p/27k">short</a><a href="/doc/1">Track as GPX</a>
        <a href="/doc/2">25,5 km</a><a href="/doc/3">Hämta fil</a><script>var u = "https:\\/\\/cdn.example.net\\/t.gpx";</script><a href="https://drive.google.com/drive/folders/z">here</a>
        <iframe src="//maps.example.org/1"></iframe><script src="/s.js"></script>"""
    h, b = F.lit(html), F.lit(BASE)
    root = "https://www.example.org"
    got = one(spark, pages.course_links(h, b), pages.gpx_links(h, b), pages.distance_links(h, b), pages.download_links(h, b), pages.source_links(h, b, "iframe"), pages.source_links(h, b, "script"))
    assert got[0] == [f"{root}/races/2026/map/long", f"{root}/p/27k", f"{root}/doc/1", f"{root}/doc/2"]
    assert got[1] == ["https://cdn.example.net/t.gpx", f"{root}/doc/1", "https://drive.google.com/drive/folders/z"]
    assert got[2:] == ([f"{root}/doc/2"], [f"{root}/doc/3"], ["https://maps.example.org/1"], [f"{root}/s.js"])


@pytest.mark.parametrize(
    "html,want",
    [
        ('<script type="application/ld+json">{"name": " Fell Race "}</script><title>x</title>', "Fell Race"), ('<meta property="og:title" content="Big Run"><title>x</title>', "Big Run"),
        ('<meta content="Big Run" name="og:title">', "Big Run"), ("<title>Loop 50 | Site</title><h1>y</h1>", "Loop 50"), ("<h1>The <i>Hill</i>\n Race</h1>", "The Hill Race"), ("", None), (None, None),
    ],
)
def test_page_name(spark, html, want):
    assert one(spark, pages.page_name(F.lit(html).cast("string"))) == (want,)


@pytest.mark.parametrize(
    "html,url,want",
    [
        ("<p>Startavgift: 450 kr</p>", "https://a.se/x", ("450", "SEK")), ("<p>Price 450kr</p>", "https://a.no/", ("450", "NOK")), ("<p>60€ - 90€</p>", "https://a.fr", ("60-90", "EUR")),
        ("<p>Fee: $120</p>", "https://a.com", ("120", "USD")), ("<p>T-shirt 900 SEK" + " x" * 200 + " entry fee 1 200 SEK</p>", "https://a.se", ("1200", "SEK")),
        ('<script>{"price": "35", "priceCurrency": "eur"}</script>', "https://a.fr", ("35", "EUR")), ("<p>5 kr, 12 people</p>", "https://a.se", None), ("<head>300 kr</head>", "https://a.se", None), (None, None, None),
    ],
)
def test_price(spark, html, url, want):
    got = one(spark, pages.price(F.lit(html).cast("string"), F.lit(url).cast("string")))[0]
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "html,want", [("<p>Distance 42 km</p>\n<p>Elevation gain: 1 200 m</p>\n<p>In 1999</p>", 1200.0), ("<p>D+ 900m</p>", 900.0), ("<p>10 km</p>\n<p>ascent 300 or 9000</p>", 300.0), ("<p>ascent 1,200 or 10k or 450 m</p>", 450.0), ("<p>stigning 12 34 m</p>", 34.0), ("<p>flat</p>", None), (None, None)]
)
def test_elevation_gain(spark, html, want):
    assert one(spark, pages.elevation_gain(F.lit(html).cast("string"))) == (want,)


@pytest.mark.parametrize(
    "url,want",
    [("https://a.se/80-km", "80 km"), ("https://a.se/r/100k/", "100 km"), ("https://a.se/10-miles", "16.1 km"), ("https://a.se/half-marathon/", "21 km"), ("https://a.se/backyard-ultra", "backyard"), ("https://a.se/about", None), (None, None)],
)
def test_address_distance(spark, url, want):
    assert one(spark, pages.address_distance(F.lit(url).cast("string"))) == (want,)


def test_track_source(spark):
    urls = ["https://www.dropbox.com/s/a", "https://connect.garmin.com/x", "https://drive.google.com/a", "https://files.a.se/t.gpx", "https://b.se/t.gpx", None]
    got = one(spark, *[pages.track_source(F.lit(u).cast("string"), F.lit("https://www.a.se/")) for u in urls])
    assert got == ("dropbox", "garmin_connect", "google_drive", "internal_gpx", "external_gpx", None)


def test_event_routing(spark):
    e = lambda **v: (json.dumps(v),)
    rows = [e(object_type="activity", aspect_type="create", object_id=1, owner_id=2), e(object_type="activity", aspect_type="delete", object_id="3", owner_id="4"), e(object_type="athlete", aspect_type="update", owner_id=5, updates={"authorized": "false"}), e(object_type="athlete", aspect_type="update", owner_id=5), ("nonsense",), (None,), e(object_type="activity", aspect_type="create", owner_id=2)]
    got = jobs.route_events(spark.createDataFrame(rows, "body string")).select("action", "activity_id", "user_id").collect()
    assert [tuple(r) for r in got] == [("fetch", "1", "2"), ("delete", "3", "4"), ("close", None, "5"), *[(None, None, None)] * 4]


def test_retries_and_grants(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    now = ts("2026-03-10 10:07:30")
    text = lambda c: c.cast("string")
    got = one(spark, text(jobs.retry_at(now, F.lit(False), ts("2020-01-01"), F.lit("a"))), text(jobs.retry_at(now, F.lit(True), ts("2026-01-01"), F.lit("a"))), text(jobs.retry_at(now, F.lit(True), ts("2020-01-01"), F.lit("a"))), jobs.scopes(F.lit("read,activity:read READ")), jobs.scopes(F.lit(None).cast("string")))
    assert got[:2] == ("2026-03-10 10:15:00", "2026-03-11 00:00:00") and got[2].startswith("2026-03-11 23:") and got[3:] == (["activity:read", "read"], [])
    state = spark.range(1).select(*jobs.token_state(F.lit("r"), F.lit(" "), F.lit(10), F.lit("read"), now)).first()
    assert (state["has_refresh_token"], state["has_access_token"], state["expired"], state["has_read"], state["has_activity_write"]) == (True, False, True, True, False)


def test_write_plan_counts_and_search(spark):
    rows = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [2.0]), (3, "c", [3.0])], "id long, name string, route array<double>")
    stored = jobs.write_plan(spark.createDataFrame([], "id long, properties_hash string, content_hash string"), rows, ["id"], ["name"], ["route"])
    assert {r["decision"] for r in stored.collect()} == {"write"}
    changed = spark.createDataFrame([(1, "a", [1.0]), (2, "B", [2.0]), (3, "c", [4.0])], rows.schema)
    assert {r["id"]: r["decision"] for r in jobs.write_plan(stored, changed, ["id"], ["name"], ["route"]).collect()} == {1: "skip", 2: "patch", 3: "write"}
    maps = spark.createDataFrame([("One", {"s": ["x", "y"], "t": []}, []), ("two", {"s": ["z"]}, ["u"]), (None, None, None)], "name string, found map<string,array<string>>, urls array<string>")
    assert {tuple(r) for r in jobs.source_counts(maps, "found").collect()} == {("s", 2, 3), ("t", 1, 0)}
    assert [r["name"] for r in jobs.search(maps, " ON", ["name"], {"urls": False}, "found", "S").collect()] == ["One"]
    assert jobs.search(maps, None, ["name"], {"urls": True}).count() == 1 and jobs.search(maps, None, ["name"], {"urls": None}).count() == 3


def test_distances_to_routes(spark):
    routes = spark.createDataFrame([("o", 1, 10.2), ("o", 2, 41.0), ("p", 3, None)], "organizer string, route_id long, km double")
    verbose = spark.createDataFrame([("o", "100 km, 10 km, 42 km"), ("p", "5 km")], "organizer string, distances string")
    assert {r["route_id"]: r["distances"] for r in races.assign_distances(routes, verbose).collect()} == {1: ["10 km"], 2: ["42 km", "100 km"], 3: []}
    d = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, races.unclaimed_distances(d(50.0, 10.0, 10.5, 21.0), d(20.5)), races.unclaimed_distances(d(5.0), F.lit(None).cast("array<double>"))) == ([10.0, 50.0], [5.0])


def test_points_into_lines(spark):
    schema = "organizer string, id long, is_line boolean, km array<double>, urls array<string>, name string"
    rows = [("o", 1, True, [10.0], ["a"], "line"), ("o", 2, True, [10.4], None, "other"), ("o", 3, False, [10.1], ["b", "a"], "point"), ("o", 4, False, [50.0], None, "alone"), ("q", 5, False, [10.0], None, "far"), ("o", 6, False, None, None, "none")]
    got = {r["id"]: (r["name"], r["urls"]) for r in races.absorb_points(spark.createDataFrame(rows, schema), ["name"]).collect()}
    assert got == {1: ("point", ["a", "b"]), 2: ("other", []), 4: ("alone", []), 5: ("far", []), 6: ("none", [])}


def read(data: bytes):
    """The fields of a message, as (number, value) pairs."""
    out, at = [], 0

    def number():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            out.append((tag >> 3, number()))
        else:
            size = number() if tag & 7 == 2 else 8
            out.append((tag >> 3, data[at : at + size]))
            at += size
    return out


def test_vector_tiles(spark):
    p = lambda x, y: geo.point(F.lit(float(x)), F.lit(float(y)))
    ways = spark.range(2).select((F.col("id") + 7).alias("id"), F.array(p(10, 59), p(10.001, 59.001), p(10.002, 59)).alias("line"), F.lit("path").alias("highway"), F.when(F.col("id") == 0, F.lit(3)).alias("grade"))
    got = vector_tiles.encode_tiles(tiles.clip_to_tiles(ways, 8), "ways", 8, ["highway", "grade"]).collect()
    assert len(got) == 1 and got[0]["n_features"] == 2
    (outer,) = read(bytes(got[0]["tile"]))
    body = read(outer[1])
    assert outer[0] == 3 and (15, 2) in body and (1, b"ways") in body and (5, 4096) in body and [v for n, v in body if n == 3] == [b"highway", b"grade"]
    first, second = (dict(read(v)) for n, v in body if n == 2)
    assert (first[1], second[1], first[3]) == (7, 8, 2) and first[2] == bytes([0, 0, 1, 1]) and second[2] == bytes([0, 0])
    commands = list(first[4])
    assert commands[0] == 9 and first[4] == second[4]


def test_tiles_equal_those_of_one_call(spark):
    """Bytes made feature by feature against layer(), which writes a whole tile."""
    r = random.Random(6)
    rows = []
    for i in range(60):
        lng, lat = 10 + r.random(), 59 + r.random()
        line = [{"lng": lng + k * 0.01, "lat": lat + r.random() / 50} for k in range(r.choice([1, 2, 5]))]
        rows.append((i % 50, line, r.choice(["path", "road", "å", None]), r.choice([1, 2, None]), r.choice([0.5, None, float("nan")]), r.choice([True, False])))
    schema = "id long, line array<struct<lng:double,lat:double>>, highway string, grade int, slope double, lit boolean"
    df = spark.createDataFrame(rows + rows[:3], schema)
    pieces = tiles.clip_to_tiles(df.where("size(line) > 1"), 9).unionByName(df.where("size(line) = 1").withColumns({"x": geo.tile_x(F.col("line")[0]["lng"], 9), "y": geo.tile_y(F.col("line")[0]["lat"], 9), "fragment": F.lit(0)}))
    names = ["highway", "grade", "slope", "lit"]
    got = {(g["x"], g["y"]): (g["n_features"], bytes(g["tile"])) for g in vector_tiles.encode_tiles(pieces, "ways", 9, names).collect()}
    zipped = {(g["x"], g["y"]): gzip.decompress(bytes(g["tile"])) for g in vector_tiles.encode_tiles(pieces, "ways", 9, names, zipped=True).collect()}
    assert zipped == {k: v for k, (_, v) in got.items()}
    unit = F.transform("line", lambda p: geo.tile_units(p["lng"], p["lat"], F.col("x"), F.col("y"), 9))
    held = {}
    for p in pieces.withColumn("u", unit).collect():
        u = [(q["px"], q["py"]) for q in p["u"] if q is not None]
        if len(u) >= 2 or len(p["line"]) == len(u) == 1:
            held.setdefault((p["x"], p["y"]), []).append((p["id"], p["fragment"], u, [p[n] for n in names]))
    assert set(got) == set(held) and len(held) > 2
    for k, f in held.items():
        assert got[k][0] == len(f)
        if len({x[:2] for x in f}) < len(f):
            continue  # rows of one id and fragment stand in an order of their own
        f.sort(key=lambda x: x[:2])
        want = vector_tiles.layer("ways", [x[0] for x in f], [np.array(x[2]) for x in f], {n: [x[3][i] for x in f] for i, n in enumerate(names)})
        assert got[k][1] == want
