"""Event dates, name parts, repeats, uploads and feeds on small tables."""

import base64

import pytest
from pyspark.sql import functions as F

from geocairn.functions import pages
from geocairn.operators import merge, races
from geocairn.sources import tables


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    "html,want",
    [
        ('<script type="application/ld+json">{"startDate": "2026-05-02T09:00"}</script><time datetime="2025-01-01">', "2026-05-02"), ('<time class=a datetime="2026-06-01T10:00Z">', "2026-06-01"),
        ('<meta name="event-date" content="20260703">', "2026-07-03"), ("<p>1.8.2026</p><p>12 September 2026</p><p>September 12, 2026</p>", "2026-09-12"), ("<p>12 marathon 2026, 3rd of May 2027</p>", "2027-05-03"), ("<p>Call 1234-56-78</p><p>Sat 9. oct 2026</p>", "2026-10-09"),
        ("<p>2026-08-15T10:00 or 16.08.2026 or Aug 16, 2026</p>", "2026-08-16"), ("<p>10 km 2026, May 2026, 12 5 2026</p>", None), ("<p>no day</p>", None), (None, None),
    ],
)
def test_event_date(spark, html, want):
    assert one(spark, pages.event_date(F.lit(html).cast("string"), F.lit("2026-01-10").cast("date"))) == (want,)


def test_name_segment(spark):
    s = lambda v: F.lit(v).cast("string")
    got = one(spark, pages.name_segment(s("50K | Big Run"), s(""), s("Big Run 2026")), pages.name_segment(s("One / Two"), s("two two one"), s(None)), pages.name_segment(s("Plain"), s("x"), s(None)), pages.name_segment(s(None), s("x"), s(None)))
    assert got == ("50K", "Two", "Plain", None)


def test_repeats(spark):
    rows = spark.createDataFrame([("o", 1, "A", 10.0, False), ("o", 2, "a ", 10.5, False), ("o", 3, "A", 20.0, True), ("o", 4, "B", 10.0, False), ("o", 5, "A", None, False), ("o", 6, "A", None, True)], "organizer string, pos int, name string, km double, content_only boolean")
    assert sorted(r["pos"] for r in races.drop_near_repeats(rows).collect()) == [1, 3, 4, 5, 6]
    assert sorted(r["pos"] for r in races.page_per_distance(rows).collect()) == [1, 3, 5, 6]


def test_route_labels(spark):
    label = lambda a, b, *s: races.route_label(F.lit(a), F.lit(b), F.array(*map(F.lit, s)).cast("array<string>"))
    assert one(spark, label(1, 1), label(1, 4), label(1, 9), label(6, 1), label(2, 3), label(1, 1, "Ride", "RUN")) == ("Road bike", "Mountain bike", "Bike", "Gravel bike", "Run/hike", "Run/hike")


def test_fill_from(spark):
    schema = "id int, name string, line string"
    got = merge.fill_from(spark.createDataFrame([(1, "a", "l"), (2, "b", "m")], schema), spark.createDataFrame([(1, "c", None), (3, "d", None)], schema), ["id"], ["name", "line"])
    assert {tuple(r) for r in got.collect()} == {(1, "c", "l"), (2, "b", "m"), (3, "d", None)}


def test_uploads_and_feeds(spark):
    gpx = '<gpx xmlns="x"><trk><name> Up </name><trkseg><trkpt lat="1" lon="2"/><trkpt lat="3" lon="4"/></trkseg></trk></gpx>'
    packed = base64.encodebytes(gpx.encode()).decode()
    files = spark.createDataFrame([(1, gpx), (2, packed), (3, "not a track"), (4, "<gpx><trkpt lat='1' lon='2'/>"), (5, None), (6, "")], "id int, content string")
    got = {r["id"]: (r["name"], r["line"] and [tuple(p) for p in r["line"]]) for r in tables.tracks(tables.uploads(files), "gpx").collect()}
    assert got[1] == got[2] == ("Up", [(2.0, 1.0), (4.0, 3.0)])
    assert all(got[i][1] is None for i in (3, 4, 5, 6))
    dense = "<gpx>" + "".join(f"<rtept lat='{i / 1000}' lon='0'/>" for i in range(2001)) + "<rtept lat='x' lon='1'/></gpx>"
    kept = tables.tracks(spark.createDataFrame([(dense,), ("<!DOCTYPE a><gpx><rtept lat='1' lon='2'/><rtept lat='1' lon='2'/></gpx>",)], "value string")).collect()
    assert [tuple(p) for p in kept[0]["line"]] == [(0.0, 0.0), (0.0, 2.0)] and kept[1]["line"] is None
    feed = spark.createDataFrame([('{"races": [{"slug": "a", "km": 5}, {"slug": "b"}]}',), ("nonsense",), ("{}",)], "value string")
    assert [tuple(r) for r in tables.entries(feed, "races", "slug string, km double").collect()] == [("a", 5.0), ("b", None)]
