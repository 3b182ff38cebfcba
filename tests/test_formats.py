"""Data sources of track files and map-query answers: the same rows as the table functions give, and bad files that fail nothing."""

import json

import pytest
from pyspark.sql import functions as F

from geocairn.sources import formats, tables


def gpx(name, points):
    return f"<gpx xmlns='http://www.topografix.com/GPX/1/1'><trk><name>{name}</name><trkseg>" + "".join(f"<trkpt lat='{b}' lon='{a}'/>" for a, b in points) + "</trkseg></trk></gpx>"


@pytest.fixture
def folder(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "in" / "sub").mkdir(parents=True)
    put = lambda name, text: (tmp_path / "in" / name).write_text(text)
    put("a.gpx", gpx("A", [(10 + k / 100, 59) for k in range(30)]))
    put("sub/b.gpx", gpx("B", [(10, 59)]))
    put("c.gpx", gpx("C", [(10 + k / 1e5, 59 + (k % 7) / 1e6) for k in range(2500)] + [(500, 1)]))
    put("bad.gpx", "<gpx><trk>")
    (tmp_path / "in" / "worse.gpx").write_bytes(b"\xff\xfe\x00\xff")
    put("other.txt", "x")
    answer = {"elements": [{"type": "node", "id": 1, "lat": 59.5, "lon": 10, "tags": {"name": "Top", "ele": "100"}}, {"type": "way", "id": 2, "geometry": [{"lat": 1, "lon": 2}, None, {"lat": 3, "lon": 4}]},
        {"type": "relation", "id": 3, "members": [{"type": "way", "ref": 9, "role": "outer", "geometry": [{"lat": 1, "lon": 2}, {"lat": 3, "lon": 4}]}, {"type": "way", "ref": 8, "role": "inner", "geometry": []}]}]}
    put("m.json", json.dumps(answer))
    put("n.json", "{}")
    return f"{tmp_path}/in"


def test_tracks_are_those_of_the_table_function(spark, folder):
    got = {r["path"].rsplit("/", 1)[1]: r for r in spark.read.format("gpx_tracks").load(folder).collect()}
    assert set(got) == {"a.gpx", "b.gpx", "c.gpx", "bad.gpx", "worse.gpx"}
    assert all(got[x]["error"] and got[x]["line"] is None for x in ("bad.gpx", "worse.gpx")) and all(got[x]["error"] is None for x in ("a.gpx", "b.gpx", "c.gpx"))
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "[abc].gpx").text(folder)
    want = {r["name"]: r["line"] for r in tables.tracks(files).collect()}
    assert {r["name"]: r["line"] for r in got.values() if r["error"] is None} == want and want["B"] is None and 2 <= len(want["C"]) < 2000


def test_partitions_by_size_and_filters_by_path(spark, folder):
    read = spark.read.format("gpx_tracks").option("partitionBytes", 3000).load(folder)
    assert read.rdd.getNumPartitions() > 1 and read.count() == 5
    one = read.where(F.col("path") == f"{folder}/a.gpx")
    assert [r["name"] for r in one.collect()] == ["A"] and one.rdd.getNumPartitions() == 1
    assert read.where(F.col("path").startswith(f"{folder}/sub/") & (F.col("name") == "B")).count() == 1
    assert [len(p.paths) for p in formats.dealt([(0, "a", 5), (0, "b", 5), (0, "c", 50), (0, "d", 0)], 10)] == [2, 1, 1] and formats.dealt([], 10) == []
    assert spark.read.format("gpx_tracks").load(f"{folder}/none").count() == 0
    with pytest.raises(Exception, match="load"):
        spark.read.format("gpx_tracks").load().count()


def test_elements_are_those_of_the_table_function(spark, folder):
    got = spark.read.format("map_answers").load(folder)
    columns = ["type", "id", "lng", "lat", "tags", "line", "outers"]
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "m.json").text(folder)
    key = lambda r: r["id"]
    assert sorted(got.where("error is null").select(*columns).collect(), key=key) == sorted(tables.overpass_elements(files).select(*columns).collect(), key=key)
    assert [r["path"].rsplit("/", 1)[1] for r in got.where("error is not null").collect()] == ["n.json"]


def test_a_stream_reads_each_file_once(spark, folder, tmp_path):
    def run():
        stream = spark.readStream.format("gpx_tracks").load(folder).select("path", "name", "error")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return sorted(r["name"] for r in spark.read.parquet(f"{tmp_path}/out").where("error is null").collect())

    assert run() == ["A", "B", "C"] == run()
    with open(f"{folder}/d.gpx", "w") as f:
        f.write(gpx("D", [(1, 2), (3, 4)]))
    assert run() == ["A", "B", "C", "D"]
