"""Organizer documents by use, their redirects and writes, and points merged with points against a plain greedy version."""

import json
import random

import pytest
from pyspark.sql import functions as F

from geocairn.functions import text
from geocairn.operators import races
from geocairn.sources import documents


@pytest.fixture
def folder(tmp_path):
    def put(name, value):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(value if isinstance(value, str) else json.dumps(value))

    routes = [{"sourceUrl": "u", "name": "r", "distance": 10.5, "coordinates": [[10, 59], [11, 60]]}]
    put("a.no/organizer.json", {"id": "a.no", "url": "https://a.no", "discovery": {"x": [{"name": "A", "date": "2026-01-01"}, {"name": "B"}]}, "scrapers": {"s": {"startFee": "100", "routes": routes}}, "lastMaxSlotIndex": 3})
    put("b.no/sub +1/organizer.json", {"id": "b", "url": "https://b.no", "scrapers": {"s": {"routes": [{"coordinates": "not a list"}]}}})
    put("c.no/organizer.json", {"id": "c.no", "url": "https://c.no"})
    put("d.no/organizer.json", {"id": "d.no"})
    put("e.no/organizer.json", "{cut")
    put("c.no/redirect.txt", " a.no\n")
    put("f.no/redirect.txt", " ")
    put("a.no/races/0.json", {"id": "race:a.no-0", "kind": "race", "properties": {"name": "A"}, "geometry": {"type": "Point", "coordinates": [1, 2]}})
    put("a.no/races/1.json", "{cut")
    put("c.no/races/0.json", {"id": "race:c.no-0", "kind": "race"})
    return str(tmp_path)


def test_documents_by_use(spark, folder):
    files, redirects = documents.read_files(spark, folder), documents.read_redirects(spark, folder)
    assert [tuple(r) for r in redirects.collect()] == [("c.no", "a.no")]
    held = lambda **o: {r["organizer"]: r for r in documents.documents(files, **o).collect()}
    assert set(held(use="identity")) == {"a.no", "b.no/sub +1", "c.no"}
    slim = held(use="metadata", redirects=redirects)
    assert set(slim) == {"a.no", "b.no/sub +1"} and len(slim["a.no"]["discovery"]["x"]) == 2 and slim["a.no"]["scrapers"]["s"]["startFee"] == "100"
    whole = held(use="all")["a.no"]["scrapers"]["s"]
    assert whole["routes"][0]["coordinates"] == [[10.0, 59.0], [11.0, 60.0]]
    read = documents.documents(files, use="metadata")
    assert "coordinates" not in read._jdf.queryExecution().optimizedPlan().toString() and "coordinates" not in read.schema.simpleString()
    races_ = {r["organizer"]: r["id"] for r in documents.read_races(spark, folder).collect()}
    assert races_ == {"a.no": "race:a.no-0", "c.no": "race:c.no-0"}
    assert documents.read_races(spark, folder, "a.no").count() == 1


def test_writes_follow_redirects_and_keep_routes(spark):
    items = spark.createDataFrame([(1, "A", "s", "https://a", "x"), (2, "b", "s", "https://b", "y"), (3, "b", "t", "https://b", "z"), (4, "old", "s", "https://old", "w")], "pos int, organizer string, source string, url string, discovery string")
    redirects = spark.createDataFrame([("OLD", "older"), ("older", "a")], "source string, target string")
    got = {(r["organizer"].lower(), r["source"]): (r["url"], r["discoveries"]) for r in documents.routed_discoveries(items, redirects).collect()}
    assert got == {("a", "s"): ("https://a", ["x", "w"]), ("b", "s"): ("https://b", ["y"]), ("b", "t"): ("https://b", ["z"])}
    stored = spark.createDataFrame([("a", "s", "r1", "fee1", "n1")], "organizer string, scraper string, routes string, fee string, name string")
    new = spark.createDataFrame([("a", "s", None, None, "n2"), ("a", "t", "r9", "fee9", None)], stored.schema)
    assert {tuple(r) for r in documents.patched_outputs(stored, new, ["organizer", "scraper"], ["routes"]).collect()} == {("a", "s", "r1", None, "n2"), ("a", "t", "r9", "fee9", None)}
    assert [r[0] for r in spark.createDataFrame([("no",), ("XX ",), (None,)], "c string").select(documents.country_name(F.col("c"), {"NO": "Norway"})).collect()] == ["Norway", "XX", None]


def alike(a, b):
    return a == b or (max(a, b) > 0 and abs(a - b) < text.ROUGH * max(a, b))


def plain_merge(rows):
    """rows (organizer, id, is_line, km, urls, name, fee) in order of id, one organizer after the other."""
    out = {r[1]: list(r) for r in rows}
    for organizer in {r[0] for r in rows}:
        points = [out[r[1]] for r in sorted(rows, key=lambda r: r[1]) if r[0] == organizer and not r[2] and any(k > 0 for k in r[3])]
        gone = set()
        for i, s in enumerate(points):
            if s[1] in gone:
                continue
            mine = [(k, s[5] and s[5].strip().lower()) for k in s[3] if k > 0]
            for c in points[i + 1 :]:
                if c[1] in gone:
                    continue
                theirs = c[5] and c[5].strip().lower()
                if any(alike(k, q) for k, _ in mine for q in c[3] if q > 0) and (not mine[0][1] or not theirs or mine[0][1] == theirs):
                    s[6] = c[6] if s[6] is None else s[6]
                    s[4] = s[4] + [u for u in c[4] if u not in s[4]]
                    gone.add(c[1])
        for g in gone:
            del out[g]
    return sorted((r[0], r[1], r[2], tuple(r[3]), tuple(r[4]), r[5], r[6]) for r in out.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_points_merge_as_in_a_plain_greedy_version(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(160):
        km = [round(r.choice([5, 10, 21.1, 42.2]) * (1 + r.randrange(-4, 5) * 0.03), 2) for _ in range(r.choice([0, 1, 1, 2]))]
        rows.append((f"o{i % 3}", i, r.random() < 0.1, km, [f"u{r.randrange(9)}"], r.choice(["Run", " run", "Trail", None, ""]), r.choice([None, f"fee{i}"])))
    rows += [("chain", 1000 + i, False, [10 * 1.04**i], [f"c{i}"], None, None) for i in range(25)] + [("same", 2000 + i, False, [7.0], ["s"], "x", None) for i in range(30)]
    df = spark.createDataFrame(rows, "organizer string, id long, is_line boolean, km array<double>, urls array<string>, name string, fee string").repartition(5)
    got = sorted((g["organizer"], g["id"], g["is_line"], tuple(g["km"]), tuple(g["urls"]), g["name"], g["fee"]) for g in races.merge_points(df, ["fee"]).collect())
    assert got == plain_merge(rows) and len(got) < len(rows) - 60


def test_long_chains_of_redirects_are_followed(spark):
    """Eight steps, the limit, whatever a query's SQL unrolls."""
    items = spark.createDataFrame([(1, "o390625", "s", "https://x", "d")], "pos int, organizer string, source string, url string, discovery string")
    redirects = spark.createDataFrame([(f"O{5**i}", f"o{5 ** (i - 1)}") for i in range(1, 9)], "source string, target string")
    assert [r["organizer"] for r in documents.routed_discoveries(items, redirects).collect()] == ["o1"]
