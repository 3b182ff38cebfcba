"""Nearest distances against plain loops."""

import random

from pyspark.sql import functions as F

from geocairn.operators import races


def about(a, b):
    return a == b or abs(a - b) < 0.09 * max(a, b)


def _listing(n, seed):
    r = random.Random(seed)
    return [(r.choice("pq") if i % 9 else None, i, r.choice([10.0, 10.5, 11.0, 21.1, r.uniform(5, 50), 0.0, None]), r.choice([True, False, None])) for i in range(n)]


def test_best_discovery_against_loops(spark):
    routes, found = _listing(150, 1), _listing(120, 2)
    want = {}
    for o, i, km, _ in routes:
        near = [((m is not None, bool(m)), abs(km - k), j) for p, j, k, m in found if o and o == p and km and k and about(km, k)]
        if near:
            want[i] = min(near)[2]
    a = spark.createDataFrame([x[:3] for x in routes], "organizer string, route_id long, km double")
    b = spark.createDataFrame(found, "organizer string, discovery_id long, km double, is_multi boolean")
    assert {r["route_id"]: r["discovery_id"] for r in races.best_discovery(a, b).collect()} == want and want


def test_nearest_doesnt_list_pairs(spark):
    """Equal distances meet once: neither plan joins routes to discoveries row by row."""
    a = spark.range(400).select(F.lit("o").alias("organizer"), F.col("id").alias("route_id"), (10 + F.col("id") % 3).cast("double").alias("km"))
    b = spark.range(300).select(F.lit("o").alias("organizer"), F.col("id").alias("discovery_id"), (10 + F.col("id") % 3).cast("double").alias("km"), F.lit(False).alias("is_multi"))
    df = races.best_discovery(a, b)
    assert {r["discovery_id"] for r in df.collect()} == {0, 1, 2}
    assert races.nearest_of_about(a, b.select("organizer", "km", F.col("is_multi").alias("rank"), F.col("discovery_id").alias("id"))).count() == 3


def test_absorbed_points_against_loops(spark):
    lines, points = _listing(80, 3), _listing(150, 4)
    rows = [(o or "n", i, True, [k], None, f"l{i}") for o, i, k, _ in lines] + [(o or "n", 1000 + i, False, [k, k], None, f"p{i}") for o, i, k, _ in points]
    want = {r[1]: r[5] for r in rows if r[2]}
    for o, i, _, (km, _), _, name in [r for r in rows if not r[2]]:
        near = [(abs(km - r[3][0]), r[1]) for r in rows if r[2] and r[0] == o and km and r[3][0] and about(km, r[3][0])]
        want[min(near)[1] if near else i] = name
    df = spark.createDataFrame(rows, "organizer string, id long, is_line boolean, km array<double>, urls array<string>, name string")
    out = races.absorb_points(df, ["name"])
    assert {r["id"]: r["name"] for r in out.collect()} == want
