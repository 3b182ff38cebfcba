"""Queries whose SQL answers for a part of the rows only, against plain versions over all rows."""

import math
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

from geocairn.plans import QUERIES


def cell(k):
    return math.floor((59 + (k * 104729 % 10007) / 10007.0 * 2) / 0.05), math.floor((10 + (k * 7919 % 10007) / 10007.0 * 2) / 0.05)


def test_paths_by_thirds_takes_every_customer(spark, tmp_path):
    orders = [(k, k * 7 % 20) for k in range(1, 90)] + [(500, 23), (501, 28), (502, 28)]
    events = [(k, k % 4 if k % 11 else None, datetime(2024, 1, 1) + timedelta(minutes=k)) for k in range(1, 700)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    want = set()
    for user in range(4):
        seen = {(r + i, c + j) for e, u, _ in events if u == user for r, c in [cell(e)] for i in (-1, 0, 1) for j in (-1, 0, 1)}
        for path in {c for _, c in orders}:
            places = sorted(o for o, c in orders if c == path)
            met = {i * 3 // len(places) for i, o in enumerate(places) if cell(o) in seen}
            if len(met) == min(3, len(places)):
                want.add((user, path))
    got = [tuple(r) for r in QUERIES["paths_by_thirds"](spark, str(tmp_path)).select("route_id", "path_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {p for _, p in want if p % 10 >= 3} and len(want) < 4 * 22


def test_address_distances_takes_every_mile(spark, tmp_path):
    spark.createDataFrame([(k, k) for k in range(1, 51)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")

    def want(n):
        if n % 4 > 1:
            return "21 km" if n % 4 == 2 else "backyard"
        km = str(n) if n % 4 == 0 else str((n * Decimal("1.60934")).quantize(Decimal("0.1"), ROUND_HALF_UP)).removesuffix(".0")
        return f"{km} km"

    got = dict(QUERIES["address_distances"](spark, str(tmp_path)).select("p_partkey", "distance").collect())
    assert got == {n: want(n) for n in range(1, 51)}
    assert got[5] == "8 km" and got[13] == "20.9 km"
