"""Packed lines and lines made to fit a size, against plain versions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from geocairn.functions import kernels, packed
from geocairn.operators import shards, tiles


def plain_pack(points):
    out, before = bytearray(), (0, 0)
    for lng, lat in points:
        now = (round(lng * 1e7), round(lat * 1e7))
        for a, b in zip(now, before, strict=True):
            d = (a - b + 2**31) % 2**32 - 2**31
            n = (d << 1 ^ d >> 31) & 0xFFFFFFFF
            while n > 127:
                out.append(n & 127 | 128)
                n >>= 7
            out.append(n)
        before = now
    return bytes(out)


def lines(seed=1, n=60):
    r = np.random.default_rng(seed)
    out = [[(float(x), float(y)) for x, y in np.column_stack([r.uniform(-180, 180, k), r.uniform(-90, 90, k)])] for k in r.integers(0, 9, n)]
    return out + [[(10.0, 59.0), (10.0000001, 59.0), (10.0, 59.0)], [(-180.0, -90.0), (180.0, 90.0)], [(0.0, 0.0)], []]


def test_bytes_are_those_of_a_plain_coder():
    rows = lines()
    flat = np.array([p for x in rows for p in x])
    sizes = np.array([len(x) for x in rows])
    data, lengths = packed.pack(flat[:, 0], flat[:, 1], sizes)
    ends = np.cumsum(lengths)
    assert [data[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)] == [plain_pack(x) for x in rows]
    lng, lat, counts = packed.unpack(data, lengths)
    assert counts.tolist() == sizes.tolist() and np.abs(np.column_stack([lng, lat]) - flat).max() <= 0.5001e-7


def test_known_bytes_and_cut_ones():
    for points, said in (([(10.0, 10.0)], bytes([128, 132, 175, 95, 128, 132, 175, 95])), ([(0.0, 0.0), (1e-7, -1e-7)], bytes([0, 0, 2, 1]))):
        p = np.array(points)
        data, lengths = packed.pack(p[:, 0], p[:, 1], np.array([len(p)]))
        assert data.tobytes() == said == plain_pack(points)
    data = np.frombuffer(bytes([2, 2, 4]) + bytes([2, 130]) + bytes([6, 8]), np.uint8)  # a vertex and a half, cut within a number, whole
    lng, lat, counts = packed.unpack(data, np.array([3, 2, 2]))
    assert counts.tolist() == [1, 0, 1] and np.allclose(lng, [1e-7, 3e-7]) and np.allclose(lat, [1e-7, 4e-7])


def test_columns_with_nulls(spark):
    rows = [(i, [{"lng": a, "lat": b} for a, b in x]) for i, x in enumerate(lines(2))] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, line array<struct<lng:double,lat:double>>").repartition(3)
    got = df.withColumn("p", packed.pack_line("line")).withColumn("back", packed.unpack_line("p")).collect()
    for r in got:
        assert (r["p"], r["back"]) == (None, None) if r["line"] is None else (bytes(r["p"]) == plain_pack([tuple(p) for p in r["line"]]) and len(r["back"]) == len(r["line"]))
        assert r["line"] is None or all(abs(p["lng"] - q["lng"]) < 1e-7 and abs(p["lat"] - q["lat"]) < 1e-7 for p, q in zip(r["line"], r["back"], strict=True))


def test_each_line_comes_once_from_its_shards(spark):
    line = lambda a, b: [{"lng": 10 + x / 10, "lat": 59.0} for x in range(a, b)]
    df = spark.createDataFrame([(1, line(0, 9), "a"), (2, line(5, 6), "b"), (3, line(30, 31), "c"), (4, [], "d"), (5, None, "e")], "id long, line array<struct<lng:double,lat:double>>, name string")
    made = shards.build_shards(df, 11)
    tiles_of_1 = made.where("id = 1").select("x", "y")
    assert tiles_of_1.count() > 4
    got = shards.shard_features(made, tiles_of_1.union(tiles_of_1)).orderBy("id").collect()
    assert [(r["id"], r["name"], len(r["line"])) for r in got] == [(1, "a", 9), (2, "b", 1)]


@pytest.mark.parametrize("seed", range(6))
def test_ranks_are_the_tolerances_at_which_vertices_go(seed):
    r = np.random.default_rng(seed)
    p = np.round(r.normal(size=(int(r.integers(2, 60)), 2)).cumsum(axis=0), 1)
    if seed == 5:
        p = np.concatenate([p, p[:1]])
    rank = kernels.vertex_ranks(p)
    for e in [0.0, *sorted(set(rank[np.isfinite(rank)])), 1.0, 99.0]:
        assert (kernels.douglas_peucker(p, e) == (rank > e)).all()


def text_size(rings):
    return sum(len(json.dumps([a, b], separators=(",", ":"))) + 1 for r in rings for a, b in r) + 2 * len(rings) + 2


def test_features_fit_with_the_least_tolerance(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(12):
        open_ = np.round(r.normal(size=(80, 2)).cumsum(axis=0), 3)
        ring = np.round(np.column_stack([np.cos(np.arange(40) / 6.4), np.sin(np.arange(40) / 6.4)]) + r.normal(size=(40, 2)) / 9, 3)
        rows.append((i, [open_.tolist()] if i % 2 else [ring.tolist() + ring[:1].tolist(), (ring[:20] * 3).tolist() + (ring[:1] * 3).tolist()]))
    rows.append((12, [[[0.0, 0.0], [1.0, 1.0]]]))
    df = spark.createDataFrame([(i, [[{"lng": float(a), "lat": float(b)} for a, b in x] for x in rings]) for i, rings in rows] + [(13, None)], "id long, rings array<array<struct<lng:double,lat:double>>>")
    for limit in (100_000, 700, 300, 10):
        for g in tiles.fitted(df, limit).collect():
            if g["rings"] is None:
                continue
            rings = [np.array(x) for x in dict(rows)[g["id"]]]
            ranks = [kernels._ring_ranks(x) for x in rings]
            sizes = {}
            for e in [-1.0, *sorted({float(v) for k in ranks for v in k[np.isfinite(k)]})]:
                sizes[e] = text_size([x[k > e].tolist() for x, k in zip(rings, ranks, strict=True)])
            fits = [e for e in sizes if sizes[e] <= limit]
            assert g["tolerance"] == (min(fits) if fits else max(sizes))
            got = [[(p["lng"], p["lat"]) for p in x] for x in g["rings"]]
            assert got == [[tuple(v) for v in x[k > g["tolerance"]].tolist()] for x, k in zip(rings, ranks, strict=True)]
            assert all(x[0] == x[-1] and len(x) >= 4 for x in got) or g["id"] % 2 or g["id"] == 12
