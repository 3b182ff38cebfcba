"""Kernels that take whole columns against plain ones for one line, and what they keep in memory."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geocairn.functions import kernels
from geocairn.operators import vector_tiles


def plain_clip(points, box):
    low, high = np.array(box[:2]), np.array(box[2:])
    pieces = []
    for p, q in zip(points[:-1], points[1:], strict=True):
        d = q - p
        near, far = 0.0, 1.0
        for axis in (0, 1):
            if d[axis] == 0:
                if not low[axis] <= p[axis] <= high[axis]:
                    near = 2.0
                continue
            t = sorted(((low[axis] - p[axis]) / d[axis], (high[axis] - p[axis]) / d[axis]))
            near, far = max(near, t[0]), min(far, t[1])
        if near > far:
            continue
        a, b = (p if near == 0 else p + near * d), (q if far == 1 else p + far * d)
        if pieces and near == 0 and np.array_equal(pieces[-1][-1], a):
            pieces[-1].append(b)
        else:
            pieces.append([a, b])
    return [np.array(x) for x in pieces if len(x) > 2 or not np.array_equal(x[0], x[1])]


def test_clip_of_many_lines(spark):
    r = random.Random(5)
    lines = [[(float(r.randrange(6)), float(r.randrange(6))) for _ in range(r.choice([0, 1, 2, 3, 30]))] for _ in range(200)] + [None]
    box = (1.0, 1.0, 4.0, 3.5)
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line array<struct<lng:double,lat:double>>").coalesce(1)
    edges = F.struct(*[F.lit(v).alias(n) for v, n in zip(box, ("min_lng", "min_lat", "max_lng", "max_lat"), strict=True)])
    out = df.select("i", kernels.clip_line("line", edges).alias("p"), kernels.simplify_line("line", F.when(F.col("i") % 3 > 0, 0.8)).alias("s")).collect()
    assert len(out) == 201
    for r_ in out:
        if lines[r_["i"]] is None:
            assert r_["p"] is None and r_["s"] is None
            continue
        points = np.array(lines[r_["i"]], float).reshape(-1, 2)
        assert [[tuple(x) for x in p] for p in r_["p"]] == [[tuple(x) for x in p.tolist()] for p in plain_clip(points, box)]
        kept = points[kernels.douglas_peucker(points, 0.8)] if r_["i"] % 3 else points
        assert [tuple(x) for x in r_["s"]] == [tuple(x) for x in kept.tolist()]


def test_clip_holds_no_objects():
    n = 2000
    points = pa.StructArray.from_arrays([pa.array(np.random.default_rng(i).random(n * 100)) for i in (1, 2)], ["lng", "lat"])
    line = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 100, pa.int32()), points)
    box = pa.StructArray.from_arrays([pa.array([v] * n) for v in (0.2, 0.2, 0.8, 0.8)], ["min_lng", "min_lat", "max_lng", "max_lat"])
    tracemalloc.start()
    pieces = kernels.clip_line.func(line, box)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pieces) == n and peak < 40 * points.nbytes


@pytest.mark.parametrize("part", [slice(None), slice(1, 3), slice(2, 2)])
def test_joined_bytes(part):
    f = pa.array([{"n": n, "bytes": b} for n, b in ((1, b"ab"), (3, b"c"), (2, b""), (1, b"xyz"))], pa.struct([("n", pa.int64()), ("bytes", pa.binary())]))[part]
    assert vector_tiles._joined(f) == b"".join(x["bytes"] * x["n"] for x in f.to_pylist())
