"""Pairs settled block by block: against plain loops, and without a shuffle of pairs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from geocairn.operators import meetings, spatial

AROUND = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))


def plain(left, right, offsets):
    want, got = {}, {}
    for i, x, y in left:
        for j, u, v, bits, w in right:
            want[j] = w
            if (x - u, y - v) in offsets:
                got[i, j] = got.get((i, j), 0) | bits
    return {p for p, bits in got.items() if bits & want[p[1]] == want[p[1]]}


@pytest.mark.parametrize(("side", "offsets"), [(6, AROUND), (6, ((0, 0),)), (200, AROUND)])
def test_pairs_against_loops(spark, side, offsets):
    rng = np.random.default_rng(3)
    left = [(f"a{i}", *map(int, rng.integers(0, side, 2))) for i in range(90) for _ in range(4)]
    right = [(j, *map(int, rng.integers(0, side, 2)), 1 << int(rng.integers(0, 3)), 7 if j % 3 else 1) for j in range(70) for _ in range(5)]
    right = [r[:3] + (r[3] if r[0] % 3 else 1,) + r[4:] for r in right]
    a = spark.createDataFrame(left + [("null", None, 1), (None, 1, 1)], "a string, x int, y int")
    b = spark.createDataFrame(right, "b long, x int, y int, bits int, want int")
    got = [tuple(r) for r in meetings.pairs_meeting(a, b, ("a", "b"), ("x", "y"), offsets, 100).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(left, right, offsets) and got


@pytest.mark.parametrize("held", [1 << 26, 400])
@pytest.mark.parametrize("at_once", [4_000_000, 500])
def test_small_bit_sets_and_stretches(monkeypatch, held, at_once):
    monkeypatch.setattr(meetings, "SET_BYTES", held)
    monkeypatch.setattr(meetings, "AT_ONCE", at_once)
    rng = np.random.default_rng(4)
    for side in (5, 300):
        left, right = np.sort(rng.integers(0, 300, 2000)), np.sort(np.concatenate([np.arange(40), rng.integers(0, 40, 400)]))
        x, y = (rng.integers(0, side, (n, 2)) for n in (len(left), len(right)))
        bits, want = 1 << rng.integers(0, 3, len(right)), np.full(40, 7)
        found = meetings._meet(left, x @ [1, 1j], right, y @ [1, 1j], bits, want, np.array([0j, 1 + 0j]))
        got = [(int(p), int(q)) for ps, qs in found for p, q in zip(ps, qs, strict=True)]
        assert len(got) == len(set(got))
        assert set(got) == plain([(int(i), *map(int, k)) for i, k in zip(left, x, strict=True)], [(int(j), *map(int, k), int(s), 7) for j, k, s in zip(right, y, bits, strict=True)], ((0, 0), (1, 0)))


def shuffled(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _lines(spark, name, n):
    one = F.array(*[F.struct((10 + F.col("id") * 0 + i / 100).alias("lng"), F.lit(60.0).alias("lat")) for i in range(3)])
    return spark.range(n).select(F.col("id").alias(name), one.alias("line"))


def test_thirds_shuffle_no_pairs(spark):
    df = spatial.paths_by_thirds(_lines(spark, "route_id", 40), _lines(spark, "path_id", 50), 0.05)
    assert not re.search(r"hashpartitioning\(route_id#\d+L?, path_id", shuffled(df))
    assert df.count() == 2000


def test_lines_within_shuffle_no_pairs(spark):
    df = spatial.lines_within(_lines(spark, "a_id", 40), _lines(spark, "b_id", 50), 50.0)
    assert not re.search(r"hashpartitioning\((a_id|route_id)#\d+L?, (b_id|point_id)", shuffled(df))
    assert df.count() == 2000


def _scattered(spark, name, n, of, **more):
    """n ids with `of` rows each, their keys scattered over 41 x 41 cells."""
    cell = lambda salt: F.pmod(F.xxhash64("id", "i", F.lit(salt)), F.lit(41)).cast("int")
    return spark.range(n).select("id", F.explode(F.sequence(F.lit(1), F.lit(of))).alias("i")).select(F.col("id").alias(name), cell(1).alias("x"), cell(2).alias("y"), *[c.alias(k) for k, c in more.items()])


def _dense(spark, n_left, n_right):
    """Pairs that are about a third of all."""
    left, right = _scattered(spark, "a", n_left, 66), _scattered(spark, "b", n_right, 9, bits=F.call_function("shiftleft", F.lit(1), F.col("i").cast("int") % 3), want=F.lit(7))
    return meetings.pairs_meeting(left, right, ("a", "b"), ("x", "y"), AROUND)


def test_listed_pairs_take_little_room(spark, tmp_path):
    """About a byte a pair in Parquet, however many left ids there are."""
    _dense(spark, 6000, 4000).write.parquet(f"{tmp_path}/pairs")
    n = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert 0.2 < n / (6000 * 4000) < 0.5
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 1.25 * n


def test_sides_are_put_down_once(spark):
    """Blocks aren't repeated for each other's sake."""
    plan = shuffled(_dense(spark, 300, 200))
    assert "CartesianProduct" in plan and "explode(sequence(pmod" not in plan


def test_ids_of_many_rows_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(meetings, "LEFT_IDS", 3)
    monkeypatch.setattr(meetings, "RIGHT_IDS", 5)
    left, right = _scattered(spark, "a", 60, 40).unionByName(_scattered(spark, "a", 2, 900)), _scattered(spark, "b", 50, 4, bits=F.lit(1) + F.col("i") % 2, want=F.lit(3))
    got = [tuple(r) for r in meetings.pairs_meeting(left, right, ("a", "b"), ("x", "y"), AROUND).collect()]
    assert len(got) == len(set(got)) and set(got) == plain([tuple(r) for r in left.collect()], [tuple(r) for r in right.collect()], AROUND)


def test_tasks_of_lines_within_hold_few_left_ids(spark):
    df = spatial.lines_within(_lines(spark, "a_id", 3000), _lines(spark, "b_id", 300), 50.0)
    assert "explode(sequence(pmod" not in shuffled(df)
    each = df.groupBy(F.spark_partition_id().alias("t")).agg(F.count_distinct("a_id").alias("left"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in each) == 900_000 and max(r["left"] for r in each) <= 300


def test_left_blocks_are_so_many_at_most(spark, monkeypatch):
    monkeypatch.setattr(meetings, "LEFT_IDS", 1)
    monkeypatch.setattr(meetings, "LEFT_BLOCKS", 20)
    df = spatial.lines_within(_lines(spark, "a_id", 200), _lines(spark, "b_id", 50), 50.0)
    assert df.rdd.getNumPartitions() == 40 and df.distinct().count() == df.count() == 10_000
