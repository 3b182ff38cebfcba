"""Tables kept by key: what merges leave, which files they touch, and what fails without harm."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from geocairn.sources.keyed import Conflict, KeyedTable

SCHEMA = StructType([StructField(n, t) for n, t in (("user", StringType()), ("id", LongType()), ("name", StringType()), ("score", IntegerType()), ("until", TimestampType()))])
CHANGES = StructType([*SCHEMA, StructField("op", StringType())])


def rows_of(df):
    return {(r["user"], r["id"]): (r["name"], r["score"]) for r in df.collect()}


def table_of(spark, tmp_path, rows=(), **options):
    table = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, ["user", "id"], **({"buckets": 8} | options))
    return table.merge(spark.createDataFrame([(*r, "upsert") for r in rows], CHANGES)) if rows else table


def plain(state, changes):
    """changes (user, id, name, score, op, order) one after the other."""
    rank = {"upsert": 0, "patch": 1, "delete": 2}
    for user, i, name, score, op, _ in sorted(changes, key=lambda c: (c[5], rank[c[4]])):
        if op == "upsert":
            state[user, i] = (name, score)
        elif op == "delete":
            state.pop((user, i), None)
        elif (user, i) in state:
            old = state[user, i]
            state[user, i] = (old[0] if name is None else name, old[1] if score is None else score)
    return state


def test_batches_leave_what_a_plain_version_leaves(spark, tmp_path):
    r = random.Random(1)
    table, state = table_of(spark, tmp_path), {}
    for batch in range(4):
        changes = []
        for n in range(120):
            key = (r.choice(["a", "b", None]), r.randrange(12))
            changes.append((*key, r.choice([None, f"n{n}"]), r.choice([None, n]), r.choice(["upsert", "patch", "delete", "patch"]), batch * 1000 + n))
        table = table.merge(spark.createDataFrame(changes, "user string, id long, name string, score int, op string, at long"), order="at")
        state = plain(state, changes)
        assert rows_of(table.read()) == state and table.read().count() == len(state)
    assert table.version == 4 and rows_of(KeyedTable(spark, table.folder).read()) == state
    ids = spark.createDataFrame([("a", i) for i in range(12)] + [(None, 3)], "user string, id long")
    assert rows_of(table.multi_get(ids)) == {k: v for k, v in state.items() if k[0] == "a" or k == (None, 3)}


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = table_of(spark, tmp_path, [("u", i, f"n{i}", i, None) for i in range(200)], buckets=16)
    before = {b: p["folder"] for b, p in table.parts.items()}
    assert len(before) == 16 and sum(p["rows"] for p in table.parts.values()) == 200
    after = table.merge(spark.createDataFrame([("u", 7, "seven", "patch"), ("u", 8, None, "delete")], "user string, id long, name string, op string"))
    changed = [b for b in before if after.parts.get(b, {}).get("folder") != before[b]]
    assert 1 <= len(changed) <= 2 and rows_of(after.lookup(user="u", id=7)) == {("u", 7): ("seven", 7)} and after.lookup(user="u", id=8).count() == 0
    assert len(after.lookup(user="u", id=7).inputFiles()) == 1 < len(after.read().inputFiles())
    assert rows_of(KeyedTable(spark, table.folder, version=1).read())["u", 7] == ("n7", 7)  # the older version stays
    assert after.merge(after.read().limit(0).withColumn("op", F.lit("patch"))).version == after.version
    left = len(after.read().inputFiles())
    assert after.vacuum() == len(changed) and len(after.read().inputFiles()) == left and after.read().count() == 199


def test_a_snapshot_rewrites_what_differs(spark, tmp_path):
    rows = [("u", i, f"n{i}", i, None) for i in range(100)]
    table = table_of(spark, tmp_path, rows, buckets=32)
    new = [("u", 5, "five", 5, None), ("v", 1, None, None, None)] + [x for x in rows if x[1] not in (5, 6)]
    after = table.replace(spark.createDataFrame(new, SCHEMA))
    assert rows_of(after.read()) == {(x[0], x[1]): (x[2], x[3]) for x in new}
    assert sum(after.parts.get(b) != p for b, p in table.parts.items()) <= 3
    assert after.replace(spark.createDataFrame(new, SCHEMA)).version == after.version


def test_a_failed_write_leaves_the_older_version(spark, tmp_path):
    table = table_of(spark, tmp_path, [("u", i, f"n{i}", i, None) for i in range(50)])
    broken = spark.createDataFrame([("u", 1, "x", "upsert")], "user string, id long, name string, op string").withColumn("score", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        table.merge(broken)
    again = KeyedTable(spark, table.folder)
    assert again.version == table.version and rows_of(again.read()) == rows_of(table.read())
    one = table.merge(spark.createDataFrame([("u", 1, "one", "patch")], "user string, id long, name string, op string"))
    with pytest.raises(Conflict):  # a second writer that started from the same version
        table.merge(spark.createDataFrame([("u", 2, "two", "patch")], "user string, id long, name string, op string"))
    assert rows_of(KeyedTable(spark, table.folder).read()) == rows_of(one.read()) and rows_of(one.read())["u", 1] == ("one", 1)


def test_expiry_rewrites_mixed_buckets_only(spark, tmp_path):
    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [("u", i, None, i, day(1 + i % 20)) for i in range(24)] + [("v", i, None, i, None) for i in range(3)]
    table = table_of(spark, tmp_path, rows, buckets=64, expires="until")
    after = table.expire("2024-01-10 00:00:00")
    assert rows_of(after.read()) == {(x[0], x[1]): (x[2], x[3]) for x in rows if x[4] is None or x[4] > day(10)}
    live = lambda b: [x for x in table.read([b]).collect() if x["until"] is None or x["until"] > day(10)]
    kinds = {b: ("kept" if len(live(b)) == p["rows"] else "gone" if not live(b) else "mixed") for b, p in table.parts.items()}
    assert {"kept", "gone"} <= set(kinds.values())
    assert all((b not in after.parts) if k == "gone" else (after.parts[b] == table.parts[b]) == (k == "kept") for b, k in kinds.items())
    assert after.expire("2024-01-10").version == after.version
