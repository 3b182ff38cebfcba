"""Keyed state over a feed: finds, deletes, repeats and restarts."""

import random
from datetime import datetime, timedelta

from geocairn.streaming import feeds, status

SCHEMA = "user_id long, activity_id long, kind string, feature_id string, at timestamp, deleted boolean"
START = datetime(2024, 1, 1)


def feed_rows(seed, n=260):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        deleted = r.random() < 0.12
        kind = None if deleted or r.random() < 0.1 else r.choice(status.STAGES)
        rows.append((r.choice([1, 2]), r.randrange(6), kind, f"f{r.randrange(4)}" if kind else None, START + timedelta(minutes=k), deleted))
    rows += [(None, 1, "peaks", "f1", START, False), (1, None, "peaks", "f1", START, False), (1, 99, None, None, START, None)]
    return rows


def plain(rows):
    gone, facts, seen = {}, {}, set()
    for user, activity, kind, feature, at, deleted in rows:
        if user is None or activity is None:
            continue
        key = (user, activity)
        seen.add(key)
        if deleted:
            gone[key] = max(gone.get(key, at), at)
        elif kind:
            facts[*key, kind, feature] = max(at, facts.get((*key, kind, feature), at))
    live = {f for f, at in facts.items() if f[:2] not in gone or at > gone[f[:2]]}
    return live | {(*k, "status", status.status_of({f[2] for f in live if f[:2] == k}, k in gone)) for k in seen}


def run(spark, base, folder):
    stream = feeds.read_changes(spark, f"{base}/in", SCHEMA, 1)
    status.keep_status(stream, folder, f"{base}/checkpoint").awaitTermination()


def put(spark, base, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")


def test_state_after_deletes_repeats_and_restarts(spark, tmp_path):
    rows = feed_rows(3)
    shuffled = rows[:150] + rows[40:60]  # some rows come twice
    random.Random(5).shuffle(shuffled)
    out = f"{tmp_path}/out"
    put(spark, tmp_path, shuffled[:80])
    put(spark, tmp_path, shuffled[80:])
    run(spark, tmp_path, out)
    held = lambda: {tuple(r) for r in status.current_status(spark, out).collect()}
    assert held() == plain(rows[:150])
    run(spark, tmp_path, out)  # nothing new
    assert held() == plain(rows[:150])
    put(spark, tmp_path, rows[150:])  # started anew from the checkpoint in mid-stream
    run(spark, tmp_path, out)
    assert held() == plain(rows)
    n = {tuple(r) for r in status.counters(spark, out, ["what", "name"]).collect()}
    want = {}
    for f in plain(rows):
        want[f[2:]] = want.get(f[2:], 0) + 1
    assert n == {(*k, v) for k, v in want.items()} and {"deleted", "partial"} <= {k[1] for k in want}
    deltas = spark.read.parquet(out)
    assert deltas.where("delta = -1 and what <> 'status'").count() > 5


def test_state_is_forgotten_when_nothing_comes(spark, tmp_path):
    out, day = f"{tmp_path}/out", timedelta(days=1)
    for k, (activity, at) in enumerate([(1, START), (2, START + 40 * day), (2, START + 80 * day), (1, START + 81 * day)]):
        put(spark, tmp_path, [(1, activity, "peaks", f"f{k}", at, False)])
        stream = feeds.read_changes(spark, f"{tmp_path}/in", SCHEMA, 1)
        status.keep_status(stream, out, f"{tmp_path}/checkpoint", forget=10 * day, late="1 day").awaitTermination()
    log = [tuple(r)[1:] for r in spark.read.parquet(out).collect()]
    assert sorted(x for x in log if x[1] == "peaks") == [(1, "peaks", "f0", 1), (1, "peaks", "f3", 1), (2, "peaks", "f1", 1), (2, "peaks", "f2", 1)]
    assert log.count((1, "status", "partial", 1)) == 2  # told anew, as nothing of the first time is held


class _Handle:
    """A store of one activity that counts what it is asked."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_state_is_asked_a_fixed_number_of_times():
    handle, state = _Handle(), status.ActivityState(timedelta(days=1))
    state.init(handle)
    rows = [{"micros": k, "deleted": False, "kind": "peaks", "feature_id": f"f{k}"} for k in range(50)]
    assert len(list(state.handleInputRows((1, 2), iter(rows), None))) == 51 and handle.calls == 3
    assert [r["name"] for r in state.handleInputRows((1, 2), iter([{"micros": 10**6, "deleted": False, "kind": "paths", "feature_id": "x"}]), None)] == ["x"]
    assert handle.calls == 7 and len(handle.timers) == 1
