"""Streams over several files: rows out of order, late rows, restarts, episodes taken back."""

import random

import pytest
from pyspark.sql import functions as F

from rigspan.operators import predict, segment, sync
from rigspan.streaming import live, stream
from test_folds import marker_fold

SEC = 1_000_000
MARKERS = "bag long, seq long, t_us long, cmd int"


def markers(seed, bags=4, n=60):
    rng = random.Random(seed)
    logs = [[rng.choice([1, 1, 2, 2, 3, 4]) for _ in range(n)] for _ in range(bags)]
    return logs, [(b, k, (k + 10) * SEC, c) for b, log in enumerate(logs) for k, c in enumerate(log)]


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def found(changes):
    out = {}
    for r in stream.net_episodes(changes).orderBy("bag", "start_us").collect():
        out.setdefault(r.bag, []).append((r.start_us // SEC - 10, r.stop_us // SEC - 10))
    return out


def test_markers_in_any_order_and_a_restart(spark, tmp_path):
    """Rows of one bag lie in random order over the files; the state survives the end of a run; net of the changelog is the fold."""
    logs, rows = markers(5)
    random.Random(6).shuffle(rows)
    path, base = str(tmp_path / "log"), str(tmp_path / "out")
    want = {b: marker_fold(log) for b, log in enumerate(logs) if marker_fold(log)}
    for part in (rows[:90], rows[90:91], rows[91:170]):
        write(spark, path, part, MARKERS)
    log = lambda: stream.read(spark, path, spark.createDataFrame([], MARKERS).schema)
    live.run(live.episode_changes(log(), "1 hour"), base)
    write(spark, path, rows[170:], MARKERS)
    write(spark, path, [(-1, 0, 10_000 * SEC, 9)], MARKERS)
    changes, late = live.run(live.episode_changes(log(), "1 hour"), base)
    assert found(changes) == want and late == 0
    # a later marker takes back what an earlier one committed
    assert changes.where("op = -1").count() == changes.where("op = 1").count() - sum(map(len, want.values())) > 0


def test_late_markers_are_counted_and_not_folded(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, [(0, 0, 100 * SEC, 1), (0, 1, 200 * SEC, 2), (0, 2, 210 * SEC, 1)], MARKERS)
    write(spark, path, [(0, 3, 500 * SEC, 2)], MARKERS)
    write(spark, path, [(0, 9, 150 * SEC, 3), (0, 10, 495 * SEC, 9)], MARKERS)  # a cancel behind the watermark, and a row within it
    write(spark, path, [(-1, 4, 9000 * SEC, 9)], MARKERS)
    changes, late = live.run(live.episode_changes(stream.read(spark, path, spark.createDataFrame([], MARKERS).schema), "10 seconds"))
    assert sorted((r.start_us // SEC, r.stop_us // SEC) for r in changes.collect()) == [(100, 200), (210, 500)]
    assert late == 1


MESSAGES = "bag long, seq long, t_us long, topic string, cmd int, value double"


@pytest.mark.parametrize("disorder", [0, 25 * SEC])
def test_live_grace_equals_the_batch_join(spark, disorder):
    rng = random.Random(8)
    rows = []
    for b in range(3):
        times = sorted(rng.sample(range(10, 900), 160))
        rows += [(b, b * 1000 + k, t * SEC, "control" if k % 4 == 0 else "x", rng.choice([1, 1, 2, 2, 3, 4]) if k % 4 == 0 else None, float(k)) for k, t in enumerate(times)]
    df = spark.createDataFrame(rows, MESSAGES)
    changes = lambda log: live.episode_changes(log.select("bag", "seq", "t_us", "cmd"), "30 seconds")
    [(got, late)] = live.replay(df, [lambda log: live.grace_rows(log.drop("cmd"), changes(log), "30 seconds", 20 * SEC, 1000 * SEC, 2 * SEC)], 3, disorder)
    episodes = segment.keep_long(segment.control_episodes(df.select("bag", "seq", "t_us", "cmd").where("cmd is not null")), 2 * SEC)
    want = sync.interval_join(df.drop("cmd"), episodes, 20 * SEC)
    key = lambda d: sorted((r.bag, r.seq, r.episode_id) for r in d.collect())
    assert late == 0 and key(live.net_grace(got, episodes, 20 * SEC)) == key(want)
    taken_back = got.join(episodes, ["bag", "start_us", "stop_us"], "left_anti").count()
    assert taken_back > 0  # rows of episodes that a later marker took back were there and went


def test_live_grace_drops_late_messages(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, [(0, 0, 100 * SEC, "control", 1, 0.0), (0, 1, 110 * SEC, "x", None, 0.0), (0, 2, 120 * SEC, "control", 2, 0.0)], MESSAGES)
    write(spark, path, [(0, 3, 123 * SEC, "x", None, 0.0), (0, 4, 500 * SEC, "control", 9, 0.0)], MESSAGES)  # the slower of markers and messages moves the watermark
    for k in range(3):  # chained operators judge lateness some batches behind
        write(spark, path, [(0, 7 + k, (505 + k) * SEC, "control", 9, 0.0)], MESSAGES)
    write(spark, path, [(0, 5, 122 * SEC, "x", None, 0.0)], MESSAGES)
    write(spark, path, [(-1, 6, 9000 * SEC, "x", -1, 0.0)], MESSAGES)
    log = stream.read(spark, path, spark.createDataFrame([], MESSAGES).schema)
    changes = live.episode_changes(log.select("bag", "seq", "t_us", "cmd"), "10 seconds")
    rows, late = live.run(live.grace_rows(log.drop("cmd"), changes, "10 seconds", 4 * SEC, 1000 * SEC))
    assert sorted(r.seq for r in rows.collect()) == [0, 1, 2, 3] and late >= 1


def test_windows_over_batches_with_a_restart(spark, tmp_path):
    """Latest values and latency summaries: append mode, late rows left out, a replayed batch not doubled."""
    rng = random.Random(12)
    rows = [(k % 3, k, (50 + k * 7 + rng.randint(-20, 20)) * SEC, rng.choice("ab"), float(k)) for k in range(200)]
    schema = "bag long, seq long, t_us long, topic string, value double"
    path, base = str(tmp_path / "log"), str(tmp_path / "out")
    log = lambda: stream.read(spark, path, spark.createDataFrame([], schema).schema).withColumn("ts", F.timestamp_micros("t_us"))
    slots = lambda: stream.latest_per_slot(log(), "60 seconds", "60 seconds")
    write(spark, path, rows[:80], schema)
    write(spark, path, rows[80:120], schema)
    live.run(slots(), base)
    write(spark, path, rows[120:] + [(0, 999, 60 * SEC, "a", -1.0)], schema)  # the last one is far behind
    write(spark, path, [(-1, 1000, 90_000 * SEC, "a", 0.0)], schema)
    got, late = live.run(slots(), base)
    want = stream.latest_per_slot(spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("t_us")), "60 seconds")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and late == 1
    latency = lambda d: stream.latency_summary(d.withColumn("robot", F.col("bag")).withColumn("sec", F.col("value")), "60 seconds", "5 minutes")
    got, _ = live.run(latency(log()))
    want = latency(spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("t_us")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_replayed_batch_overwrites_itself(spark, tmp_path):
    sink = live.write_once(str(tmp_path))
    for ids in (range(3), range(3)):
        sink(spark.createDataFrame([(k,) for k in ids], "k long"), 7)
    sink(spark.createDataFrame([(9,)], "k long"), 8)
    assert sorted(r.k for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path)).collect()) == [0, 1, 2, 9]


def test_three_states_in_one_stream_equal_the_batch_chain(spark):
    """Readiness, mode gate and hysteresis over several appends of rows out of order."""
    rng = random.Random(17)
    rows = []
    for b in range(3):
        for k in range(90):
            topic = rng.choice(["a", "b", "control"])
            rows.append((b, b * 1000 + k, (50 + k * 3) * SEC, topic, rng.choice([1, 1, 2]) if topic == "control" else None, rng.random()))
    df = spark.createDataFrame(rows, MESSAGES)
    [(got, late)] = live.replay(df, [lambda log: live.gated_hand(log, "20 seconds", ["a", "b", "control"], 7, 8 * SEC, 0.7, 0.3)], 2, 15 * SEC)
    want = {}
    for b in range(3):
        own = sorted((r for r in rows if r[0] == b), key=lambda r: (r[2], r[1]))
        ready = max(min(r[2] for r in own if r[3] == k) for k in ("a", "b", "control"))
        mode, on = 0, []
        for r in own:
            if r[2] >= ready:
                mode = r[4] or mode
                on += [r] if mode == 1 and r[3] != "control" else []
        done, _ = predict.limited([r[2] for r in on], [r[5] for r in on], 8 * SEC, 0.7, 0.3)
        want |= {(b, r[1]): (k % 7, *d) for k, (r, d) in enumerate(zip(on, done, strict=True))}
    assert late == 0 and {(r.bag, r.seq): (r.step, r.closed, r.published) for r in got.collect()} == want


def test_a_batch_of_rows_costs_few_calls_of_the_state():
    """A key's rows of a batch are held as one value, and read again as they were."""
    import pandas as pd

    class State:
        def __init__(self):
            self.items = []

        def appendList(self, rows):
            self.items += rows

        def appendValue(self, row):
            self.items.append(row)

        def put(self, rows):
            self.items = list(rows)

        def get(self):
            return iter(self.items)

        def clear(self):
            self.items = []

    class One(State):
        def exists(self):
            return bool(self.items)

        def update(self, row):
            self.items = [row]

        def get(self):
            return self.items[0] if self.items else None

    class Handle:
        def getListState(self, name, schema):
            return State()

        def getValueState(self, name, schema):
            return One()

        def registerTimer(self, ms):
            pass

        deleteTimer = registerTimer

    class Times:
        def getCurrentWatermarkInMs(self):
            return 500

    fold = live.ModeGate(7)
    fold.init(Handle())
    rows = pd.DataFrame({"t_us": [k * 1000 for k in range(1000)], "seq": range(1000), "topic": ["a"] * 1000, "cmd": [1] + [0] * 999, "value": [0.5, None] * 500})
    list(fold.handleInputRows((3,), iter([rows[:600], rows[600:]]), Times()))
    assert len(fold.held.items) == 1
    [out] = fold.handleExpiredTimer((3,), Times(), None)
    assert out["seq"].tolist() == list(range(501)) and out["step"].tolist() == [k % 7 for k in range(501)] and out["value"].isna().sum() == 250
    assert len(fold.held.items) == 1 and len(live.unpacked(fold.held.items[0][0])) == 499
