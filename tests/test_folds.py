"""Sequential semantics on hand-made cases, and properties that must hold."""

import bisect
import itertools
import math
import random

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rigspan.functions import geometry as geo
from rigspan.operators import evaluate, predict, samples, scan, segment, sync
from rigspan.plans import catalog, eval_queries
from rigspan.streaming import stream


def marker_fold(cmds):
    """The marker machine, restated."""
    current, live = None, []
    for t, c in enumerate(cmds):
        if c == 1 and current is None:
            current = t
        elif c == 2 and current is not None:
            live.append((current, t))
            current = None
        elif c == 3:
            current = None
        elif c == 4 and current is None and live:
            live.pop()
    return live


CASES = [[1, 1, 2], [1, 3, 2], [1, 2, 4], [4], [1, 2, 1, 4, 2], [1, 2, 1, 2, 4, 4], [1, 2, 1, 3, 4], [1], [9, 1, 9, 2]]


def test_marker_machine(spark):
    rng = random.Random(3)
    logs = CASES + [[rng.choice([1, 1, 2, 2, 3, 4, 9]) for _ in range(rng.randint(0, 25))] for _ in range(150)]
    rows = [(b, t, t, c) for b, log in enumerate(logs) for t, c in enumerate(log)]
    df = spark.createDataFrame(rows, "bag long, seq long, t_us long, cmd int")
    for parts in (1, 7):
        got = {}
        for r in segment.control_episodes(df.repartition(parts)).orderBy("bag", "episode_id").collect():
            got.setdefault(r.bag, []).append((r.start_us, r.stop_us))
        assert got == {b: marker_fold(log) for b, log in enumerate(logs) if marker_fold(log)}


def test_time_repair():
    assert segment.repair([0, 10], [1, 11], [2, 12], 1) == [(0, 1, 2), (10, 11, 12)]
    assert segment.repair([0, 10], [11], [2, 12], 1) == [(0, 1, 2), (10, 11, 12)]  # pause missing: end less a tick
    assert segment.repair([0, 1, 10], [3, 11], [5, 12], 1) == [(0, 3, 5), (10, 11, 12)]  # start within an episode
    assert segment.repair([0, 10], [1], [2], 1) == [(0, 1, 2)]  # lists run out
    assert segment.repair([], [1], [2, 3], 1) == []


def test_time_repair_by_searching():
    """The same episodes by looking up, for every start, the next pause and end not used yet."""

    def searched(starts, pauses, ends, tick):
        out, used_p, used_e, over = [], 0, 0, 0
        for s in starts:
            if out and s < over:
                continue
            p = max(used_p, bisect.bisect_left(pauses, s))
            e = max(used_e, bisect.bisect_left(ends, s))
            if p >= len(pauses) or e >= len(ends):
                return out
            over, used_e = ends[e], e + 1
            early = pauses[p] <= over
            out.append((s, pauses[p] if early else over - tick, over))
            used_p = p + early
        return out

    rng = random.Random(7)
    for _ in range(4000):
        wide = rng.choice([6, 40])
        a, b, c = (sorted(rng.randint(0, wide) for _ in range(rng.randint(0, 7))) for _ in range(3))
        if not len(a) == len(b) == len(c):
            assert segment.repair(a, b, c, 1) == searched(a, b, c, 1), (a, b, c)


def hold(ticks, closes, opens):
    """Hand state per tick, row by row: each state waits for the next event that ends it; stale ones are used late."""
    waiting, state = [list(closes), list(opens)], 0
    for t in ticks:
        if waiting[state] and waiting[state][0] < t:
            waiting[state].pop(0)
            state = 1 - state
        yield state


def test_hand_hold_in_blocks(spark):
    rng = random.Random(8)
    cases = [tuple(sorted(rng.sample(range(60), rng.randint(0, 14))) for _ in range(3)) for _ in range(60)]
    cases += [([0, 1, 2, 3], [1], []), ([1, 2, 3, 4], [0, 0], [0]), ([1, 2], [], [0])]
    rows = [(e, kind, t) for e, lists in enumerate(cases) for kind, times in zip(("tick", "close", "open"), lists, strict=True) for t in times]
    df = spark.createDataFrame(rows, "episode_id long, kind string, t_us long")
    want = {(e, t): h for e, (ticks, closes, opens) in enumerate(cases) for t, h in zip(ticks, hold(ticks, closes, opens), strict=True)}
    for width in (7, 1000):  # an episode in many blocks, and in one
        assert {(r.episode_id, r.t_us): r.hand for r in segment.hold_state(df, width).collect()} == want


def test_limited_hysteresis_in_blocks(spark):
    """Blocks shorter and longer than the rate limit, ties, blocks without a change: all equal the rule row by row."""
    rng = random.Random(13)
    rows = [(r, k, t, rng.choice([-3.0, 0.0, 0.0, 3.0]) if r % 2 else rng.uniform(-3, 3)) for r in range(6) for k, t in enumerate(sorted(rng.choices(range(900), k=150)))]
    df = spark.createDataFrame(rows, "robot long, seq long, t_us long, x double")
    for least, width in ((60, 25), (60, 400), (0, 50), (60, 5000)):
        want = {}
        for r in range(6):
            own = [x for x in rows if x[0] == r]
            done, _ = predict.limited([x[2] for x in own], [1 / (1 + math.exp(-x[3])) for x in own], least, 0.7, 0.3)
            want |= {(r, x[1]): d for x, d in zip(own, done, strict=True)}
        got = {(r.robot, r.seq): (r.closed, r.published) for r in predict.limited_hysteresis(df, least, width=width).collect()}
        assert got == want, (least, width)


def test_scans_in_blocks(spark):
    """Running sums, last rows and neighbours across block borders, gaps of blocks included."""
    rng = random.Random(14)
    rows = [(k, s, rng.choice([None, 1.0, 2.5, -3.0]), rng.randint(1, 5)) for k in range(3) for s in sorted(rng.sample(range(300), 70))]
    df = spark.createDataFrame(rows, "k long, s long, v double, n long")
    for width in (3, 40, 10_000):
        sums = {(r.k, r.s): r.t for r in scan.running_sums(df, ["k"], ["s"], width, {"t": F.col("n")}).collect()}
        near = {(r.k, r.s): list(r.l) for r in scan.last_rows(df, ["k"], ["s"], width, "n", 6, "l").collect()}
        sides = {(r.k, r.s): (r.b, r.a) for r in scan.around(df, ["k"], ["s"], width, F.col("v"), "b", "a").collect()}
        for k in range(3):
            own = [r for r in rows if r[0] == k]
            for i, r in enumerate(own):
                before = [x[2] for x in own[: i + 1] if x[2] is not None]
                after = [x[2] for x in own[i:] if x[2] is not None]
                assert sums[k, r[1]] == sum(x[3] for x in own[: i + 1])
                assert near[k, r[1]] == [x[3] for x in own[max(0, i - 5) : i + 1]]
                assert sides[k, r[1]] == (before[-1] if before else None, after[0] if after else None)


def test_weighted_meters_in_blocks(spark):
    rng = random.Random(15)
    rows = [(0, s, rng.uniform(0, 9), rng.randint(1, 7)) for s in range(130)]
    df = spark.createDataFrame(rows, "run long, seq long, value double, n long")
    for r in evaluate.rolling(df, ["run"], ["seq"], "value", size=20, weight="n", width=11).collect():
        own = rows[: r.seq + 1]
        last = sorted(x[2] for x in own[-20:])
        assert r.overall == pytest.approx(sum(x[2] * x[3] for x in own) / sum(x[3] for x in own))
        assert (r.median, r.highest, r.latest) == (last[(len(last) - 1) // 2], last[-1], own[-1][2])
        assert r["mean"] == pytest.approx(sum(last) / len(last))


def test_grace_keeps_repeated_rows(spark):
    """Every message goes once, to its first episode; equal ones stay apart."""
    rng = random.Random(9)
    cuts = [sorted(rng.sample(range(300), 14)) for _ in range(3)]
    eps = [(b, k, c[2 * k], c[2 * k + 1]) for b, c in enumerate(cuts) for k in range(7)]
    msgs = [(rng.randint(0, 2), 1, rng.randint(0, 330), "a", 1.0) for _ in range(400)]
    m = spark.createDataFrame(msgs + msgs[:50], "bag long, seq long, t_us long, topic string, value double")
    e = spark.createDataFrame(eps, "bag long, episode_id long, start_us long, stop_us long")
    got = sorted((r.bag, r.t_us, r.episode_id) for r in sync.interval_join(m, e, grace_us=25, cell_us=40).collect())
    want = sorted((b, t, min(x)) for b, _, t, _, _ in msgs + msgs[:50] if (x := [k for eb, k, s, u in eps if eb == b and s <= t < u + 25]))
    assert got == want


def test_as_of_by_searching(spark):
    rng = random.Random(10)
    ticks = [(k, i, rng.randint(0, 60)) for k in range(3) for i in range(20)]
    data = [(rng.randint(0, 2), rng.choice("ab"), rng.randint(0, 60), q, float(q)) for q in range(90)]
    out = sync.as_of(
        spark.createDataFrame(ticks, "k long, i long, g_us long"),
        spark.createDataFrame(data, "k long, topic string, t_us long, seq long, value double"),
        {"a": "next", "b": "last"},
        ["k"],
    )
    sliced = [
        sync.as_of_sliced(
            spark.createDataFrame(ticks, "k long, i long, g_us long"),
            spark.createDataFrame(data, "k long, topic string, t_us long, seq long, value double"), {"a": "next", "b": "last"}, ["k"], width, fail_empty=True,
        ).collect()
        for width in (1, 9, 1000)
    ]
    assert all(sorted(map(tuple, s)) == sorted(map(tuple, out.collect())) for s in sliced)
    for r in out.collect():
        rows = lambda topic, r=r: sorted((t, q, v) for k, x, t, q, v in data if k == r.k and x == topic)
        later = [v for t, _, v in rows("a") if t >= r.g_us] or [rows("a")[-1][2]]
        sooner = [v for t, _, v in rows("b") if t <= r.g_us] or [0.0]
        assert (r.a, r.b) == (later[0], sooner[-1])


def test_streams_over_batches_equal_their_batch_form(spark, tmp_path):
    rng = random.Random(11)
    rows = pd.DataFrame([(rng.randint(0, 3), s, s * 7, rng.choice(["a", "b", "control"]), rng.choice([None, None, 1.0, 2.0]), float(s)) for s in range(200)], columns=["bag", "seq", "t_us", "topic", "cmd", "value"])
    for k, (lo, hi) in enumerate(itertools.pairwise([0, 50, 51, 140, 200])):
        rows[lo:hi].to_parquet(tmp_path / f"m-{k}.parquet")
    df = spark.createDataFrame(rows).withColumn("cmd", F.when(F.isnan("cmd"), None).otherwise(F.col("cmd")))
    live = lambda f: stream.run_available(f(stream.read(spark, str(tmp_path), df.schema)))
    want = {tuple(r) for r in stream.gated_steps(df, 5).select("bag", "seq", "step").collect()}
    assert {tuple(r) for r in live(lambda s: stream.gated_stream(s, 5)).collect()} == want
    got = {(r.bag, r.slot_us, r.topic): r.value for r in live(lambda s: stream.carried_forward(s, 100)).collect()}
    held = {}
    for b in range(4):
        own = [r for r in rows.itertuples() if r.bag == b]
        for s in range(own[0].t_us // 100, own[-1].t_us // 100):
            held |= {(b, s * 100, r.topic): r.value for r in own if r.t_us < (s + 1) * 100}
    assert got == held


def test_an_empty_mandatory_stream_raises(spark):
    ticks = spark.createDataFrame([(0, 0, 10), (1, 0, 10)], "k long, i long, g_us long")
    data = spark.createDataFrame([(0, "a", 50, 1, 1.0), (1, "b", 5, 2, 2.0)], "k long, topic string, t_us long, seq long, value double")
    missing = sync.empty_streams(ticks.select("k"), data, ["a", "b"], ["k"]).collect()
    assert sorted(map(tuple, missing)) == [(0, "b"), (1, "a")]
    assert sync.as_of_sliced(ticks, data, {"b": "last"}, ["k"], 20, fail_empty=True).count() == 2  # the one with a default may be empty
    with pytest.raises(Exception, match="no message of topic a in k 1"):
        sync.as_of_sliced(ticks, data, {"a": "next"}, ["k"], 20, fail_empty=True).collect()


def test_a_hot_episode_runs_in_many_tasks(spark):
    """One episode; no task sees more than a few slices of it."""
    ticks = spark.range(40_000).selectExpr("0L as k", "id as i", "id * 10 as g_us")
    data = spark.range(60_000).selectExpr("0L as k", "if(id % 3 = 0, 'a', 'b') as topic", "id * 7 as t_us", "id as seq", "id * 1.0D as value")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = sync.as_of_sliced(ticks, data, {"a": "next", "b": "last"}, ["k"], 2_000)
        sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        got = out.agg(F.sum("a"), F.sum("b"), F.count("*")).first()
        want = sync.as_of(ticks, data, {"a": "next", "b": "last"}, ["k"]).agg(F.sum("a"), F.sum("b"), F.count("*")).first()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == want and len(sizes) == 4 and max(sizes) < 2 * 40_000 / 4


def test_as_of_edges(spark):
    ticks = spark.createDataFrame([(0, 0, 10), (0, 1, 20), (0, 2, 99)], "k long, i long, g_us long")
    data = spark.createDataFrame(
        [(0, "a", 10, 1, 1.0), (0, "a", 15, 2, 2.0), (0, "a", 15, 3, 3.0), (0, "b", 20, 4, 7.0)],
        "k long, topic string, t_us long, seq long, value double",
    )
    out = sync.as_of(ticks, data, {"a": "next", "b": "last"}, ["k"]).orderBy("i").collect()
    assert [(r.a, r.b) for r in out] == [(1.0, 0.0), (3.0, 7.0), (3.0, 7.0)]  # at the tick, clamp, default


def test_shift_and_previous(spark):
    rows = spark.createDataFrame([(0, i, float(i)) for i in range(4)] + [(1, 0, 9.0)], "k long, i long, v double")
    out = sync.shift_ahead(rows, 3, "v", ["k"], "i", "a")
    assert {(r.k, r.i): r.a for r in out.collect()} == {(0, 0): 3.0, (0, 1): 3.0, (0, 2): 3.0, (0, 3): 3.0, (1, 0): 9.0}
    out = sync.previous(rows, "v", ["k"], "i", "a")
    assert {(r.k, r.i): r.a for r in out.collect()}[(0, 0)] == 0.0


def test_joins_have_no_nested_loop(spark, capsys):
    m = spark.createDataFrame([(0, 1, 5, "a", 1.0)], "bag long, seq long, t_us long, topic string, value double")
    e = spark.createDataFrame([(0, 0, 1, 9)], "bag long, episode_id long, start_us long, stop_us long")
    for df in (sync.interval_join(m, e), sync.interval_join(m, e, grace_us=4), sync.as_of(sync.grid(e, 2), sync.interval_join(m, e), {"a": "next"}, ["bag", "episode_id"])):
        df.explain()
        plan = capsys.readouterr().out
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert df.count() > 0


def test_limited_hysteresis_batch_equals_stream(spark, tmp_path):
    assert predict.limited([0, 1], [0.7, 0.3], 0, 0.7, 0.3)[0] == [(False, False), (False, False)]  # thresholds themselves do nothing
    done, _ = predict.limited([0, 10, 11, 30], [0.9, 0.9, 0.1, 0.1], 5, 0.7, 0.3)
    assert done == [(False, False), (True, True), (True, False), (False, True)]
    rng = random.Random(1)
    rows = pd.DataFrame([(r, i, i * 100, rng.uniform(-3, 3)) for i in range(120) for r in range(3)], columns=["robot", "seq", "t_us", "x"])
    for k, part in enumerate((rows[:100], rows[100:101], rows[101:])):
        part.to_parquet(tmp_path / f"part-{k}.parquet")
    df = spark.createDataFrame(rows)
    want = {(r.robot, r.seq): (r.closed, r.published) for r in predict.limited_hysteresis(df, 150).collect()}
    live = stream.run_available(stream.limited_hysteresis(stream.read(spark, str(tmp_path), df.schema), 150))
    assert {(r.robot, r.seq): (r.closed, r.published) for r in live.collect()} == want


def test_smoothing_equals_pandas(spark):
    values, lead = [None, None, None, 1.0, None, 3.0, 2.0, None, None, 7.0, None], 3
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "run long, epoch long, value double")
    want = pd.Series(values).interpolate().ewm(com=2).mean().tolist()
    for width in (1, 2, 100):
        got = [r.smooth for r in evaluate.smoothed(df, 2, width).orderBy("epoch").collect()]
        assert got[lead:] == pytest.approx(want[lead:]) and got[:lead] == [None] * lead


def test_split_needs_two(spark):
    with pytest.raises(ValueError, match="two episodes"):
        samples.splits(spark.createDataFrame([(1,)], "episode_id long"), 3)
    two = samples.splits(spark.createDataFrame([(1,), (2,)], "episode_id long"), 3).collect()
    assert sorted((r.trial, r.part) for r in two) == [(t, p) for t in range(3) for p in ("train", "val")]


def test_chunks_and_batches(spark):
    steps = spark.createDataFrame([(0, i, [float(i)]) for i in range(3)], "episode_id long, step long, action array<double>")
    last = samples.chunks(steps, "action", 4, 1).where("start_ts = 2").first()
    assert last.actions == [[2.0], [0.0], [0.0], [0.0]] and last.is_pad == [False, True, True, True]
    ids = spark.range(100)
    for parts in (1, 5):
        out = samples.shuffled_batches(ids.repartition(parts), "id", 32, 1, 0, range_rows=30).orderBy("position").collect()
        assert [r.position for r in out] == list(range(100)) and [r.batch for r in out][-1] == 3
        first = [r.id for r in out] if parts == 1 else first  # noqa: F821
        assert [r.id for r in out] == first


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=7, max_size=7).filter(lambda v: sum(x * x for x in v[3:]) > 0.05))
def test_transform_inverse(spark, v):
    m = geo.matrix(*[F.lit(x) for x in v])
    unit = spark.range(1).select(geo.compose(geo.inverse(m), m).alias("u"), geo.quaternion(m).alias("q")).first()
    assert unit.u == pytest.approx([1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], abs=1e-9)
    n = sum(x * x for x in v[3:]) ** 0.5 * (-1 if v[6] < 0 else 1)
    assert [abs(x) for x in unit.q] == pytest.approx([abs(x / n) for x in v[3:]], abs=1e-6)


def test_box_pairs(spark):
    boxes = [(0, 0, 0.0, 0.0, 1.0, 1.0), (0, 1, 2.0, 0.0, 3.0, 1.0), (0, 2, 1.0, 0.0, 2.0, 1.0), (0, 3, 5.0, 5.0, 4.0, 6.0)]
    df = spark.createDataFrame(boxes, "g long, id long, x0 double, y0 double, x1 double, y1 double")
    out = {(r.a, r.b): r for r in evaluate.box_pairs(df, df, "g").collect()}
    assert len(out) == 9  # the inverted box is refused
    assert out[0, 0].iou == 1 and out[0, 0].giou == 1
    assert out[0, 1].iou == 0 and out[0, 1].giou == pytest.approx(-1 / 3)
    assert out[0, 2].iou == out[2, 0].iou == 0


def test_box_pairs_of_a_large_group_are_spread(spark):
    """One group of many boxes a side: all pairs, none in one task; overlapping ones by grid cells equal those with a share."""
    rng = random.Random(16)
    boxes = [(0, k, x, y, x + rng.choice([0.0, 0.05, 0.4]), y + 0.1) for k in range(300) for x, y in [(rng.uniform(-1, 1), rng.uniform(-1, 1))]]
    df = spark.createDataFrame(boxes, "g long, id long, x0 double, y0 double, x1 double, y1 double")
    pairs = evaluate.box_pairs(df, df, "g", block=40)
    assert pairs.count() == 300 * 300 and pairs.select("a", "b").distinct().count() == 300 * 300
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r.n for r in evaluate.box_pairs(df, df, "g", block=40).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 90_000 / 2
    want = {(r.a, r.b): r.iou for r in pairs.where("iou > 0").collect()}
    for cell in (0.07, 5.0):
        rows = evaluate.overlapping_pairs(df, df, "g", cell).collect()
        assert {(r.a, r.b): r.iou for r in rows} == want and len(rows) == len(want)


def test_box_pairs_are_dealt_by_what_they_make(spark):
    """Adaptive execution sees few bytes: the pairs are spread all the same, in tasks of about ``rows``, small groups behind large ones."""
    sides = {0: (300, 200), 1: (90, 41), 2: (1, 1), 3: (5, 0)} | {g: (7, 9) for g in range(10, 200)}
    make = lambda k: [(g, j, float(j), 0.0, j + 1.0, 1.0) for g, n in sides.items() for j in range(n[k])]
    left, right = (spark.createDataFrame(make(k), "g long, id long, x0 double, y0 double, x1 double, y1 double") for k in (0, 1))
    want = sum(a * b for a, b in sides.values())
    for given_, least in (({}, 4), ({"rows": 5000}, -(-want // 5000))):
        pairs = evaluate.box_pairs(left, right, "g", block=40, **given_)
        sizes = [r.n for r in pairs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == want == pairs.select("g", "a", "b").distinct().count()
        assert len(sizes) == least and max(sizes) < 1.5 * want / least
    none = evaluate.box_pairs(left.where("g = 3"), right, "g")
    assert none.count() == 0


def test_generalised_iou_rows_of_a_task_are_in_the_order_of_the_value(spark):
    rows = catalog.QUERIES["J10_generalised_iou"](spark, "/root/testdata/sf0.01").withColumn("p", F.spark_partition_id()).collect()
    assert rows == sorted(rows, key=lambda r: (r.p, r.giou)) and len(rows) == 6171


def test_millionths_round_as_sql_does(spark):
    rng = random.Random(4)
    values = [None, math.nan, math.inf, -math.inf, 0.0, -1e-9, 1e300, 0.1234565, -0.1234565, 1.0000005, 0.0000025, -0.9999995, 0.49999999999999994e-6]
    values += [rng.uniform(-1, 1) for _ in range(500)] + [(k + 0.5) / 1e6 for k in rng.sample(range(-10**6, 10**6), 500)]
    out = [r.x for r in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(eval_queries.millionths("x")).collect()]
    want = [duckdb.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values]
    assert [str(x) if x != x else x for x in out] == [str(x) if x is not None and x != x else x for x in want]


def test_ranges_of_clustered_ids_are_even(spark, monkeypatch):
    """Ids in two far clusters: the order is right and no range holds over twice the mean."""
    held = []
    write = samples.written
    monkeypatch.setattr(samples, "written", lambda df: held.append(write(df)) or held[-1])
    ids = spark.range(6000).selectExpr("if(id % 3 = 0, id, id + 1000000000000) as id")
    got = [(r.id, r.at) for r in samples.sorted_index(ids, "id", range_rows=500).collect()]
    assert sorted(got) == [(k, i) for i, k in enumerate(sorted(r.id for r in ids.collect()))]
    sizes = [r.n for r in held[0].groupBy("__r").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 6000 and len(sizes) == 12 and max(sizes) <= 2 * 500


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "scores array<double>, target long")
    assert [r.accuracy for r in evaluate.top_k_accuracy(none, [1, 5]).collect()] == [0.0, 0.0]


def test_synchronise_and_shift_share_one_exchange(spark):
    ticks = spark.range(10).selectExpr("id % 2 as k", "id as i", "id * 10 as g_us")
    data = spark.range(50).selectExpr("id % 2 as k", "if(id % 3 = 0, 'a', 'b') as topic", "id as t_us", "id as seq", "id * 1.0D as value")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = sync.as_of(ticks, data, {"a": "next", "b": "last"}, ["k"])
        rows = sync.shift_ahead(rows, 3, "a", ["k"], "i", "action")
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_folds_of_many_small_blocks_share_batches(spark):
    """No call per group: groups come many to a batch, and go on over batches of three rows."""
    rng = random.Random(8)
    rows = [(r, k, rng.randrange(3000), rng.uniform(-3, 3)) for r in range(12) for k in range(rng.randint(1, 25))]
    rows += [(None, 1, 5, 1.0), (3, 99, None, 1.0)]
    df = spark.createDataFrame(rows, "robot long, seq long, t_us long, x double")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for most in ("3", before):
        spark.conf.set(name, most)
        try:
            out = predict.limited_hysteresis(df, least_us=200, close=0.55, width=500)
            assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
            got = {(r.robot, r.seq): (r.closed, r.published) for r in out.collect()}
        finally:
            spark.conf.set(name, before)
        want = {}
        for robot in range(12):
            own = sorted((t, s, 1 / (1 + math.exp(-x))) for r, s, t, x in rows if r == robot and t is not None)
            done, _ = predict.limited([t for t, _, _ in own], [p for _, _, p in own], 200, 0.55, 0.3)
            want |= {(robot, s): d for (_, s, _), d in zip(own, done, strict=True)}
        assert got == want
