"""Queries of the streaming operators, run over the tables as streams or in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segment
from ..streaming import live, stream
from .fixtures import TABLES
from .eval_queries import LIMITED
from .log_queries import EPISODES, HOUR, LEAST
from .registry import query


def streamed(t, name: str):
    """A fixture over its base table as a stream."""
    base, (columns, _) = TABLES[name]
    path = f"{t.sf_dir}/{base}.parquet"
    return stream.read(t.spark, path, t.spark.read.parquet(path).schema).selectExpr(*columns)


LATE = "48 hours"


def replayed(rows, *builds):
    """Tables of streams over a fixture as a live log whose rows come up to two days late."""
    return [table for table, _ in live.replay(rows, list(builds), files=2, disorder_us=48 * HOUR)]


@query("T1_stream_episodes", "select bag, start_us, stop_us from all_episodes", "messages", also=EPISODES)
def stream_episodes(t):
    markers = t("messages").where("cmd is not null").select("bag", "seq", "t_us", "cmd")
    return stream.net_episodes(*replayed(markers, lambda log: live.episode_changes(log, LATE)))


@query("T2_latest_per_slot", f"select t_us // {HOUR} * {HOUR} as slot_us, bag, topic, arg_max(value, seq) as value from messages group by 1, 2, 3", "messages")
def latest_per_slot(t):
    return replayed(t("messages").drop("cmd"), lambda log: stream.latest_per_slot(log.withColumn("ts", F.timestamp_micros("t_us")), "1 hour", LATE))[0]


@query(
    "T2_latest_carried",
    f"""select g.bag, g.s * {HOUR} as slot_us, m.topic, arg_max(m.value, m.t_us * 1000000000 + m.seq) as value
       from (select bag, unnest(range(min(t_us) // {HOUR}, max(t_us) // {HOUR})) as s from messages group by bag) g
       join (select bag, seq, t_us::hugeint as t_us, topic, value from messages) m on m.bag = g.bag and m.t_us < (g.s + 1) * {HOUR} group by all""",
    "messages",
)
def latest_carried(t):
    return stream.run_available(stream.carried_forward(streamed(t, "messages"), HOUR))


@query("T3_stream_hysteresis", "select rw.robot, rw.seq, st.closed, st.published from st join rw on rw.robot = st.robot and rw.n = st.n", "logits", also=LIMITED)
def stream_hysteresis(t):
    return stream.run_available(stream.limited_hysteresis(streamed(t, "logits"), least_us=HOUR, close=0.55))


@query("T4_stream_frame_rate", "select robot, block, round(1 / avg(sec), 4) as hz from (select *, (row_number() over (partition by robot order by seq) - 1) // 30 as block from latency) group by 1, 2 having count(*) = 30", "latency")
def stream_frame_rate(t):
    rows = stream.run_available(stream.frame_rate(streamed(t, "latency").select("robot", "seq", "sec")))
    return rows.select("robot", "block", F.round("hz", 4).alias("hz"))


@query(
    "T5_readiness",
    """select m.bag, m.seq, m.topic, m.value from messages m join (select bag, greatest(min(t_us) filter (topic = 'click'), min(t_us) filter (topic = 'view'), min(t_us) filter (topic = 'control')) as r from messages group by 1) g
       on m.bag = g.bag and m.t_us >= g.r""",
    "messages",
)
def readiness(t):
    return stream.ready_rows(t("messages"), ["click", "view", "control"]).select("bag", "seq", "topic", "value")


@query(
    "T6_mode_gate",
    """select bag, seq, (row_number() over (partition by bag order by t_us, seq) - 1) % 100 as step from
       (select *, last_value(case when cmd in (1, 2) then cmd end ignore nulls) over (partition by bag order by t_us, seq rows between unbounded preceding and current row) as mode from messages) where mode = 1 and topic <> 'control'""",
    "messages",
)
def mode_gate(t):
    return stream.run_available(stream.gated_stream(streamed(t, "messages"), 100))


_CHAIN = """rd as (select m.* from messages m join (select bag, greatest(min(t_us) filter (topic = 'click'), min(t_us) filter (topic = 'view'), min(t_us) filter (topic = 'control')) as r from messages group by 1) g on m.bag = g.bag and m.t_us >= g.r),
on_ as (select * from (select *, last_value(case when cmd in (1, 2) then cmd end ignore nulls) over (partition by bag order by t_us, seq rows between unbounded preceding and current row) as mode from rd) where mode = 1 and topic <> 'control'),
rw as materialized (select bag, seq, t_us, value / 100 as p, row_number() over (partition by bag order by t_us, seq) as n from on_),
st as (select bag, n, false as closed, t_us as last, false as published from rw where n = 1
  union all select bag, n, case when go then not closed else closed end, case when go then t_us else last end, go from
    (select rw.*, st.closed, st.last, (case when st.closed then p < 0.3 else p > 0.55 end) and rw.t_us - st.last > 3600000000 as go from st join rw on rw.bag = st.bag and rw.n = st.n + 1))"""


@query("T5_gated_hand", "select rw.bag, rw.seq, (rw.n - 1) % 100 as step, st.closed, st.published from st join rw on rw.bag = st.bag and rw.n = st.n", "messages", also=_CHAIN)
def gated_hand(t):
    """Readiness, mode gate and limited hysteresis chained in one running query."""
    rows = t("messages").withColumn("value", F.col("value") / 100)
    return replayed(rows, lambda log: live.gated_hand(log, LATE, ["click", "view", "control"], 100, HOUR, 0.55, 0.3))[0]


@query("T4_latency_summary", f"select robot, t_us // {24 * HOUR} * {24 * HOUR} as from_us, count(*) as n, round(sum(sec), 5) as total, max(sec) as most from latency group by 1, 2", "latency")
def latency_summary(t):
    rows = replayed(t("latency"), lambda log: stream.latency_summary(log.withColumn("ts", F.timestamp_micros("t_us")), LATE))[0]
    return rows.select("robot", "from_us", "n", F.round(F.col("mean") * F.col("n"), 5).alias("total"), "most")


@query(
    "T7_stream_grace",
    f"""select bag, seq, topic, value, (select min(e.episode_id) from episodes e where m.bag = e.bag and m.t_us >= e.start_us and m.t_us < e.stop_us + {LEAST}) as episode_id
       from messages m where exists (select 1 from episodes e where m.bag = e.bag and m.t_us >= e.start_us and m.t_us < e.stop_us + {LEAST})""",
    "messages",
    also=EPISODES,
)
def stream_grace(t):
    changes = lambda log: live.episode_changes(log.select("bag", "seq", "t_us", "cmd"), LATE)
    joined = lambda log: live.grace_rows(log.drop("cmd"), changes(log), LATE, LEAST, 90 * 24 * HOUR, LEAST)
    rows, log = replayed(t("messages"), joined, changes)
    # the changelog on its own says which commits were taken back
    return live.net_grace(rows, segment.keep_long(stream.net_episodes(log), LEAST), LEAST).select("bag", "seq", "topic", "value", "episode_id")
