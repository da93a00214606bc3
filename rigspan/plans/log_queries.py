"""Queries from message logs to synchronised episodes: sources, segmentation, joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import samples, segment, sync
from ..sources import store
from ..sources import tables as src
from .registry import Tables, query

HOUR = 3_600_000_000
LEAST = 4 * HOUR

EPISODES = f"""
mk as (select * from messages where cmd between 1 and 4),
mc as (select *, max(case when cmd in (2, 3) then seq end) over (partition by bag order by t_us, seq rows between unbounded preceding and 1 preceding) as closed from mk),
ms as (select *, min(case when cmd = 1 then t_us end) over (partition by bag, coalesce(closed, -1) order by t_us, seq rows between unbounded preceding and 1 preceding) as start_us from mc),
mt as (select *, case when cmd = 2 and start_us is not null then 1 when cmd = 4 and start_us is null then -1 else 0 end as step from ms),
mw as (select *, sum(step) over (partition by bag order by t_us, seq rows unbounded preceding) as walk from mt where step <> 0),
mh as (select *, walk - least(0, min(walk) over (partition by bag order by t_us, seq rows unbounded preceding)) as height from mw),
ml as (select *, min(height) over (partition by bag order by t_us, seq rows between current row and unbounded following) as low from mh),
all_episodes as (select bag, row_number() over (partition by bag order by t_us, seq) - 1 as episode_id, start_us, t_us as stop_us from ml where step = 1 and low >= height),
episodes as (select bag, row_number() over (partition by bag order by start_us) - 1 as episode_id, start_us, stop_us from all_episodes where stop_us - start_us >= {LEAST})
"""
GRID = EPISODES + f""",
ticks as (select bag, episode_id, i, start_us + i * {HOUR} as g_us from (select *, unnest(range(0, (stop_us - start_us) // {HOUR} + 1)) as i from episodes)),
inside as (select m.bag, m.seq, m.t_us, m.topic, m.value, e.episode_id from messages m join episodes e on m.bag = e.bag and m.t_us between e.start_us and e.stop_us)
"""


def episodes(t: Tables) -> DataFrame:
    return segment.keep_long(segment.control_episodes(t("messages").select("bag", "seq", "t_us", "cmd")), LEAST)


def ticks(t: Tables) -> DataFrame:
    return sync.grid(episodes(t), HOUR)


def inside(t: Tables) -> DataFrame:
    return sync.interval_join(t("messages").drop("cmd"), episodes(t), cell_us=24 * HOUR)


KEYS = ["bag", "episode_id"]
MANDATORY = ["click", "view"]
TOPICS = {"click": "next", "view": "next", "purchase": "last", "error": "last"}


def synchronised(t: Tables) -> DataFrame:
    return sync.as_of(ticks(t), inside(t), TOPICS, ["bag", "episode_id"])


def _next_sql(topic: str) -> str:
    return f"""coalesce((select arg_min(m.value, (m.t_us, m.seq)) from inside m where m.bag = g.bag and m.episode_id = g.episode_id and m.topic = '{topic}' and m.t_us >= g.g_us),
      (select arg_max(m.value, (m.t_us, m.seq)) from inside m where m.bag = g.bag and m.episode_id = g.episode_id and m.topic = '{topic}')) as {topic}"""


def _last_sql(topic: str) -> str:
    return f"coalesce((select arg_max(m.value, (m.t_us, m.seq)) from inside m where m.bag = g.bag and m.episode_id = g.episode_id and m.topic = '{topic}' and m.t_us <= g.g_us), 0.0) as {topic}"


SYNC = GRID + f""",
synced as (select bag, episode_id, i, g_us, {", ".join(_next_sql(k) if v == "next" else _last_sql(k) for k, v in TOPICS.items())} from ticks g)
"""


# --- sources ---------------------------------------------------------------


@query("S1_message_scan", "select bag, seq, t_us, topic, value from messages where topic in ('click', 'view') and value > 10", "messages")
def message_scan(t):
    return src.scan_messages(t("messages"), ["click", "view"]).where("value > 10").select("bag", "seq", "t_us", "topic", "value")


@query("S2_topic_inventory", "select topic, count(*) as n, min(t_us) as first_us, max(t_us) as last_us from messages group by topic", "messages")
def topic_inventory(t):
    return src.topic_inventory(t("messages"))


@query(
    "S3_required_topics",
    """select b.bag, r.topic as missing from (select distinct bag from messages) b, (select unnest(['control', 'click', 'lidar']) as topic) r
       where not exists (select 1 from messages m where m.bag = b.bag and m.topic = r.topic)""",
    "messages",
)
def required_topics(t):
    return src.missing_topics(t("messages"), ["control", "click", "lidar"])


@query(
    "S4_output_name",
    "select name, count(*) as n from (select regexp_extract(concat('/data/', event_type, '/bag_', cast(user_id % 10 as varchar), '.db3'), '([^/]+?)(\\.[^./]*)?$', 1) as name from events) group by name",
)
def output_name(t):
    path = F.concat(F.lit("/data/"), "event_type", F.lit("/bag_"), (F.col("user_id") % 10).cast("string"), F.lit(".db3"))
    return t("events").select(src.output_name(path).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


_USED = "select user_id // 15 as bag, cast(floor(value) as bigint) as episode_id from events"


@query(
    "S5_next_free_index",
    f"""with u as (select distinct * from ({_USED})),
    c as (select bag, episode_id + 1 as free from u union select distinct bag, 5 from u)
    select bag, min(free) as next_free from c where free >= 5 and not exists (select 1 from u where u.bag = c.bag and u.episode_id = c.free) group by bag""",
)
def next_free_index(t):
    ids = t("events").selectExpr("user_id div 15 as bag", "cast(floor(value) as bigint) as episode_id")
    return segment.next_free_index(ids, 5)


_LONG = "select episode_id, step, dim - 1 as dim, round(qpos[dim], 6) as value from (select *, unnest(range(1, 9)) as dim from steps)"


def _long(df: DataFrame, column: str = "qpos", keys: tuple[str, ...] = ("episode_id", "step")) -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("dim", "value")).select(
        *keys, F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value")
    )


def stored(t: Tables) -> str:
    """The steps as a store: five episodes a bag, attributes from their length at 30 steps a second."""
    path = f"{src.shared_dir(t.spark)}/store-{uuid.uuid4().hex}"
    steps = t("steps").withColumn("bag", F.expr("episode_id div 5"))
    spans = steps.groupBy("bag", "episode_id").agg(F.lit(0).cast("long").alias("start_us"), F.expr("max(step) * 1000000 div 30").alias("stop_us"))
    joints = t("joints").select(F.expr("seq % 5 as bag"), "seq", "names")
    store.write_store(steps, store.episode_attributes(spans, joints), path)
    return path


@query("S6_episode_sink", _LONG, "steps")
def episode_sink(t):
    return _long(store.read_steps(t.spark, stored(t)))


@query(
    "S6_episode_meta",
    """select bag, episode_id, false as sim, 30 as fps, start_us, stop_us, list_aggregate(j.names, 'string_agg', ',') as joint_names, steps from
       (select episode_id // 5 as bag, episode_id, 0 as start_us, max(step) * 1000000 // 30 as stop_us, count(*) as steps from steps group by 1, 2) e
       left join (select seq % 5 as bag, arg_min(names, seq) as names from joints group by 1) j using (bag)""",
    "steps",
    "joints",
)
def episode_meta(t):
    return store.read_meta(t.spark, stored(t)).withColumn("joint_names", F.concat_ws(",", "joint_names"))


@query(
    "S6_log_attributes",
    """select e.bag, e.episode_id, false as sim, 30 as fps, start_us, stop_us, list_aggregate(j.names, 'string_agg', ',') as joint_names, (select count(*) from ticks k where k.bag = e.bag and k.episode_id = e.episode_id) as steps
       from episodes e left join (select bag, arg_min(names, seq) as names from joints group by 1) j using (bag)""",
    "messages",
    "joints",
    also=GRID,
)
def log_attributes(t):
    """From the log to a store: synchronised episodes as steps, with the attributes of their recording."""
    path = f"{src.shared_dir(t.spark)}/store-{uuid.uuid4().hex}"
    store.write_store(synchronised(t), store.episode_attributes(episodes(t), t("joints")), path, order="i")
    return store.read_meta(t.spark, path).withColumn("joint_names", F.concat_ws(",", "joint_names"))


@query("S7_episode_scan", _LONG + " where episode_id = 7", "steps")
def episode_scan(t):
    return _long(store.read_steps(t.spark, stored(t), bag=1, episode=7, fields=["qpos"]))


@query("S8_episode_slice", _LONG + " where episode_id = 7 and step between 3 and 9", "steps")
def episode_slice(t):
    return _long(store.read_steps(t.spark, stored(t), bag=1, episode=7, first=3, n=7, fields=["qpos"]))


@query("S9_dataset_listing", "select episode_id, count(*) as steps from steps group by episode_id", "steps")
def dataset_listing(t):
    return store.read_meta(t.spark, stored(t)).select("episode_id", "steps")


@query(
    "S10_structure",
    """select 'qpos' as field, count(*) as n, min(len(qpos)) as least, max(len(qpos)) as most from steps
       union all select 'action', count(*), min(len(action)), max(len(action)) from steps""",
    "steps",
)
def structure(t):
    return src.structure(t("steps"), ["qpos", "action"])


@query(
    "S11_episode_times",
    """select bag, episode_id, printf('%.6f', (start_us - t0) / 1e6) as start_s, printf('%.6f', (stop_us - t0) / 1e6) as stop_s
       from (select *, min(start_us) over (partition by bag) as t0 from episodes)""",
    "messages",
    also=EPISODES,
)
def episode_times(t):
    return src.time_offsets(episodes(t))


@query(
    "S11_time_reader",
    """select bag, episode_id, round(start_us / 1e6, 3) as start, round((start_us + (stop_us - start_us) // 2) / 1e6, 3) as pause, round(stop_us / 1e6, 3) as stop from episodes""",
    "messages",
    also=EPISODES,
)
def time_reader(t):
    paused = episodes(t).withColumn("pause_us", F.col("start_us") + F.expr("(stop_us - start_us) div 2"))
    path = f"{src.shared_dir(t.spark)}/times-{uuid.uuid4().hex}"
    src.time_lines(paused).write.partitionBy("bag").csv(path, sep="\t")
    lines = t.spark.read.schema("n long, text string, bag long").csv(path, sep="\t")
    rows = src.read_offsets(lines)
    return rows.select("bag", "episode_id", *[F.round(c, 3).alias(c) for c in ("start", "pause", "stop")])


@query(
    "S12_stats_check",
    """select r.field, case r.field when 'qpos' then (select max(len(qpos)) from steps) when 'action' then (select max(len(action)) from steps) else 0 end as width,
       r.field in ('qpos', 'action') as present from (select unnest(['qpos', 'action', 'example']) as field) r""",
    "steps",
)
def stats_check(t):
    stats = lambda c, n: samples.wide_statistics(t("steps"), c, n).withColumn("field", F.lit(c))
    return src.required_fields(stats("qpos", 8).unionByName(stats("action", 7)), ["qpos", "action", "example"])


@query(
    "S12_stats_store",
    """select field, dim - 1 as dim, round(avg(v[dim]), 6) as mean, round(greatest(stddev_samp(v[dim]), 0.01), 6) as std from
       (select 'qpos' as field, qpos as v, unnest(range(1, 9)) as dim from steps union all select 'action', action, unnest(range(1, 8)) from steps) group by 1, 2""",
    "steps",
)
def stats_store(t):
    path = f"{src.shared_dir(t.spark)}/stats-{uuid.uuid4().hex}"
    widths = {"qpos": 8, "action": 7}
    store.write_statistics({f: samples.wide_statistics(t("steps"), f, n) for f, n in widths.items()}, path)
    return store.read_statistics(t.spark, path, widths).select("field", "dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("S13_json_log", "select event_type as run, count(*) as n, sum(cast(props->>'k' as bigint))::bigint as total from events group by event_type")
def json_log(t):
    lines = t("events").select("event_type", "props")
    parsed = src.parse_log(lines, "props", "k long")
    return parsed.groupBy(F.col("event_type").alias("run")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("S13_run_logs", "select event_type as run, count(*) as n, sum(cast(props->>'k' as bigint))::bigint as total from events group by event_type")
def run_logs(t):
    path = f"{src.shared_dir(t.spark)}/logs-{uuid.uuid4().hex}"
    t("events").select(F.col("event_type").alias("run"), F.col("props").alias("value")).write.partitionBy("run").text(path)
    parsed = src.read_run_logs(t.spark, f"{path}/*", "k long")
    return parsed.groupBy("run").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query(
    "S14_task_lookup",
    """select t.task, t.model_dof::bigint as model_dof, count(distinct s.episode_id) as episodes, cast(floor(t.episode_len * 1.5) as bigint) as max_timesteps
       from steps s join (values (0, 'toy_circle_chase', 240, 2), (1, 'sim_transfer_cube_scripted', 400, 14), (2, 'real_panda_pick_n_place', 650, 8), (3, 'real_tocabi_place', 900, 14)) t(id, task, episode_len, model_dof)
       on s.episode_id % 4 = t.id group by 1, 2, t.episode_len""",
    "steps",
)
def task_lookup(t):
    names = F.element_at(F.array(*[F.lit(n) for n in ("toy_circle_chase", "sim_transfer_cube_scripted", "real_panda_pick_n_place", "real_tocabi_place")]), (F.col("episode_id") % 4 + 1).cast("int"))
    met = src.with_task(t("steps").withColumn("task", names), factor=1.5)
    return met.groupBy("task", F.col("model_dof").cast("long").alias("model_dof"), "max_timesteps").agg(F.countDistinct("episode_id").alias("episodes"))


@query("S15_rollout_log", "select robot, count(*) as n, round(avg(sec), 6) as mean_sec from latency group by robot", "latency")
def rollout_log(t):
    path = f"{src.shared_dir(t.spark)}/rollout-{uuid.uuid4().hex}"
    src.append_log(t("latency"), path)
    return t.spark.read.parquet(path).groupBy("robot").agg(F.count("*").alias("n"), F.round(F.avg("sec"), 6).alias("mean_sec"))


@query(
    "S16_scenarios",
    """select rollout, round(0.0 + 0.2 * ('0x' || substr(md5('7:' || rollout || ':x'), 1, 8))::bigint / 4294967296, 6) as x,
       round(0.4 + 0.2 * ('0x' || substr(md5('7:' || rollout || ':y'), 1, 8))::bigint / 4294967296, 6) as y from (select distinct rollout from rewards)""",
    "rewards",
)
def scenarios(t):
    made = src.scenarios(t("rewards").select("rollout").distinct(), "rollout", {"x": (0.0, 0.2), "y": (0.4, 0.6)}, seed=7)
    return made.select("rollout", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# --- segmentation and grids ------------------------------------------------


@query("W1_episode_segmentation", "select * from all_episodes", "messages", also=EPISODES)
def episode_segmentation(t):
    return segment.control_episodes(t("messages").select("bag", "seq", "t_us", "cmd"))


@query("P29_duration_filter", "select * from episodes", "messages", also=EPISODES)
def duration_filter(t):
    return episodes(t)


@query("T0b_max_episodes", "select * from episodes where episode_id < 2", "messages", also=EPISODES)
def max_episodes(t):
    return episodes(t).where("episode_id < 2")


def _time_lists(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "view", "pause").when(F.col("event_type") == "purchase", "end")
    return t("events").select(F.expr("user_id div 15").alias("bag"), kind.alias("kind"), (F.col("event_id") * 1.0).alias("t")).where("kind is not null")


_REPAIR = """tl as (select user_id // 15 as bag, case event_type when 'click' then 'start' when 'view' then 'pause' else 'end' end as kind, event_id * 1.0::double as t from events where event_type in ('click', 'view', 'purchase')),
ls as materialized (select bag, coalesce(list(t order by t) filter (kind = 'start'), []) as st, coalesce(list(t order by t) filter (kind = 'pause'), []) as pa, coalesce(list(t order by t) filter (kind = 'end'), []) as en from tl group by bag),
wk as (select bag, 0 as n, 0::bigint as p, 0::bigint as e, null::double as over_, false as done, null::double as s, null::double as pause, null::double as stop from ls where not (len(st) = len(pa) and len(pa) = len(en))
  union all select bag, n + 1, case when skip or fin then p else np + (pa[np + 1] <= en[ne + 1])::int end, case when skip or fin then e else ne + 1 end, case when skip or fin then over_ else en[ne + 1] end, fin,
    case when not skip and not fin then nx end, case when not skip and not fin then case when pa[np + 1] <= en[ne + 1] then pa[np + 1] else en[ne + 1] - 1.0 end end, case when not skip and not fin then en[ne + 1] end
  from (select *, not skip and (np >= len(pa) or ne >= len(en)) as fin from (select wk.bag, wk.n, wk.p, wk.e, wk.over_, ls.pa, ls.en, ls.st[wk.n + 1] as nx, coalesce(ls.st[wk.n + 1] < wk.over_, false) as skip,
    greatest(wk.p, len(list_filter(ls.pa, lambda x: x < ls.st[wk.n + 1]))) as np, greatest(wk.e, len(list_filter(ls.en, lambda x: x < ls.st[wk.n + 1]))) as ne
    from wk join ls on ls.bag = wk.bag where wk.n < len(ls.st) and not wk.done))),
rp as (select bag, s, pause, stop from wk where s is not null
  union all select bag, unnest(st), unnest(pa), unnest(en) from ls where len(st) = len(pa) and len(pa) = len(en))"""


@query("W2_time_repair", 'select bag, row_number() over (partition by bag order by s, stop) - 1 as episode_id, s as "start", pause, stop from rp', also=_REPAIR)
def time_repair(t):
    return segment.repair_times(_time_lists(t), tick=1.0)


@query("W3_grid", "select * from ticks", "messages", also=GRID)
def grid(t):
    return ticks(t)


_TWO = GRID + f""", paused as (select *, start_us + (stop_us - start_us) // 2 as pause_us from episodes),
two as (select bag, episode_id, 0 as part, k, start_us + k * {HOUR} as g_us from (select *, unnest(range(0, cast(ceil((pause_us + {HOUR} - start_us) / {HOUR}) as bigint))) as k from paused)
  union all select bag, episode_id, 1, k, stop_us + k * {HOUR} from (select *, unnest(range(0, 4)) as k from paused))"""


@query("W4_two_part_grid", "select bag, episode_id, row_number() over (partition by bag, episode_id order by part, k) - 1 as i, g_us from two", "messages", also=_TWO)
def two_part_grid(t):
    paused = episodes(t).withColumn("pause_us", F.col("start_us") + F.expr("(stop_us - start_us) div 2"))
    return sync.two_part_grid(paused, HOUR, 4 * HOUR)


_HOLD = GRID + """,
tk as materialized (select bag * 1000000 + episode_id as episode_id, g_us as t_us, row_number() over (partition by bag, episode_id order by g_us) as n from ticks),
ev as (select bag * 1000000 + episode_id as episode_id, topic, t_us, row_number() over (partition by bag, episode_id, topic order by t_us) as k from inside where topic in ('click', 'view')),
tn as materialized (select episode_id, case topic when 'click' then 2 * k - 2 else 2 * k - 1 end as j, t_us from ev),
hd as (select k.episode_id, k.t_us, k.n, case when u.t_us < k.t_us then 1 else 0 end as done from tk k left join tn u on u.episode_id = k.episode_id and u.j = 0 where k.n = 1
  union all select k.episode_id, k.t_us, k.n, h.done + case when u.t_us < k.t_us then 1 else 0 end from hd h join tk k on k.episode_id = h.episode_id and k.n = h.n + 1
    left join tn u on u.episode_id = k.episode_id and u.j = h.done)"""


@query("W5_hand_hold", "select episode_id, t_us, cast(done % 2 as int) as hand from hd", "messages", also=_HOLD)
def hand_hold(t):
    key = (F.col("bag") * 1_000_000 + F.col("episode_id")).alias("episode_id")
    kind = F.when(F.col("topic") == "click", "close").otherwise("open")
    rows = ticks(t).select(key, F.lit("tick").alias("kind"), F.col("g_us").alias("t_us")).unionByName(
        inside(t).where("topic in ('click', 'view')").select(key, kind.alias("kind"), "t_us")
    )
    return segment.hold_state(rows, width=24 * HOUR)


@query("J1_interval_join", "select * from inside", "messages", also=GRID)
def interval_join(t):
    return inside(t)


@query(
    "J2_interval_grace",
    f"""select bag, seq, t_us, topic, value, (select min(e.episode_id) from episodes e where m.bag = e.bag and m.t_us >= e.start_us and m.t_us < e.stop_us + {LEAST}) as episode_id
       from messages m where exists (select 1 from episodes e where m.bag = e.bag and m.t_us >= e.start_us and m.t_us < e.stop_us + {LEAST})""",
    "messages",
    also=EPISODES,
)
def interval_grace(t):
    return sync.interval_join(t("messages").drop("cmd"), episodes(t), grace_us=LEAST, cell_us=24 * HOUR)


@query("J3_forward_as_of", "select bag, episode_id, i, g_us, click from synced", "messages", also=SYNC)
def forward_as_of(t):
    return sync.as_of_sliced(ticks(t), inside(t), {"click": "next"}, ["bag", "episode_id"], 12 * HOUR)


@query("J4_backward_as_of", "select bag, episode_id, i, g_us, purchase from synced", "messages", also=SYNC)
def backward_as_of(t):
    return sync.as_of_sliced(ticks(t), inside(t), {"purchase": "last"}, ["bag", "episode_id"], 12 * HOUR)


@query(
    "J5_empty_streams",
    """select e.bag, e.episode_id, r.topic from episodes e, (select unnest(['click', 'view']) as topic) r
       where not exists (select 1 from inside m where m.bag = e.bag and m.episode_id = e.episode_id and m.topic = r.topic)""",
    "messages",
    also=GRID,
)
def empty_streams(t):
    return sync.empty_streams(episodes(t), inside(t), MANDATORY, KEYS)


@query(
    "J5_synchronise",
    """select * from synced s where not exists (select 1 from (select unnest(['click', 'view']) as topic) r
       where not exists (select 1 from inside m where m.bag = s.bag and m.episode_id = s.episode_id and m.topic = r.topic))""",
    "messages",
    also=SYNC,
)
def synchronise(t):
    """Episodes that hold every mandatory stream; a further empty one would raise."""
    within, every = inside(t), episodes(t)
    whole = every.join(sync.empty_streams(every, within, MANDATORY, KEYS).select(*KEYS).distinct(), KEYS, "left_anti")
    grid_rows = sync.grid(whole, HOUR)
    return sync.as_of_sliced(grid_rows, within.join(whole.select(*KEYS), KEYS, "left_semi"), TOPICS, KEYS, 12 * HOUR, fail_empty=True)


@query(
    "W6_future_shift",
    "select bag, episode_id, i, coalesce(lead(click, 3) over w, last_value(click) over (partition by bag, episode_id order by i rows between unbounded preceding and unbounded following)) as action from synced window w as (partition by bag, episode_id order by i)",
    "messages",
    also=SYNC,
)
def future_shift(t):
    return sync.shift_ahead(synchronised(t), 3, "click", ["bag", "episode_id"], "i", "action").select("bag", "episode_id", "i", "action")


@query(
    "W7_previous_state",
    """select bag, episode_id, i, state, coalesce(lead(state, 15) over w, last_value(state) over (partition by bag, episode_id order by i rows between unbounded preceding and unbounded following)) as action
       from (select *, coalesce(lag(purchase, 1) over (partition by bag, episode_id order by i), purchase) as state from synced) window w as (partition by bag, episode_id order by i)""",
    "messages",
    also=SYNC,
)
def previous_state(t):
    keys = ["bag", "episode_id"]
    rows = sync.previous(synchronised(t), "purchase", keys, "i", "state")
    return sync.shift_ahead(rows, 15, "state", keys, "i", "action").select(*keys, "i", "state", "action")


@query(
    "W13_time_deltas",
    "select bag, seq, delta_us from (select bag, seq, t_us - lead(t_us) over (partition by bag order by t_us, seq) as delta_us from messages) where delta_us is not null",
    "messages",
)
def time_deltas(t):
    from pyspark.sql import Window

    w = Window.partitionBy("bag").orderBy("t_us", "seq")
    return t("messages").withColumn("delta_us", F.col("t_us") - F.lead("t_us").over(w)).where("delta_us is not null").select("bag", "seq", "delta_us")


@query("A9_episode_lengths", f"select bag, count(*) as n, min(ticks) as least, round(avg(ticks), 6) as mean, max(ticks) as most from (select bag, episode_id, count(*) as ticks from ticks group by 1, 2) group by bag", "messages", also=GRID)
def episode_lengths(t):
    per = ticks(t).groupBy("bag", "episode_id").agg(F.count("*").alias("ticks"))
    return per.groupBy("bag").agg(F.count("*").alias("n"), F.min("ticks").alias("least"), F.round(F.avg("ticks"), 6).alias("mean"), F.max("ticks").alias("most"))


@query("A10_value_counts", "select purchase > 0 as held, count(*) as n from synced group by 1", "messages", also=SYNC)
def value_counts(t):
    return synchronised(t).groupBy((F.col("purchase") > 0).alias("held")).agg(F.count("*").alias("n"))


@query(
    "A29_message_counters",
    """select topic, count(*) as n, sum(case when cmd = 1 then 1 else 0 end)::bigint as starts, sum(case when cmd = 2 then 1 else 0 end)::bigint as stops,
       sum(case when cmd in (3, 4) then 1 else 0 end)::bigint as cancels from messages group by topic""",
    "messages",
)
def message_counters(t):
    count = lambda cond: F.count_if(F.expr(cond))
    return t("messages").groupBy("topic").agg(F.count("*").alias("n"), count("cmd = 1").alias("starts"), count("cmd = 2").alias("stops"), count("cmd in (3, 4)").alias("cancels"))


@query("A30_max_length", "select max(n) as longest from (select episode_id, count(*) as n from steps group by 1)", "steps")
def max_length(t):
    return t("steps").groupBy("episode_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("longest"))


@query("U1_concatenate", "select bag, t_us from messages where topic = 'click' union all select bag, t_us from messages where topic = 'view'", "messages")
def concatenate(t):
    part = lambda k: t("messages").where(F.col("topic") == k).select("bag", "t_us")
    return part("click").unionByName(part("view"))


@query("U2_set_difference", "select distinct bag, t_us // 86400000000 as day from messages where topic = 'click' except select distinct bag, t_us // 86400000000 from messages where topic = 'error'", "messages")
def set_difference(t):
    days = lambda k: t("messages").where(F.col("topic") == k).select("bag", F.expr("t_us div 86400000000").alias("day")).distinct()
    return days("click").join(days("error"), ["bag", "day"], "left_anti")


@query("U3_tracked_topics", "select bag, count(*) as n from messages where topic in ('click', 'purchase') group by bag", "messages")
def tracked_topics(t):
    return t("messages").where(F.col("topic").isin("click", "purchase")).groupBy("bag").agg(F.count("*").alias("n"))


def flagship(t: Tables) -> DataFrame:
    """Mean and sample deviation of every synchronised signal over the valid episodes."""
    signals = synchronised(t).select("bag", F.posexplode(F.array(*TOPICS)).alias("dim", "value"))
    return signals.groupBy("dim").agg(
        F.count("*").alias("n"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.greatest(F.stddev_samp("value"), F.lit(0.01)), 6).alias("std"),
    ).select(F.col("dim").cast("long").alias("dim"), "n", "mean", "std")


query(
    "flagship_log_statistics",
    """select dim, count(*) as n, round(avg(value), 6) as mean, round(greatest(stddev_samp(value), 0.01), 6) as std
       from (select unnest([0, 1, 2, 3])::bigint as dim, unnest([click, view, purchase, error]) as value from synced) group by dim""",
    "messages",
    also=SYNC,
)(flagship)
