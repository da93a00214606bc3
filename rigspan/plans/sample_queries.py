"""Queries from steps to training samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import samples
from .registry import query

ACT = "act as (select episode_id, step, dim - 1 as dim, action[dim] as value from (select *, unnest(range(1, 8)) as dim from steps))"
QP = "qp as (select episode_id, step, dim - 1 as dim, qpos[dim] as value from (select *, unnest(range(1, 9)) as dim from steps))"
STATS = ACT + ", st as (select dim, avg(value) as mean, greatest(stddev_samp(value), 0.01) as std from act group by dim)"
EPS = ACT + ", es as (select episode_id, dim, count(*) as steps, avg(value) as mean, avg((value > 0)::int) as pos from act group by 1, 2)"


def r6(c: str):
    return F.round(c, 6).alias(c)


@query("A1_norm_statistics", "select dim, round(mean, 6) as mean, round(std, 6) as std from st", "steps", also=STATS)
def norm_statistics(t):
    return samples.wide_statistics(t("steps"), "action", 7).select("dim", r6("mean"), r6("std"))


@query(
    "A2_pose_statistics",
    """select w.dim, round(coalesce(s.mean, 0.0), 6) as mean, round(coalesce(s.std, 1.0), 6) as std from (select unnest(range(0, 13)) as dim) w
       left join (select dim, avg(value) as mean, greatest(stddev_samp(value), 0.01) as std from act where dim between 3 and 5 group by dim) s on w.dim = s.dim""",
    "steps",
    also=ACT,
)
def pose_statistics(t):
    return samples.partial_statistics(t("steps"), "action", [3, 4, 5], 13).select("dim", r6("mean"), r6("std"))


@query("A3_example_qpos", "select step, dim, round(value, 6) as value from qp where episode_id = (select max(episode_id) from steps)", "steps", also=QP)
def example_qpos(t):
    last = t("steps").agg(F.max("episode_id").alias("episode_id"))
    return samples.long_form(t("steps").join(F.broadcast(last), "episode_id"), "qpos").select("step", "dim", r6("value"))


@query("A4_binary_channel", "select dim, case when dim = 6 then 0.0 else round(mean, 6) end as mean, case when dim = 6 then 1.0 else round(std, 6) end as std from st", "steps", also=STATS)
def binary_channel(t):
    return samples.binary_last(samples.wide_statistics(t("steps"), "action", 7)).select("dim", r6("mean"), r6("std"))


@query("A5_episode_statistics", "select episode_id, dim, steps, round(mean, 6) as mean, round(pos, 6) as pos from es", "steps", also=EPS)
def episode_statistics(t):
    return samples.episode_statistics(t("steps"), "action").select("episode_id", "dim", "steps", r6("mean"), r6("pos"))


@query("A6_weighted_combination", "select dim, round(avg(value), 6) as mean, round(avg((value > 0)::int), 6) as pos, count(*) as steps from act where episode_id % 2 = 0 group by dim", "steps", also=ACT)
def weighted_combination(t):
    stats = samples.episode_statistics(t("steps"), "action").where("episode_id % 2 = 0")
    return samples.combined(stats).select("dim", r6("mean"), r6("pos"), "steps")


TRIALS = (
    EPS
    + """, n as (select count(distinct episode_id) as n from steps),
tr as (select trial, episode_id, row_number() over (partition by trial order by ('0x' || substr(md5('0:' || trial || ':' || episode_id), 1, 8))::bigint, episode_id) as k
  from (select distinct episode_id from steps), (select unnest(range(0, 20)) as trial)),
pt as (select trial, episode_id, case when k <= greatest(1, least(n - 1, cast(floor(0.8 * n) as bigint))) then 'train' else 'val' end as part from tr, n),
sd as (select trial, dim, sum(steps * mean) filter (part = 'train') / sum(steps) filter (part = 'train') as tm, sum(steps * pos) filter (part = 'train') / sum(steps) filter (part = 'train') as tp,
  sum(steps * mean) filter (part = 'val') / sum(steps) filter (part = 'val') as vm, sum(steps * pos) filter (part = 'val') / sum(steps) filter (part = 'val') as vp
  from es join pt using (episode_id) group by 1, 2),
gl as (select dim, sum(steps * mean) / sum(steps) as gm, sum(steps * pos) / sum(steps) as gp from es group by dim),
sc as (select trial, avg(abs(tm - vm)) + 2 * avg(abs(tp - vp)) + 1.5 * avg(abs(vm - gm)) + 2.5 * avg(abs(vp - gp)) + 0.5 * avg(abs(tm - gm)) + avg(abs(tp - gp)) as score from sd join gl using (dim) group by trial)"""
)


def _trials(t):
    stats = samples.episode_statistics(t("steps"), "action")
    return stats, samples.splits(t("steps").select("episode_id").distinct(), 20)


@query("A7_split_score", "select trial, round(score, 6) as score from sc", "steps", also=TRIALS)
def split_score(t):
    return samples.split_scores(*_trials(t)).select("trial", r6("score"))


@query("B2_balanced_split", "select arg_min(trial, (round(score, 9), trial)) as trial, round(min(score), 6) as score from sc", "steps", also=TRIALS)
def balanced_split(t):
    return samples.best_split(samples.split_scores(*_trials(t))).select("trial", r6("score"))


@query("J6_trials", "select trial, part, count(*) as n from pt group by 1, 2", "steps", also=TRIALS)
def trials(t):
    return _trials(t)[1].groupBy("trial", "part").agg(F.count("*").alias("n"))


@query("A8_split_report", "select dim, round(tm, 6) as train_mean, round(vm, 6) as val_mean, round(abs(tm - vm), 6) as mean_gap, round(abs(tp - vp), 6) as pos_gap from sd where trial = 0", "steps", also=TRIALS)
def split_report(t):
    stats, parts = _trials(t)
    both = samples.combined(stats.join(parts.where("trial = 0"), "episode_id"), "part")
    side = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c)))
    wide = both.groupBy("dim").agg(*[side(p, c).alias(f"{p}_{c}") for p in ("train", "val") for c in ("mean", "pos")])
    return wide.select("dim", r6("train_mean"), r6("val_mean"), F.round(F.abs(F.col("train_mean") - F.col("val_mean")), 6).alias("mean_gap"), F.round(F.abs(F.col("train_pos") - F.col("val_pos")), 6).alias("pos_gap"))


@query("A11_first_steps", "select dim, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std from act where step < 5 group by dim", "steps", also=ACT)
def first_steps(t):
    return samples.long_form(t("steps").where("step < 5"), "action").groupBy("dim").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query("B1_random_split", "select episode_id, part from pt where trial = 0", "steps", also=TRIALS)
def random_split(t):
    return samples.splits(t("steps").select("episode_id").distinct(), 1).select("episode_id", "part")


@query(
    "B3_shuffled_batches",
    "select id, k - 1 as position, (k - 1) // 32 as batch from (select vec_id as id, row_number() over (order by ('0x' || substr(md5('3:1:' || vec_id), 1, 8))::bigint, vec_id) as k from embeddings)",
)
def shuffled_batches(t):
    return samples.shuffled_batches(t("embeddings").select(F.col("vec_id").alias("id")), "id", 32, seed=3, epoch=1)


@query(
    "B4_ragged_padding",
    "select batch, id, k - 1 as at, coalesce(v[k], 0) as value, k > len(v) as pad from (select *, unnest(range(1, max(len(v)) over (partition by batch) + 1)) as k from ragged)",
    "ragged",
)
def ragged_padding(t):
    rows = samples.padded(t("ragged"), "batch", "v")
    each = rows.select("batch", "id", F.posexplode(F.arrays_zip("padded", "mask")).alias("at", "x"))
    return each.select("batch", "id", F.col("at").cast("long").alias("at"), F.col("x.padded").alias("value"), F.col("x.mask").alias("pad"))


@query("B5_seed_repeats", "select seed, count(distinct h) as n from (select seed, ('0x' || substr(md5(seed || ':' || vec_id), 1, 8))::bigint % 1000 as h from embeddings, (select unnest([1, 2]) as seed)) group by seed")
def seed_repeats(t):
    drawn = t("embeddings").select(F.explode(F.array(F.lit(1), F.lit(2))).alias("seed"), "vec_id")
    return drawn.groupBy("seed").agg(F.countDistinct(samples.hashed(F.col("seed"), F.col("vec_id")) % 1000).alias("n"))


CH = """, ch as (select s.episode_id, s.step as start_ts, k as offset_, a.action as action from (select *, unnest(range(0, 8)) as k from steps) s
  left join steps a on a.episode_id = s.episode_id and a.step = s.step + k)"""


@query("W8_action_chunks", "select episode_id, start_ts, offset_, dim - 1 as dim, round(coalesce(action[dim], 0.0), 6) as value, action is null as pad from (select *, unnest(range(1, 8)) as dim from ch)", "steps", also=ACT + CH)
def action_chunks(t):
    return _long_chunks(samples.chunks(t("steps"), "action", 8, 7))


def _long_chunks(rows):
    each = rows.select("episode_id", "start_ts", F.posexplode(F.arrays_zip("actions", "is_pad")).alias("offset_", "x"))
    each = each.select("episode_id", "start_ts", F.col("offset_").cast("long").alias("offset_"), F.col("x.is_pad").alias("pad"), F.posexplode("x.actions").alias("dim", "value"))
    return each.select("episode_id", "start_ts", "offset_", F.col("dim").cast("long").alias("dim"), r6("value"), "pad")


@query(
    "W9_pose_chunks",
    """select s.episode_id, s.step as start_ts, count(a.step) as held from (select *, unnest(range(0, 8)) as k from (select *, count(*) over (partition by episode_id) as n from steps)) s
       left join steps a on a.episode_id = s.episode_id and a.step = s.step + k and a.step < s.n - 5 where s.step < s.n - 5 group by 1, 2""",
    "steps",
)
def pose_chunks(t):
    rows = samples.chunks(samples.trimmed(t("steps"), 5), "action", 8, 7)
    return rows.select("episode_id", "start_ts", F.size(F.filter("is_pad", lambda x: ~x)).cast("long").alias("held"))


LEN = "ln as (select episode_id, count(*) as n from steps group by 1)"


@query("W10_random_starts", "select epoch, episode_id, ('0x' || substr(md5('5:' || epoch || ':' || episode_id), 1, 8))::bigint % n as start_ts from ln, (select unnest(range(0, 3)) as epoch)", "steps", also=LEN)
def random_starts(t):
    return samples.random_starts(t("steps").groupBy("episode_id").agg(F.count("*").alias("n")), 5, 3)


@query("W11_whole_episodes", "select epoch, episode_id, 0::bigint as start_ts from ln, (select unnest(range(0, 2)) as epoch)", "steps", also=LEN)
def whole_episodes(t):
    return samples.random_starts(t("steps").groupBy("episode_id").agg(F.count("*").alias("n")), 5, 2, whole=True)


@query("W12_truncate", "select episode_id, step from steps s where step < (select max(step) from steps x where x.episode_id = s.episode_id)", "steps")
def truncate(t):
    last = t("steps").groupBy("episode_id").agg(F.max("step").alias("last"))
    return t("steps").join(last, "episode_id").where("step < last").select("episode_id", "step")


@query("P16_z_score", "select episode_id, step, a.dim, round((value - mean) / std, 6) as value from act a join st on a.dim = st.dim", "steps", also=STATS)
def z_score(t):
    long = samples.long_form(t("steps"), "action")
    return samples.normalised(long, samples.wide_statistics(t("steps"), "action", 7)).select("episode_id", "step", "dim", r6("value"))


@query("J7_statistics_broadcast", "select episode_id, step, a.dim, round(value * std + mean, 6) as value from act a join st on a.dim = st.dim", "steps", also=STATS)
def statistics_broadcast(t):
    long = samples.long_form(t("steps"), "action")
    return samples.normalised(long, samples.wide_statistics(t("steps"), "action", 7), back=True).select("episode_id", "step", "dim", r6("value"))


@query("P17_denormalise_some", "select episode_id, step, a.dim, round(case when a.dim < 6 then value * std + mean else value end, 6) as value from act a join st on a.dim = st.dim", "steps", also=STATS)
def denormalise_some(t):
    stats = samples.wide_statistics(t("steps"), "action", 7)
    long = samples.long_form(t("steps"), "action").join(F.broadcast(stats), "dim")
    value = F.when(F.col("dim") < 6, F.col("value") * F.col("std") + F.col("mean")).otherwise(F.col("value"))
    return long.select("episode_id", "step", "dim", F.round(value, 6).alias("value"))


@query("P18_std_floor", "select episode_id, step, a.dim, round((value - mean) / greatest(std, 0.1), 6) as value from act a join st on a.dim = st.dim", "steps", also=STATS)
def std_floor(t):
    long = samples.long_form(t("steps"), "action")
    return samples.normalised(long, samples.wide_statistics(t("steps"), "action", 7), floor=0.1).select("episode_id", "step", "dim", r6("value"))


@query("T0a_sorted_index", "select episode_id, row_number() over (order by episode_id) - 1 as at from (select distinct episode_id from steps)", "steps")
def sorted_index(t):
    return samples.sorted_index(t("steps"), "episode_id")


@query("T0c_preview", "select episode_id, step, round(action[3], 6) as value from steps where step < 5", "steps")
def preview(t):
    return t("steps").where("step < 5").select("episode_id", "step", F.round(F.get("action", F.lit(2)), 6).alias("value"))


@query("T0f_first_step", "select episode_id, round(arg_min(qpos[8], step), 6) as value from steps group by 1", "steps")
def first_step(t):
    return t("steps").groupBy("episode_id").agg(F.round(F.min_by(F.get("qpos", F.lit(7)), "step"), 6).alias("value"))


@query("W29_positions", "select episode_id, step, row_number() over (partition by episode_id order by step) - 1 as at from steps", "steps")
def positions(t):
    from pyspark.sql import Window

    at = (F.row_number().over(Window.partitionBy("episode_id").orderBy("step")) - 1).cast("long")
    return t("steps").select("episode_id", "step", at.alias("at"))


@query("J12_tracking_error", "select q.episode_id, q.step, q.dim, round(q.value - a.value, 6) as error from qp q join act a on q.episode_id = a.episode_id and q.step = a.step and q.dim = a.dim", "steps", also=ACT + ", " + QP)
def tracking_error(t):
    zipped = t("steps").select("episode_id", "step", F.posexplode(F.arrays_zip(F.slice("qpos", 1, 7).alias("q"), F.col("action").alias("a"))).alias("dim", "x"))
    return zipped.select("episode_id", "step", F.col("dim").cast("long").alias("dim"), F.round(F.col("x.q") - F.col("x.a"), 6).alias("error"))
