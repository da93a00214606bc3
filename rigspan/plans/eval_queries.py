"""Queries over predictions, rewards, metrics, scores and boxes."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate, predict
from ..sources import store
from ..sources.tables import shared_dir
from .registry import query


def r6(c: str, name: str | None = None):
    return F.round(c, 6).alias(name or c)


def millionths(c: str):
    """:func:`r6` the way SQL does it, on doubles: no decimal is made for each of very many rows."""
    x = F.col(c) * 1e6
    whole = F.when(x < 0, -F.floor(0.5 - x)).otherwise(F.floor(x + 0.5))
    return F.when(F.abs(x) < 1 << 52, whole / 1e6).otherwise(F.col(c)).alias(c)


PRED = """predictions as (select vec_id % 25 as rollout, vec_id // 25 as query_t, k as offset_, embedding[8 * k + 1 : 8 * k + 8]::double[] as action from embeddings, (select unnest(range(0, 8)) as k)),
pl as (select *, query_t + offset_ as target_t from predictions),
px as (select rollout, query_t, offset_, target_t, d - 1 as dim, action[d] as value from pl, (select unnest(range(1, 9)) as d))"""


def predictions(t):
    offset = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("offset_")
    rows = t("embeddings").select((F.col("vec_id") % 25).alias("rollout"), F.expr("vec_id div 25").alias("query_t"), offset, "embedding")
    return rows.select("rollout", "query_t", F.col("offset_").cast("long").alias("offset_"), F.expr("transform(slice(embedding, 8 * offset_ + 1, 8), x -> cast(x as double))").alias("action"))


def _ens(k: float, ahead: int) -> str:
    return f"""{PRED}, en as (select a.rollout, a.target_t, a.dim, sum(exp(-{k} * older) * value) / sum(exp(-{k} * older)) as value, count(*) as n from
      (select x.*, (select count(*) from pl o where o.rollout = x.rollout and o.target_t = x.target_t and o.query_t < x.query_t and len(list_filter(o.action, lambda v: v = 0)) = 0) as older
       from px x where x.query_t <= x.target_t - {ahead}) a group by 1, 2, 3)"""


@query("W14_ensemble", "select rollout, target_t, dim, round(value, 6) as value, n from en", also=_ens(0.01, 0))
def ensemble(t):
    return predict.ensemble(predictions(t)).select("rollout", "target_t", "dim", r6("value"), "n")


@query(
    "W15_populated_rule",
    "select rollout, count(*) as n from (select rollout, [round(v, 1) for v in action] as action from pl) where len(list_filter(action, lambda v: v = 0)) = 0 group by 1",
    also=PRED,
)
def populated_rule(t):
    coarse = predictions(t).withColumn("action", F.transform("action", lambda v: F.round(v, 1)))
    return coarse.where(F.forall("action", lambda v: v != 0)).groupBy("rollout").agg(F.count("*").alias("n"))


@query("W16_lookahead", "select rollout, target_t, dim, round(value, 6) as value, n from en", also=_ens(0.1, 4))
def lookahead(t):
    return predict.ensemble(predictions(t), k=0.1, lookahead=4).select("rollout", "target_t", "dim", r6("value"), "n")


@query(
    "W17_fallback",
    """select p.rollout, p.query_t as target_t, p.dim, round(coalesce(e.value, p.value), 6) as value, e.value is null as fallback from px p
       left join en e on e.rollout = p.rollout and e.target_t = p.query_t and e.dim = p.dim where p.offset_ = 0""",
    also=_ens(0.1, 4),
)
def fallback(t):
    rows = predictions(t)
    return predict.with_fallback(predict.ensemble(rows, k=0.1, lookahead=4), rows).select("rollout", "target_t", "dim", r6("value"), "fallback")


@query("W19_playback", "select rollout, target_t as t, dim, round(value, 6) as value from px where query_t % 4 = 0 and offset_ < 4", also=PRED)
def playback(t):
    rows = predict.playback(predictions(t), 4)
    return rows.select("rollout", "t", F.posexplode("action").alias("dim", "value")).select("rollout", "t", F.col("dim").cast("long").alias("dim"), r6("value"))


@query(
    "W18_compensated_step",
    """select robot, seq, sum(slot) over (partition by robot order by seq)::bigint as step from
       (select robot, seq, case when row_number() over w = 1 then 0 else floor(lag(sec) over w * 30)::bigint + 1 end as slot from latency window w as (partition by robot order by seq))""",
    "latency",
)
def compensated_step(t):
    return predict.compensated_steps(t("latency"), 30).select("robot", "seq", "step")


@query(
    "W20_hysteresis",
    """select robot, seq, coalesce(last_value(turn ignore nulls) over (partition by robot order by t_us, seq rows between unbounded preceding and current row), 0)::bigint as closed from
       (select *, case when 1 / (1 + exp(-x)) > 0.55 then 1 when 1 / (1 + exp(-x)) < 0.3 then 0 end as turn from logits)""",
    "logits",
)
def hysteresis(t):
    return predict.hysteresis(t("logits"), close=0.55).select("robot", "seq", "closed")


LIMITED = """rw as materialized (select robot, seq, t_us, 1 / (1 + exp(-x)) as p, row_number() over (partition by robot order by t_us, seq) as n from logits),
st as (select robot, n, false as closed, t_us as last, false as published from rw where n = 1
  union all select robot, n, case when go then not closed else closed end, case when go then t_us else last end, go from
    (select rw.*, st.closed, st.last, (case when st.closed then p < 0.3 else p > 0.55 end) and rw.t_us - st.last > 3600000000 as go from st join rw on rw.robot = st.robot and rw.n = st.n + 1))"""


@query("W20_hysteresis_limited", "select rw.robot, rw.seq, st.closed, st.published from st join rw on rw.robot = st.robot and rw.n = st.n", "logits", also=LIMITED)
def hysteresis_limited(t):
    return predict.limited_hysteresis(t("logits"), least_us=3_600_000_000, close=0.55, width=24 * 3_600_000_000)


@query(
    "P30_edges",
    'select robot, seq, p as "on" from (select *, lag(p, 1, false) over (partition by robot order by t_us, seq) as b from (select *, 1 / (1 + exp(-x)) > 0.5 as p from logits)) where p <> b',
    "logits",
)
def edges(t):
    return predict.edges(t("logits")).select("robot", "seq", "on")


@query("X1_pluggable_predictor", "select episode_id as rollout, step as query_t, k as offset_, round(qpos[3] * (1 + k / 10.0::double), 6) as value from steps, (select unnest(range(0, 4)) as k)", "steps")
def pluggable_predictor(t):
    rows = predict.predict(t("steps").select("episode_id", "step", "qpos"), predict.linear_predictor(), "rollout long, query_t long, offset_ long, action array<double>")
    return rows.select("rollout", "query_t", "offset_", F.round(F.get("action", F.lit(2)), 6).alias("value"))


# --- rewards ---------------------------------------------------------------

RET = "rt as (select rollout, coalesce(sum(reward), 0)::bigint as total, max(reward) as highest, coalesce(max(reward) = 4, false) as success from rewards group by 1)"


@query("A13_returns", "select * from rt", "rewards", also=RET)
def returns(t):
    return evaluate.returns(t("rewards"))


@query("A14_success_rate", "select count(*) as n, round(avg(success::int), 6) as rate, round(avg(total), 6) as mean_return from rt", "rewards", also=RET)
def success_rate(t):
    return evaluate.returns(t("rewards")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("success").cast("int")), 6).alias("rate"), F.round(F.avg("total"), 6).alias("mean_return"))


@query(
    "S15_eval_result",
    """select 'policy' as name, r as reward, count(*) as rollouts, round(avg(success::int), 6) as success_rate, round(avg(total), 6) as mean_return,
       count(*) filter (highest >= r) as reached, round(count(*) filter (highest >= r) / count(*), 6) as rate from rt, (select unnest(range(0, 5)) as r) group by r""",
    "rewards",
    also=RET,
)
def eval_result(t):
    path = f"{shared_dir(t.spark)}/results-{uuid.uuid4().hex}"
    store.append_result(evaluate.returns(t("rewards")), "policy", path)
    rows = t.spark.read.parquet(path).select("name", "rollouts", "success_rate", "mean_return", F.posexplode(F.arrays_zip("reached", "rates")).alias("reward", "x"))
    return rows.select("name", F.col("reward").cast("long").alias("reward"), "rollouts", r6("success_rate"), r6("mean_return"), F.col("x.reached").alias("reached"), r6("x.rates", "rate"))


@query("J8_reward_table", "select r as reward, count(rt.rollout) as n, round(count(rt.rollout) / (select count(*) from rt), 6) as rate from (select unnest(range(0, 5)) as r) left join rt on highest >= r group by 1", "rewards", also=RET)
def reward_table(t):
    return evaluate.at_least(evaluate.returns(t("rewards"))).select("reward", "n", r6("rate"))


_L, _R = "vx300s_left/10_left_gripper_finger", "vx300s_right/10_right_gripper_finger"


@query(
    "A16_transfer_rewards",
    f"""select rollout, t, case when l and not b then 4 when l then 3 when r and not b then 2 when r then 1 else 0 end::bigint as reward from
       (select rollout, t, bool_or(geom2 = '{_L}') as l, bool_or(geom2 = '{_R}') as r, bool_or(geom2 = 'table') as b from contacts where geom1 = 'red_box' group by 1, 2)""",
    "contacts",
)
def transfer_rewards(t):
    return evaluate.transfer_rewards(t("contacts"))


@query(
    "A17_insertion_rewards",
    f"""select rollout, t, case when p then 4 when k and not b then 3 when l and r and not b then 2 when l and r then 1 else 0 end::bigint as reward from
       (select rollout, t, bool_or(geom1 = 'red_peg' and geom2 = '{_R}') as r, bool_or(geom1 like 'socket-_' and geom2 = '{_L}') as l,
        bool_or((geom1 = 'red_peg' or geom1 like 'socket-_') and geom2 = 'table') as b, bool_or(geom1 = 'red_peg' and geom2 like 'socket-_') as k,
        bool_or(geom1 = 'red_peg' and geom2 = 'pin') as p from contacts_peg group by 1, 2)""",
    "contacts_peg",
)
def insertion_rewards(t):
    return evaluate.insertion_rewards(t("contacts_peg"))


@query("J11_contact_pairs", f"select distinct rollout, t from contacts where (geom1, geom2) in (('red_box', '{_L}'), ('red_box', '{_R}'))", "contacts")
def contact_pairs(t):
    pairs = t.spark.createDataFrame([("red_box", _L), ("red_box", _R)], "geom1 string, geom2 string")
    return t("contacts").join(F.broadcast(pairs), ["geom1", "geom2"], "left_semi").select("rollout", "t").distinct()


# --- metrics ---------------------------------------------------------------


@query("A12_metric_means", "select run, phase, epoch, round(avg(value), 4) as mean from metrics group by 1, 2, 3", "metrics")
def metric_means(t):
    return t("metrics").groupBy("run", "phase", "epoch").agg(F.round(F.avg("value"), 4).alias("mean"))


@query("A18_reduce", "select run, epoch, round(avg(per) + 1e-7, 3) as mean, round(sum(per) + 1e-7, 4) as total from (select run, epoch, rank, avg(value) as per from metrics group by 1, 2, 3) group by 1, 2", "metrics")
def reduce_(t):
    per = t("metrics").groupBy("run", "epoch", "rank").agg(F.avg("value").alias("per"))
    return per.groupBy("run", "epoch").agg(F.round(F.avg("per") + 1e-7, 3).alias("mean"), F.round(F.sum("per") + 1e-7, 4).alias("total"))


@query("A19_meter_merge", "select run, round(sum(value) / count(*), 4) as overall, count(*) as n from metrics group by 1", "metrics")
def meter_merge(t):
    per = t("metrics").groupBy("run", "rank").agg(F.sum("value").alias("s"), F.count("*").alias("c"))
    return per.groupBy("run").agg(F.round(F.sum("s") / F.sum("c"), 4).alias("overall"), F.sum("c").alias("n"))


@query("A15_latency", "select robot, round(min(sec), 6) as least, round(avg(sec), 6) as mean, round(max(sec), 6) as most from (select *, row_number() over (partition by robot order by seq) as k from latency) where k > 1 group by 1", "latency")
def latency(t):
    w = Window.partitionBy("robot").orderBy("seq")
    rows = t("latency").withColumn("k", F.row_number().over(w)).where("k > 1")
    return rows.groupBy("robot").agg(F.round(F.min("sec"), 6).alias("least"), F.round(F.avg("sec"), 6).alias("mean"), F.round(F.max("sec"), 6).alias("most"))


@query(
    "W21_rolling_meter",
    """select run, seq, round(list_sort(l)[(len(l) + 1) // 2], 4) as median, round(m + 1e-6, 3) as mean, round(h, 4) as highest, value as latest, round(o + 1e-6, 3) as overall from
       (select run, seq, value, list(value) over w as l, avg(value) over w as m, max(value) over w as h, sum(value * (rank + 1)) over v / sum(rank + 1) over v as o from metrics
        window w as (partition by run order by seq rows between 19 preceding and current row), v as (partition by run order by seq rows unbounded preceding))""",
    "metrics",
)
def rolling_meter(t):
    rows = evaluate.rolling(t("metrics").withColumn("n", F.col("rank") + 1), ["run"], ["seq"], "value", weight="n", width=10_000)
    # a nudge off the halves, which engines that add in another order round either way
    near = [F.round(F.col(c) + 1e-6, 3).alias(c) for c in ("mean", "overall")]
    return rows.select("run", "seq", F.round("median", 4).alias("median"), F.round("highest", 4).alias("highest"), "latest", *near)


@query("W22_named_meters", "select run, phase, seq, round(avg(value) over (partition by run, phase order by seq rows unbounded preceding) + 1e-6, 3) as overall from metrics", "metrics")
def named_meters(t):
    rows = evaluate.rolling(t("metrics"), ["run", "phase"], ["seq"], "value", width=10_000)
    return rows.select("run", "phase", "seq", F.round(F.col("overall") + 1e-6, 3).alias("overall"))


@query("W23_eta", "select robot, seq, round(avg(sec) over w * (count(*) over (partition by robot) - row_number() over w) + 1e-9, 6) as eta from latency window w as (partition by robot order by seq)", "latency")
def eta(t):
    return evaluate.eta(t("latency"), "robot", "seq", "sec", width=1000).select("robot", "seq", F.round(F.col("eta") + 1e-9, 6).alias("eta"))


LOSS = "ls as (select run, epoch, avg(value) as loss from metrics where phase = 'val' group by 1, 2)"


def losses(t, phase: str = "val"):
    return t("metrics").where(F.col("phase") == phase).groupBy("run", "epoch").agg(F.avg("value").alias("loss"))


@query("W24_best_so_far", "select run, epoch, round(loss, 4) as loss from (select *, min(loss) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) as b from ls) where b is null or loss < b", "metrics", also=LOSS)
def best_so_far(t):
    return evaluate.best_so_far(losses(t), "loss").where("improved").select("run", "epoch", F.round("loss", 4).alias("loss"))


@query(
    "W25_snapshots",
    """select l.run, l.epoch, (select arg_min(x.epoch, (x.loss, x.epoch)) from ls x where x.run = l.run and x.epoch <= l.epoch) as best_epoch from ls l
       where epoch % 20 = 0 or epoch = (select max(epoch) from ls y where y.run = l.run)""",
    "metrics",
    also=LOSS,
)
def snapshots(t):
    return evaluate.snapshots(losses(t), "loss", 20).select("run", "epoch", "best_epoch")


@query("W26_training_curve", "select run, epoch, round((row_number() over w - 1) * (99.0::double) / greatest(count(*) over (partition by run) - 1, 1), 6) as x, round(loss, 4) as y from ls window w as (partition by run order by epoch)", "metrics", also=LOSS)
def training_curve(t):
    w, n = Window.partitionBy("run").orderBy("epoch"), F.count("*").over(Window.partitionBy("run"))
    x = (F.row_number().over(w) - 1) * F.lit(99.0) / F.greatest(n - 1, F.lit(1))
    return losses(t).select("run", "epoch", F.round(x, 6).alias("x"), F.round("loss", 4).alias("y"))


_SMOOTH = LOSS + """, gp as materialized (select run, epoch, case when epoch % 5 <> 0 then loss end as v, row_number() over (partition by run order by epoch) as n from ls),
ip as materialized (select g.run, g.epoch, g.n, case when b.n is null then null when a.n is null or a.n = b.n then b.v else b.v + (a.v - b.v) * (g.n - b.n) / (a.n - b.n) end as v from gp g
  left join gp b on b.run = g.run and b.n = (select max(x.n) from gp x where x.run = g.run and x.n <= g.n and x.v is not null)
  left join gp a on a.run = g.run and a.n = (select min(x.n) from gp x where x.run = g.run and x.n >= g.n and x.v is not null)),
ew as (select run, n, epoch, coalesce(v, 0) as top, case when v is null then 0.0::double else 1.0 end as bottom from ip where n = 1
  union all select i.run, i.n, i.epoch, e.top * (10.0::double / 11) + coalesce(i.v, 0), e.bottom * (10.0::double / 11) + case when i.v is null then 0 else 1 end from ew e join ip i on i.run = e.run and i.n = e.n + 1)"""


@query("W27_smoothing", "select run, epoch, case when bottom > 0 then round(top / bottom, 4) end as smooth from ew", "metrics", also=_SMOOTH)
def smoothing(t):
    gaps = losses(t).withColumn("value", F.when(F.col("epoch") % 5 != 0, F.col("loss"))).select("run", "epoch", "value")
    return evaluate.smoothed(gaps, com=10, width=16).select("run", "epoch", F.round("smooth", 4).alias("smooth"))


@query("W28_frame_rate", "select robot, block, round(1 / avg(sec), 4) as hz from (select *, (row_number() over (partition by robot order by seq) - 1) // 30 as block from latency) group by 1, 2 having count(*) = 30", "latency")
def frame_rate(t):
    return evaluate.frame_rate(t("latency")).select("robot", "block", F.round("hz", 4).alias("hz"))


@query("P28_epoch_filter", "select run, epoch, count(*) as n from metrics where epoch % 20 = 0 group by 1, 2", "metrics")
def epoch_filter(t):
    return t("metrics").where("epoch % 20 = 0").groupBy("run", "epoch").agg(F.count("*").alias("n"))


@query("A21_precision_recall", "select run, round(avg(p), 6) as precision_, round(arg_max(p, seq), 6) as recall, round(2 * avg(p) * arg_max(p, seq) / (avg(p) + arg_max(p, seq) + 1e-8), 6) as f1 from (select run, seq, value / 1000000 as p from metrics) group by 1", "metrics")
def precision_recall(t):
    out = t("metrics").withColumn("p", F.col("value") / 1000000).groupBy("run").agg(F.avg("p").alias("p"), F.max_by("p", "seq").alias("r"))
    f1 = 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r") + 1e-8)
    return out.select("run", r6("p", "precision_"), r6("r", "recall"), F.round(f1, 6).alias("f1"))


# --- scores, losses, boxes -------------------------------------------------


@query(
    "A20_top_k_accuracy",
    """select k, round(avg(case when r <= k then 100.0::double else 0 end), 6) as accuracy from (select id, target, 1 + (select count(*) from (select unnest(scores) as v, unnest(range(0, 10)) as c) where v > scores[target + 1] or (v = scores[target + 1] and c < target)) as r from scores),
       (select unnest([1, 3, 5]::bigint[]) as k) group by k""",
    "scores",
)
def top_k_accuracy(t):
    return evaluate.top_k_accuracy(t("scores"), [1, 3, 5]).select("k", r6("accuracy"))


@query("T0d_top_k", "select id, class, round(value, 6) as value from (select *, row_number() over (partition by id order by value desc, class) as k from (select id, unnest(scores) as value, unnest(range(0, 10)) as class from scores)) where k <= 3", "scores")
def top_k(t):
    best = F.slice(F.sort_array(F.transform("scores", lambda x, i: F.struct(x.alias("value"), (-i).alias("class"))), asc=False), 1, 3)
    return t("scores").select("id", F.explode(best).alias("x")).select("id", (-F.col("x.class")).cast("long").alias("class"), F.round("x.value", 6).alias("value"))


@query("T0e_latest_value", "select robot, arg_max(sec, seq) as latest from latency group by 1", "latency")
def latest_value(t):
    return t("latency").groupBy("robot").agg(F.max_by("sec", "seq").alias("latest"))


PAD = "pd as (select s.episode_id, s.step, k as offset_, a.action is null as pad, coalesce(a.action[1], 0.0) as y, s.qpos[1] as x, coalesce(a.action[7], 0.0) as z, s.qpos[8] as logit from (select *, unnest(range(0, 4)) as k from steps) s left join steps a on a.episode_id = s.episode_id and a.step = s.step + k)"


def _padded(t):
    from ..operators import samples

    chunks = samples.chunks(t("steps"), "action", 4, 7).withColumnRenamed("start_ts", "step")
    rows = t("steps").select("episode_id", "step", "qpos").join(chunks, ["episode_id", "step"])
    each = rows.select("qpos", F.posexplode(F.arrays_zip("actions", "is_pad")).alias("offset_", "c"))
    return each.select(
        "offset_", F.col("c.is_pad").alias("pad"), F.get("c.actions", F.lit(0)).alias("y"), F.get("c.actions", F.lit(6)).alias("z"), F.get("qpos", F.lit(0)).alias("x"), F.get("qpos", F.lit(7)).alias("logit")
    )


def _loss(t):
    live = lambda v: F.sum(F.when(~F.col("pad"), v).otherwise(0.0)) / F.count("*")
    bce = F.greatest(F.col("logit"), F.lit(0.0)) - F.col("logit") * (F.col("z") > 0).cast("double") + F.log1p(F.exp(-F.abs("logit")))
    return _padded(t).agg(live(F.abs(F.col("y") - F.col("x"))).alias("l1"), live(bce).alias("bce"), live(F.pow(F.col("y") - F.col("x"), F.lit(2))).alias("l2"))


_L1 = "sum(case when not pad then abs(y - x) else 0 end) / count(*)"
_BCE = "sum(case when not pad then greatest(logit, 0) - logit * (z > 0)::int + ln(1 + exp(-abs(logit))) else 0 end) / count(*)"


@query("A22_masked_l1", f"select round({_L1}, 6) as l1 from pd", "steps", also=PAD)
def masked_l1(t):
    return _loss(t).select(r6("l1"))


@query("A23_masked_bce", f"select round({_BCE}, 6) as bce from pd", "steps", also=PAD)
def masked_bce(t):
    return _loss(t).select(r6("bce"))


@query("A24_masked_squares", "select round(sum(case when not pad then (y - x) * (y - x) else 0 end) / count(*), 6) as l2 from pd", "steps", also=PAD)
def masked_squares(t):
    return _loss(t).select(r6("l2"))


@query("A25_kl_divergence", "select round(sum(kl) / (select count(*) from steps), 6) as total, round(avg(kl), 6) as mean from (select -0.5 * (1 + v - m * m - exp(v)) as kl from (select unnest(qpos[1:7]) as m, unnest(action) as v from steps))", "steps")
def kl_divergence(t):
    kl = F.zip_with(F.slice("qpos", 1, 7), "action", lambda m, v: -0.5 * (1 + v - m * m - F.exp(v)))
    each = t("steps").select(F.posexplode(kl).alias("dim", "kl")).groupBy("dim").agg(F.avg("kl").alias("kl"))
    return each.agg(F.round(F.sum("kl"), 6).alias("total"), F.round(F.avg("kl"), 6).alias("mean"))


@query("A26_weighted_loss", f"select round({_L1} + 0.1 * {_BCE} + 10 * (select avg(action[1] * action[1]) from steps), 6) as loss from pd", "steps", also=PAD)
def weighted_loss(t):
    kl = t("steps").agg(F.avg(F.pow(F.get("action", F.lit(0)), F.lit(2))).alias("kl"))
    return _loss(t).crossJoin(F.broadcast(kl)).select(F.round(F.col("l1") + 0.1 * F.col("bce") + 10 * F.col("kl"), 6).alias("loss"))


@query("A27_first_action_mse", "select round(avg((y - x) * (y - x)), 6) as mse from pd where offset_ = 0", "steps", also=PAD)
def first_action_mse(t):
    return _padded(t).where("offset_ = 0").agg(F.round(F.avg(F.pow(F.col("y") - F.col("x"), F.lit(2))), 6).alias("mse"))


@query("A28_mask_boxes", "select mask_id, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from mask_pixels group by 1", "mask_pixels")
def mask_boxes(t):
    return evaluate.boxes_of_masks(t("mask_pixels"))


XY = "xy as (select *, cx - 0.5 * w as x0, cy - 0.5 * h as y0, cx + 0.5 * w as x1, cy + 0.5 * h as y1 from boxes)"
IOU = (
    XY
    + """, pr as (select a.grp, a.id as a, b.id as b, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) as areas,
  greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) as both_,
  (greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)) as hull
  from xy a join xy b on a.grp = b.grp and a.side = 0 and b.side = 1)"""
)


@query("P24_box_corners", "select id, round(x0, 6) as x0, round(y0, 6) as y0, round(x1, 6) as x1, round(y1, 6) as y1 from xy", "boxes", also=XY)
def box_corners(t):
    return evaluate.corners(t("boxes")).select("id", r6("x0"), r6("y0"), r6("x1"), r6("y1"))


def _pairs(t):
    xy = evaluate.corners(t("boxes"))
    return evaluate.box_pairs(xy.where("side = 0"), xy.where("side = 1"), "grp")


@query("J9_box_iou", "select grp, a, b, round(both_ / (areas - both_), 6) as iou from pr", "boxes", also=IOU)
def box_iou(t):
    return _pairs(t).select("grp", "a", "b", r6("iou"))


@query("J9_overlapping_boxes", "select grp, a, b, round(both_ / (areas - both_), 6) as iou from pr where both_ > 0", "boxes", also=IOU)
def overlapping_boxes(t):
    xy = evaluate.corners(t("boxes"))
    return evaluate.overlapping_pairs(xy.where("side = 0"), xy.where("side = 1"), "grp", cell=0.1).select("grp", "a", "b", r6("iou"))


@query("J10_generalised_iou", "select grp, a, b, round(both_ / (areas - both_) - (hull - (areas - both_)) / hull, 6) as giou from pr", "boxes", also=IOU)
def generalised_iou(t):
    """Equal values lie side by side, as the rows grow with the square of the boxes: files of half the size."""
    return _pairs(t).select("grp", "a", "b", millionths("giou")).sortWithinPartitions("giou")
