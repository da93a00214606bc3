"""Queries of the per-row features and of the geometry jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import features as fx
from ..functions import geometry as geo
from ..sources.tables import uniform
from .registry import query


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def _dims(rows, keys, array):
    """Long form of an array column, rounded."""
    each = rows.select(*keys, F.posexplode(array).alias("dim", "value"))
    return each.select(*keys, F.col("dim").cast("long").alias("dim"), r6("value", "value"))


def _list(*items: str, body: str, keys: str = "id") -> str:
    """SQL for the long form of a list of expressions."""
    return f"select {keys}, unnest(range(0, {len(items)})) as dim, unnest([{', '.join(f'round({i}, 6)' for i in items)}]) as value {body}"


ID = ["episode_id", "step"]
STEPS = {"body": "from steps", "keys": "episode_id, step"}


@query("P1_seconds", "select seq, round(t_us * 1000 * 1e-9, 6) as t from messages", "messages")
def seconds(t):
    return t("messages").select("seq", r6(fx.seconds(F.col("t_us") * 1000), "t"))


@query("P2_merged_seconds", "select seq, round(t_us // 1000000 + (t_us % 1000000) * 1000 * 10e-10, 6) as t from messages", "messages")
def merged_seconds(t):
    return t("messages").select("seq", r6(fx.merged_seconds(F.expr("t_us div 1000000"), (F.col("t_us") % 1000000) * 1000), "t"))


@query("P3_topic_routing", "select seq, case when topic = 'click' then value end as click, case when topic = 'view' then value end as view_ from messages where topic in ('click', 'view')", "messages")
def topic_routing(t):
    put = lambda k: F.when(F.col("topic") == k, F.col("value"))
    return t("messages").where(F.col("topic").isin("click", "view")).select("seq", put("click").alias("click"), put("view").alias("view_"))


@query("P4_twist_vector", _list(*[f"action[{k}]" for k in range(1, 7)], **STEPS), "steps")
def twist_vector(t):
    linear, angular = F.slice("action", 1, 3), F.slice("action", 4, 3)
    parts = t("steps").select(*ID, F.struct(linear.alias("linear"), angular.alias("angular")).alias("twist"))
    return _dims(parts, ID, F.concat("twist.linear", "twist.angular"))


@query("P5_flags", "select episode_id, step, case when action[7] > 0 then 1.0::double else 0.0::double end as value from steps", "steps")
def flags(t):
    return t("steps").select(*ID, fx.flag(fx.el("action", 6) > 0).alias("value"))


@query("P6_joint_order", "select bag, seq, unnest(range(0, 3)) as dim, unnest([round(pos[list_position(names, n)], 6) for n in (select arg_min(f.names, f.seq) from joints f where f.bag = j.bag)]) as value from joints j", "joints")
def joint_order(t):
    first = t("joints").groupBy("bag").agg(F.min_by("names", "seq").alias("canon"))
    rows = t("joints").join(first, "bag")
    return _dims(rows, ["bag", "seq"], fx.by_name(F.col("names"), F.col("pos"), F.col("canon")))


@query("P7_named_state", "select bag, seq, unnest([0, 1]::bigint[]) as dim, unnest([round(pos[list_position(names, 'j1')], 6), round(pos[list_position(names, 'j2')] + pos[list_position(names, 'j3')], 6)]) as value from joints", "joints")
def named_state(t):
    names, pos = F.col("names"), F.col("pos")
    state = F.concat(fx.by_name(names, pos, ["j1"]), F.array(fx.width_of(names, pos, ["j2", "j3"])))
    return _dims(t("joints"), ["bag", "seq"], state)


@query("P8_initial_width", "select bag, round(arg_min(pos[list_position(names, 'j2')] + pos[list_position(names, 'j3')], seq), 6) as width from joints group by bag", "joints")
def initial_width(t):
    return t("joints").groupBy("bag").agg(r6(F.min_by(fx.width_of(F.col("names"), F.col("pos"), ["j2", "j3"]), "seq"), "width"))


@query("P9_arm_and_width", _list(*[f"qpos[{k}]" for k in range(1, 8)], "2 * qpos[8]", **STEPS), "steps")
def arm_and_width(t):
    return _dims(t("steps"), ID, fx.arm_and_width(F.col("qpos")))


@query("P10_dimension_pick", _list("qpos[3]", "qpos[1]", "qpos[6]", **STEPS), "steps")
def dimension_pick(t):
    return _dims(t("steps"), ID, fx.pick("qpos", [2, 0, 5]))


@query("P11_gather_and_hand", _list("qpos[3]", "qpos[5]", "action[7]", **STEPS), "steps")
def gather_and_hand(t):
    return _dims(t("steps"), ID, F.concat(fx.pick("qpos", [2, 4]), F.array(fx.el("action", 6))))


_RAW = "from (select vec_id as id, embedding[1:16]::double[] as raw, embedding[1:14]::double[] as act from embeddings)"


def _raw(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.expr("transform(slice(embedding, 1, 16), x -> cast(x as double))").alias("raw"))


_N = "(raw[{}] - 0.01844) / (0.058 - 0.01844)"


@query("P12_two_arms", _list(*[f"raw[{k}]" for k in range(1, 7)], _N.format(7), *[f"raw[{k}]" for k in range(9, 15)], _N.format(15), body=_RAW))
def two_arms(t):
    return _dims(_raw(t), ["id"], fx.two_arms(F.col("raw")))


_U = "{}(act[{}] * (0.058 - 0.01844) + 0.01844)"


@query("P13_arm_command", _list(*[f"act[{k}]" for k in range(1, 7)], _U.format("", 7), _U.format("-", 7), *[f"act[{k}]" for k in range(8, 14)], _U.format("", 14), _U.format("-", 14), body=_RAW))
def arm_command(t):
    return _dims(_raw(t), ["id"], fx.arm_command(F.slice("raw", 1, 14)))


@query(
    "P14_gripper_maps",
    _list(
        "(x - 0.01244) / (0.02417 - 0.01244)", "(x - 0.01844) / (0.058 - 0.01844)", "x * (0.02417 - 0.01244) + 0.01244", "x * (0.058 - 0.01844) + 0.01844",
        "(x - 0.01244) / (0.02417 - 0.01244) * (0.058 - 0.01844) + 0.01844", "(x + 0.6842) / (0.3083 + 0.6842)", "(x + 0.6213) / (1.491 + 0.6213)",
        "x * (0.3083 + 0.6842) - 0.6842", "x * (1.491 + 0.6213) - 0.6213", "(x + 0.6842) / (0.3083 + 0.6842) * (1.491 + 0.6213) - 0.6213",
        "x / (0.02417 - 0.01244)", "x / (0.058 - 0.01844)", "(x - 0.01244) / (0.02417 - 0.01244) * (0.3083 + 0.6842) - 0.6842",
        "(x + 0.6842) / (0.3083 + 0.6842) * (0.02417 - 0.01244) + 0.01244", "(x - 0.01844) / (0.058 - 0.01844) * (1.491 + 0.6213) - 0.6213",
        "(x + 0.6213) / (1.491 + 0.6213) * (0.058 - 0.01844) + 0.01844", "x - (0.3083 - 0.6842) / 2",
        body="from (select vec_id as id, embedding[1]::double as x from embeddings)",
    ),
)
def gripper_maps(t):
    x = F.col("x")
    maps = [fx.normalise(x, w, "position") for w in ("master", "puppet")] + [fx.unnormalise(x, w, "position") for w in ("master", "puppet")]
    maps += [fx.leader_to_follower(x, "position")] + [fx.normalise(x, w, "joint") for w in ("master", "puppet")]
    maps += [fx.unnormalise(x, w, "joint") for w in ("master", "puppet")] + [fx.leader_to_follower(x, "joint")]
    maps += [fx.velocity(x, w) for w in ("master", "puppet")]
    maps += [fx.convert(x, "master", "position", "joint"), fx.convert(x, "master", "joint", "position"), fx.convert(x, "puppet", "position", "joint"), fx.convert(x, "puppet", "joint", "position")]
    maps += [x - F.lit(fx.joint_middle("master"))]
    rows = t("embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return _dims(rows, ["id"], F.array(*maps))


@query("P15_replace_grippers", _list(*[f"action[{k}]" for k in range(1, 7)], "qpos[8]", **STEPS), "steps")
def replace_grippers(t):
    return _dims(t("steps"), ID, fx.replace_dims(F.col("action"), {6: fx.el("qpos", 7)}))


@query("P19_clip", _list(*[f"greatest(least(action[{k}], {m}), -{m})" for k, m in enumerate((0.03, 0.03, 0.03, 0.1, 0.1, 0.1), 1)], **STEPS), "steps")
def clip(t):
    return _dims(t("steps"), ID, fx.clip(F.slice("action", 1, 6), fx.TWIST_LIMITS))


@query("P20_safety_cap", _list("qpos[1]", "least(action[1], 0.05)", "qpos[3]", "action[2] - least(action[1], 0.05)", *[f"qpos[{k}]" for k in range(5, 9)], **STEPS), "steps")
def safety_cap(t):
    first = F.least(fx.el("action", 0), F.lit(0.05))
    targets = F.array(first, fx.el("action", 1) - first)
    return _dims(t("steps"), ID, fx.scatter(F.col("qpos"), [1, 3], targets))


@query("P21_sigmoid", "select seq, round(1 / (1 + exp(-x)), 6) as p, 1 / (1 + exp(-x)) > 0.5 as on_ from logits", "logits")
def sigmoid(t):
    p = fx.sigmoid(F.col("x"))
    return t("logits").select("seq", r6(p, "p"), (p > 0.5).alias("on_"))


@query("P22_hand_label", "select seq, case when round_even(x, 0) < 0.5 then 'open' else 'closed' end as hand from logits", "logits")
def hand_label(t):
    return t("logits").select("seq", fx.hand_label(F.col("x")).alias("hand"))


@query("P23_standardise", _list("(qpos[1] / 255 - 0.485) / 0.229", "(qpos[2] / 255 - 0.456) / 0.224", "(qpos[3] / 255 - 0.406) / 0.225", **STEPS), "steps")
def standardise(t):
    return _dims(t("steps"), ID, fx.standardise(F.slice("qpos", 1, 3), [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]))


@query("P25_camera_members", "select camera, count(*) as n from (select unnest(case when event_type like '%view' then ['left', 'right'] else [event_type] end) as camera from events) group by 1")
def camera_members(t):
    name = F.regexp_replace("event_type", "view$", "stereo")
    return t("events").select(F.explode(fx.camera_members(name)).alias("camera")).groupBy("camera").agg(F.count("*").alias("n"))


@query("P26_frame_slot", "select seq, floor(sec * 30)::bigint as slot, round((1 + floor(sec * 30)) / 30 - sec, 6) as left_ from latency", "latency")
def frame_slot(t):
    slot, left = fx.frame_slot(F.col("sec"), 30)
    return t("latency").select("seq", slot.alias("slot"), r6(left, "left_"))


@query("P27_concatenate_state", _list(*[f"qpos[{k}]" for k in range(1, 9)], "action[1]", **STEPS), "steps")
def concatenate_state(t):
    return _dims(t("steps"), ID, F.concat("qpos", F.array(fx.el("action", 0))))


# --- geometry --------------------------------------------------------------

POSES = """pp as (select *, lead(id, 1) over (order by id) as next_id from poses)"""
_S = "(2 / (qx * qx + qy * qy + qz * qz + qw * qw))"
_M = [
    f"1 - {_S} * (qy * qy + qz * qz)", f"{_S} * (qx * qy - qz * qw)", f"{_S} * (qx * qz + qy * qw)", "px",
    f"{_S} * (qx * qy + qz * qw)", f"1 - {_S} * (qx * qx + qz * qz)", f"{_S} * (qy * qz - qx * qw)", "py",
    f"{_S} * (qx * qz - qy * qw)", f"{_S} * (qy * qz + qx * qw)", f"1 - {_S} * (qx * qx + qy * qy)", "pz",
    "0.0", "0.0", "0.0", "1.0",
]
MATS = "mats as (select id, [" + ", ".join(_M) + "]::double[] as m from poses)"
_INV = [f"m[{4 * c + r + 1}]" if c < 3 else "-(" + " + ".join(f"m[{4 * k + r + 1}] * m[{4 * k + 4}]" for k in range(3)) + ")" for r in range(3) for c in range(4)] + ["0.0", "0.0", "0.0", "1.0"]
INVS = MATS + ", invs as (select id, [" + ", ".join(_INV) + "]::double[] as v from mats)"
_MUL = [" + ".join(f"a.{{0}}[{4 * r + k + 1}] * b.{{1}}[{4 * k + c + 1}]" for k in range(4)) for r in range(4) for c in range(4)]


def mats(t):
    return t("poses").select("id", geo.matrix(*[F.col(c) for c in ("px", "py", "pz", "qx", "qy", "qz", "qw")]).alias("m"))


def neighbours(t):
    """Each pose with the pose of the next id."""
    a, b = mats(t), mats(t).select((F.col("id") - 1).alias("id"), F.col("m").alias("b"))
    return a.join(b, "id")


@query("G1_matrix", _list(*[f"m[{k}]" for k in range(1, 17)], body="from mats"), "poses", also=MATS)
def matrix(t):
    return _dims(mats(t), ["id"], F.col("m"))


@query("G2_compose", _list(*[x.format("m", "m") for x in _MUL], body="from mats a join mats b on b.id = a.id + 1", keys="a.id as id"), "poses", also=MATS)
def compose(t):
    return _dims(neighbours(t), ["id"], geo.compose(F.col("m"), F.col("b")))


@query("G3_inverse", _list(*[f"v[{k}]" for k in range(1, 17)], body="from invs"), "poses", also=INVS)
def inverse(t):
    return _dims(mats(t), ["id"], geo.inverse(F.col("m")))


@query("G4_vectors", _list("px", "py", "pz", *[f"case when qw < 0 then -{q} else {q} end" for q in ("qx", "qy", "qz", "qw")], body="from poses"), "poses")
def vectors(t):
    return _dims(mats(t), ["id"], F.concat(geo.position(F.col("m")), geo.quaternion(F.col("m"))))


@query("G5_change_of_frame", _list(*[x.format("v", "m") for x in _MUL], body="from invs a join mats b on b.id = a.id + 1", keys="a.id as id"), "poses", also=INVS)
def change_of_frame(t):
    return _dims(neighbours(t), ["id"], geo.relative(F.col("m"), F.col("b")))


@query("G6_flat", _list(*[f"m[{4 * r + c + 1}]" for c in range(4) for r in range(3)], body="from mats"), "poses", also=MATS)
def flat(t):
    return _dims(mats(t), ["id"], geo.flat12(F.col("m")))


@query("G7_six_values", _list(*[f"m[{4 * r + c + 1}]" for c in range(2) for r in range(3)], *[f"m[{4 * r + 4}]" for r in range(3)], body="from mats"), "poses", also=MATS)
def six_values(t):
    return _dims(mats(t), ["id"], geo.rotation6(geo.flat12(F.col("m"))))


GS = """g0 as (select vec_id as id, embedding[1:6]::double[] as v from embeddings),
g1 as (select *, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) as l from g0),
g2 as (select id, v[1] / l as a, v[2] / l as b, v[3] / l as c, v[4] as d, v[5] as e, v[6] as f from g1),
g3 as (select *, d - (a * d + b * e + c * f) * a as p, e - (a * d + b * e + c * f) * b as q, f - (a * d + b * e + c * f) * c as r from g2),
g4 as (select id, a, b, c, p / sqrt(p * p + q * q + r * r) as p, q / sqrt(p * p + q * q + r * r) as q, r / sqrt(p * p + q * q + r * r) as r from g3)"""


@query("G8_gram_schmidt", _list("a", "b", "c", "p", "q", "r", "b * r - c * q", "c * p - a * r", "a * q - b * p", body="from g4"), also=GS)
def gram_schmidt(t):
    rows = t("embeddings").select(F.col("vec_id").alias("id"), F.expr("transform(slice(embedding, 1, 6), x -> cast(x as double))").alias("v"))
    return _dims(rows, ["id"], geo.gram_schmidt(F.col("v")))


KEY = """kf as (select traj, 10 * (k - 1) as t, value, kk from (select user_id as traj, row_number() over (partition by user_id order by event_id) as k, value, cast(props->>'k' as double) as kk from events)),
kn as (select *, lead(t) over w as t2, lead(value) over w as v2, lead(kk) over w as k2 from kf window w as (partition by traj order by t))"""


@query("G9_keyframe_interpolation", "select traj, g as t, round(value + (v2 - value) * (g - t) / (t2 - t), 6) as value, round(kk + (k2 - kk) * (g - t) / (t2 - t), 6) as k from (select *, unnest(range(t, t2)) as g from kn where t2 is not null)", also=KEY)
def keyframe_interpolation(t):
    w = Window.partitionBy("traj").orderBy("event_id")
    parsed = t("events").select(F.col("user_id").alias("traj"), "event_id", F.array("value", F.get_json_object("props", "$.k").cast("double")).alias("v"))
    frames = parsed.withColumn("n", F.row_number().over(w)).withColumn("t", (10 * (F.col("n") - 1)).cast("long"))
    order = Window.partitionBy("traj").orderBy("t")
    spans = frames.withColumns({"t2": F.lead("t").over(order), "v2": F.lead("v").over(order)}).where("t2 is not null")
    each = spans.withColumn("g", F.explode(F.sequence("t", F.col("t2") - 1)))
    each = each.withColumn("share", (F.col("g") - F.col("t")) / (F.col("t2") - F.col("t")))
    out = each.withColumn("m", geo.lerp(F.col("v"), F.col("v2"), F.col("share"))).select("traj", F.col("g").alias("t"), "m")
    return out.select("traj", "t", r6(F.get("m", F.lit(0)), "value"), r6(F.get("m", F.lit(1)), "k"))


# arm, t, offsets, gripper, whether the turn starts from the initial orientation, axis, degrees
_FRAMES = [
    ("left", 0, 0.0, 0.4, 0.0, 1, 1.0, 0.0, 0.0, 0.0),
    ("left", 100, -0.1, 0.25, 1.0, 0, 1.0, 0.0, 0.0, 90.0),
    ("left", 360, -0.1, 0.25, 0.0, 0, 1.0, 0.0, 0.0, 0.0),
    ("right", 0, 0.0, 0.4, 0.0, 1, 0.0, 1.0, 0.0, 0.0),
    ("right", 90, 0.05, 0.2, 1.0, 1, 0.0, 1.0, 0.0, -60.0),
    ("right", 120, 0.0, 0.2, 1.0, 1, 0.0, 1.0, 0.0, 60.0),
]
_DRAW = "('0x' || substr(md5('7:' || rollout || ':{0}'), 1, 8))::bigint / 4294967296"
_TURN = ", ".join(f"('{f[0]}', {', '.join(f'{x}' if isinstance(x, int) else f'{x}::double' for x in f[1:])})" for f in _FRAMES)


@query(
    "G10_scenario_keyframes",
    f"""select rollout, arm, t, round(0.2 * u + dx, 6) as x, round(dz, 6) as z, gripper, round(iw * c - iz * s * nz, 6) as qw, round(iw * s * nx - iz * s * ny, 6) as qx,
       round(iw * s * ny + iz * s * nx, 6) as qy, round(iw * s * nz + iz * c, 6) as qz from
       (select *, case when own = 1 then cos(yaw) else 1 end as iw, case when own = 1 then sin(yaw) else 0 end as iz, cos(radians(deg) / 2) as c, sin(radians(deg) / 2) as s from
        (select rollout, {_DRAW.format("x")} as u, {_DRAW.format("yaw")} as yaw from (select distinct rollout from rewards)), (values {_TURN}) v(arm, t, dx, dz, gripper, own, nx, ny, nz, deg))""",
    "rewards",
)
def scenario_keyframes(t):
    """Keyframes of both arms: positions from the drawn object, orientations turned from the arm's initial one or from none."""
    template = t.spark.createDataFrame(_FRAMES, "arm string, t int, dx double, dz double, gripper double, own int, nx double, ny double, nz double, deg double")
    draw = lambda c: uniform(7, F.col("rollout"), F.lit(c))
    rows = t("rewards").select("rollout").distinct().withColumns({"px": 0.2 * draw("x"), "yaw": draw("yaw")})
    each = rows.crossJoin(F.broadcast(template))  # six rows per scenario
    own = F.col("own") == 1
    initial = [F.when(own, F.cos("yaw")).otherwise(1.0), F.lit(0.0), F.lit(0.0), F.when(own, F.sin("yaw")).otherwise(0.0)]
    q = geo.turned(initial, [F.col("nx"), F.col("ny"), F.col("nz")], F.col("deg"))
    parts = [F.round(c + 0.0, 6).alias(n) for c, n in zip(q, ("qw", "qx", "qy", "qz"), strict=True)]
    return each.select("rollout", "arm", "t", r6(F.col("px") + F.col("dx"), "x"), r6("dz", "z"), "gripper", *parts)
