"""Rollouts, run logs, losses, boxes: what evaluation computes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan

# fixed values: names of the simulator's parts
LEFT = "vx300s_left/10_left_gripper_finger"
RIGHT = "vx300s_right/10_right_gripper_finger"
SOCKETS = ["socket-1", "socket-2", "socket-3", "socket-4"]


def touches(pairs: list[tuple[str, str]]) -> Column:
    """Whether any of the (ordered) pairs is among a step's contacts."""
    hit = F.lit(False)
    for a, b in pairs:
        hit = hit | ((F.col("geom1") == a) & (F.col("geom2") == b))
    return F.bool_or(hit)


def transfer_rewards(contacts: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Reward 0 to 4 per rollout and step for the transfer task; steps without contact get 0."""
    hits = contacts.groupBy("rollout", "t").agg(
        touches([("red_box", LEFT)]).alias("left"), touches([("red_box", RIGHT)]).alias("right"), touches([("red_box", "table")]).alias("table")
    )
    lifted = ~F.col("table")
    reward = F.when(F.col("left") & lifted, 4).when(F.col("left"), 3).when(F.col("right") & lifted, 2).when(F.col("right"), 1).otherwise(0)
    return _on_steps(hits.select("rollout", "t", reward.cast("long").alias("reward")), steps)


def insertion_rewards(contacts: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Reward 0 to 4 per rollout and step for the insertion task."""
    hits = contacts.groupBy("rollout", "t").agg(
        touches([("red_peg", RIGHT)]).alias("right"),
        touches([(s, LEFT) for s in SOCKETS]).alias("left"),
        touches([("red_peg", "table")] + [(s, "table") for s in SOCKETS]).alias("table"),
        touches([("red_peg", s) for s in SOCKETS]).alias("socket"),
        touches([("red_peg", "pin")]).alias("pin"),
    )
    free, both = ~F.col("table"), F.col("left") & F.col("right")
    reward = F.when(F.col("pin"), 4).when(F.col("socket") & free, 3).when(both & free, 2).when(both, 1).otherwise(0)
    return _on_steps(hits.select("rollout", "t", reward.cast("long").alias("reward")), steps)


def _on_steps(rewards: DataFrame, steps: DataFrame | None) -> DataFrame:
    if steps is None:
        return rewards
    return steps.select("rollout", "t").join(rewards, ["rollout", "t"], "left").select("rollout", "t", F.coalesce("reward", F.lit(0).cast("long")).alias("reward"))


def returns(rewards: DataFrame, full: int = 4) -> DataFrame:
    """Per rollout: sum and maximum of its rewards (nulls left out) and whether the maximum is ``full``."""
    out = rewards.groupBy("rollout").agg(F.coalesce(F.sum("reward"), F.lit(0)).alias("total"), F.max("reward").alias("highest"))
    return out.withColumn("success", F.coalesce(F.col("highest") == full, F.lit(False)))


def at_least(returned: DataFrame, full: int = 4) -> DataFrame:
    """How many rollouts reached each reward 0 to ``full``, zero counts included."""
    n = F.count("*")
    counts = [F.count_if(F.col("highest") >= r).alias(f"r{r}") for r in range(full + 1)]
    each = [F.struct(F.lit(r).cast("long").alias("reward"), F.col(f"r{r}").alias("n"), (F.col(f"r{r}") / F.col("all")).alias("rate")) for r in range(full + 1)]
    return returned.agg(n.alias("all"), *counts).select(F.explode(F.array(*each)).alias("x")).select("x.*")


def top_k_accuracy(scores: DataFrame, ks: list[int]) -> DataFrame:
    """Percent of rows whose target is among their k best scores (ties: the lower class); 0 for no rows."""
    own = F.get("scores", F.col("target").cast("int"))
    better = F.size(F.filter("scores", lambda x: x > own))
    tied = F.size(F.filter(F.slice("scores", F.lit(1), F.col("target").cast("int")), lambda x: x == own))
    ranked = scores.withColumn("rank", better + tied + 1)
    hits = ranked.agg(*[F.coalesce(F.avg(F.when(F.col("rank") <= k, 100.0).otherwise(0.0)), F.lit(0.0)).alias(f"k{k}") for k in ks])
    return hits.select(F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"k{k}").alias("accuracy")) for k in ks])).alias("x")).select("x.*")


def corners(boxes: DataFrame) -> DataFrame:
    """Centre and size to corner coordinates."""
    half = lambda c, s, sign: F.col(c) + sign * 0.5 * F.col(s)
    return boxes.withColumns({"x0": half("cx", "w", -1), "y0": half("cy", "h", -1), "x1": half("cx", "w", 1), "y1": half("cy", "h", 1)})


def _measured(met: DataFrame, by: str) -> DataFrame:
    area = lambda k: (F.col(f"{k}_x1") - F.col(f"{k}_x0")) * (F.col(f"{k}_y1") - F.col(f"{k}_y0"))
    span = lambda lo, hi: F.greatest(hi - lo, F.lit(0.0))
    both = span(F.greatest("a_x0", "b_x0"), F.least("a_x1", "b_x1")) * span(F.greatest("a_y0", "b_y0"), F.least("a_y1", "b_y1"))
    hull = span(F.least("a_x0", "b_x0"), F.greatest("a_x1", "b_x1")) * span(F.least("a_y0", "b_y0"), F.greatest("a_y1", "b_y1"))
    met = met.withColumns({"both": both, "hull": hull}).withColumn("union_", area("a") + area("b") - F.col("both"))
    met = met.withColumn("iou", F.try_divide("both", "union_"))
    return met.withColumn("giou", F.col("iou") - F.try_divide(F.col("hull") - F.col("union_"), F.col("hull"))).select(by, "a", "b", "iou", "union_", "giou")


def _side(boxes: DataFrame, by: str, k: str) -> DataFrame:
    return boxes.where("x1 >= x0 and y1 >= y0").select(by, F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("x0", "y0", "x1", "y1")])


def _dealing(left: DataFrame, right: DataFrame, by: str, block: int, rows: int) -> tuple[DataFrame, int]:
    """Per group the blocks a side, its pairs and where they begin in a line of all pairs; and the tasks to cut that line into.

    Groups of several blocks follow each other in the line; the others, which
    may be many, begin anywhere behind them, so no window runs over those.
    """
    parts = lambda n: F.ceil(F.col(n) / block)
    sizes = left.groupBy(by).agg(F.count("*").alias("__na")).join(right.groupBy(by).agg(F.count("*").alias("__nb")), by)
    sizes = sizes.select(by, parts("__na").alias("__ka"), parts("__nb").alias("__kb"), (F.col("__na") * F.col("__nb")).alias("__n"))
    blocks = F.col("__ka") * F.col("__kb")
    sums = [F.sum("__n"), F.sum(F.when(blocks > 1, F.col("__n"))), F.sum(blocks)]
    pairs, split, met = sizes.agg(*[F.coalesce(x, F.lit(0)) for x in sums]).first()
    tasks = max(1, -(-pairs // rows), min(met, left.sparkSession.sparkContext.defaultParallelism))
    before = F.sum("__n").over(Window.partitionBy(F.when(blocks == 1, F.xxhash64(by))).orderBy(by)) - F.col("__n")
    begin = F.when(blocks > 1, before).otherwise(split + F.pmod(F.xxhash64(by), F.lit(max(1, pairs - split))))
    return sizes.withColumn("__begin", begin / max(1, pairs)).withColumn("__n", F.col("__n") / max(1, pairs)), tasks


def box_pairs(a: DataFrame, b: DataFrame, by: str, block: int = 1000, rows: int = 7_000_000) -> DataFrame:
    """IoU, union and generalised IoU of every box of ``a`` with every box of ``b`` in its group.

    Both sides of a group are dealt into blocks of about ``block`` boxes, and
    each block of one side is sent once for each block of the other, so the
    pairs of a large group are spread over tasks. What a task makes, ``rows``
    pairs and one meeting of blocks at most (groups of one block a side by
    chance), says how many there are: by the few bytes that they read, adaptive
    execution would leave all pairs to one.
    """
    left, right = _side(a, by, "a"), _side(b, by, "b")
    sizes, tasks = _dealing(left, right, by, block, rows)
    at = F.col("__begin") + (F.col("__a") * F.col("__kb") + F.col("__b")) / (F.col("__ka") * F.col("__kb")) * F.col("__n")
    task = F.floor(at * tasks).cast("int").alias("__task")

    def dealt(side: DataFrame, k: str, own: str, other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(f"__k{other}").cast("int") - 1))
        mine = F.pmod(F.xxhash64(k, *side.columns), F.col(f"__k{own}")).cast("int")
        sent = side.join(sizes, by).withColumn(f"__{own}", mine).withColumn(f"__{other}", every)
        return sent.select(*side.columns, "__a", "__b", task).repartitionById(tasks, "__task")

    return _measured(dealt(left, "a", "a", "b").join(dealt(right, "b", "b", "a"), ["__task", by, "__a", "__b"]), by)


def overlapping_pairs(a: DataFrame, b: DataFrame, by: str, cell: float) -> DataFrame:
    """:func:`box_pairs` of the boxes that share some area only, each pair once.

    Every box is sent to the grid cells of side ``cell`` that it touches, and a
    pair counts in the cell of the lower corner of what both share; boxes that
    do not meet never meet in a join either, unless they share a cell.
    """
    def cells(side: DataFrame, k: str) -> DataFrame:
        axis = lambda c: F.sequence(F.floor(F.col(f"{k}_{c}0") / cell), F.floor(F.col(f"{k}_{c}1") / cell))
        return side.withColumn("__cx", F.explode(axis("x"))).withColumn("__cy", F.explode(axis("y")))

    met = cells(_side(a, by, "a"), "a").join(cells(_side(b, by, "b"), "b"), [by, "__cx", "__cy"])
    low = lambda c: F.greatest(f"a_{c}0", f"b_{c}0")
    shared = [low(c) < F.least(f"a_{c}1", f"b_{c}1") for c in "xy"]
    once = (F.floor(low("x") / cell) == F.col("__cx")) & (F.floor(low("y") / cell) == F.col("__cy"))
    return _measured(met.where(shared[0] & shared[1] & once), by)


def boxes_of_masks(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("mask_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def rolling(metrics: DataFrame, by: list[str], order: list[str], value: str, size: int = 20, weight: str | None = None, width: int = 1 << 20) -> DataFrame:
    """Median (the lower middle), mean, maximum and latest of the last ``size`` values, and the mean of all so far, weighted by ``weight``.

    A group is scanned in blocks of ``width`` of its first order column.
    """
    n = F.lit(1) if weight is None else F.col(weight)
    rows = scan.running_sums(metrics, by, order, width, {"__total": F.col(value) * n, "__n": n})
    rows = scan.last_rows(rows, by, order, width, value, size, "__near")
    near = F.array_sort("__near")
    return rows.withColumns({
        "median": F.element_at(near, F.ceil(F.size(near) / 2).cast("int")),
        "mean": F.aggregate("__near", F.lit(0.0), lambda a, x: a + x) / F.size("__near"),
        "highest": F.array_max("__near"),
        "latest": F.col(value),
        "overall": F.try_divide("__total", "__n"),
    }).drop("__near", "__total", "__n")


def eta(rows: DataFrame, by: str, order: str, value: str, width: int = 1 << 20) -> DataFrame:
    """``rows`` with eta: the mean of ``value`` so far times the rows still to come."""
    counts = rows.groupBy(by).agg(F.count("*").alias("__all"))
    run = scan.running_sums(rows, [by], [order], width, {"__total": F.col(value), "__n": F.lit(1)})
    return run.join(counts, by).withColumn("eta", F.col("__total") / F.col("__n") * (F.col("__all") - F.col("__n"))).drop("__total", "__n", "__all")


def best_so_far(losses: DataFrame, value: str) -> DataFrame:
    """Rows with ``improved``: strictly below every earlier epoch of their run."""
    w = Window.partitionBy("run").orderBy("epoch")
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return losses.withColumn("improved", before.isNull() | (F.col(value) < before))


def snapshots(losses: DataFrame, value: str, every: int) -> DataFrame:
    """At each ``every``-th epoch and the last one the best epoch so far (the first of equals)."""
    w = Window.partitionBy("run").orderBy("epoch")
    best = F.min_by("epoch", F.struct(value, "epoch")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.max("epoch").over(Window.partitionBy("run"))
    return losses.withColumns({"best_epoch": best, "last": last}).where((F.col("epoch") % every == 0) | (F.col("epoch") == F.col("last"))).drop("last")


def interpolated(rows: DataFrame, width: int = 1 << 20) -> DataFrame:
    """``rows(run, epoch, value)`` with gaps filled linearly by position; leading ones stay null, trailing ones keep the last value."""
    placed = scan.running_sums(rows, ["run"], ["epoch"], width, {"at": F.lit(1)})
    known = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.struct("at", "value"))
    near = scan.around(placed, ["run"], ["epoch"], width, known, "b", "a")
    apart = F.col("a.at") - F.col("b.at")
    mix = F.col("b.value") + (F.col("a.value") - F.col("b.value")) * (F.col("at") - F.col("b.at")) / apart
    return near.select("run", "epoch", F.when(F.col("a").isNull() | (apart == 0), F.col("b.value")).otherwise(mix).alias("value"))


def smoothed(rows: DataFrame, com: float, width: int = 1 << 20) -> DataFrame:
    """Gaps of ``rows(run, epoch, value)`` filled linearly (leading ones kept), then the weighted mean with decay com / (1 + com).

    Numerator and denominator decay alike: a block adds its own and shrinks
    what it was entered with by the power of its length.
    """
    keep = com / (1 + com)

    def sums(values: np.ndarray, top: float, bottom: float) -> tuple[list[float], list[float]]:
        tops, bottoms = [], []
        for v in values.tolist():
            if bottom or v == v:  # leading gaps weigh nothing
                top, bottom = (top * keep + v, bottom * keep + 1.0)
            tops.append(top), bottoms.append(bottom)
        return tops, bottoms

    def summarise(block: dict[str, np.ndarray]) -> list:
        tops, bottoms = sums(block["value"].astype(float), 0.0, 0.0)
        return [tops[-1], bottoms[-1], len(tops)]

    def enter(blocks: list[tuple]) -> list:
        out, top, bottom = [], 0.0, 0.0
        for t, b, n in blocks:
            out.append((top, bottom))
            top, bottom = top * keep**n + t, bottom * keep**n + b
        return out

    def fold(block: dict[str, np.ndarray], state: tuple | None) -> tuple:
        tops, bottoms = sums(block["value"].astype(float), *(state or (0.0, 0.0)))
        return ([t / b if b else None for t, b in zip(tops, bottoms, strict=True)],)

    state = "top double, bottom double"
    return scan.composed(interpolated(rows, width), ["run"], ["epoch"], width, summarise, f"{state}, n long", enter, state, fold, "run long, epoch long, smooth double")


def frame_rate(latency: DataFrame, frames: int = 30) -> DataFrame:
    """1 / mean(sec) of every complete run of ``frames`` rows of a robot."""
    at = F.row_number().over(Window.partitionBy("robot").orderBy("seq")) - 1
    groups = latency.withColumn("block", F.floor(at / frames)).groupBy("robot", "block").agg(F.count("*").alias("n"), (1 / F.avg("sec")).alias("hz"))
    return groups.where(F.col("n") == frames).select("robot", "block", "hz")
