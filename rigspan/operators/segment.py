"""Episodes from control markers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan

START, STOP, CANCEL, CANCEL_LAST = 1, 2, 3, 4


def control_episodes(markers: DataFrame) -> DataFrame:
    """Committed episodes of ``markers(bag, seq, t_us, cmd)``: bag, episode_id, start_us, stop_us.

    1 starts (ignored while recording), 2 commits, 3 cancels the current
    recording, 4 takes back the last commit (ignored while recording or with
    none left); other markers and an unfinished tail are dropped. Commits and
    take-backs walk a stack that cannot fall under empty: a commit survives
    if the reflected height never falls below its own again. One shuffle by bag.
    """
    order = Window.partitionBy("bag").orderBy("t_us", "seq")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # the same rows from the end backwards, so that the frame grows and no row is read twice
    after = Window.partitionBy("bag").orderBy(F.desc("t_us"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    rows = markers.where(F.col("cmd").between(START, CANCEL_LAST))
    at = F.struct("t_us", "seq")
    rows = rows.withColumn("closed", F.last(F.when(F.col("cmd").isin(STOP, CANCEL), at), ignorenulls=True).over(past))
    open_ = Window.partitionBy("bag", "closed").orderBy("t_us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start_us", F.min(F.when(F.col("cmd") == START, F.col("t_us"))).over(open_))
    step = (
        F.when((F.col("cmd") == STOP) & F.col("start_us").isNotNull(), 1)
        .when((F.col("cmd") == CANCEL_LAST) & F.col("start_us").isNull(), -1)
        .otherwise(0)
    )
    rows = rows.withColumn("step", step).where("step <> 0")
    rows = rows.withColumn("walk", F.sum("step").over(upto))
    rows = rows.withColumn("height", F.col("walk") - F.least(F.lit(0), F.min("walk").over(upto)))
    kept = rows.withColumn("low", F.min("height").over(after)).where("step = 1 and low >= height")
    return kept.select(
        "bag", (F.row_number().over(order) - 1).cast("long").alias("episode_id"), "start_us", F.col("t_us").alias("stop_us")
    )


def keep_long(episodes: DataFrame, min_us: int = 4_000_000) -> DataFrame:
    """Episodes of at least ``min_us``, numbered anew per bag."""
    order = Window.partitionBy("bag").orderBy("start_us")
    return episodes.where(F.col("stop_us") - F.col("start_us") >= min_us).withColumn(
        "episode_id", (F.row_number().over(order) - 1).cast("long")
    )


def next_free_index(ids: DataFrame, start: int = 0, by: str = "bag", id_col: str = "episode_id") -> DataFrame:
    """Per group the smallest index from ``start`` on that no row has."""
    used = ids.where(F.col(id_col) >= start).select(by, id_col).distinct()
    order = Window.partitionBy(by).orderBy(id_col)
    gaps = used.withColumn("next", F.lead(id_col).over(order)).where(f"next is null or next > {id_col} + 1")
    first = gaps.groupBy(by).agg(F.min(F.col(id_col) + 1).alias("free"))
    begins = used.groupBy(by).agg(F.min(id_col).alias("low"))
    free = F.when(F.col("low").isNull() | (F.col("low") > start), F.lit(start)).otherwise(F.col("free")).cast("long")
    return ids.select(by).distinct().join(begins, by, "left").join(first, by, "left").select(by, free.alias("next_free"))


def repair(starts: list[float], pauses: list[float], ends: list[float], tick: float) -> list[tuple[float, float, float]]:
    """Episodes from sorted start, pause and end times, some of which may be missing or too many.

    Lists of equal length are matched as they stand. Else all times are read
    as one sequence of events: a start opens an episode unless one is open,
    the next end closes it, and its pause is the first in between. An episode
    without one pauses a tick before its end, but only if a later pause is
    still to come; without that the sequence ends.
    """
    if len(starts) == len(pauses) == len(ends):
        return list(zip(starts, pauses, ends, strict=True))
    events = sorted([(t, 0) for t in starts] + [(t, 1) for t in pauses] + [(t, 2) for t in ends])
    last_pause = max(pauses, default=float("-inf"))
    out: list[tuple[float, float, float]] = []
    opened: list[float] = []  # the open episode's start, then starts met meanwhile
    within: list[float] = []  # pauses since the open episode's start
    for t, kind in events:
        if kind == 0:
            opened.append(t)
            within = within if len(opened) > 1 else [x for x in within if x >= t]
        elif kind == 1:
            within.append(t)
        elif opened:
            if not within and last_pause <= t:
                break
            out.append((opened[0], within[0] if within else t - tick, t))
            # what lies at the very end may belong to the next episode
            opened, within = [x for x in opened[1:] if x >= t], [x for x in within[1:] if x >= t]
    return out


def repair_times(times: DataFrame, tick: float = 1 / 30) -> DataFrame:
    """Episodes of ``times(bag, kind, t)`` with kind start, pause or end: bag, episode_id, start, pause, stop."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [sorted(pdf.loc[pdf["kind"] == k, "t"]) for k in ("start", "pause", "end")]
        rows = repair(*lists, tick)
        return pd.DataFrame(
            [(pdf["bag"].iloc[0], k, *r) for k, r in enumerate(rows)], columns=["bag", "episode_id", "start", "pause", "stop"]
        )

    return times.groupBy("bag").applyInPandas(fold, "bag long, episode_id long, start double, pause double, stop double")


def hold_state(rows: DataFrame, width: int = 1 << 34) -> DataFrame:
    """Hand state on the grid of ``rows(episode_id, kind, t_us)`` with kind tick, close or open: episode_id, t_us, hand.

    Close and open events take turns. Turn j needs the first tick behind its
    event and comes one tick after turn j - 1 at the earliest, so it comes at
    tick j + max(f(m) - m) over the turns m up to j, with f(m) the ticks not
    behind event m. All counts run over blocks of ``width`` microseconds, so an
    episode spans tasks.
    """
    key = ["episode_id"]
    at = F.when(F.col("kind") == "tick", 0).when(F.col("kind") == "close", 1).otherwise(2)
    is_ = lambda k: (F.col("kind") == k).cast("long")
    # a tick at an event's time is not behind it, so it is counted before it
    rows = scan.running_sums(rows.withColumn("__kind", at), key, ["t_us", "__kind"], width, {k: is_(k) for k in ("tick", "close", "open")})
    total = rows.groupBy(*key).agg(F.max("close").alias("__closes"), F.max("open").alias("__opens"))
    # turns go on until the list whose turn it is has run out
    turns = F.when(F.col("__closes") > F.col("__opens"), 2 * F.col("__opens") + 1).otherwise(2 * F.col("__closes"))
    j = F.when(F.col("kind") == "close", 2 * F.col("close") - 2).otherwise(2 * F.col("open") - 1)
    events = rows.where("kind <> 'tick'").withColumn("j", j).join(total.select(*key, turns.alias("__turns")), key).where(F.col("j") < F.col("__turns"))
    late = scan.running_max(events, key, "j", 1 << 16, F.col("tick") - F.col("j"), "__late")
    comes = late.select(*key, (F.col("j") + F.col("__late") + 1).alias("tick"), F.lit(1).cast("long").alias("turn"), F.lit(None).cast("long").alias("t_us"))
    ticks = rows.where("kind = 'tick'").select(*key, "tick", F.lit(0).cast("long").alias("turn"), "t_us")
    both = comes.unionByName(ticks).withColumn("__is", 1 - F.col("turn"))
    state = scan.running_sums(both, key, ["tick", "__is"], 1 << 16, {"n": F.col("turn")})
    return state.where("t_us is not null").select(*key, "t_us", (F.col("n") % 2).cast("int").alias("hand"))
