"""Chunk predictions to actions: ensembling, playback, hysteresis, safety."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def spread(predictions: DataFrame) -> DataFrame:
    """Long form with the step each prediction is for: rollout, query_t, offset_, target_t, dim, value."""
    return predictions.select(
        "rollout", "query_t", "offset_", (F.col("query_t") + F.col("offset_")).alias("target_t"), "action"
    )


def ensemble(predictions: DataFrame, k: float = 0.01, lookahead: int = 0, zero_is_missing: bool = True) -> DataFrame:
    """Weighted mean of all predictions that cover a step: rollout, target_t, dim, value, n.

    Ordered by query time, prediction i weighs exp(-k * i), the oldest most.
    With a look-ahead of d only those queried d steps before the target or
    earlier count. A prediction with an exact zero in any dimension is missing.
    """
    rows = spread(predictions)
    if zero_is_missing:
        rows = rows.where(F.forall("action", lambda x: x != 0))
    rows = rows.where(F.col("query_t") <= F.col("target_t") - lookahead)
    order = Window.partitionBy("rollout", "target_t").orderBy("query_t")
    rows = rows.withColumn("w", F.exp(F.lit(-k) * (F.row_number().over(order) - 1)))
    each = rows.select("rollout", "target_t", "w", F.posexplode("action").alias("dim", "value"))
    return each.groupBy("rollout", "target_t", F.col("dim").cast("long").alias("dim")).agg(
        (F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"), F.count("*").alias("n")
    )


def with_fallback(ensembled: DataFrame, predictions: DataFrame) -> DataFrame:
    """Ensembled values for every query step; where none is left, the first action of that step's chunk."""
    own = predictions.where("offset_ = 0").select("rollout", F.col("query_t").alias("target_t"), F.posexplode("action").alias("dim", "own"))
    own = own.withColumn("dim", F.col("dim").cast("long"))
    return own.join(ensembled, ["rollout", "target_t", "dim"], "left").select(
        "rollout", "target_t", "dim", F.coalesce("value", "own").alias("value"), F.col("value").isNull().alias("fallback")
    )


def playback(predictions: DataFrame, every: int) -> DataFrame:
    """Chunks played in turn: step t takes offset t % every of the chunk asked at t - t % every."""
    rows = spread(predictions).where((F.col("query_t") % every == 0) & (F.col("offset_") < every))
    return rows.select("rollout", F.col("target_t").alias("t"), "action")


def hysteresis(rows: DataFrame, close: float = 0.7, open_: float = 0.3) -> DataFrame:
    """closed per row of ``rows(robot, seq, t_us, x)``: shut over ``close``, opened under ``open_``, else kept."""
    p = 1 / (1 + F.exp(-F.col("x")))
    w = Window.partitionBy("robot").orderBy("t_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(p > close, 1).when(p < open_, 0)
    return rows.withColumn("closed", F.coalesce(F.last(turn, ignorenulls=True).over(w), F.lit(0)).cast("long"))


def limited(times: list[int], probs: list[float], least_us: int, close: float, open_: float, state: tuple[bool, int] | None = None):
    """Hysteresis with a rate limit, row by row: (closed, published); a change too soon is dropped.

    Starts open, published at the first row's time. Returns the rows and the last (closed, publish time).
    """
    out, (closed, last) = [], state or (False, times[0] if times else 0)
    for t, p in zip(times, probs, strict=True):
        wants = p > close if not closed else not p < open_
        published = wants != closed and t - last > least_us
        if published:
            closed, last = wants, t
        out.append((closed, published))
    return out, (closed, last)


def limited_hysteresis(rows: DataFrame, least_us: int = 500_000, close: float = 0.7, open_: float = 0.3, width: int = 1 << 34) -> DataFrame:
    """robot, seq, closed, published of ``rows(robot, seq, t_us, x)``; a robot is folded in blocks of ``width`` microseconds.

    What happens behind a publish depends on its row and new state alone, so a
    block's rows form chains of publishes: from whatever state it is entered,
    the first row that may publish joins one of them. A block tells, for open
    and closed, which rows those are and how their chain leaves it.
    """

    def wanted(block: dict[str, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        t, p = block["t_us"].astype(np.int64), block["p"].astype(float)
        return t, [np.flatnonzero(p > close), np.flatnonzero(p < open_)]  # rows that would change open, closed

    def summarise(block: dict[str, np.ndarray]) -> list:
        t, rows_ = wanted(block)
        times = [t[r] for r in rows_]
        # the chain behind a publish at row i: where it ends, from the last row backwards
        exits: list[dict[int, tuple[int, int]]] = [{}, {}]
        for i, was in sorted([(int(i), c) for c in (0, 1) for i in rows_[c]], reverse=True):
            now = 1 - was
            j = int(np.searchsorted(times[now], t[i] + least_us, side="right"))
            exits[was][i] = exits[now][int(rows_[now][j])] if j < len(times[now]) else (now, int(t[i]))
        near = t[0] + least_us
        out: list = [int(t[0])]
        for c in (0, 1):
            upto = int(np.searchsorted(times[c], near, side="right")) + 1  # the first row behind that serves every earlier publish
            head = rows_[c][:upto].tolist()
            out += [t[head].tolist(), [exits[c][i][0] for i in head], [exits[c][i][1] for i in head]]
        return out

    def enter(blocks: list[tuple]) -> list:
        out, state = [], None
        for first, *tables in blocks:
            out.append((None, None) if state is None else (bool(state[0]), state[1]))
            closed, last = state or (0, first)
            times, to, at = tables[3 * closed : 3 * closed + 3]
            k = int(np.searchsorted(np.asarray(times, np.int64), last + least_us, side="right"))
            state = (int(to[k]), int(at[k])) if k < len(times) else (closed, last)
        return out

    def fold(block: dict[str, np.ndarray], state: tuple | None) -> tuple:
        done, _ = limited(block["t_us"].tolist(), block["p"].tolist(), least_us, close, open_, state)
        return tuple(zip(*done, strict=True))

    probs = rows.select("robot", "seq", "t_us", (1 / (1 + F.exp(-F.col("x")))).alias("p"))
    table = lambda c: f"t{c} array<long>, to{c} array<int>, at{c} array<long>"
    summary = f"first_us long, {table(0)}, {table(1)}"
    return scan.composed(probs, ["robot"], ["t_us", "seq"], width, summarise, summary, enter, "was boolean, last_us long", fold, "robot long, seq long, closed boolean, published boolean")


def edges(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows whose thresholded probability differs from the row before (at first: from off)."""
    on = 1 / (1 + F.exp(-F.col("x"))) > threshold
    w = Window.partitionBy("robot").orderBy("t_us", "seq")
    return rows.withColumn("on", on).withColumn("before", F.lag("on", 1, False).over(w)).where("on <> before").drop("before")


def compensated_steps(rows: DataFrame, hz: float) -> DataFrame:
    """Step per row: the row's own slot int(sec * hz) and one more, summed; the first row's slot is 0."""
    order = Window.partitionBy("robot").orderBy("seq")
    slot = F.when(F.row_number().over(order) == 1, 0).otherwise(F.floor(F.lag("sec").over(order) * hz) + 1)
    total = F.sum("slot").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("slot", slot.cast("long")).withColumn("step", total)


def predict(rows: DataFrame, predictor: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Chunk predictions of a user's function over batches of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield predictor(batch)

    return rows.mapInPandas(run, schema)


def linear_predictor(offsets: int = 4) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A deterministic predictor for tests: each offset adds a tenth of the state."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            [
                (r.episode_id, r.step, k, [float(x) * (1 + k / 10) for x in r.qpos])
                for r in batch.itertuples()
                for k in range(offsets)
            ],
            columns=["rollout", "query_t", "offset_", "action"],
        )

    return run
