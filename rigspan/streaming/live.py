"""Live logs whose rows come late: event order across micro-batches, episodes as a changelog, and what joins to them.

A row is held in keyed state until the watermark has passed its time, so the
marker machine sees every bag in event order whatever order the files came in.
Rows behind the watermark never reach it; the engine drops and counts them
(:func:`late_rows`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.predict import limited
from ..operators.segment import CANCEL, CANCEL_LAST, START, STOP
from ..sources.tables import shared_dir
from .stream import read

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "bag long, op int, start_us long, stop_us long, at_us long, at_ts timestamp"


def _changes(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["bag", "op", "start_us", "stop_us", "at_us"])
    return out.assign(at_ts=pd.to_datetime(out["at_us"].astype("int64"), unit="us", utc=True))


def packed(rows: list[tuple]) -> bytes:
    """Rows as one Arrow stream."""
    table = pa.table({str(k): pa.array(c) for k, c in enumerate(zip(*rows, strict=True))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> list[tuple]:
    return list(zip(*[c.to_pylist() for c in pa.ipc.open_stream(data).read_all().columns], strict=True))


class EventOrder(StatefulProcessor):
    """One key's rows, held until the watermark has passed them and then folded in the order of time and sequence.

    A subclass names the columns it holds (``t_us`` and ``seq`` first), opens
    its own state, and folds the rows that are due into output rows. A batch's
    rows are held as one value: each step of a state is a call from the worker.
    """

    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.wake = handle.getValueState("wake", "ms long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def fold(self, key: tuple, due: list[tuple]) -> pd.DataFrame | None:
        raise NotImplementedError

    def _wake_at(self, first_us: int) -> None:
        """One timer a key, at the earliest row held."""
        ms, now = -(-first_us // 1000), self.wake.get()
        if now is None or ms < now[0]:
            if now is not None:
                self.handle.deleteTimer(now[0])
            self.handle.registerTimer(ms)
            self.wake.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for batch in rows for r in zip(*[batch[c].tolist() for c in self.columns], strict=True)]
        if new:
            self.held.appendValue((packed(new),))
            self._wake_at(min(r[0] for r in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((r for (data,) in self.held.get() for r in unpacked(data)), key=lambda r: r[:2])
        due, rest = [r for r in held if r[0] <= past], [r for r in held if r[0] > past]
        out = self.fold(key, due)
        self.held.put([(packed(rest),)]) if rest else self.held.clear()
        self.wake.clear()
        if rest:
            self._wake_at(rest[0][0])
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


def _keep(state, value) -> None:
    """Set a state, or clear it where there is nothing to keep."""
    (state.put if isinstance(value, list) else state.update)(value) if value else state.clear()


class MarkerOrder(EventOrder):
    """One bag: the open start and the stack of live commits."""

    columns = ["t_us", "seq", "cmd"]

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getListState("live", "start_us long, stop_us long")
        self.opened = handle.getValueState("opened", "start_us long")

    def fold(self, key: tuple, due: list[tuple]) -> pd.DataFrame:
        current = (self.opened.get() or (None,))[0]
        live, out = [tuple(r) for r in self.live.get()], []
        for t, _, cmd in due:
            if cmd == START and current is None:
                current = t
            elif cmd == STOP and current is not None:
                live.append((current, t))
                out.append((key[0], 1, current, t, t))
                current = None
            elif cmd == CANCEL:
                current = None
            elif cmd == CANCEL_LAST and current is None and live:
                out.append((key[0], -1, *live.pop(), t))
        _keep(self.live, live)
        _keep(self.opened, None if current is None else (current,))
        return _changes(out)


MESSAGE = "bag long, seq long, t_us long, topic string, cmd int, value double, ts timestamp"


def _messages(bag: int, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["t_us", "seq", "topic", "cmd", "value"])
    out.insert(0, "bag", bag)
    return out[["bag", "seq", "t_us", "topic", "cmd", "value"]].assign(ts=pd.to_datetime(out["t_us"].astype("int64"), unit="us", utc=True))


class MessageOrder(EventOrder):
    columns = ["t_us", "seq", "topic", "cmd", "value"]


class ReadyGate(MessageOrder):
    """One bag: rows pass from the time on at which every topic has been seen."""

    def __init__(self, topics: list[str]):
        self.topics = set(topics)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "topic string")

    def fold(self, key: tuple, due: list[tuple]) -> pd.DataFrame:
        seen, out = {r[0] for r in self.seen.get()}, []
        known = len(seen)
        for _, now in groupby(due, key=lambda r: r[0]):  # rows of one time come together
            rows = list(now)
            seen |= {r[2] for r in rows} & self.topics
            out += rows if seen == self.topics else []
        if len(seen) > known:
            self.seen.put([(t,) for t in sorted(seen)])
        return _messages(key[0], out)


class ModeGate(MessageOrder):
    """One bag: data rows pass while the last mode command is start, with a step counter that wraps."""

    def __init__(self, most: int):
        self.most = most

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.mode = handle.getValueState("mode", "running boolean, steps long")

    def fold(self, key: tuple, due: list[tuple]) -> pd.DataFrame:
        running, steps = self.mode.get() or (False, 0)
        out, at = [], []
        for row in due:
            if row[3] in (START, STOP):
                running = row[3] == START
            if running and row[2] != "control":
                out.append(row), at.append(steps % self.most)
                steps += 1
        self.mode.update((running, steps))
        return _messages(key[0], out).assign(step=pd.Series(at, dtype="int64"))


class Hysteresis(EventOrder):
    """One bag: a hand that closes and opens by a row's probability, at most once in a while."""

    columns = ["t_us", "seq", "step", "value"]

    def __init__(self, least_us: int, close: float, open_: float):
        self.rule = least_us, close, open_

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.hand = handle.getValueState("hand", "closed boolean, last_us long")

    def fold(self, key: tuple, due: list[tuple]) -> pd.DataFrame:
        state = self.hand.get()
        done, last = limited([r[0] for r in due], [r[3] for r in due], *self.rule, state)
        self.hand.update((bool(last[0]), int(last[1])))
        rows = [(key[0], r[1], r[2], c, p) for r, (c, p) in zip(due, done, strict=True)]
        return pd.DataFrame(rows, columns=["bag", "seq", "step", "closed", "published"])


def _ordered(rows: DataFrame, fold: EventOrder, out: str, time: str = "") -> DataFrame:
    return rows.groupBy("bag").transformWithStateInPandas(fold, outputStructType=out, outputMode="Append", timeMode="EventTime", eventTimeColumnName=time)


def gated_hand(messages: DataFrame, late: str, topics: list[str], most: int, least_us: int, close: float, open_: float) -> DataFrame:
    """Readiness, mode gate and rate-limited hysteresis of ``messages(bag, seq, t_us, topic, cmd, value)`` as one stream of three states.

    ``value`` is the probability. Rows up to ``late`` out of order are put in
    order, later ones are dropped and counted.
    """
    rows = messages.where("t_us is not null and bag is not null").select(
        "bag", F.coalesce("seq", F.lit(0)).alias("seq"), "t_us", F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce(F.col("cmd").cast("int"), F.lit(0)).alias("cmd"), "value", F.timestamp_micros("t_us").alias("ts")
    )
    ready = _ordered(rows.withWatermark("ts", late), ReadyGate(topics), MESSAGE, "ts")
    running = _ordered(ready, ModeGate(most), f"{MESSAGE}, step long", "ts")
    return _ordered(running, Hysteresis(least_us, close, open_), "bag long, seq long, step long, closed boolean, published boolean")


def episode_changes(markers: DataFrame, late: str) -> DataFrame:
    """Changelog of a stream of ``markers(bag, seq, t_us, cmd)``: op 1 for a commit, -1 when a later marker takes it back.

    Rows may come in any order that is no more than ``late`` behind the newest
    row; what the watermark has not passed yet is still held. ``at_ts`` is the
    marker's own time and the event time of what follows. Runs with
    :func:`run` only, which sets the state store that timers need.
    """
    rows = markers.where(F.col("cmd").isNotNull() & F.col("t_us").isNotNull()).select("bag", F.coalesce("seq", F.lit(0)).alias("seq"), "t_us", F.col("cmd").cast("int").alias("cmd"), F.timestamp_micros("t_us").alias("ts")).withWatermark("ts", late)
    return _ordered(rows, MarkerOrder(), CHANGES, "at_ts")


def grace_rows(messages: DataFrame, changes: DataFrame, late: str, grace_us: int, longest_us: int, min_us: int = 0) -> DataFrame:
    """Messages with every committed episode of their bag that holds them or ended less than ``grace_us`` before, as a stream.

    A join of two streams: an episode leaves the state once the messages'
    watermark has passed its stop and the grace, a message once no episode of
    at most ``longest_us`` can still hold it; longer episodes lose the rows
    before their last ``longest_us``. Episodes shorter than ``min_us`` are left
    out. A message later than ``late`` is dropped. A commit that is taken back
    later gives no row here: :func:`net_grace` removes its rows by the changelog.
    """
    m = messages.withColumn("ts", F.timestamp_micros("t_us")).withWatermark("ts", late)
    c = changes.where((F.col("op") == 1) & (F.col("stop_us") - F.col("start_us") >= min_us)).select(F.col("bag").alias("__bag"), "start_us", "stop_us", "at_ts")
    inside = (F.col("bag") == F.col("__bag")) & (F.col("t_us") >= F.col("start_us")) & (F.col("t_us") < F.col("stop_us") + grace_us)
    alive = F.expr(f"ts < at_ts + interval {grace_us} microseconds and ts >= at_ts - interval {longest_us} microseconds")
    return m.join(c, inside & alive).select(*messages.columns, "start_us", "stop_us")


def net_grace(rows: DataFrame, episodes: DataFrame, grace_us: int) -> DataFrame:
    """``rows`` of :func:`grace_rows` less those of episodes taken back, each message with its first episode only.

    ``episodes(bag, episode_id, start_us, stop_us)`` are the live ones.
    """
    past = Window.partitionBy("bag").orderBy("start_us").rowsBetween(Window.unboundedPreceding, -1)
    live = episodes.withColumn("__from", F.greatest("start_us", F.max(F.col("stop_us") + grace_us).over(past)))
    return rows.join(live, ["bag", "start_us", "stop_us"]).where(F.col("t_us") >= F.col("__from")).drop("__from", "start_us", "stop_us")


@contextmanager
def _timers(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were left out, over the batches that the query still reports."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def run(stream: DataFrame, base: str | None = None) -> tuple[DataFrame, int]:
    """Run a stream over all that is there, one micro-batch a trigger, into the table ``base``/rows; the table and the number of late rows.

    Run again with the same ``base`` it goes on where the checkpoint stands.
    Batches are written by :func:`write_once`.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    with _timers(spark):
        query = stream.writeStream.foreachBatch(write_once(f"{base}/rows")).outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    table = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{base}/rows")
    return table, late_rows(query)


def write_once(path: str):
    """A sink that is idempotent by batch id: a batch replayed after a failure overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")

    return write


def replay(rows: DataFrame, builds: list[Callable[[DataFrame], DataFrame]], files: int, disorder_us: int, key: str = "seq") -> list[tuple[DataFrame, int]]:
    """Run streams over ``rows`` as a live log that grows ``files`` times and in which a row comes up to ``disorder_us`` after its time.

    The delay is a hash of ``key``, so every append holds rows of its own span
    in no order. After each append every stream of ``builds`` goes on from its
    checkpoint. A last append holds the end: a row without values, a year
    later, so that the watermark passes all others and their windows. For each
    stream its table and the number of late rows, of which there are none.
    """
    spark, base = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/log-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min("t_us"), F.max("t_us")).first()
    low, high = (0, 0) if low is None else (low, high)
    comes = F.col("t_us") - low + F.pmod(F.xxhash64(key), F.lit(disorder_us + 1))
    part = F.floor(comes * files / (high - low + disorder_us + 1))
    end = {c: F.lit(None) for c in rows.columns} | {"bag": F.lit(-1), "cmd": F.lit(-1), "t_us": F.lit(high + disorder_us + 366 * 86_400_000_000)}
    late, tables = [0] * len(builds), []
    for k in range(files + 1):
        new = rows.where(part == k) if k < files else spark.range(1).select(*[end[c].cast(kind).alias(c) for c, kind in rows.dtypes])
        new.write.mode("append").parquet(f"{base}/rows")
        done = [run(build(read(spark, f"{base}/rows", rows.schema, files_per_trigger=1 << 30)), f"{base}/stream-{j}") for j, build in enumerate(builds)]
        late, tables = [n + m for n, (_, m) in zip(late, done, strict=True)], [t for t, _ in done]
    return list(zip(tables, late, strict=True))
