"""The engine's incremental forms: Structured Streaming with keyed state.

The stateful operators here take rows in event order within their key, up to the
disorder of one micro-batch, and give the same net result as their batch form;
:mod:`live` holds those for logs whose rows come late.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.predict import limited
from ..operators.segment import START, STOP
from ..sources.tables import shared_dir


def read(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream, one micro-batch per ``files_per_trigger``; ``path`` may be one file or a folder."""
    # a file is read as the only one of its folder by that name, a folder whole
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and _is_file(spark, path) else reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()


def run_available(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there, to a table in the shared folder, and read that."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # keyed state is small here; its partitions are fixed for a stream's life
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start(f"{base}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def _collected(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(by, kind="stable")


def net_episodes(changes: DataFrame) -> DataFrame:
    """Episodes that no later change took back."""
    return changes.groupBy("bag", "start_us", "stop_us").agg(F.sum("op").alias("n")).where("n > 0").drop("n")


def latest_per_slot(messages: DataFrame, slot: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """The latest value of each bag and topic per time slot; ``ts`` is the event time."""
    rows = messages.withWatermark("ts", late) if messages.isStreaming else messages
    return rows.groupBy(F.window("ts", slot), "bag", "topic").agg(F.max_by("value", "seq").alias("value")).select(
        F.unix_micros("window.start").alias("slot_us"), "bag", "topic", "value"
    )


def limited_hysteresis(rows: DataFrame, least_us: int = 500_000, close: float = 0.7, open_: float = 0.3) -> DataFrame:
    """Rate-limited hysteresis of ``rows(robot, seq, t_us, x)``; state per robot: closed and the last publish time."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _collected(batches, ["t_us", "seq"])
        done, last = limited(pdf["t_us"].tolist(), pdf["p"].tolist(), least_us, close, open_, tuple(state.get) if state.exists else None)
        state.update((bool(last[0]), int(last[1])))
        yield pd.DataFrame({"robot": pdf["robot"], "seq": pdf["seq"], "closed": [c for c, _ in done], "published": [p for _, p in done]})

    probs = rows.select("robot", "seq", "t_us", (1 / (1 + F.exp(-F.col("x")))).alias("p"))
    return probs.groupBy("robot").applyInPandasWithState(
        fold, "robot long, seq long, closed boolean, published boolean", "closed boolean, last long", "append", GroupStateTimeout.NoTimeout
    )


def frame_rate(rows: DataFrame, frames: int = 30) -> DataFrame:
    """1 / mean(sec) of every complete run of ``frames`` rows; state per robot: the run so far."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, held = state.get if state.exists else (0, [])
        held = list(held) + _collected(batches, ["seq"])["sec"].tolist()
        out = []
        while len(held) >= frames:
            mean = sum(held[:frames]) / frames
            out.append((key[0], block, 1 / mean if mean else None))
            block, held = block + 1, held[frames:]
        state.update((block, held))
        yield pd.DataFrame(out, columns=["robot", "block", "hz"])

    return rows.groupBy("robot").applyInPandasWithState(
        fold, "robot long, block long, hz double", "block long, held array<double>", "append", GroupStateTimeout.NoTimeout
    )


def ready_rows(messages: DataFrame, topics: list[str]) -> DataFrame:
    """Rows of a bag from the time on at which every topic has been seen."""
    first = [F.min(F.when(F.col("topic") == k, F.col("t_us"))).alias(f"f{j}") for j, k in enumerate(topics)]
    gates = messages.groupBy("bag").agg(*first)
    missing = F.greatest(*[F.col(f"f{j}").isNull().cast("int") for j in range(len(topics))]) if len(topics) > 1 else F.col("f0").isNull().cast("int")
    ready = F.greatest(*[F.col(f"f{j}") for j in range(len(topics))]) if len(topics) > 1 else F.col("f0")
    gates = gates.where(missing == 0).select("bag", ready.alias("ready_us"))
    return messages.join(gates, "bag").where("t_us >= ready_us").drop("ready_us")


def gated_steps(messages: DataFrame, most: int) -> DataFrame:
    """Data rows while the last mode command is start (1) and not stop (2), with a step counter that wraps at ``most``."""
    from pyspark.sql import Window

    order = Window.partitionBy("bag").orderBy("t_us", "seq")
    running = F.last(F.when(F.col("cmd").isin(START, STOP), F.col("cmd")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    on = messages.withColumn("mode", running).where("mode = 1 and topic <> 'control'")
    return on.withColumn("step", ((F.row_number().over(order) - 1) % most).cast("long")).drop("mode")


def gated_stream(messages: DataFrame, most: int) -> DataFrame:
    """:func:`gated_steps` as a stream: state per bag is the last mode command and the steps so far."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _collected(batches, ["t_us", "seq"])
        mode, steps = state.get if state.exists else (0, 0)
        command = rows["cmd"].where(rows["cmd"].isin([START, STOP])).ffill().fillna(mode)
        on = rows[(command == START) & (rows["topic"] != "control")]
        state.update((int(command.iloc[-1]), steps + len(on)))
        yield pd.DataFrame({"bag": on["bag"], "seq": on["seq"], "step": [(steps + k) % most for k in range(len(on))]})

    return messages.select("bag", "seq", "t_us", "topic", F.col("cmd").cast("double").alias("cmd")).groupBy("bag").applyInPandasWithState(
        fold, "bag long, seq long, step long", "mode int, steps long", "append", GroupStateTimeout.NoTimeout
    )


def carried_forward(messages: DataFrame, slot_us: int) -> DataFrame:
    """At the end of every slot the latest value of each topic of a bag so far, as a stream.

    A slot is emitted once a message of a later one arrives; slots without
    messages repeat the values before. State per bag: the open slot and the
    latest values. A message that comes in a later micro-batch than its slot's
    end counts from the open slot on.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _collected(batches, ["t_us", "seq"])
        open_, topics, values = state.get if state.exists else (None, [], [])
        latest, out = dict(zip(topics, values, strict=True)), []
        for r in rows.itertuples():
            now = int(r.t_us) // slot_us
            open_ = now if open_ is None else open_
            for s in range(open_, now):
                out += [(key[0], s * slot_us, topic, value) for topic, value in latest.items()]
            open_ = max(open_, now)
            latest[r.topic] = float(r.value)
        state.update((open_, list(latest), list(latest.values())))
        yield pd.DataFrame(out, columns=["bag", "slot_us", "topic", "value"])

    return messages.select("bag", "seq", "t_us", "topic", "value").groupBy("bag").applyInPandasWithState(
        fold, "bag long, slot_us long, topic string, value double", "slot long, topics array<string>, vals array<double>", "append", GroupStateTimeout.NoTimeout
    )


def latency_summary(rows: DataFrame, late: str = "1 hour", span: str = "1 day") -> DataFrame:
    """Count, mean and largest latency of every robot and time span; ``ts`` is the event time, spans close with the watermark."""
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", span), "robot").agg(F.count("*").alias("n"), F.avg("sec").alias("mean"), F.max("sec").alias("most")).select(
        "robot", F.unix_micros("window.start").alias("from_us"), "n", "mean", "most"
    )
