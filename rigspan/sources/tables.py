"""Message logs, episode tables and run logs: scans, checks and sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: task, episodes, episode length, cameras, degrees of freedom
TASKS = [
    ("toy_circle_chase", 10, 240, ["main"], 2),
    ("sim_transfer_cube_scripted", 5, 400, ["top"], 14),
    ("sim_panda_catch_ball", 200, 500, ["wrist"], 7),
    ("real_tocabi_pick_n_place", 200, 1000, ["stereo"], 9),
    ("real_panda_pick_n_place", 100, 650, ["left", "hand", "right"], 8),
    ("real_panda_peg_in_hole", 48, 600, ["top"], 7),
    ("real_tocabi_task_open", 50, 600, ["left"], 13),
    ("real_tocabi_open_head", 50, 600, ["left"], 5),
    ("real_tocabi_open", 50, 600, ["left", "right"], 14),
    ("real_tocabi_pick_cup", 50, 600, ["left", "right"], 14),
    ("real_tocabi_insert", 50, 450, ["left", "right"], 14),
    ("real_tocabi_pick", 32, 450, ["left"], 13),
    ("real_tocabi_pickup", 65, 600, ["left"], 14),
    ("real_tocabi_place", 12, 900, ["left", "right"], 14),
    ("real_tocabi_approach_tabletop", 22, 450, ["head"], 11),
    ("sim_tocabi_approach_mustard", 20, 223, ["top"], 8),
    ("sim_tocabi_approach_tabletop", 45, 250, ["top"], 8),
    ("sim_transfer_cube_human", 50, 400, ["top"], 14),
    ("sim_insertion_scripted", 50, 400, ["top"], 14),
    ("sim_insertion_human", 50, 500, ["top"], 14),
]


def shared_dir(spark: SparkSession) -> str:
    """The session's folder that driver and executors share; its own only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: what depends on how its rows were dealt stays as it is, whatever executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_messages(messages: DataFrame, topics: list[str], from_us: int | None = None, to_us: int | None = None) -> DataFrame:
    """Rows of some topics within a time range; both filters reach the scan."""
    out = messages.where(F.col("topic").isin(topics))
    if from_us is not None:
        out = out.where(F.col("t_us") >= from_us)
    return out if to_us is None else out.where(F.col("t_us") <= to_us)


def topic_inventory(messages: DataFrame) -> DataFrame:
    return messages.groupBy("topic").agg(F.count("*").alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


def missing_topics(messages: DataFrame, required: list[str], fail: bool = False) -> DataFrame:
    """Per bag the required topics it lacks; with ``fail`` a row raises instead."""
    present = messages.groupBy("bag").agg(F.collect_set(F.when(F.col("topic").isin(required), F.col("topic"))).alias("have"))
    lacking = present.select("bag", F.explode(F.array_except(F.array(*[F.lit(r) for r in required]), "have")).alias("missing"))
    return lacking.select(F.raise_error(F.concat(F.lit("missing topic "), "missing"))) if fail else lacking


def output_name(path: Column) -> Column:
    """Last part of a path without its extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def structure(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows and width range of array fields, in one pass."""
    sums = [x for f in fields for x in (F.count(f).alias(f"n_{f}"), F.min(F.size(f)).alias(f"lo_{f}"), F.max(F.size(f)).alias(f"hi_{f}"))]
    each = [F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("n"), F.col(f"lo_{f}").cast("long").alias("least"), F.col(f"hi_{f}").cast("long").alias("most")) for f in fields]
    return rows.agg(*sums).select(F.explode(F.array(*each)).alias("x")).select("x.*")


def time_offsets(episodes: DataFrame) -> DataFrame:
    """Episode times as text: seconds after the bag's first start, six decimals."""
    t0 = F.min("start_us").over(Window.partitionBy("bag"))
    text = lambda c: F.format_string("%.6f", (F.col(c) - F.col("t0")) / 1e6)
    return episodes.withColumn("t0", t0).select("bag", "episode_id", text("start_us").alias("start_s"), text("stop_us").alias("stop_s"))


def time_lines(episodes: DataFrame) -> DataFrame:
    """Lines (bag, n, text) of ``episodes(bag, episode_id, start_us, pause_us, stop_us)``: t0, then offsets "start, pause, end"."""
    t0 = episodes.groupBy("bag").agg(F.min("start_us").alias("t0"))
    head = t0.select("bag", F.lit(0).cast("long").alias("n"), F.format_string("%.6f", F.col("t0") / 1e6).alias("text"))
    text = lambda c: F.format_string("%.6f", (F.col(c) - F.col("t0")) / 1e6)
    body = episodes.join(t0, "bag").select("bag", (F.col("episode_id") + 1).alias("n"), F.concat_ws(", ", *map(text, ("start_us", "pause_us", "stop_us"))).alias("text"))
    return head.unionByName(body)


def read_offsets(lines: DataFrame) -> DataFrame:
    """Episode times of ``lines(bag, n, text)``: line 0 is t0, the others are offsets "start, pause, end"."""
    t0 = lines.where("n = 0").select("bag", F.col("text").cast("double").alias("t0"))
    parts = F.split("text", r",\s*")
    rows = lines.where("n > 0").join(t0, "bag")
    return rows.select("bag", (F.col("n") - 1).alias("episode_id"), *[(parts[k].cast("double") + F.col("t0")).alias(c) for k, c in enumerate(("start", "pause", "stop"))])


def required_fields(stats: DataFrame, required: list[str]) -> DataFrame:
    """field, width and present of every required field of a statistics table; a missing one has width 0."""
    have = stats.groupBy("field").agg(F.count("*").alias("n"))
    want = stats.sparkSession.createDataFrame([(r,) for r in required], "field string")
    return F.broadcast(want).join(have, "field", "left").select(
        "field", F.coalesce("n", F.lit(0)).cast("long").alias("width"), F.col("n").isNotNull().alias("present")
    )


def parse_log(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON lines of a run log as columns; broken lines give nulls."""
    return lines.withColumn("__j", F.from_json(column, schema)).select(*[c for c in lines.columns if c != column], "__j.*")


def read_run_logs(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Logs of many runs in JSON lines, one folder per run that names it (``name`` or ``run=name``)."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return spark.read.schema(schema).json(paths).withColumn("run", F.regexp_replace(folder, "^run=", ""))


def tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TASKS, "task string, num_episodes int, episode_len int, camera_names array<string>, model_dof int")


def with_task(rows: DataFrame, factor: float = 1.0) -> DataFrame:
    """Rows with their task's settings and time limit."""
    known = tasks(rows.sparkSession).withColumn("max_timesteps", F.floor(F.col("episode_len") * factor).cast("long"))
    return rows.join(F.broadcast(known), "task")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on seed and parts alone, not on partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / 4294967296


def scenarios(ids: DataFrame, key: str, ranges: dict[str, tuple[float, float]], seed: int) -> DataFrame:
    """Object positions drawn uniformly from ``ranges``, with the upright quaternion."""
    drawn = {c: lo + (hi - lo) * uniform(seed, F.col(key), F.lit(c)) for c, (lo, hi) in ranges.items()}
    return ids.select(key, *[v.alias(c) for c, v in drawn.items()], F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)]).alias("quat"))
