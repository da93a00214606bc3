"""Stored episodes: steps, their attributes, statistics and evaluation results as tables that are scanned in part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def episode_attributes(episodes: DataFrame, joints: DataFrame, fps: int = 30, sim: bool = False) -> DataFrame:
    """bag, episode_id, sim, fps, start_us, stop_us, joint_names of ``episodes``; the names are those of the bag's first ``joints(bag, seq, names)``.

    A bag without joints has null names.
    """
    names = joints.groupBy("bag").agg(F.min_by("names", "seq").alias("joint_names"))
    return episodes.join(names, "bag", "left").select("bag", "episode_id", F.lit(sim).alias("sim"), F.lit(fps).alias("fps"), "start_us", "stop_us", "joint_names")


def write_store(steps: DataFrame, attributes: DataFrame, path: str, order: str = "step") -> None:
    """Tables ``steps`` and ``episode_meta`` under ``path``: a folder per bag, rows by episode and ``order``.

    Rows are dealt by ranges, so a large bag is spread over tasks and a file
    holds few episodes: a scan of one skips the others' row groups. The
    attributes get the number of steps; an episode without steps has 0.
    """
    counts = steps.groupBy("bag", "episode_id").agg(F.count("*").alias("steps"))
    meta = attributes.join(counts, ["bag", "episode_id"], "left").withColumn("steps", F.coalesce("steps", F.lit(0)).cast("long"))
    by = ["bag", "episode_id", order]
    steps.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy("bag").parquet(f"{path}/steps")
    meta.sortWithinPartitions("bag", "episode_id").write.parquet(f"{path}/episode_meta")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored episode, with its attributes."""
    return spark.read.parquet(f"{path}/episode_meta")


def read_steps(spark: SparkSession, path: str, bag: int | None = None, episode: int | None = None, first: int = 0, n: int | None = None, fields: list[str] | None = None, order: str = "step") -> DataFrame:
    """Stored steps: of one bag (only its folder is listed), one episode, ``n`` steps from ``first``, some fields; each limits the scan."""
    out = spark.read.parquet(f"{path}/steps").withColumn("bag", F.col("bag").cast("long"))
    if bag is not None:
        out = out.where(F.col("bag") == bag)
    if episode is not None:
        out = out.where(F.col("episode_id") == episode)
    if first:
        out = out.where(F.col(order) >= first)
    if n is not None:
        out = out.where(F.col(order) < first + n)
    return out if fields is None else out.select("bag", "episode_id", order, *fields)


def write_statistics(stats: dict[str, DataFrame], path: str) -> None:
    """Statistics (dim, mean, std) of several fields as one table."""
    out = None
    for field, rows in stats.items():
        part = rows.select(F.lit(field).alias("field"), "dim", "mean", "std")
        out = part if out is None else out.unionByName(part)
    out.coalesce(1).write.partitionBy("field").parquet(path)  # one row per field and dimension


def read_statistics(spark: SparkSession, path: str, widths: dict[str, int]) -> DataFrame:
    """Stored statistics; raises where a field of ``widths`` is missing or has another number of dimensions."""
    stats = spark.read.schema("dim long, mean double, std double, field string").parquet(path).select("field", "dim", "mean", "std")
    have = {r.field: r.n for r in stats.groupBy("field").agg(F.count("*").alias("n")).collect()}  # one row per field
    wrong = [f"{f}: {have.get(f, 0)} of {n} dimensions" for f, n in widths.items() if have.get(f, 0) != n]
    if wrong:
        raise ValueError(f"statistics at {path} do not fit: {'; '.join(wrong)}")
    return stats


def append_result(returned: DataFrame, name: str, path: str, full: int = 4) -> None:
    """Append an evaluation to the result table: rollouts, success rate, mean return, and how many reached each reward.

    ``returned(total, highest, success)`` has a row per rollout; none at all give a row of zeros with null rates.
    """
    reached = [F.count_if(F.col("highest") >= r) for r in range(full + 1)]
    row = returned.agg(F.count("*").alias("rollouts"), F.avg(F.col("success").cast("int")).alias("success_rate"), F.avg("total").alias("mean_return"), F.array(*reached).alias("reached"))
    rates = F.transform("reached", lambda x: F.try_divide(x, F.col("rollouts")))
    row.select(F.lit(name).alias("name"), "*", rates.alias("rates")).write.mode("append").parquet(path)
