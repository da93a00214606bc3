"""Episodes to training samples: statistics, splits, chunks, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

GAP_WEIGHTS = (1.0, 2.0, 1.5, 2.5, 0.5, 1.0)


def long_form(steps: DataFrame, column: str, keys: tuple[str, ...] = ("episode_id", "step")) -> DataFrame:
    return steps.select(*keys, F.posexplode(column).alias("dim", "value")).withColumn("dim", F.col("dim").cast("long"))


def wide_statistics(steps: DataFrame, column: str, width: int, floor: float = 0.01) -> DataFrame:
    """dim, mean, sample deviation (at least ``floor``) of an array column, without exploding it."""
    sums = [x for k in range(width) for x in (F.avg(F.get(column, F.lit(k))).alias(f"m{k}"), F.stddev_samp(F.get(column, F.lit(k))).alias(f"s{k}"))]
    each = [
        F.struct(F.lit(k).cast("long").alias("dim"), F.col(f"m{k}").alias("mean"), F.greatest(F.col(f"s{k}"), F.lit(floor)).alias("std"))
        for k in range(width)
    ]
    return steps.agg(*sums).select(F.explode(F.array(*each)).alias("x")).select("x.*")


def partial_statistics(steps: DataFrame, column: str, dims: list[int], width: int, floor: float = 0.01) -> DataFrame:
    """Statistics of some dimensions; the others have mean 0 and deviation 1."""
    have = wide_statistics(steps, column, max(dims) + 1, floor).where(F.col("dim").isin(dims))
    every = steps.sparkSession.range(width).select(F.col("id").alias("dim"))
    return every.join(F.broadcast(have), "dim", "left").select("dim", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(1.0)).alias("std"))


def binary_last(stats: DataFrame) -> DataFrame:
    """The last dimension as a binary channel: mean 0, deviation 1."""
    last = stats.agg(F.max("dim").alias("last"))
    is_last = F.col("dim") == F.col("last")
    return stats.crossJoin(F.broadcast(last)).select(
        "dim", F.when(is_last, 0.0).otherwise(F.col("mean")).alias("mean"), F.when(is_last, 1.0).otherwise(F.col("std")).alias("std")
    )


def episode_statistics(steps: DataFrame, column: str) -> DataFrame:
    """Per episode and dimension: steps, mean, share above 0."""
    return long_form(steps, column).groupBy("episode_id", "dim").agg(
        F.count("*").alias("steps"), F.avg("value").alias("mean"), F.avg((F.col("value") > 0).cast("double")).alias("pos")
    )


def combined(stats: DataFrame, *by: str) -> DataFrame:
    """Length-weighted mean and share per dimension over the episodes of each group."""
    weigh = lambda c: (F.sum(F.col("steps") * F.col(c)) / F.sum("steps")).alias(c)
    return stats.groupBy(*by, "dim").agg(weigh("mean"), weigh("pos"), F.sum("steps").alias("steps"))


def hashed(*parts: Column) -> Column:
    """A 32-bit number that depends on the parts alone; the same in every engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def splits(episodes: DataFrame, trials: int, ratio: float = 0.8, seed: int = 0) -> DataFrame:
    """trial, episode_id, part for ``trials`` random splits with clip(int(ratio * n), 1, n - 1) for training."""
    n = episodes.count()
    if n < 2:
        raise ValueError("a split needs two episodes at least")
    train = min(max(int(ratio * n), 1), n - 1)
    drawn = episodes.select("episode_id", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    placed = positions(drawn, hashed(F.lit(seed), F.col("trial"), F.col("episode_id")), "episode_id", ["trial"])
    part = F.when(F.col("__at") < train, "train").otherwise("val")
    return placed.select(F.col("trial").cast("long").alias("trial"), "episode_id", part.alias("part"))


#: Rows of a range that is numbered by one task.
RANGE_ROWS = 1 << 20


def positions(rows: DataFrame, h: Column, tie: str, by: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with __at, their position from 0 in the order of ``h``, then ``tie``, within each group of ``by``.

    As many ranges as the rows need at ``range_rows`` each, cut where a sample
    of the rows says, so clustered values and large groups are split evenly.
    Rows are numbered within their range and add the count of the group's
    ranges before. The ranges are written, as they must not be drawn anew.
    """
    by = by or []
    cut = rows.withColumn("__h", h)
    ranges = max(1, -(-rows.count() // range_rows))
    cut = written(cut.repartitionByRange(ranges, *by, "__h", tie).withColumn("__r", F.spark_partition_id()))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*by, "__r").agg(F.count("*").alias("__n"))  # one row per range and group that it holds
    starts = counts.withColumn("__s", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    at = F.row_number().over(Window.partitionBy(*by, "__r").orderBy("__h", tie)) - 1
    placed = cut.withColumn("__k", at).join(starts, [*by, "__r"])
    return placed.withColumn("__at", (F.col("__s") + F.col("__k")).cast("long")).select(*rows.columns, "__at")


def split_scores(stats: DataFrame, parts: DataFrame) -> DataFrame:
    """Weighted sum of the six gaps between train, val and global means and shares, per trial; less is better."""
    each = stats.join(parts, "episode_id")
    sides = combined(each, "trial", "part").groupBy("trial", "dim").agg(
        *[F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{p}_{c}") for p in ("train", "val") for c in ("mean", "pos")]
    )
    whole = combined(stats).select("dim", F.col("mean").alias("all_mean"), F.col("pos").alias("all_pos"))
    gap = lambda a, b: F.avg(F.abs(F.col(a) - F.col(b)))
    pairs = [(a, b, c) for a, b in (("train", "val"), ("val", "all"), ("train", "all")) for c in ("mean", "pos")]
    score = sum((w * gap(f"{a}_{c}", f"{b}_{c}") for w, (a, b, c) in zip(GAP_WEIGHTS, pairs, strict=True)), F.lit(0.0))
    return sides.join(F.broadcast(whole), "dim").groupBy("trial").agg(score.alias("score"))


def best_split(scores: DataFrame) -> DataFrame:
    """The first trial of the least score (scores equal to nine decimals tie)."""
    return scores.agg(F.min_by("trial", F.struct(F.round("score", 9), "trial")).alias("trial"), F.min("score").alias("score"))


def chunks(steps: DataFrame, column: str, size: int, width: int) -> DataFrame:
    """Per start step the next ``size`` vectors, zero-padded, and the padding mask."""
    w = Window.partitionBy("episode_id").orderBy("step").rowsBetween(0, size - 1)
    zero = F.array(*[F.lit(0.0)] * width)
    return steps.withColumn("__c", F.collect_list(column).over(w)).select(
        "episode_id",
        F.col("step").alias("start_ts"),
        F.concat("__c", F.array_repeat(zero, F.lit(size) - F.size("__c"))).alias("actions"),
        F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: k >= F.size("__c")).alias("is_pad"),
    )


def trimmed(steps: DataFrame, tail: int = 120) -> DataFrame:
    """Steps before the last ``tail`` of their episode; episodes not longer than that go."""
    n = F.count("*").over(Window.partitionBy("episode_id"))
    at = F.row_number().over(Window.partitionBy("episode_id").orderBy("step"))
    return steps.withColumn("__n", n).withColumn("__k", at).where(F.col("__k") <= F.col("__n") - tail).drop("__n", "__k")


def random_starts(lengths: DataFrame, seed: int, epochs: int, whole: bool = False) -> DataFrame:
    """One start per episode and epoch, uniform below the episode's length; 0 with ``whole``."""
    drawn = lengths.select("episode_id", "n", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    start = F.lit(0).cast("long") if whole else hashed(F.lit(seed), F.col("epoch"), F.col("episode_id")) % F.col("n")
    return drawn.select(F.col("epoch").cast("long").alias("epoch"), "episode_id", start.alias("start_ts"))


def normalised(long: DataFrame, stats: DataFrame, floor: float | None = None, back: bool = False) -> DataFrame:
    """z-scores of ``long(..., dim, value)`` by ``stats``, or with ``back`` the values again."""
    std = F.col("std") if floor is None else F.greatest(F.col("std"), F.lit(floor))
    value = F.col("value") * std + F.col("mean") if back else (F.col("value") - F.col("mean")) / std
    return long.join(F.broadcast(stats.select("dim", "mean", "std")), "dim").select(*long.columns[:-1], value.alias("value"))


def shuffled_batches(rows: DataFrame, id_col: str, size: int, seed: int, epoch: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows in a seeded order with batch = position div size, the last batch short.

    The order is by hash, see :func:`positions`.
    """
    placed = positions(rows, hashed(F.lit(seed), F.lit(epoch), F.col(id_col)), id_col, range_rows=range_rows)
    return placed.select(*rows.columns, F.col("__at").alias("position"), F.floor(F.col("__at") / size).alias("batch"))


def sorted_index(ids: DataFrame, id_col: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Distinct ids with at, their place from 0 in rising order."""
    return positions(ids.select(id_col).distinct(), F.col(id_col), id_col, range_rows=range_rows).withColumnRenamed("__at", "at")


def padded(rows: DataFrame, batch: str, column: str) -> DataFrame:
    """Arrays zero-padded to the longest of their batch, and the padding mask."""
    longest = rows.groupBy(batch).agg(F.max(F.size(column)).alias("__m"))
    missing = F.col("__m") - F.size(column)
    return rows.join(longest, batch).select(
        *rows.columns,
        F.concat(column, F.array_repeat(F.lit(0).cast("long"), missing)).alias("padded"),
        F.concat(F.array_repeat(F.lit(False), F.size(column)), F.array_repeat(F.lit(True), missing)).alias("mask"),
    )
