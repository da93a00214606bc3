"""Sharding: a two-pass external shuffle.

Pass 1 counts rows and bytes per shard, which sets how many memory-sized
buckets a shard needs. Pass 2 scatters the records into the buckets by seeded
hashes, Fisher-Yates shuffles each bucket in memory, numbers its rows from the
bucket's prefix count and writes it. Rows that repeat so often that they alone
would fill a bucket are counted first and scattered one by one. The law is ``key``: the id and the shard count alone
decide the shard (jump hash), so growing by one shard moves rows only into it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few_or_shuffled


def jump_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit hashes: shards 0 to ``shards`` - 1."""
    key = hashes.astype(np.uint64)
    at = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    while len(going):
        at[going] = ahead[going]
        with np.errstate(over="ignore"):
            key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (key[going] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[going] = ((at[going] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        going = going[ahead[going] < shards]
    return at.astype(np.int32)


def _jump_udf(shards: int):
    @F.pandas_udf("int")
    def jump(h: pd.Series) -> pd.Series:
        return pd.Series(jump_shard(h.to_numpy(np.int64), shards))

    return jump


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A permutation of n positions: each index swaps with one drawn from those not yet placed."""
    order = np.arange(n)
    # draws[i] is uniform over i..n-1, one vector of draws for the whole pass
    draws = np.random.default_rng(seed).integers(np.arange(n), n) if n else order
    for i, j in enumerate(draws.tolist()):
        order[i], order[j] = order[j], order[i]
    return order


def external_shuffle(
    docs: DataFrame,
    shards: int = 40,
    seed: int = 17,
    bucket_bytes: int = 32 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Shuffle ``docs`` into shards; returns id, text, size, shard, slot, grown_shard.

    size: UTF-8 bytes plus 16. slot: gapless from 0 within the shard, in random
    order. grown_shard: the shard under ``shards`` + 1. Other columns of
    ``docs`` are left out, so their names cannot clash. Null text: size 16 and
    stays null. A null id is a key like any other. Repeated rows: each keeps
    its own slot, and many alike are spread over their shard's buckets. Empty
    table: no rows. A bucket holds ``bucket_bytes`` on average, or one longer
    record.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long"))
    key = F.xxhash64(F.lit(seed), "id")
    placed = rows.withColumns({"shard": _jump_udf(shards)(key), "grown_shard": _jump_udf(shards + 1)(key)})

    sums = placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()  # at most `shards` rows
    buckets = {r.shard: max(1, -(-r.b // bucket_bytes)) for r in sums}
    per_shard = F.lit(1)
    for shard, n in buckets.items():
        if n > 1:
            per_shard = F.when(F.col("shard") == shard, n).otherwise(per_shard)
    nth = F.lit(0).cast("long")
    bucket = F.pmod(F.xxhash64(F.lit(seed + 2), "mix", "nth"), per_shard.cast("long")).cast("int")
    placed = placed.withColumn("mix", F.xxhash64(F.lit(seed + 1), "id", "text")).withColumn("nth", nth).withColumn("bucket", bucket)
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    large = counts.where(F.col("b") > 4 * bucket_bytes).select("shard", "bucket")
    again = placed.join(few_or_shuffled(large), ["shard", "bucket"], "left_semi").groupBy("mix").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    hot = few_or_shuffled(again.where(F.col("b") > bucket_bytes).where("n > 1").select("mix"))
    if not hot.isEmpty():
        columns = ["id", "text", "size", "shard", "grown_shard", "mix"]
        alike = placed.join(hot, "mix", "left_semi").groupBy(columns).agg(F.count("*").alias("n"))
        blocks = alike.select(*columns, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 1000"))).alias("k"))
        each = blocks.repartition("mix", "k").select(*columns, F.explode(F.sequence(F.col("k") * 1000, F.least(F.col("n"), F.col("k") * 1000 + 1000) - 1)).alias("nth"))
        placed = placed.join(hot, "mix", "left_anti").select(*columns, "nth").unionByName(each).withColumn("bucket", bucket)
        counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))

    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))

    def shuffle_bucket(table: pa.Table) -> pa.Table:
        # a fixed order first, so that a recomputed bucket is shuffled alike
        table = table.sort_by([("mix", "ascending"), ("size", "ascending")])
        first = [table.column(c)[0].as_py() for c in ("shard", "bucket", "start")] if len(table) else [0, 0, 0]
        table = table.take(pa.array(fisher_yates(len(table), [seed, *first[:2]])))
        slots = pa.array(first[2] + np.arange(len(table), dtype=np.int64))
        return table.select(["id", "text", "size", "shard"]).append_column("slot", slots).append_column("grown_shard", table.column("grown_shard"))

    # the counts join on the buckets' own key, so the records are shuffled once for both
    started = placed.join(starts, ["shard", "bucket"])
    schema = placed.withColumn("slot", F.lit(0).cast("long")).select("id", "text", "size", "shard", "slot", "grown_shard").schema
    mixed = started.groupBy("shard", "bucket").applyInArrow(shuffle_bucket, schema)
    return mixed.withColumnsRenamed({"id": id_col, "text": text_col})


def write_shards(shuffled: DataFrame, path: str) -> DataFrame:
    """Write one folder per shard, bucket by bucket as the tasks hold them, and read the table back.

    A task writes its buckets' rows in the order of their slots, so a shard's
    files are ranges of slots, a bucket is never torn, and no shard meets in
    one task.
    """
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return shuffled.sparkSession.read.schema(shuffled.schema).parquet(path)
