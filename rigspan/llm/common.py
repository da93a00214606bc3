"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset and the master is local, a
    folder of this process is made and set; a cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to a table in the shared folder, read it back.

    The files outlive any executor, so a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def drop_table(*frames: DataFrame) -> None:
    """Delete the files behind frames of :func:`materialize`.

    What was computed for them goes too: Spark drops a shuffle's files and a
    broadcast once the driver's JVM has collected what refers to them.
    """
    context = frames[0].sparkSession.sparkContext
    context._jvm.System.gc()
    for df in frames:
        path = context._jvm.org.apache.hadoop.fs.Path(df._table_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch that a task hands to Python at once; both sides hold several copies of it.
BATCH_BYTES = 4 << 20


def give_back() -> None:
    """Return the memory that a task has freed: its worker stays, idle or in the next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow``, with batches bounded in bytes and not only in rows: texts may be long."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(tidy, schema)


#: Ids that a broadcast may hold: 16 MB at most.
BROADCAST_IDS = 2_000_000


def few_or_shuffled(ids: DataFrame) -> DataFrame:
    """A hint to broadcast ``ids`` where they were counted to be few; else the join shuffles."""
    ids = materialize(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def hot_keys(counts: DataFrame, key: str, n: str, share: int = 1000) -> DataFrame | None:
    """Keys with over one ``share``-th of all rows, thus fewer than ``share`` keys; None if there are none.

    ``counts`` has one row per key with its number of rows in column ``n``.
    That bound is what allows :func:`spread_join` to broadcast them.
    """
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    return counts.where(F.col(n) > total / share).select(key) if total and most > total / share else None


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, spread: str) -> DataFrame:
    """Left join to ``right``, which has one row per key, without a hot task.

    The fewer than a thousand hot keys' rows of ``right`` are broadcast; rows
    of ``left`` that met one go on under a key of their own, hashed from
    column ``spread``, so no key gathers many rows in the shuffle. Without hot
    keys it is a plain join.
    """
    if hot is None:
        return left.join(right, key, "left").select(*[left[c] for c in left.columns], *[c for c in right.columns if c != key])
    names = [c for c in right.columns if c != key]
    few = right.join(F.broadcast(hot), key, "left_semi").select(
        F.col(key).alias("__hk"), F.struct(*names).alias("__hot")
    )
    many = right.join(F.broadcast(hot), key, "left_anti").select(
        F.col(key).alias("__ck"), F.lit(0).alias("__part"), F.struct(*names).alias("__cold")
    )
    met = F.col("__hot").isNotNull()
    out = left.join(F.broadcast(few), F.col(key) == F.col("__hk"), "left").withColumn(
        "__to", F.when(met, 1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))).otherwise(0).cast("int")
    )
    out = out.join(many, (F.col(key) == F.col("__ck")) & (F.col("__to") == F.col("__part")), "left")
    return out.select(
        *[left[c] for c in left.columns],
        *[F.coalesce(F.col(f"__hot.{c}"), F.col(f"__cold.{c}")).alias(c) for c in names],
    )
