"""Fixed-rate grids, interval joins and as-of joins, without a nested-loop join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grid(episodes: DataFrame, step_us: int = 33_333) -> DataFrame:
    """Ticks from start (included) to stop (included) by ``step_us``: bag, episode_id, i, g_us."""
    n = F.floor((F.col("stop_us") - F.col("start_us")) / step_us)
    return episodes.select("bag", "episode_id", "start_us", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("i")).select(
        "bag", "episode_id", "i", (F.col("start_us") + F.col("i") * step_us).alias("g_us")
    )


def two_part_grid(episodes: DataFrame, step_us: int, tail_us: int = 4_000_000) -> DataFrame:
    """Ticks of [start, pause + step) and of [stop, stop + tail), numbered through."""
    def part(first, length, k):
        n = F.ceil(length / step_us)
        return episodes.where(n > 0).select(
            "bag", "episode_id", F.lit(k).alias("part"), first.alias("from"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k")
        )

    both = part(F.col("start_us"), F.col("pause_us") + step_us - F.col("start_us"), 0).unionByName(
        part(F.col("stop_us"), F.lit(tail_us), 1)
    )
    order = Window.partitionBy("bag", "episode_id").orderBy("part", "k")
    return both.select(
        "bag", "episode_id", (F.row_number().over(order) - 1).cast("long").alias("i"), (F.col("from") + F.col("k") * step_us).alias("g_us")
    )


def interval_join(messages: DataFrame, episodes: DataFrame, grace_us: int = 0, cell_us: int = 3_600_000_000) -> DataFrame:
    """Messages inside an episode of their bag, ends included.

    Both sides carry the time cell they touch, so the join is on (bag, cell)
    and only its residual compares times. With a grace the tail end is open
    (``t < stop + grace``) and a message goes to its first episode only; an
    episode's number follows its start. Repeated messages stay. ``messages`` may
    be a stream.
    """
    stop = F.col("stop_us") + grace_us
    if grace_us:
        # what an earlier episode's grace covers is that one's: the later one begins behind it
        past = Window.partitionBy("bag").orderBy("episode_id").rowsBetween(Window.unboundedPreceding, -1)
        episodes = episodes.withColumn("start_us", F.greatest("start_us", F.max(stop).over(past))).where(F.col("start_us") < stop)
    cells = episodes.select(
        F.col("bag").alias("ebag"), "episode_id", "start_us", stop.alias("until_us"),
        F.explode(F.sequence(F.floor(F.col("start_us") / cell_us), F.floor(stop / cell_us))).alias("ecell"),
    )
    inside = (F.col("t_us") >= F.col("start_us")) & (
        F.col("t_us") < F.col("until_us") if grace_us else F.col("t_us") <= F.col("until_us")
    )
    met = messages.withColumn("cell", F.floor(F.col("t_us") / cell_us)).join(
        cells, (F.col("bag") == F.col("ebag")) & (F.col("cell") == F.col("ecell")) & inside
    )
    return met.select(*messages.columns, "episode_id")


def as_of(ticks: DataFrame, messages: DataFrame, topics: dict[str, str], keys: list[str]) -> DataFrame:
    """For every tick a value of each topic: one union, one shuffle by ``keys``.

    ``topics`` maps a topic to ``next`` (first message at or after the tick,
    after the last one: the last) or ``last`` (last message at or before it,
    else 0.0). ``ticks(keys, i, g_us)``, ``messages(keys, topic, t_us, seq, value)``.
    """
    grid_rows = ticks.select(*keys, F.col("g_us").alias("t"), F.lit(0).cast("long").alias("seq"), "i", F.lit(None).cast("string").alias("topic"), F.lit(None).cast("double").alias("value"))
    data_rows = messages.where(F.col("topic").isin(list(topics))).select(
        *keys, F.col("t_us").alias("t"), "seq", F.lit(None).cast("long").alias("i"), "topic", "value"
    )
    both = grid_rows.unionByName(data_rows)
    tick = F.col("i").isNotNull().cast("int")
    # from the end backwards, so that every frame grows and no row is read twice
    ahead = Window.partitionBy(*keys).orderBy(F.desc("t"), tick, F.desc("seq"))
    behind = Window.partitionBy(*keys).orderBy("t", tick, "seq")
    whole = behind.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    columns = {}
    for topic, way in topics.items():
        value = F.when(F.col("topic") == topic, F.col("value"))
        if way == "next":
            near = F.last(value, ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, 0))
            columns[topic] = F.coalesce(near, F.last(value, ignorenulls=True).over(whole))
        else:
            columns[topic] = F.coalesce(F.last(value, ignorenulls=True).over(behind.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return both.withColumns(columns).where("i is not null").select(*keys, "i", F.col("t").alias("g_us"), *topics)


def as_of_sliced(
    ticks: DataFrame, messages: DataFrame, topics: dict[str, str], keys: list[str], slice_us: int = 3_600_000_000, fail_empty: bool = False
) -> DataFrame:
    """:func:`as_of` with every (keys, time slice) on its own task, for episodes too long for one.

    A small table has each slice's first and last value of every topic; from it
    a slice learns the last value before it, the first one behind it, and the
    episode's last. With ``fail_empty`` an episode without any message of a
    ``next`` topic raises; a ``last`` topic may be empty.
    """
    cell = lambda c: F.floor(F.col(c) / slice_us).alias("__slice")
    by = [*keys, "__slice"]
    data = messages.where(F.col("topic").isin(list(topics))).select(*keys, cell("t_us"), F.col("t_us").alias("t"), "seq", "topic", "value")
    at = F.struct("t", "seq")
    ends = []
    for k, topic in enumerate(topics):
        own = F.when(F.col("topic") == topic, at)
        ends += [F.max_by(F.struct("value"), own).alias(f"__last{k}"), F.min_by(F.struct("value"), own).alias(f"__first{k}")]
    # slices that hold ticks but no messages need an entry as well
    places = data.select(*by, "t", "seq", "topic", "value").unionByName(ticks.select(*keys, cell("g_us")).distinct(), allowMissingColumns=True)
    slices = places.groupBy(*by).agg(*ends)
    order = Window.partitionBy(*keys).orderBy("__slice")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = []
    for k, (topic, way) in enumerate(topics.items()):
        end = F.last(f"__last{k}", ignorenulls=True).over(whole)
        if way == "next":
            near = F.coalesce(F.last(f"__first{k}", ignorenulls=True).over(ahead), end)
            if fail_empty:
                where = F.concat_ws(", ", *[F.concat(F.lit(f"{c} "), F.col(c).cast("string")) for c in keys])
                near = F.coalesce(near, F.raise_error(F.concat(F.lit(f"no message of topic {topic} in "), where)))
        else:
            near = F.last(f"__last{k}", ignorenulls=True).over(past)
        carried.append(near.getField("value").alias(f"__in{k}"))
    entry = slices.select(*by, *carried)
    grid_rows = ticks.select(*keys, cell("g_us"), F.col("g_us").alias("t"), F.lit(0).cast("long").alias("seq"), "i")
    both = grid_rows.unionByName(data, allowMissingColumns=True)
    tick = F.col("i").isNotNull().cast("int")
    behind = Window.partitionBy(*by).orderBy("t", tick, "seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(F.desc("t"), tick, F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    columns = {f"__v{k}": F.last(F.when(F.col("topic") == topic, F.col("value")), ignorenulls=True).over(before if way == "next" else behind) for k, (topic, way) in enumerate(topics.items())}
    met = both.withColumns(columns).where("i is not null").join(entry, by)
    values = [F.coalesce(f"__v{k}", f"__in{k}", *([F.lit(0.0)] if way == "last" else [])).alias(topic) for k, (topic, way) in enumerate(topics.items())]
    return met.select(*keys, "i", F.col("t").alias("g_us"), *values)


def empty_streams(episodes: DataFrame, messages: DataFrame, mandatory: list[str], keys: list[str]) -> DataFrame:
    """Episodes with a mandatory topic of which they have no message: keys, topic."""
    seen = messages.where(F.col("topic").isin(mandatory)).groupBy(*keys).agg(F.collect_set("topic").alias("__have"))
    want = F.array(*[F.lit(m) for m in mandatory])
    lacking = F.array_except(want, F.coalesce("__have", F.array().cast("array<string>")))
    return episodes.select(*keys).join(seen, keys, "left").select(*keys, F.explode(lacking).alias("topic"))


def shift_ahead(rows: DataFrame, k: int, value: str, keys: list[str], order: str, out: str) -> DataFrame:
    """The value k rows on; behind the end the group's last one."""
    w = Window.partitionBy(*keys).orderBy(order)
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn(out, F.coalesce(F.lead(value, k).over(w), last))


def previous(rows: DataFrame, value: str, keys: list[str], order: str, out: str) -> DataFrame:
    """The value of the row before; the first row's own."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn(out, F.coalesce(F.lag(value, 1).over(w), F.col(value)))
